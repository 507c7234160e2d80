"""Training-order materialisation: fixed-stride token shards in an order given by a keyed permutation.

Every sequence gets a dense index, and a Feistel network over the next power of four, walked until it lands below the
number of sequences, gives its global slot. Slots are range partitioned: part k holds slots k * rows to (k + 1) * rows in
order, a file of its own whose records all have the same number of decoded bytes, so that reading from any slot on opens
only that slot's part and those after it.

Parts are Parquet files rather than flat bytes: record r of part k is its row r, slot k * rows + r, and readers skip row
groups by the statistics of their slots. The dense index of a sequence is its place in the input as Spark splits it, so the
same documents in other files get other slots.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, new_dir, written
from tidemark.llm.packing import BATCH_BYTES
from tidemark.llm.tokens import VOCABULARY, encoder

STRIDE = 1024
#: Sequences in a part, and parts in a folder.
SHARD_ROWS, FOLDER = 8192, 1000
PAD_ID = 0
ROUNDS = 6

SEQUENCES = "part int, own long, doc_id long, seq_no int, n_tokens int, packed binary"
ROWS = "slot long, shard long, doc_id long, seq_no int, n_tokens int, ids binary"


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 .. n - 1 given by key, applied to index."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(zlib.crc32(f"{key}:{r}".encode()) << 20 | r) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mixed >> np.uint64(32) & low)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while len(beyond := np.flatnonzero(out >= n)):  # cycle-walking: each step stays on the index's own cycle
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stride: int = STRIDE, vocabulary: str = VOCABULARY) -> DataFrame:
    """Each document's ids in sequences of `stride`, the last one padded, numbered by (part, own): own counts within a task.

    A null or empty text is one sequence with the end id only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, squeeze, part, own = encoder(vocabulary), zstandard.ZstdCompressor(1), TaskContext.get().partitionId(), 0
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                ids = enc.ids(text)
                if ids.max() >= 1 << 16:
                    raise ValueError("ids need more than 16 bits")
                for k, start in enumerate(range(0, len(ids), stride)):
                    piece = np.full(stride, PAD_ID, "<u2")
                    piece[: len(ids) - start] = ids[start : start + stride]
                    rows.append((part, own, doc, k, min(stride, len(ids) - start), squeeze.compress(piece.tobytes())))
                    own += 1
            yield pd.DataFrame(rows, columns=["part", "own", "doc_id", "seq_no", "n_tokens", "packed"]).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, SEQUENCES)


def write_training_order(docs: DataFrame, path: str, key: int = 1, id_col: str = "doc_id", text_col: str = "text", stride: int = STRIDE, shard_rows: int = SHARD_ROWS, vocabulary: str = VOCABULARY) -> int:
    """Writes the parts to path, FOLDER of them in each folder, and returns the number of sequences; an empty table has none.

    The sequences are written once before they are numbered, so a task that runs again can't change a number. Only the
    counts of the tasks reach the driver. The order depends on the key and on how the input is split."""
    sequences = written(token_sequences(docs, id_col, text_col, stride, vocabulary), "sequences", BATCH_BYTES)
    counts = sorted((r["part"], r["n"]) for r in sequences.groupBy("part").agg(F.count("*").alias("n")).collect())
    first, n = {}, 0
    for part, size in counts:
        first[part], n = n, n + size
    shared = docs.sparkSession.sparkContext.broadcast(first)
    expand = stride * 2

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            slot = feistel(pdf["part"].map(shared.value).to_numpy(np.int64) + pdf["own"].to_numpy(np.int64), n, key)
            yield pdf.drop(columns=["part", "own"]).astype({"doc_id": "Int64"}).assign(slot=slot, shard=slot // shard_rows)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loose = zstandard.ZstdDecompressor()
        for pdf in batches:
            pdf = pdf.astype({"doc_id": "Int64"})
            pdf["ids"] = [loose.decompress(x, max_output_size=expand) for x in pdf.pop("packed")]
            yield pdf

    shards = max(1, -(-n // shard_rows))
    rows = sequences.mapInPandas(number, ROWS.replace("ids", "packed"))
    # part k is exactly the slots of shard k: each id has a task of its own
    rows = rows.repartitionById(shards, F.col("shard").cast("int")).mapInPandas(unpack, ROWS).withColumn("folder", F.floor(F.col("shard") / FOLDER).cast("int"))
    rows.sortWithinPartitions("folder", "slot").write.partitionBy("folder").option("compression", "zstd").parquet(path)
    discard(sequences)
    return n


def read_from(spark: SparkSession, path: str, slot: int = 0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The sequences from a slot on, in the order of slots, for resuming: folders before it aren't listed, and files before it are skipped by their statistics."""
    table = spark.read.schema(ROWS + ", folder int").parquet(path)
    rows = table.filter((F.col("folder") >= slot // shard_rows // FOLDER) & (F.col("slot") >= slot)).drop("folder")
    return rows.orderBy("slot")


def training_order(docs: DataFrame, key: int = 1, **options) -> DataFrame:
    """write_training_order() to a new folder in the shared one, and the table it holds."""
    path = new_dir(docs.sparkSession, "training-order")
    write_training_order(docs, path, key, **options)
    return docs.sparkSession.read.schema(ROWS).parquet(path)
