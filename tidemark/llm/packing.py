"""Packing by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most `room` ids. Only the histogram of piece lengths (at most `room` rows) reaches
the driver, where lengths are placed longest first into the packs that are shortest so far; packs of one pattern are
kept as a count, never one by one. The resulting slots (length, ranks, sequences, offset) are broadcast and joined to the
pieces by each piece's rank within its length. Only texts go to Python and only pieces come back, a few MB at once.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.tokens import VOCABULARY, encoder

ROOM = 2048
#: Pieces of one length that are ranked together; longer lists of equal lengths are split into hash buckets.
RANKED_TOGETHER = 50_000
#: Bytes of texts that a Python worker gets at once, and ids that it gives back at once, about.
BATCH_BYTES, IDS_AT_ONCE = 4 << 20, 1 << 19

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, vocabulary: str = VOCABULARY, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids cut into runs of `room`, the last one shorter.

    ids is little-endian uint32. A null or empty text has the end id only; repeated rows give repeated pieces."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for pdf in batches:
            rows, held = [], 0
            for doc, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                ids = enc.ids(text)
                for start in range(0, len(ids), room):
                    raw = ids[start : start + room].astype("<u4").tobytes()
                    rows.append((doc, start, len(raw) // 4, zlib.crc32(raw), len(ids), raw)[: len(columns)])
                    held += len(raw) // 4
                    if held >= IDS_AT_ONCE:
                        yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, PIECES + ", ids binary" * keep_ids)


def pack_histogram(histogram: dict[int, int], room: int = ROOM) -> tuple[pd.DataFrame, int]:
    """Slots and the number of sequences for {length: count}.

    A slot says that the pieces of `length` with ranks from `rank` on, `count` of them, go to the sequences from
    `sequence` on, one each, at `offset`. Sequences of one packing pattern are a run of ids, split when only some of
    them take another piece."""
    packs: list[tuple[int, int, int]] = []  # used, first sequence, count
    slots, made = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if packs and packs[0][0] + length <= room:
                used, first, count = heapq.heappop(packs)
                k = min(left, count)
                if k < count:
                    heapq.heappush(packs, (used, first + k, count - k))
            else:
                used, first, k = 0, made, left
                made += k
            slots.append((length, rank, first, used, k))
            if used + length < room:
                heapq.heappush(packs, (used + length, first, k))
            rank, left = rank + k, left - k
    return pd.DataFrame(slots, columns=["length", "rank", "sequence", "offset", "count"], dtype="int64"), made


def ranked(pieces: DataFrame, largest: int) -> DataFrame:
    """pieces with `rank`, from 0 without gaps within each length. Lengths that many pieces share are ranked in hash buckets."""
    buckets = max(32, -(-largest // RANKED_TOGETHER))
    # the ids' checksum parts pieces without a document's id
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(*(c for c in ("doc_id", "start", "ids_crc32", "doc_tokens") if c in pieces.columns)), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start")
    return dealt.withColumn("own", F.row_number().over(own) - 1).join(sizes, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("own")).drop("bucket", "own", "base")


def pack(pieces: DataFrame, room: int = ROOM) -> DataFrame:
    """pieces with sequence_id and offset; pieces in a sequence follow each other without gaps.

    pieces is read three times, so pass a written table. No pieces give no rows. All other columns stay."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = pack_histogram(histogram, room)
    slots = pieces.sparkSession.createDataFrame(slots[["length", "rank", "sequence", "offset", "count"]].values.tolist(), "length long, rank long, sequence long, offset long, count long")
    # a length has some tens of slots, one of which holds a rank; ids don't leave the JVM
    slot, rank = F.struct("rank", "sequence", "offset", "count").alias("_slot"), F.col("rank") - F.col("_slot.rank")
    placed = ranked(pieces, max(histogram.values(), default=0)).join(F.broadcast(slots.select("length", slot)), "length").filter((rank >= 0) & (rank < F.col("_slot.count")))
    return placed.select(*pieces.columns, (F.col("_slot.sequence") + rank).alias("sequence_id"), F.col("_slot.offset").alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, vocabulary: str = VOCABULARY, keep_ids: bool = True) -> DataFrame:
    """Documents cut, written once, and packed."""
    return pack(written(token_pieces(docs, id_col, text_col, room, vocabulary, keep_ids), "pieces", BATCH_BYTES), room)
