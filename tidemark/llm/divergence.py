"""Audit of how sources of a language differ in their words, by a sort-based stream.

Each task sorts the words of some documents by (lang, term, source, document) and emits the lengths of their runs: the run's
first document, its number of documents and of occurrences. These partial runs are dealt out by (lang, term) and sorted by
(lang, term, source, document); a second scan of run lengths, which streams, gives every (lang, term, source) its document
frequency and count. However frequent a term is, it has one partial run for each block of documents, not a row for each. A second pass goes over the terms that are kept,
a block of a language's terms with the axis of its sources, and adds up the differences of exact whole-number rates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import weighed, written

#: A language keeps the terms of so many of its documents; a rate is 1 + floor(UNIT (count + ADD) / (N + ADD V)).
LEAST_DOCS, ADD, UNIT = 30, 5, 10**9
TOP = 50
#: Bytes of texts counted together before rows are dealt out.
TOGETHER = 1 << 25
#: Terms whose rates are compared at once, and about so many make a block of a language's terms.
TERMS, BLOCK = 2048, 16_384

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What each byte of a text becomes: letters and all bytes above 7F are parts of terms, others part them.
_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

KINDS = {"lang": pa.string(), "term": pa.string(), "source": pa.string(), "document": pa.int64(), "df": pa.int64(), "n": pa.int64()}
CELL = "lang string, term string, source string, df long, n long"
CELLS = pa.schema([(k, v) for k, v in KINDS.items() if k != "document"])
PART = "lang string, source string, part string, item string, value string"


def _spread(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[pa.RecordBatch]:
    """Runs of (lang, term, source) within some documents at a time: the first document, distinct documents and occurrences."""
    for batch in batches:
        of, texts, first, size = _groups(batch), batch.column("text"), 0, 0
        for i in range(batch.num_rows):
            size += len(texts[i].as_buffer())
            if size >= together or i == batch.num_rows - 1:
                yield _counted(batch, of, first, i + 1)
                first, size = i + 1, 0


def _groups(batch: pa.RecordBatch) -> np.ndarray:
    """A number for each row's (lang, source)."""
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    return np.asarray(lang.indices).astype(np.int64) * max(1, len(source.dictionary)) + np.asarray(source.indices)


def _counted(batch: pa.RecordBatch, of: np.ndarray, low: int, high: int) -> pa.RecordBatch:
    plain = pa.array([t.as_py().translate(_BYTES).strip() for t in batch.column("text").slice(low, high - low)], pa.large_binary()).cast(pa.large_string())
    words = pc.ascii_split_whitespace(plain)
    sizes, flat = np.diff(np.asarray(words.offsets)), words.flatten()
    rows, coded = np.repeat(np.arange(low, high), sizes), flat.dictionary_encode()
    term, real = np.asarray(coded.indices).astype(np.int64), np.asarray(pc.not_equal(flat, "").to_numpy(zero_copy_only=False))
    rows, key = rows[real], (of[rows] * max(1, len(coded.dictionary)) + term)[real]
    order = np.argsort(key, kind="stable")
    rows, key = rows[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    other = new.copy()
    other[1:] |= rows[1:] != rows[:-1]
    at = np.flatnonzero(new)
    head, df, n = rows[at], np.add.reduceat(other.astype(np.int64), at) if len(at) else at, np.diff(np.append(at, len(key)))
    text = coded.dictionary.take(term[real][order][at]).cast(pa.string())
    columns = [batch.column("lang").take(head), text, batch.column("source").take(head), batch.column("document").take(head), pa.array(df, pa.int64()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, KINDS.values(), strict=True)], list(KINDS))


def _cells(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Runs of equal (lang, term, source) in sorted rows, with the sums of df and n, and the first of each run of (lang, term)."""
    rows = rows.combine_chunks()
    differ = []
    for c in ("lang", "term", "source"):
        x = rows.column(c).chunk(0)
        differ.append(np.append(True, np.asarray(pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False), bool)))
    term = differ[0] | differ[1]
    at = np.flatnonzero(term | differ[2])
    sums = [pa.array(np.add.reduceat(rows.column(c).to_numpy(), at)) for c in ("df", "n")]
    return pa.table([*(rows.column(c).take(at) for c in ("lang", "term", "source")), *sums], schema=CELLS), np.flatnonzero(term[at])


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The cells of each term in at least `least` documents. A run goes on over batches: the last term's cells wait for the next one."""
    held = CELLS.empty_table()
    for batch in batches:
        if batch.num_rows:
            found, first = _cells(pa.concat_tables([held, pa.Table.from_batches([batch]).select(CELLS.names).cast(CELLS)]))
            held, done = found.slice(first[-1]), found.slice(0, first[-1])
            yield from _frequent(done, first[:-1], least)
    yield from _frequent(held, np.zeros(min(1, held.num_rows), int), least)


def _frequent(found: pa.Table, first: np.ndarray, least: int) -> list[pa.RecordBatch]:
    if not len(first):
        return []
    enough = np.add.reduceat(found.column("df").to_numpy(), first) >= least
    return found.filter(pa.array(np.repeat(enough, np.diff(np.append(first, found.num_rows))))).to_batches()


def cells(docs: DataFrame, least: int = 1) -> DataFrame:
    """(lang, term, source, df, n): in how many documents of a language's source a term stands, and how often, for the terms
    that at least `least` documents of the language have; one row for each three.

    docs: lang, source and text, null ones read as ''. Every row is a document of its own. Texts without a term give none."""
    rows = _read(docs).withColumn("document", F.monotonically_increasing_id())
    rows = rows.mapInArrow(partial(_spread, together=TOGETHER), "lang string, term string, source string, document long, df long, n long")
    # a key has a row for each TOGETHER bytes of texts at most, and a task holds no more of it than a row for each source
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "lang", "term").sortWithinPartitions("lang", "term", "source", "document").mapInArrow(partial(_runs, least=least), CELL)


def _read(docs: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))


def rates(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(UNIT (count + ADD) / (N + ADD V)), exactly: whole numbers of any size where 64 bits don't hold them."""
    if max(int(counts.max(initial=0)), int(n.max(initial=0))) > 8 * 10**9:
        counts, n = counts.astype(object), n.astype(object)
    return 1 + (UNIT * (counts + ADD)) // (n + ADD * v)


def _block(terms: pd.DataFrame, axis: pd.DataFrame, top: int, size: int) -> pd.DataFrame:
    """Partial sums of one block of a language's terms for each two of its sources, and each source's `top` terms of the block."""
    axis = axis.sort_values("source", key=lambda s: s.str.encode("utf-8"))
    lang, sources, v, s = axis["lang"].iloc[0], axis["source"].tolist(), int(axis["v"].iloc[0]), len(axis)
    place, totals = {x: i for i, x in enumerate(sources)}, axis["total"].to_numpy(np.int64)
    sums, best = np.zeros((s, s), object), [[] for _ in sources]
    for at in range(0, len(terms), size):
        part = terms.iloc[at : at + size]
        of = np.repeat(np.arange(len(part)), part["counts"].map(len))
        pairs = [(place[c["source"]], c["n"]) for x in part["counts"] for c in x]
        where, n = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], np.int64)
        counts = np.zeros((len(part), s), np.int64)
        counts[of, where] = n
        p = rates(counts, totals, v)
        for a in range(s - 1):
            sums[a, a + 1 :] += np.abs(p[:, a + 1 :] - p[:, a : a + 1]).sum(0)
        if top:
            whole = rates(counts.sum(1), np.array([totals.sum()]), v)
            gain, names = p - whole[:, None], part["term"].to_numpy()
            for a in range(s):
                over = np.flatnonzero((counts[:, a] > 0) & (gain[:, a] > 0))
                best[a] = sorted([*best[a], *((-int(gain[i, a]), names[i].encode(), names[i]) for i in over)])[:top]
    rows = [(lang, sources[x], "pair", sources[y], str(sums[a, b])) for a in range(s) for b in range(a + 1, s) for x, y in ((a, b), (b, a))]
    rows += [(lang, sources[a], "term", name, str(-lost)) for a in range(s) for lost, _, name in best[a]]
    return pd.DataFrame(rows, columns=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's rates of the kept terms are from each other source's of
    the language (part `pair`), and the `top` terms that it has more often than the language (part `term`).

    Null text, lang and source are '', each a group as others are; rows that are repeated count as often. Without documents
    there is no row. What is carried to a task is a block of a language's terms and the axis of its sources, whose pairs are
    the result. Other columns play no part."""
    spark = docs.sparkSession
    groups = _read(docs).groupBy("lang", "source").agg(F.count("*").alias("documents"))
    kept = cells(docs, least).groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = written(kept, "terms")
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    axis = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    # a language has as many blocks as its terms fill
    blocks = F.floor(F.col("v") / BLOCK).cast("int")
    axis = axis.withColumn("block", F.explode(F.sequence(F.lit(0), blocks)))
    terms = weighed(kept, sizes, "lang", "v", kept.count()).withColumn("block", F.pmod(F.xxhash64("term"), blocks + 1).cast("int")).drop("v")

    size = TERMS

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _block(left, right, top, size)

    parts = terms.groupBy("lang", "block").cogroup(axis.groupBy("lang", "block")).applyInPandas(compare, PART)
    found = parts.groupBy("lang", "source", "part", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return found.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))


#: The same as the query over `documents`, in DuckDB's SQL.
SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents
), words AS (
  SELECT r, lang, source, unnest(list_filter(regexp_split_to_array(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN (SELECT lang, term FROM kept) USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + {ADD})) // (g.total + {ADD} * s.v) AS p,
    1 + ({UNIT}::HUGEINT * (k.n + {ADD})) // (s.total + {ADD} * s.v) AS q
  FROM totals g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, (SELECT 0) AS zero FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT lang, source, part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN apart USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= {TOP}
"""
