"""Periodic runs of words, by comparing a text's word ids with every shift of themselves.

For each lag q up to half the words, a stretch of at least max(q, 12 - q) places i with word i = word i + q is a run of period q.
Such a stretch holds a multiple of that minimum, so a lag needs one comparison in so many words to tell whether it has any,
and only stretches that show there are followed to their ends. Short texts are scanned together, one lag of all of them at a
time; a long one is dealt out as ranges of lags, each a row of its own that any task can scan.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and so many periods.
LEAST, MIN_EXP = 12, 2
#: Texts of more words are dealt out, LAGS lags to a row.
LONG, LAGS = 16_384, 4_096
#: Runs of shorter periods are looked for before any range of lags: their multiples are no runs of their own.
SHORT = 32
#: Words scanned together, about.
TOGETHER = 1 << 21

REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
Change = Callable[[object, list[bytes]], list[bytes]]


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than a space and 09 to 0D, which is what bytes.split() splits at."""
    return (text or b"").split()


def word_ids(words: list[bytes]) -> np.ndarray:
    return pd.factorize(np.array(words, object))[0].astype(np.int32) if words else np.zeros(0, np.int32)


def _divisors(q: int) -> list[int]:
    """q by each of its prime factors: a period below q that divides it divides one of these."""
    found, left, f = [], q, 2
    while f * f <= left:
        if left % f == 0:
            found.append(q // f)
            while left % f == 0:
                left //= f
        f += 1
    return found + [q // left] * (left > 1)


def _reach(ids: np.ndarray, at: int, q: int, end: int) -> int:
    """The first place from `at` on that differs from the one q later, `end` at most."""
    step = 64
    while at < end:
        to = min(end, at + step)
        differ = ids[at:to] != ids[at + q : to + q]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = to, min(4 * step, 1 << 16)
    return end


def _back(ids: np.ndarray, at: int, q: int, end: int) -> int:
    """The first place of the stretch that `at` is in, `end` at least."""
    step = 64
    while at > end:
        to = max(end, at - step)
        differ = (ids[to:at] != ids[to + q : at + q])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return at - k
        at, step = to, min(4 * step, 1 << 16)
    return end


def scan(ids: np.ndarray, sizes: np.ndarray, low: int = 1, high: int | None = None, known: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs with low <= period < high in texts that stand one after another in ids.

    sizes: the texts' numbers of words, longest first. known: runs of shorter periods, whose multiples needn't be followed."""
    ends = np.cumsum(sizes)
    high = min(high or 1 << 62, (int(sizes[0]) if len(sizes) else 0) // MIN_EXP + 1)
    end_of = np.repeat(ends, sizes)
    runs, often = list(known or ()), np.array(known or (), np.int64).reshape(-1, 3)
    for q in range(low, high):
        n = int(ends[np.searchsorted(-sizes, -max(MIN_EXP * q, LEAST), "right") - 1]) if sizes[0] >= max(MIN_EXP * q, LEAST) else 0
        if not n:
            break
        least = max(q, LEAST - q)
        x = least * np.flatnonzero(ids[: n - q : least] == ids[q:n:least])
        x = x[x + q < end_of[x]]
        if not len(x):
            continue
        half = least // 2  # a stretch of this size around x reaches half of it to one side
        left, right = np.maximum(x - half, 0), np.minimum(x + least - half - 1, n - q - 1)
        x = x[(ids[left] == ids[left + q]) | (ids[right] == ids[right + q])]
        if len(often) and len(within := often[(q % often[:, 2] == 0) & (often[:, 1] > q)]):
            within = within[np.argsort(within[:, 0])]
            furthest = np.append(np.maximum.accumulate(within[:, 0] + within[:, 1] - q), 0)  # of the runs that begin up to there
            x = x[furthest[np.searchsorted(within[:, 0], x, "right") - 1] <= x]
        done, found = -1, []
        for at in x.tolist():
            if at < done:
                continue
            end = int(end_of[at])
            begin = end - int(sizes[np.searchsorted(ends, at, "right")])
            done = _reach(ids, at, q, end - q)
            start = _back(ids, at, q, begin)
            size = done - start + q
            if done - start >= least and not any(_reach(ids, start, d, start + size - d) == start + size - d for d in _divisors(q)):
                found.append((start, size, q))
        runs += found
        if many := [r for r in found if r[1] >= 4 * q]:
            often = np.concatenate([often, many])
    return runs[len(known or ()) :]


def _texts(all_ids: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start, then period."""
    sizes = np.array([len(x) for x in all_ids], np.int64)
    order = np.argsort(-sizes, kind="stable")
    found: list[list[tuple[int, int, int]]] = [[] for _ in all_ids]
    if not len(sizes) or not sizes.max():
        return found
    ends = np.cumsum(sizes[order])
    begins = ends - sizes[order]
    for start, size, period in scan(np.concatenate([all_ids[i] for i in order]), sizes[order]):
        k = int(np.searchsorted(ends, start, "right"))
        found[order[k]].append((start - int(begins[k]), size, period))
    return [sorted(r, key=lambda r: (r[0], r[2])) for r in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run has after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        edge[start + period] += 1
        edge[start + size] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _row(doc_id: object, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    kept = hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest, kept)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    kinds = [c.split() for c in schema.split(", ")]
    return pd.DataFrame({name: pd.array([r[i] for r in rows], "Int64") if kind == "long" else pd.Series([r[i] for r in rows], dtype=object) for i, (name, kind) in enumerate(kinds)})


def _ids(values: pd.Series) -> list:
    """Ids that come as text, as null ones make doubles of whole numbers."""
    return [None if v is None else int(v) for v in values]


def repeated(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of the query's documents: where the checksum of an id ends in 0, a tail that repeats its first words."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def report(docs: DataFrame, change: Change = lambda _, words: words, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, lags: int = LAGS) -> DataFrame:
    """One row for each document: number of runs, the longest one (ties: smallest start, then period), and checksums of all runs and of the text without repetitions.

    change makes the words that are scanned of an id and its words. Null and empty texts have no run, a row without id keeps
    a null one, rows that are repeated are reported as often; other columns play no part. A text of more than `long` words is
    scanned by as many tasks as it has ranges of `lags` lags."""
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # so many words need so many bytes at least
    big, raw = F.octet_length("text") >= 2 * long + 1, F.col("text").cast("binary").alias("text")

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, size = [], 0
            for doc_id, text in zip(_ids(pdf["doc_id"]), pdf["text"], strict=True):
                held.append((doc_id, change(doc_id, words_of(text))))
                size += len(held[-1][1])
                if size >= TOGETHER:
                    yield finished(held)
                    held, size = [], 0
            if held:
                yield finished(held)

    def finished(held: list) -> pd.DataFrame:
        ids, ends = word_ids([w for _, words in held for w in words]), np.cumsum([len(words) for _, words in held])
        return _frame([_row(d, words, runs) for (d, words), runs in zip(held, _texts(np.split(ids, ends[:-1])), strict=True)], REPORT)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, key, text in zip(_ids(pdf["doc_id"]), pdf["key"], pdf["text"], strict=True):
                ids = word_ids(change(doc_id, words_of(text)))
                for low in range(1, max(2, len(ids) // MIN_EXP + 1), lags):  # a text without words still has one range
                    yield _frame([(str(doc_id) if doc_id is not None else None, key, low, ids.tobytes())], "doc_id string, key string, low long, ids binary")

    def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, key, low, packed in zip(_ids(pdf["doc_id"]), pdf["key"], pdf["low"], pdf["ids"], strict=True):
                ids = np.frombuffer(packed, np.int32)
                sizes = np.array([len(ids)])
                known = scan(ids, sizes, 1, min(int(low), SHORT)) if len(ids) else []
                found = scan(ids, sizes, int(low), int(low) + lags, known) if len(ids) else []
                yield _frame([(str(doc_id) if doc_id is not None else None, key, *r) for r in found], "doc_id string, key string, start long, length long, period long")

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, text, runs in zip(_ids(pdf["doc_id"]), pdf["text"], pdf["runs"], strict=True):
                runs = [(int(r["start"]), int(r["length"]), int(r["period"])) for r in runs] if runs is not None else []
                yield _frame([_row(doc_id, change(doc_id, words_of(text)), runs)], REPORT)

    few = rows.filter(~big).select("doc_id", raw).mapInPandas(short, REPORT)
    whole = rows.filter(big).select("doc_id", F.sha2("text", 256).alias("key"), raw)
    parts = whole.mapInPandas(dealt, "doc_id string, key string, low long, ids binary")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = parts.repartition(tasks, "key", "low").mapInPandas(ranged, "doc_id string, key string, start long, length long, period long")
    # a text has fewer runs than words; repeated rows find the same ones again
    found = found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "length", "period")).alias("runs"))
    both = whole.alias("w").join(found.alias("f"), F.col("w.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("w.key") == F.col("f.key")), "left")
    return few.unionByName(both.select("w.doc_id", "w.text", "f.runs").mapInPandas(gathered, REPORT))
