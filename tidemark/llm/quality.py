"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(t_k - w.x): one vector of weights over hashed text features, and ordered thresholds t. x is the
square root of each hashed byte trigram's share of the text, so texts of any length have unit norm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 1 << 12
#: Rated documents that training reads at most.
TRAIN_DOCS = 4096
STEPS, RATE, RIDGE = 300, 0.05, 1e-4
SLICE = 1 << 20  # bytes counted at once


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the whole text's features that aren't 0; a space stands before and after it."""
    counts, n = np.zeros(DIMS, np.int64), 0
    raw = f" {text or ''}  ".encode("utf-8", "surrogatepass")
    for at in range(0, len(raw) - 2, SLICE):
        b = np.frombuffer(raw[at : at + SLICE + 2], np.uint8).astype(np.uint32)
        grams = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
        counts += np.bincount(grams * np.uint32(2654435761) >> np.uint32(32 - (DIMS - 1).bit_length()), minlength=DIMS)
        n += len(grams)
    places = np.flatnonzero(counts)
    return places.astype(np.uint16), np.sqrt(counts[places] / n).astype(np.float32)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Ordinal:
    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each grade but the last, for rows of dense features."""
        return self.tails_of((x @ self.weights.astype(np.float32)).astype(float))

    def tails_of(self, sums: np.ndarray) -> np.ndarray:
        return _logistic(sums[:, None] - self.thresholds)

    def sum_of(self, text: str | None) -> float:
        places, values = features(text)
        return float(values @ self.weights[places])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades)


def fit(x: np.ndarray, y: np.ndarray) -> Ordinal:
    """Maximum likelihood with a ridge, by Adam over all rows. One grade alone gives no thresholds."""
    grades, of = np.unique(y, return_inverse=True)
    k = len(grades) - 1
    n, dims = x.shape
    w, t0, gaps = np.zeros(dims), 0.0, np.zeros(max(0, k - 1))
    if k < 1:
        return Ordinal(grades.astype(float), w, np.zeros(0))
    moments = [np.zeros(dims + k), np.zeros(dims + k)]
    for step in range(1, STEPS + 1):
        t = t0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        s = (x @ w.astype(np.float32)).astype(float)
        edges = np.concatenate([np.zeros((n, 1)), _logistic(t - s[:, None]), np.ones((n, 1))], 1)  # P(grade <= k)
        rows = np.arange(n)
        p = np.maximum(edges[rows, of + 1] - edges[rows, of], 1e-12)
        slope = edges * (1 - edges)
        up, down = slope[rows, of + 1] / p, slope[rows, of] / p
        ds = (up - down) / n  # of -log p by s
        dt = np.zeros(k + 1)
        np.add.at(dt, of, -up / n)  # the last place takes what has no threshold
        np.add.at(dt, np.maximum(of - 1, 0), np.where(of > 0, down, 0) / n)
        dt = dt[:k]
        tail = np.cumsum(dt[::-1])[::-1]
        grad = np.concatenate([(ds.astype(np.float32) @ x).astype(float) + RIDGE * w, [tail[0]], tail[1:] * np.exp(gaps)])
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad * grad
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-9)
        w, t0, gaps = w - move[:dims], t0 - move[dims], gaps - move[dims + 1 :]
    return Ordinal(grades.astype(float), w, t0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def drawn(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled rows, by a hash of their ids."""
    return labels.orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, grade_col: str = "quality", most: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """Fits on at most `most` rated documents, ids and grades of which are broadcast; labels has id_col and grade_col.

    Rows without id, text or grade teach nothing. An id that is rated several times counts with its highest grade, one that
    several documents have with the first of their texts. No rated document gives a model without grades."""
    rated = labels.select(F.col(id_col).alias("doc_id"), F.col(grade_col).cast("double").alias("grade")).filter(F.col("grade").isNotNull() & F.col("doc_id").isNotNull())
    rated = drawn(rated.groupBy("doc_id").agg(F.max("grade").alias("grade")), most)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(rated), "doc_id").groupBy("doc_id").agg(F.max("grade").alias("grade"), F.min("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype(str), "grade": pdf["grade"], "places": [p.tobytes() for p, _ in made], "values": [v.tobytes() for _, v in made]})

    got = rows.select("doc_id", "grade", "text").mapInPandas(run, "doc_id string, grade double, places binary, values binary").toPandas().sort_values("doc_id")
    x = np.zeros((len(got), DIMS), np.float32)
    for i, (places, values) in enumerate(zip(got["places"], got["values"], strict=True)):
        x[i, np.frombuffer(places, np.uint16)] = np.frombuffer(values, np.float32)
    return fit(x, got["grade"].to_numpy())


def score(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """docs with expected_grade and tail_prob, the probability of a grade above the lowest.

    Null text is an empty one. With no grade learned both are null; with a single one, tail_prob is 1. Columns of these
    names in docs are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail_prob double")
    def rate(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        if not len(m.grades):
            return pd.DataFrame({"expected_grade": [None] * len(texts), "tail_prob": [None] * len(texts)}, dtype=float)
        tails = m.tails_of(np.array([m.sum_of(t) for t in texts]))
        return pd.DataFrame({"expected_grade": m.expected(tails), "tail_prob": tails[:, 0] if tails.shape[1] else 1.0})

    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("expected_grade", "tail_prob"))).alias("_docs")
    return docs.select(kept, rate(F.col(text_col).cast("string")).alias("_rated")).select("_docs.*", "_rated.*")


def keeps(least: float = 0.5):
    """Whether a scored row is selected: its tail probability is `least` or more. Rows without a score are kept."""
    return F.coalesce(F.col("tail_prob") >= least, F.lit(True))
