"""Toxicity: a logistic model over words and stems with a counterfactual penalty.

Besides the log loss, training pays for every labelled text that names a group: swapping the identity term for another
of its list must not change the score. That pulls the weights of the terms of a list together, so that none of them
stands for the label.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, written
from tidemark.llm.quality import drawn

# Identity terms, by what they have in common; a term may be swapped for any other of its list.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "sikh", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
    ("mexican", "chinese", "american", "german", "french", "spanish", "indian", "turkish"),
)

WORD = re.compile(r"[^\W\d_]+")
#: Labelled documents that training reads at most.
TRAIN_DOCS = 8192
#: Prefixes that stand for a word's stem; a feature counts up to MOST_TIMES in a text.
PREFIXES = (3, 4, 5, 6, 7)
MOST_TIMES = 4
#: A feature enters the model when its association with the label has this chi-square.
CHI_SQUARE = 12.0
#: A feature needs the evidence of about so many texts to get a weight.
EVIDENCE = 1.5
FAIRNESS = 5.0
STEPS, RATE, RIDGE, LEAST = 400, 0.05, 1e-4, 0.05


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features(word: str, named: frozenset[str]) -> tuple[str, ...]:
    """The word and its stems; an identity term stands for itself only."""
    return (word,) if word in named else (word, *(word[:k] + "*" for k in PREFIXES if k < len(word)))


class Model:
    """Weights of features; score() is the probability of the label."""

    def __init__(self, weights: dict[str, float], bias: float, named: frozenset[str] = frozenset()):
        self.weights, self.bias, self.named = weights, bias, named
        self.seen: dict[str, tuple[str, ...]] = {}

    def _known(self, word: str) -> tuple[str, ...]:
        found = tuple(f for f in features(word, self.named) if f in self.weights)
        if len(self.seen) < 200_000:
            self.seen[word] = found
        return found

    def score(self, text: str | None) -> float:
        seen, count = self.seen, Counter()
        for w in words(text):
            found = seen.get(w)
            if found is None:
                found = self._known(w)
            if found:
                count.update(found)
        z = self.bias + sum(self.weights[f] * min(n, MOST_TIMES) for f, n in sorted(count.items()))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def swaps(found: Iterable[str], lists: Iterable[Iterable[str]]) -> Iterator[tuple[str, str]]:
    """Each identity term of a text with each term that can replace it."""
    for terms in lists:
        for a in terms:
            if a in found:
                yield from ((a, b) for b in terms if b not in found)


def fit(cells: pd.DataFrame, y: np.ndarray, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, fairness: float = FAIRNESS) -> Model:
    """Log loss, l1, and `fairness` times the squared score change of every swap of identity terms; Adam over all rows.

    cells: row (place in y), feature, times; y: each row's label, or the mean one of its copies. Without rows every score is
    below 0.5; with one label only the bias settles at that label's side."""
    names = frozenset(t for group in terms for t in group)
    if not len(y):
        return Model({}, -1.0, names)
    n, share = len(y), float(y.mean())
    named = cells[cells["feature"].isin(names)].groupby("row")["feature"].agg(set)
    pairs = Counter(s for found in named for s in swaps(found, terms))
    place = {f: i for i, f in enumerate(sorted({*cells["feature"], *(t for s in pairs for t in s)}))}
    owner, flat = cells["row"].to_numpy(np.int64), cells["feature"].map(place).to_numpy(np.int64)
    times = np.minimum(cells["times"].to_numpy(float), MOST_TIMES)
    dims = len(place)
    ends = [np.array([place[s[k]] for s in pairs], np.int64) for k in (0, 1)]
    often = np.array(list(pairs.values()), float)
    w, bias = np.zeros(dims), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    m, v, edge = np.zeros(dims + 1), np.zeros(dims + 1), EVIDENCE / n
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, w[flat] * times, n) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        g = np.bincount(flat, off[owner] * times, dims) + RIDGE * w
        if len(often):
            change = fairness * often / n * (w[ends[0]] - w[ends[1]])
            g += np.bincount(ends[0], change, dims) - np.bincount(ends[1], change, dims)
        g = np.where(w != 0, g + edge * np.sign(w), np.sign(g) * np.maximum(np.abs(g) - edge, 0))
        g = np.append(g, off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        new = w - move[:dims]
        w, bias = np.where(new * w < 0, 0, new), bias - move[dims]
    return Model({f: float(w[i]) for f, i in place.items() if abs(w[i]) >= LEAST}, bias, names)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, fairness: float = FAIRNESS) -> Model:
    """Fits on at most `most` labelled documents, ids and labels of which are broadcast; labels has id_col and label_col.

    Rows without id or label teach nothing, and a null text is an empty one. An id with several labels counts as toxic if one
    says so. Copies of a text are one example with their labels' mean. Features are counted on the executors and screened by
    chi-square; the driver gets the chosen ones' counts in each text."""
    names = frozenset(t for group in terms for t in group)
    rated = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    rated = drawn(rated.groupBy("doc_id").agg(F.max("label").alias("label")), most)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(rated), "doc_id").groupBy("text").agg(F.avg("label").alias("label"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [Counter(f for w in words(t) for f in features(w, names)) for t in pdf["text"]]
            digest = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in pdf["text"]]
            yield pd.DataFrame({"id": digest, "label": pdf["label"], "features": [list(c) for c in made], "times": [list(c.values()) for c in made]})

    counted = written(rows.select("text", "label").mapInPandas(run, "id binary, label double, features array<string>, times array<int>"), "features")
    n, share = counted.agg(F.count("*"), F.avg("label")).first()
    if not n:
        return fit(pd.DataFrame({"row": [], "feature": [], "times": []}), np.zeros(0), terms, fairness)
    k = F.col("k")
    chi = (F.col("hit") - k * share) ** 2 / F.greatest(k * share * (1 - share) * (1 - k / n), F.lit(1e-9))
    tally = counted.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("k"), F.sum("label").alias("hit"))
    chosen = {r["feature"] for r in tally.filter((k > 1) & (k < n) & (chi >= CHI_SQUARE)).select("feature").collect()} | names
    places = counted.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(sorted(chosen))})

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = places.value
        for pdf in batches:
            some = [[(place[f], t) for f, t in zip(fs, ts, strict=True) if f in place] for fs, ts in zip(pdf["features"], pdf["times"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "at": [[f for f, _ in x] for x in some], "times": [[t for _, t in x] for x in some]})

    got = counted.mapInPandas(keep, "id binary, label double, at array<int>, times array<int>").toPandas().sort_values("id").reset_index(drop=True)
    discard(counted)
    order = np.array(sorted(chosen), object)
    sizes = [len(x) for x in got["at"]]
    at, times = (np.concatenate([np.asarray(x, np.int64) for x in got[c]]) for c in ("at", "times"))
    cells = pd.DataFrame({"row": np.repeat(np.arange(len(got)), sizes), "feature": order[at], "times": times})
    return fit(cells.sort_values(["row", "feature"]), got["label"].to_numpy(), terms, fairness)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of docs; a null text is an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), rate(F.col(text_col).cast("string")).alias("score"))
