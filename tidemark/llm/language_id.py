"""Language identification by prediction by partial matching.

For each language, counts of byte contexts up to order 3 are frozen after training. A byte costs
-log2(n / (T + D)) after the longest context it was seen in, where T and D are that context's total and number of
distinct followers, plus -log2(D / (T + D)) for every longer context it escapes from (method C, no exclusion); a context
never seen costs nothing to skip, and bytes never seen cost 8 bits. The language whose code for the text is shortest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of each language that training reads whole, about. The model holds every context they have, in every language.
TRAIN_DOCS = 1024
UNIT = 1 << 16  # code lengths are whole multiples of 1/UNIT bit, so sums are exact in any order
SLICE = 1 << 20  # bytes scored at once
START = b"\n\n\n"
EMPTY = np.uint32(0xFFFFFFFF)
#: Languages whose tables are one matrix: a context takes 4 bytes for each of them, not for each language there is.
TOGETHER = 16


def _grams(raw: bytes) -> np.ndarray:
    """Each byte of raw with the three before it, as one number; raw has START before it."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


class Table:
    """Numbers to row numbers: open addressing over numpy arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), np.uint32((1 << bits) - 1)
        self.keys, self.rows = np.full(1 << bits, EMPTY), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.rows[at] < 0
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.rows[at[put]] = keys[left[put]], left[put]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at = left[stay], at[stay] + np.uint32(1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint32(2654435761) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it has none."""
        at = self._slot(keys)
        found = np.where(self.keys[at] == keys, self.rows[at], -1)
        left = np.flatnonzero((found < 0) & (self.rows[at] >= 0))
        at = at[left]
        while len(left):
            at = at + np.uint32(1) & self.mask
            hit = self.keys[at] == keys[left]
            found[left[hit]] = self.rows[at[hit]]
            go = ~hit & (self.rows[at] >= 0)
            left, at = left[go], at[go]
        return found


class Model:
    """Frozen statistics of all languages, as code lengths: one row for each context-and-byte that any language has seen."""

    def __init__(self, langs: list[str], counts: pd.DataFrame):
        """counts: lang (place in langs), gram, n."""
        self.langs = langs
        self.parts: list[Model] = []
        n_langs = len(langs)
        if n_langs > TOGETHER:  # code lengths of a language don't depend on others
            of = counts["lang"].to_numpy(np.int64)
            for low in range(0, n_langs, TOGETHER):
                some = counts[(of >= low) & (of < low + TOGETHER)]
                self.parts.append(Model(langs[low : low + TOGETHER], some.assign(lang=some["lang"] - low)))
            return
        g4 = np.unique(counts["gram"].to_numpy(np.uint32))
        n4 = np.zeros((len(g4), n_langs))
        np.add.at(n4, (np.searchsorted(g4, counts["gram"].to_numpy(np.uint32)), counts["lang"].to_numpy(np.int64)), counts["n"].to_numpy(float))
        # order 0: every byte possible
        below, known = np.full((256, n_langs), 8.0), None
        levels = []
        for order in (0, 1, 2, 3):
            keep = np.uint32((1 << 8 * (order + 1)) - 1)
            grams, at = np.unique(g4 & keep, return_inverse=True)
            n = np.zeros((len(grams), n_langs))
            np.add.at(n, at, n4)
            contexts, of = np.unique(grams >> np.uint32(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), n_langs)), np.zeros((len(contexts), n_langs))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                lower = below[grams & np.uint32(0xFF)] if known is None else below[np.searchsorted(known, grams & np.uint32((1 << 8 * order) - 1))]
                cost = np.where(n > 0, -np.log2(n / (total + kinds)[of]), escape[of] + lower)
            levels.append((Table(grams), np.rint(cost * UNIT).astype(np.int32), Table(contexts), np.rint(escape * UNIT).astype(np.int32)))
            below, known = cost, grams
        self.levels = levels

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after its first three, a column for each language."""
        table, cost, contexts, escape = self.levels[3]
        row = table.find(grams)
        if not len(cost):  # nothing was learned: 8 bits a byte
            return np.full((len(grams), len(self.langs)), 8 * UNIT, np.int64)
        out = cost[row].astype(np.int64)
        left = np.flatnonzero(row < 0)
        if len(left):
            out[left] = 0
            for order in (3, 2, 1, 0):
                table, cost, contexts, escape = self.levels[order]
                part = grams[left] & np.uint32((1 << 8 * (order + 1)) - 1)
                row = table.find(part)
                hit = row >= 0
                out[left[hit]] += cost[row[hit]]
                left, part = left[~hit], part[~hit]
                seen = contexts.find(part >> np.uint32(8))
                out[left] += np.where(seen[:, None] >= 0, escape[seen], 0)
            out[left] += 8 * UNIT
        return out

    def bits(self, texts: list[str]) -> np.ndarray:
        """Exact code length of each whole text in each language, in units."""
        if self.parts:
            return np.concatenate([part.bits(texts) for part in self.parts], 1)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        grams, owners, size = [], [], 0

        def flush() -> None:
            cost, lengths = self.costs(np.concatenate(grams)), [len(g) for g in grams]
            np.add.at(out, owners, np.add.reduceat(cost, np.cumsum([0, *lengths[:-1]])))

        for i, text in enumerate(texts):
            raw = START + text.encode("utf-8", "surrogatepass")
            for at in range(0, len(raw) - 3, SLICE):
                grams.append(_grams(raw[at : at + SLICE + 3]))
                owners.append(i)
                size += len(grams[-1])
                if size >= SLICE:
                    flush()
                    grams, owners, size = [], [], 0
        if grams:
            flush()
        return out


def train(rows: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """rows: doc_id, text, lang. Rows without a language, text or id teach nothing; repeated rows count each time.

    About train_docs documents of each language, chosen by a hash of their ids, are counted on the executors; the driver
    gets the counts of (language, context and byte), whose number that sample bounds. No language and no context is left out.
    The model takes 4 bytes for each context of TOGETHER languages and each of these. Texts without a byte teach nothing, and a
    language that has no others costs 8 bits a byte."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return Model([], pd.DataFrame({"lang": [], "gram": [], "n": []}))
    share = F.create_map(*(x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, train_docs / sizes[lang])))))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / (1 << 30)
    rows = rows.filter(drawn < F.try_element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                held, size = [], 0
                for text in texts:
                    raw = START + text.encode("utf-8", "surrogatepass")
                    for at in range(0, len(raw) - 3, SLICE):
                        held.append(_grams(raw[at : at + SLICE + 3]))
                        size += len(held[-1])
                        if size >= SLICE:
                            yield counted(lang, held)
                            held, size = [], 0
                if held:
                    yield counted(lang, held)

    def counted(lang: str, held: list[np.ndarray]) -> pd.DataFrame:
        gram, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"lang": langs.index(lang), "gram": gram.astype(np.int64), "n": n})

    counts = rows.mapInPandas(count, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Model(langs, counts.toPandas())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the language with the shortest code and its share of 2^-length over all languages.

    `und` and score 0 where the text is null or has no letter, or no language was learned; ties go to the first name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            some = pdf["letters"].to_numpy(bool)
            lang, score = np.full(len(pdf), "und", object), np.zeros(len(pdf))
            if some.any() and m.langs:
                bits = m.bits(pdf["text"][some].tolist())
                lang[some] = np.array(m.langs, object)[bits.argmin(1)]
                behind = (bits - bits.min(1, keepdims=True)) / UNIT
                score[some] = 1 / np.exp2(-np.minimum(behind, 1000)).sum(1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": lang, "score": score})

    letters: Column = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), letters.alias("letters")).mapInPandas(run, "doc_id long, lang_pred string, score double")
