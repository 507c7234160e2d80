"""Benchmark decontamination with DataFrame functions only.

Benchmark items become a table of hashed 13-word windows. Documents are scanned once: each row turns into an array of
(position, hashes) of its windows, which is exploded and probes the windows' table by a 64-bit hash; a second hash of 32
bits and the window's length verify every hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
#: Bytes of benchmark windows, with the items that have them, that are sent to every executor; above that the join shuffles,
#: and rows of one window are dealt to SALTS tasks.
BROADCAST_BYTES, SALTS = 128 << 20, 16
#: A document is contaminated when a hit word comes at least once in so many words.
ONE_IN = 20

# Fixed value: what separates words, all of ASCII but digits and lower-case letters.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = -1  # the hash of the one row that every document has in any case


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def lowered(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATOR, -1), "")


def windows(w: Column, n: int) -> Column:
    """(pos from 1, n, h, check) of every run of n words; none if there are fewer."""
    one = lambda i: let(F.slice(w, i, n), lambda s: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.xxhash64(s).alias("h"), F.hash(s).alias("check")))
    return F.transform(F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>")), one)


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """(h, check, n, items): each distinct window with the items it occurs in. An item of fewer words is one window."""
    items = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).filter(F.col("item").isNotNull() & (F.size("w") > 0))
    whole = F.struct(F.lit(1).alias("pos"), F.size("w").alias("n"), F.xxhash64("w").alias("h"), F.hash("w").alias("check"))
    found = items.select("item", F.explode(F.when(F.size("w") >= n, windows(F.col("w"), n)).otherwise(F.array(whole))).alias("x"))
    return found.groupBy("x.h", "x.check", "x.n").agg(F.collect_set("item").alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, text_hash, n_words, hits (sorted positions of hit words, from 1), items (distinct, sorted as strings).

    Null text has no words; repeated rows give repeated rows; null ids are kept. An empty benchmark hits nothing."""
    table = benchmark_windows(benchmark, n=n).withColumnRenamed("n", "size")
    bytes_ = F.sum(F.lit(64) + F.length(F.array_join(F.col("items").cast("array<string>"), ",")))
    told = table.agg(F.collect_set("size").alias("sizes"), F.coalesce(bytes_, F.lit(0)).alias("bytes")).first()  # n sizes at most
    sizes, few = sorted(told["sizes"]), told["bytes"] <= BROADCAST_BYTES
    kind = "array<struct<pos:int,n:int,h:bigint,check:int>>"
    marker = lambda w: F.array(F.struct(F.size(w).alias("pos"), F.lit(0).alias("n"), F.lit(MARK).cast("long").alias("h"), F.lit(0).alias("check"))).cast(kind)
    cells = lambda w: F.concat(*([marker(w)] if few else [F.array().cast(kind)]), *(windows(w, k).cast(kind) for k in sizes))
    cut = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.explode(let(words(F.col(text_col)), cells)).alias("x"))
    cut = cut.select("doc_id", "text_hash", "x.pos", "x.n", "x.h", F.col("x.check").alias("own"))
    none = F.lit(None).cast(table.schema["items"].dataType)
    if few:  # the row that every document has in any case meets a row of its own
        marked = table.unionByName(docs.sparkSession.range(1).select(F.lit(MARK).cast("long").alias("h"), F.lit(0).alias("check"), F.lit(0).alias("size"), none.alias("items")))
        met = cut.join(F.broadcast(marked), "h")
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos", "text_hash"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"])
    found = met.filter((F.col("own").bitwiseXOR(F.col("check")) == 0) & (F.col("n").bitwiseXOR(F.col("size")) == 0)).select("doc_id", "text_hash", "pos", "n", "items")
    if not few:
        found = found.unionByName(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.size(words(F.col(text_col))).alias("pos"), F.lit(0).alias("n"), none.alias("items")))
    mark = F.col("n") == 0
    gathered = found.groupBy("doc_id", "text_hash").agg(
        F.count(F.when(mark, 1)).alias("copies"),
        F.max(F.when(mark, F.col("pos"))).alias("n_words"),
        F.collect_set(F.when(~mark, F.struct("pos", "n"))).alias("at"),
        F.collect_set(F.when(~mark, F.col("items"))).alias("of"),
    )
    spans = F.flatten(F.transform("at", lambda s: F.sequence(s["pos"], s["pos"] + s["n"] - 1)))
    names = F.array_sort(F.array_distinct(F.transform(F.flatten("of"), lambda x: x.cast("string"))))
    return gathered.select("doc_id", "text_hash", F.col("n_words").cast("long"), F.array_sort(F.array_distinct(spans)).alias("hits"), names.alias("items"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def report(found: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """scan() as counts and a digest, and whether each document is contaminated."""
    n_hit = F.size("hits").cast("long")
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") without the hit words of every document and what stands before them.

    Columns, their order and repeated rows stay."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be documents or spans")
    found = scan(docs, benchmark, id_col, text_col, n).filter(F.size("hits") > 0)
    if remove == "documents":
        found = found.filter(one_in * F.size("hits") >= F.col("n_words"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("hits").alias("_hits")).distinct()
    same = docs[id_col].eqNullSafe(found["_id"]) & (F.xxhash64(docs[text_col]) == found["_hash"])
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    both = F.struct(F.split(docs[text_col], word, -1).alias("gaps"), F.regexp_extract_all(docs[text_col], F.lit(word), 0).alias("words"))
    piece = lambda x: F.transform(x["words"], lambda w, i: F.when(F.array_contains(found["_hits"], i + 1), F.lit("")).otherwise(F.concat(F.get(x["gaps"], i), w)))
    kept = let(both, lambda x: F.concat(F.array_join(piece(x), ""), F.element_at(x["gaps"], -1)))
    text = F.when(found["_hits"].isNull(), docs[text_col]).otherwise(kept)
    return docs.join(found, same, "left").select(*(text.alias(c) if c == text_col else docs[c] for c in docs.columns))


#: The same as the query over `documents` and `benchmark`, in DuckDB's SQL.
SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATOR}'), lambda x: x <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATOR}'), lambda x: x <> '') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least({WINDOW}, len(w)) AS n FROM items WHERE len(w) > 0))
), sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
), found AS (SELECT r, i, d.n, item_id FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.s = b.s
), hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r
), named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
