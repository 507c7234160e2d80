"""The queries of this subpackage: opN_<name> over the whole tables of a data folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, divergence, html_wrapper, language_id, media_gif, ngram_join, packing, periodic_runs, quality, secret_scan, sharding, token_output, toxicity
from tidemark.llm.common import fold, new_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by the shortest code; rows whose id's checksum leaves 2 by 4 teach nothing."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(fold("doc_id") % 4 != 2).select("doc_id", "text", "lang"))
    found = language_id.identify(docs, model)
    return found.select("doc_id", F.coalesce(fold("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of at most 2048."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in the documents: where it stands, its checksum and its share of votes."""
    votes = secret_scan.fit(secret_scan.labelled_findings(spark))
    found = secret_scan.secrets(table(spark, sf_dir, "documents"), votes)
    return found.select("doc_id", "start", "length", F.sha2("secret", 256).alias("secret_sha256"), "score")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of documents with Jaccard similarity of 0.9 or more on three-word shingles."""
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op4_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the number of documents that each one is similar to, links inside a class included."""
    return ngram_join.linked_documents(table(spark, sf_dir, "documents")).drop("set_id")


ARRIVALS = 8


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended in eight batches, compacted, and read back from the newest version."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardedTable(spark, new_dir(spark, "shards"))
    store.append_by(docs.withColumn("arrival", F.coalesce(F.pmod("doc_id", F.lit(ARRIVALS)), F.lit(0))), "arrival")
    store.compact()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


op5_sql = "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents"


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that stand in a benchmark window."""
    return decontam.report(decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token sequences at their global slots, read back from the shards."""
    rows = token_output.training_order(table(spark, sf_dir, "documents"))
    place = F.col("slot") - F.col("shard") * token_output.SHARD_ROWS
    return rows.select("slot", "shard", place.alias("row_in_shard"), "doc_id", "seq_no", "n_tokens", F.length("ids").cast("long").alias("n_bytes"), F.crc32("ids").alias("ids_crc32"))


def op8_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as GIFs, and digests of what decoding them gives back."""
    return media_gif.gif_digest(media_gif.texts_to_gif(table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade, tail probability and whether it is kept; ratings of rows whose id's checksum is divisible by 5 teach nothing."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(fold("doc_id") % 5 != 0))
    held_out = F.coalesce(fold("doc_id") % 5 == 0, F.lit(False)).alias("held_out")
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out, "expected_grade", "tail_prob", quality.keeps().alias("keep"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels of rows whose id's checksum is divisible by 5 teach nothing."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(fold("doc_id") % 5 != 0))
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(fold("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text, by its host's wrapper."""
    found = html_wrapper.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of a language are apart in their words, and each source's own words."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs of words, tails of a tenth of the documents repeated first."""
    return periodic_runs.report(table(spark, sf_dir, "documents"), periodic_runs.repeated)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_packing, op3_secret_scan, op4_ngram_join, op4_ngram_links, op5_sharding, op6_decontamination, op7_training_order, op8_media_gif, op9_quality, op10_toxicity, op11_html_wrapper, op12_source_divergence, op13_periodic_runs)
}
SQL: dict[str, str] = {"op4_ngram_join": ngram_join.SQL, "op4_ngram_links": ngram_join.LINKS_SQL, "op5_sharding": op5_sql, "op6_decontamination": decontam.SQL, "op12_source_divergence": divergence.SQL}
