"""What several operators need: the shared folder, written tables, joins by weighed keys, and folds."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: dict[str, SparkSession] = {}
#: Keys that weighed() sends to every executor at most; a key with fewer rows than LIGHT is never one of them.
HEAVY_KEYS, LIGHT = 200_000, 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a temporary one (tests), and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(clean_up)
    _SCRATCH[path] = spark
    return path


def clean_up() -> None:
    """Deletes every table of written() that is left; results that still read them end with that."""
    while _SCRATCH:
        path, spark = _SCRATCH.popitem()
        try:
            delete(spark, path)
        except Exception:  # the session may have stopped before
            return


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """df as a table in the shared folder, read back: its lineage is cut, and lost executors lose nothing of it.

    batch_bytes: what a Python worker gets at once while it is made, about; the session's own bound otherwise."""
    spark, path, key = df.sparkSession, new_dir(df.sparkSession, name), "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    if batch_bytes:
        spark.conf.set(key, f"{batch_bytes}b")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows that discard() takes."""
    table = spark.createDataFrame([], schema)
    table._scratch = None
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read any more."""
    for table in tables:
        path = table._scratch
        if _SCRATCH.pop(path, None):
            delete(table.sparkSession, path)


def settle(spark: SparkSession) -> None:
    """Has the driver drop what the steps so far have left: their plans, and the broadcasts and shuffles that go with these.

    Many short steps leave little each, so that the JVM would rather widen its heap than clear it."""
    gc.collect()  # a plan lives as long as Python has its DataFrame
    spark.sparkContext._jvm.System.gc()


def weighed(rows: DataFrame, table: DataFrame, key: str, weight: str, n_rows: int, how: str = "inner") -> DataFrame:
    """rows joined with table (one row a key) by key, inner or left; weight, a column of table, tells how many of the rows have the key.

    Keys of more than LIGHT rows that have more than one in HEAVY_KEYS of all n_rows, HEAVY_KEYS of them at most, are sent to every
    executor, so that no task gets all rows of such a key. Only the rows of other keys are shuffled."""
    heavy = table.filter(F.col(weight) > max(LIGHT, n_rows // HEAVY_KEYS))
    light = table.filter(F.col(weight) <= max(LIGHT, n_rows // HEAVY_KEYS))
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return rows.join(F.broadcast(heavy), key).unionByName(rest)


def fold(id_col: str) -> Column:
    """crc32 of an id as text, by which rows are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))
