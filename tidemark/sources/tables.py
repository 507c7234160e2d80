"""Loading: declared columns only, NaN to null."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def load(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table's columns; a missing one raises ValueError. NaN becomes null, so that aggregates skip it."""
    df = spark.read.parquet(path)
    missing = [c for c in columns or [] if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    wanted = columns or df.columns
    real = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in real else F.col(c) for c in wanted))


def linspace(spark: SparkSession, a: float, b: float, n: int, name: str = "x") -> DataFrame:
    """(i, x): n evenly spaced points from a to b, both included."""
    step = (b - a) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(float(a)) + F.lit(step) * F.col("id")).alias(name))


def logspace(spark: SparkSession, a: float, b: float, n: int, name: str = "x") -> DataFrame:
    """(i, x): n points from a to b, evenly spaced by logarithm."""
    return linspace(spark, 0.0, 1.0, n, "_t").select("i", F.pow(F.lit(10.0), F.log10(F.lit(float(a))) + (F.log10(F.lit(float(b))) - F.log10(F.lit(float(a)))) * F.col("_t")).alias(name))


def floored_within(stored: str, unit_s: int, first: int | None = None, last: int | None = None) -> Column:
    """What a stored timestamp must fulfil for floor(its seconds / unit_s) * unit_s to lie in [first, last], in terms of the timestamp itself.

    A logical time that rises with a stored one can be bounded on the stored one: that filter stands below aggregates and
    reaches the scan, where a bound on the computed time doesn't. None is no bound."""
    at = lambda s: F.lit((datetime(1970, 1, 1) + timedelta(seconds=s)).isoformat(" ")).cast("timestamp_ntz")
    bound = F.lit(True)
    if first is not None:
        bound = bound & (F.col(stored) >= at(-(-first // unit_s) * unit_s))
    if last is not None:
        bound = bound & (F.col(stored) < at((last // unit_s + 1) * unit_s))
    return bound


def positioned(spark: SparkSession, path: str, columns: list[str] | None = None, name: str = "pos") -> DataFrame:
    """A Parquet table's columns and `name`, each row's place in the table from 0: files by name, rows as they stand in them.

    Nothing is sorted: a row's place in its file is the reader's, and what stands before a file is a prefix sum over one row for each file.
    These go to every task, as the list of files does, so that the rows of a large file stay in the tasks that read them."""
    df = spark.read.parquet(path)
    wanted = columns or df.columns
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    sizes = df.select(*place).groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return df.select(*wanted, *place).join(F.broadcast(starts), "_file").select(*wanted, (F.col("_start") + F.col("_row")).alias(name))


def last_rows(rows: DataFrame, n: int = 1, place: str = "pos") -> DataFrame:
    """The n rows that stand last; with fewer rows all of them."""
    return rows.orderBy(F.desc(place)).limit(n)


def last_of_each(rows: DataFrame, *keys: str, place: str = "pos") -> DataFrame:
    """One row for each key: the one that stands last.

    Columns are taken one by one, so that numbers are aggregated by hash, without a sort of all rows, and columns that aren't used are left out."""
    return rows.groupBy(*keys).agg(*(F.max_by(F.col(f"`{c}`"), place).alias(c) for c in rows.columns if c not in keys))
