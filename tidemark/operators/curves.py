"""Log-liquidity curves: normalised ticks, dense matrices, and windows over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip
from tidemark.operators.ordered import quantiles

HALF_WIDTH = 50


def normalised(liquidity: DataFrame, after_s: int, until_s: int | DataFrame | None, centered: bool = False) -> DataFrame:
    """Rows with after_s < hour_s <= until_s, with tick_norm in [-1, 1] around tick 0 (centered) or the pool's tick, and logl.

    Without until_s the bound is the table's own last hour, with another table (hour_s) that table's last hour; an empty one
    leaves no row. Ticks further out than HALF_WIDTH pile up at the ends, so whole ticks have 2 * HALF_WIDTH + 1 places."""
    rows = liquidity.filter(F.col("hour_s") > after_s)
    if isinstance(until_s, DataFrame):
        last = until_s.agg(F.max("hour_s").alias("_until"))
        rows = rows.join(F.broadcast(last), F.col("hour_s") <= F.col("_until")).drop("_until")
    elif until_s is not None:
        rows = rows.filter(F.col("hour_s") <= until_s)
    reference = F.lit(0.0) if centered else F.col("poolTick").cast("double")
    return rows.select("hour_s", "tickLower", "poolTick", "active_liquidity_L", clip((F.col("tickLower").cast("double") - reference) / HALF_WIDTH, -1.0, 1.0).alias("tick_norm"), F.log1p(F.col("active_liquidity_L").cast("double")).alias("logl"))


def surface(curves: DataFrame) -> DataFrame:
    """(hour_s, tick_norm, logl): the mean of each cell; cells without rows are absent."""
    return curves.groupBy("hour_s", "tick_norm").agg(F.avg("logl").alias("logl"))


def _scattered(curves: DataFrame) -> DataFrame:
    """(hour_s, ticks, y): an hour's cells are placed in an array along the axis of ticks by one aggregation.

    Sums are made by cell before an hour's cells meet; an hour has as many of them as there are ticks, some hundred."""
    cells = curves.groupBy("hour_s", "tick_norm").agg(F.sum("active_liquidity_L").alias("total"))
    axis = cells.agg(F.array_sort(F.collect_set("tick_norm")).alias("ticks"))
    held = cells.groupBy("hour_s").agg(F.map_from_entries(F.collect_list(F.struct("tick_norm", "total"))).alias("held"))
    y = F.transform("ticks", lambda x: F.log1p(F.coalesce(F.col("held")[x], F.lit(0.0))))
    return held.crossJoin(F.broadcast(axis)).select("hour_s", "ticks", y.alias("y"))


def dense(curves: DataFrame) -> DataFrame:
    """(hour_s, j, tick_norm, value): log1p of each cell's sum, 0 in empty cells; j is the tick's place from 0.

    The axes are the distinct hours and ticks."""
    cells = _scattered(curves).select("hour_s", F.posexplode(F.arrays_zip("ticks", "y")).alias("j", "v"))
    return cells.select("hour_s", "j", F.col("v.ticks").alias("tick_norm"), F.col("v.y").alias("value"))


def dense_rows(curves: DataFrame) -> DataFrame:
    """dense() as (t, y): one array for each hour."""
    return _scattered(curves).select(F.col("hour_s").alias("t"), "y")


def as_rows(cells: DataFrame, time: str = "hour_s", value: str = "value") -> DataFrame:
    """(t, y): one array for each time, in the order of j."""
    return cells.groupBy(F.col(time).alias("t")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", value))), lambda x: x[value]).alias("y"))


def quantile_windows(rows: DataFrame, by: str = "hour_s", n: int = 4) -> DataFrame:
    """rows with `window` 0 .. n - 1 by linearly interpolated quantiles over the rows; equal values stay together.

    Quantiles that coincide raise."""
    edges = quantiles(rows, by, [i / n for i in range(n + 1)]).select(F.col("quantiles").alias("_whole"), F.slice("quantiles", 2, n - 1).alias("_edges"))
    checked = F.when(F.size(F.array_distinct("_whole")) == n + 1, F.col("_edges")).otherwise(F.raise_error(F.lit("quantiles coincide")).cast("array<double>"))
    window = F.size(F.filter("_edges", lambda e: e < F.col(by))).alias("window")
    return rows.crossJoin(F.broadcast(edges.select(checked.alias("_edges")))).select(*rows.columns, window)


def statistics(rows: DataFrame, *keys: str, value: str = "logl") -> DataFrame:
    """Mean and sample deviation by keys; one row gives a null deviation."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def equal_windows(rows: DataFrame, n_rows: int, n: int = 4, rest: str = "drop", rn: str = "rn") -> DataFrame:
    """rows with `window` by place: n runs of n_rows // n rows; what is left over is dropped or goes to the last."""
    if rest not in ("drop", "last"):
        raise ValueError("rest must be drop or last")
    size = n_rows // n
    if not size:
        raise ValueError("fewer rows than windows")
    window = F.floor(F.col(rn) / size).cast("int")
    out = rows.withColumn("window", window if rest == "drop" else F.least(window, F.lit(n - 1)))
    return out.filter(F.col("window") < n)


def hopping_windows(rows: DataFrame, n_rows: int, size: int, step: int, rn: str = "rn") -> DataFrame:
    """rows with window_id: each row once for every window [id * step, id * step + size) that lies within n_rows and holds it.

    Windows count rows, not time."""
    lower = F.greatest(F.lit(0), F.ceil((F.col(rn) - size + 1) / step)).cast("int")
    upper = F.least(F.lit((n_rows - size) // step if n_rows >= size else -1), F.floor(F.col(rn) / step)).cast("int")
    return rows.withColumn("_lo", lower).withColumn("_hi", upper).filter("_lo <= _hi").withColumn("window_id", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
