"""Stableswap invariant, quotes, and the liquidity that it implies. Amounts are in tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.operators.ordered import CELLS, around, around_by_key
from tidemark.sources.tables import linspace, logspace

STEPS = 64
COINS = ("DAI", "USDC", "USDT")
QUOTES = (("usdc_usdt", 1, 2), ("dai_usdc", 0, 1), ("usdt_dai", 2, 0))


def invariant_d(balances: list[Column], a: Column, steps: int = STEPS) -> Column:
    """Newton's iteration for D from the sum of balances; 0 for empty pools. A fixed point stays where it is."""
    n = len(balances)
    total = reduce(lambda x, y: x + y, balances)
    ann = a * n

    def step(d: Column, _: Column) -> Column:
        dp = reduce(lambda acc, x: acc * d / (x * n), balances, d)
        return (ann * total + dp * n) * d / ((ann - 1) * d + dp * (n + 1))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), total, step)
    return F.when(total == 0, 0.0).otherwise(found)


def balance_y(others: list[Column], d: Column, a: Column, n: int) -> Column:
    """The balance that completes `others` (n - 1 of them, in coin order) to the invariant: the positive root."""
    c = reduce(lambda acc, x: acc * d / (x * n), others, d) * d / (a * n * n)
    beta = reduce(lambda x, y: x + y, others) + d / (a * n) - d
    root = F.sqrt(beta * beta + c * 4)
    return F.when(beta > 0, c * 2 / (beta + root)).otherwise((root - beta) / 2)


def spot_rate(balances: list[Column], i: int, j: int, d: Column, a: Column, fee: float = 0.0, dx: float = 1.0) -> Column:
    """Coin j received for each coin i when dx of coin i is paid in."""
    others = [x + dx if k == i else x for k, x in enumerate(balances) if k != j]
    return (balances[j] - balance_y(others, d, a, len(balances))) * (1.0 - fee) / dx


def quotes(pool: DataFrame, a: float | DataFrame = 4000.0, fee: float = 0.0, dx: float = 1.0, time: str = "hour_s") -> DataFrame:
    """(time, d, usdc_usdt, dai_usdc, usdt_dai) from bal_DAI, bal_USDC, bal_USDT; null where a balance is missing or not positive.

    a is a constant or a DataFrame (time, a); a time without one raises when its row is read."""
    if isinstance(a, DataFrame):
        pool = pool.join(a.select(time, F.col("a").cast("double").alias("_a")), time, "left")
        pool = pool.withColumn("_a", F.coalesce("_a", F.raise_error(F.lit("no amplification for a time")).cast("double")))
    else:
        pool = pool.withColumn("_a", F.lit(float(a)))
    balances = [F.col(f"bal_{c}") for c in COINS]
    sound = reduce(lambda x, y: x & y, (b.isNotNull() & ~F.isnan(b) & (b > 0) for b in balances))
    # D is a column of its own, so that three quotes share one solution
    solved = pool.select(time, *balances, F.col("_a"), F.when(sound, invariant_d(balances, F.col("_a"))).alias("d"))
    return solved.select(time, "d", *(F.when(sound, spot_rate(balances, i, j, F.col("d"), F.col("_a"), fee, dx)).alias(name) for name, i, j in QUOTES))


def balance_shares(pool: DataFrame, time: str = "hour_s") -> DataFrame:
    """Stacked shares: DAI, DAI and USDT, all three."""
    dai, usdt, usdc = F.col("w_DAI"), F.col("w_USDT"), F.col("w_USDC")
    return pool.select(time, dai.alias("dai"), (dai + usdt).alias("dai_usdt"), (dai + usdt + usdc).alias("all"))


# --- two coins ---
def two_coin_d(x: Column, y: Column, a: Column) -> Column:
    return invariant_d([x, y], a)


def two_coin_y(x: Column, d: Column, a: Column) -> Column:
    return balance_y([x], d, a, 2)


def marginal_price(x: Column, d: Column, a: Column, eps: float = 1e-6) -> Column:
    """-dy/dx by a forward difference."""
    return -(two_coin_y(x * (1.0 + eps), d, a) - two_coin_y(x, d, a)) / (x * eps)


def interpolated(nodes: DataFrame, points: DataFrame, key: str, x: str, y: str, at: str, cells: int | None = CELLS) -> DataFrame:
    """points (key, at, any others) with y linearly interpolated between nodes (key, x, y), constant beyond the first and last node; null for a key without nodes and
    at a place that is null or NaN. Nodes without a place are left out.

    Nodes and points are merged in one order, which is passed once in each direction: no pairs are made. The order is dealt to
    cells, so one key may have any number of rows; where keys are known to be small, cells=None orders each in one task."""
    node = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rest = F.struct(*points.columns)
    both = points.select(key, F.col(at).cast("double").alias("_x"), F.lit(1).alias("_point"), rest.alias("_row")).withColumn("_node", F.lit(None).cast("struct<x: double, y: double>"))
    both = nodes.filter(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(key, F.col(x).cast("double").alias("_x"), F.lit(0).alias("_point"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), node.alias("_node")).unionByName(both)
    order = ["_x", "_point", "_node"]
    found = around_by_key(both, key, order, "_node", "_a", "_b") if cells is None else around(both, order, "_node", "_a", "_b", cells, [key])
    slope = ratio(F.col("_b.y") - F.col("_a.y"), F.col("_b.x") - F.col("_a.x"))
    value = F.when(F.col("_x").isNull() | F.isnan("_x"), None).when(F.col("_a").isNull(), F.col("_b.y")).when(F.col("_b").isNull() | (F.col("_x") == F.col("_a.x")), F.col("_a.y")).otherwise(F.col("_a.y") + slope * (F.col("_x") - F.col("_a.x")))
    return found.filter("_point = 1").select("_row.*", value.alias(y))


def gradient(df: DataFrame, key: str, order: str, f: str, x: str) -> Column:
    """Second-order differences over uneven spacing, one-sided at both ends."""
    w = Window.partitionBy(key).orderBy(order)
    f0, x0 = F.col(f), F.col(x)
    fm, xm, fp, xp = F.lag(f).over(w), F.lag(x).over(w), F.lead(f).over(w), F.lead(x).over(w)
    hs, hd = x0 - xm, xp - x0
    inner = (hs * hs * fp + (hd * hd - hs * hs) * f0 - hd * hd * fm) / (hs * hd * (hs + hd))
    return F.when(fm.isNull(), (fp - f0) / hd).when(fp.isNull(), (f0 - fm) / hs).otherwise(inner)


def pool_densities(pools: DataFrame, xs: DataFrame, prices: DataFrame) -> DataFrame:
    """(pool, i, p, liquidity, relative): |dx / d ln P| of each pool (pool, a, x0, y0) at prices (i, p), and its share of the pool's maximum.

    A pool that lacks a coin has no density. xs (x) are the balances at which the price is taken; x, y and these are in the same unit. Both grids are sent to all tasks, as they
    don't grow with the pools, and a pool's rows are no more than theirs."""
    sound = (F.col("x0") > 0) & (F.col("y0") > 0)
    known = pools.select("pool", "a", F.when(sound, two_coin_d(F.col("x0"), F.col("y0"), F.col("a"))).alias("d"))
    nodes = known.filter("d IS NOT NULL").crossJoin(F.broadcast(xs.select("x"))).select("pool", "x", marginal_price(F.col("x"), F.col("d"), F.col("a")).alias("_p"))
    grid = known.select("pool").crossJoin(F.broadcast(prices.select("i", "p")))
    found = interpolated(nodes, grid, "pool", "_p", "x", "p", None).withColumn("_ln", F.log("p"))
    found = found.withColumn("liquidity", F.abs(gradient(found, "pool", "p", "x", "_ln")))
    return found.select("pool", "i", "p", "liquidity", ratio(F.col("liquidity"), F.max("liquidity").over(Window.partitionBy("pool"))).alias("relative"))


def liquidity_density(spark: SparkSession, amplifications: list[float], p_min: float = 0.98, p_max: float = 1.02, x_min: float = 0.1, x_max: float = 5.0, n_x: int = 3000, n_p: int = 600, x0: float = 1.0, y0: float = 1.0) -> DataFrame:
    """(a, i, p, liquidity, relative): pool_densities() of one pool at several amplifications, over a grid of balances that is even by logarithm."""
    pools = spark.createDataFrame([(float(a), float(a), float(x0), float(y0)) for a in amplifications], "pool double, a double, x0 double, y0 double")
    return pool_densities(pools, logspace(spark, x_min, x_max, n_x), linspace(spark, p_min, p_max, n_p, "p")).withColumnRenamed("pool", "a")


# --- closed forms ---
def invariant_curves(grid: DataFrame, k: float | Column = 6.0, a: float | Column = 4.0, *keep: str) -> DataFrame:
    """(keep, x, y_sum, y_product, y_hybrid, p_sum, p_product, p_hybrid) with c = (k / 2)^2; null where a denominator is 0.

    k is the sum of both balances and a the weight of the sum in the hybrid: numbers, or columns of the grid."""
    x, k, a = F.col("x"), _column(k), _column(a)
    c = k / 2 * (k / 2)
    return grid.select(
        *keep, "x", (k - x).alias("y_sum"), ratio(c, x).alias("y_product"), ratio(a * k + c - a * x, a + x).alias("y_hybrid"),
        F.lit(1.0).alias("p_sum"), ratio(c, x * x).alias("p_product"), ratio(a * a + a * k + c, (a + x) * (a + x)).alias("p_hybrid"),
    )


def _column(v: float | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def empty_at(k: float | Column = 6.0, a: float | Column = 4.0) -> dict[str, Column]:
    """By curve, the balance at which the other coin runs out."""
    k, a = _column(k), _column(a)
    return {"sum": k, "hybrid": (a * k + k / 2 * (k / 2)) / a}


def empty_points(spark: SparkSession, k: float = 6.0, a: float = 4.0) -> DataFrame:
    """empty_at() as rows (curve, x)."""
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(name).alias("curve"), x.alias("x")) for name, x in empty_at(k, a).items()))).alias("r")).select("r.*")


def stableswap_curves(grid: DataFrame, amplifications: list[float], k: float | Column = 6.0, *keep: str) -> DataFrame:
    """(keep, a, x, y) of the two-coin invariant in closed form; k is a number or a column of the grid."""
    amps = grid.sparkSession.createDataFrame([(float(a),) for a in amplifications], "a double")
    x, a, k = F.col("x"), F.col("a"), _column(k)
    u = x + k * k / (4 * a) - k
    return grid.crossJoin(F.broadcast(amps)).select(*keep, "a", "x", (0.5 * (F.sqrt(u * u + k * k * k * k / (4 * a * x)) - u)).alias("y"))
