"""Concentrated liquidity: books by tick, swap depth, hourly frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite, tick_sqrt_price
from tidemark.operators.ordered import running_sum

HOUR = 3600


def latest_snapshot(book: DataFrame, time: str = "timestamp") -> DataFrame:
    """The rows with the greatest time."""
    last = book.agg(F.max(time).alias("_last"))
    return book.join(F.broadcast(last), F.col(time) == F.col("_last")).drop("_last")


def liquidity_by_tick(book: DataFrame, order: str, duplicates: str = "last", reach: int | None = None) -> DataFrame:
    """(tick, L) of every tick in [tickLower, tickUpper). Where intervals overlap, the last one by `order` counts, or their sum.

    With reach only ticks less than so far from the row's poolTick, [poolTick - reach, poolTick + reach): intervals are cut before they are spread."""
    if duplicates not in ("last", "sum"):
        raise ValueError("duplicates must be last or sum")
    low, high = F.col("tickLower").cast("int"), F.col("tickUpper").cast("int")
    if reach is not None:
        at = F.col("poolTick").cast("int")
        low, high = F.greatest(low, at - reach), F.least(high, at + reach)
    rows = book.filter(low < high).select(F.explode(F.sequence(low, high - 1)).alias("tick"), F.col("active_liquidity_L").cast("double").alias("L"), F.col(order).alias("_order"))
    value = F.sum("L") if duplicates == "sum" else F.max_by("L", "_order")
    return rows.groupBy("tick").agg(value.alias("L"))


def swap_size_curve(book: DataFrame, k_max: int = 50, fee: float = 0.0, tick_step: int = 1, order: str = "tickLower") -> DataFrame:
    """(k_ticks, token1_in_to_move_up, token0_in_to_move_down, tick_up, tick_down, timestamp) for k = 1 .. k_max from the latest snapshot, whose time is returned.

    A tick without liquidity on the way raises, and so does a snapshot of several pool ticks. Intervals are cut to what is within reach before they are spread to ticks."""
    snap = latest_snapshot(book)
    reach = k_max * tick_step
    unique = F.when(F.min("poolTick") == F.max("poolTick"), F.min("poolTick").cast("int")).when(F.count("*") > 0, F.raise_error(F.lit("a snapshot has several pool ticks")).cast("int"))
    at = snap.agg(unique.alias("cur"), F.max("timestamp").alias("timestamp"))
    ticks = liquidity_by_tick(snap, order, reach=reach).crossJoin(F.broadcast(at))
    low, high = tick_sqrt_price(F.col("tick")), tick_sqrt_price(F.col("tick") + 1)
    up = F.col("tick") >= F.col("cur")
    step = F.when(up, F.col("tick") - F.col("cur")).otherwise(F.col("cur") - 1 - F.col("tick"))
    sized = ticks.select("cur", up.alias("up"), (F.floor(step / tick_step) + 1).alias("k"), F.when(up, F.col("L") * (high - low)).otherwise(F.col("L") * (1.0 / low - 1.0 / high)).alias("amount"))
    wanted = book.sparkSession.range(1, k_max + 1).select(F.col("id").alias("k")).crossJoin(F.broadcast(at))
    per_k = sized.groupBy("k").agg(F.sum(F.when(F.col("up"), F.col("amount"))).alias("a_up"), F.sum(F.when(~F.col("up"), F.col("amount"))).alias("a_down"), F.count("*").alias("n"))
    whole = F.when(F.coalesce("n", F.lit(0)) == 2 * tick_step, F.lit(True)).otherwise(F.raise_error(F.lit("a tick within reach has no liquidity")).cast("boolean"))
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # k_max rows
    return wanted.join(per_k, "k", "left").filter(whole).select(
        (F.col("k") * tick_step).alias("k_ticks"), (F.sum("a_up").over(w) / (1.0 - fee)).alias("token1_in_to_move_up"), (F.sum("a_down").over(w) / (1.0 - fee)).alias("token0_in_to_move_down"),
        (F.col("cur") + F.col("k") * tick_step).alias("tick_up"), (F.col("cur") - F.col("k") * tick_step).alias("tick_down"), "timestamp",
    )


#: Doubles are cut into whole numbers of so many bits.
LIMB = 32


def limbs(value: Column) -> Column:
    """A finite double as an array of (bin, limb): the sum of limb * 2^(LIMB * bin) is the value, exactly, and no limb is 0.

    Sums of limbs are whole numbers, so that what is added can be taken off again without a trace, in any order."""
    size = F.abs(value)
    top = F.least(F.lit(1023 // LIMB), F.floor(F.log2(size) / LIMB) + 1)  # a logarithm may be one too small at a power of two
    sign = F.when(value < 0, -1).otherwise(1).cast("long")

    def cut(rest: Column, bin: Column) -> Column:
        """What is left of rest below a bin, and the limb in it."""
        root = _root(bin)
        limb = F.floor(rest / root / root)
        return F.struct((rest - limb.cast("double") * root * root).alias("rest"), bin.alias("bin"), limb.alias("limb"))

    first = F.array(cut(size, top.cast("int")))
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(3)), first, lambda s, _: F.concat(s, F.array(cut(F.element_at(s, -1)["rest"], F.element_at(s, -1)["bin"] - 1))))
    found = F.filter(F.transform(steps, lambda x: F.struct(x["bin"].alias("bin"), (x["limb"] * sign).alias("limb"))), lambda x: x["limb"] != 0)
    return F.when(size > 0, found)


def _root(bin: Column) -> Column:
    """The square root of a bin's unit, as the smallest unit itself is no double."""
    return F.pow(F.lit(2.0), (bin * (LIMB // 2)).cast("double"))


def from_limbs(found: Column) -> Column:
    """The double of an array of (bin, limb), a limb for each bin; added from the smallest bin on."""
    return F.aggregate(F.array_sort(found), F.lit(0.0), lambda s, x: s + x["limb"].cast("double") * _root(x["bin"]) * _root(x["bin"]))


def position_liquidity(grid: DataFrame, positions: DataFrame, p: str = "p") -> DataFrame:
    """(p, liquidity): the sum over positions with pa <= p <= pb, 0 where there is none. Null or NaN points and bounds meet nothing; liquidity that isn't finite raises.

    One sweep over bounds and points by price: a position's liquidity is added at pa and taken off after pb, as whole numbers,
    so that nothing is left of it however large it was beside others. No point meets a position."""
    sound = lambda c: c.isNotNull() & ~F.isnan(c)
    amount = F.when(finite(F.col("liquidity")), F.col("liquidity")).when(F.col("liquidity").isNotNull(), F.raise_error(F.lit("liquidity isn't finite")).cast("double"))
    valid = positions.select(*(F.col(c).cast("double").alias(c) for c in ("pa", "pb", "liquidity"))).filter(sound(F.col("pa")) & sound(F.col("pb")) & (F.col("pa") <= F.col("pb")))
    cut = valid.select("pa", "pb", F.explode(limbs(amount)).alias("x")).groupBy("pa", "pb", "x.bin").agg(F.sum("x.limb").alias("limb"))
    bounds = F.array(F.struct(F.col("pa").alias("at"), F.lit(0).alias("kind"), F.col("limb").alias("limb")), F.struct(F.col("pb").alias("at"), F.lit(2).alias("kind"), (-F.col("limb")).alias("limb")))
    changes = cut.select("bin", F.explode(bounds).alias("b")).groupBy("bin", "b.at", "b.kind").agg(F.sum("b.limb").alias("limb"))
    points = grid.select(F.col(p).cast("double").alias("at")).groupBy("at").agg(F.count("*").alias("copies"))
    bins = changes.select("bin").distinct()  # 66 at most
    asked = points.filter(sound(F.col("at"))).crossJoin(F.broadcast(bins)).select("bin", "at", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("limb"))
    swept = running_sum(changes.unionByName(asked), ["at", "kind"], "limb", "upto", by=["bin"]).filter("kind = 1")
    found = swept.groupBy("at").agg(F.collect_list(F.struct("bin", F.col("upto").alias("limb"))).alias("limbs")).select("at", from_limbs(F.col("limbs")).alias("sum"))
    rows = points.join(found, points["at"].eqNullSafe(found["at"]), "left").select(points["at"].alias(p), F.coalesce("sum", F.lit(0.0)).alias("liquidity"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return rows.drop("_copy")


def active_tick(rows: DataFrame, by: list[str]) -> DataFrame:
    """The lowest mid price with token0 in it, for each group."""
    return rows.groupBy(*by).agg(F.min(F.when(F.col("usd_token0") > 0, F.col("priceMid"))).alias("active"))


def tick_bars(liquidity: DataFrame, hour_s: int) -> DataFrame:
    """One hour by price: (priceMid, usd_token0, usd_token1, width, active); width is 0.8 of the smallest gap."""
    rows = liquidity.filter(F.col("hour_s") == hour_s)
    gap = F.col("priceMid") - F.lag("priceMid").over(Window.partitionBy("hour_s").orderBy("priceMid"))
    width = rows.select("hour_s", gap.alias("gap")).groupBy("hour_s").agg((F.min("gap") * 0.8).alias("width"))
    return rows.join(F.broadcast(width), "hour_s").join(F.broadcast(active_tick(rows, ["hour_s"])), "hour_s").select("priceMid", "usd_token0", "usd_token1", "width", "active").orderBy("priceMid")


def total_curve(liquidity: DataFrame, hour_s: int) -> DataFrame:
    """(priceMid, usd_total) at one hour."""
    return liquidity.filter(F.col("hour_s") == hour_s).select("priceMid", "usd_total").orderBy("priceMid")


def hourly_frames(liquidity: DataFrame, start_s: int, hours: int = 400) -> DataFrame:
    """(frame, hour_s, n, width, active): one row for each hour from start_s on, also for hours without rows.

    width is 0.8 of the hour's smallest price gap, 0.0001 with fewer than two ticks, null without any."""
    spine = liquidity.sparkSession.range(hours).select(F.col("id").alias("frame"), (F.lit(start_s) + F.col("id") * HOUR).alias("hour_s"))
    rows = liquidity.filter(F.col("hour_s").between(start_s, start_s + (hours - 1) * HOUR))
    gap = F.col("priceMid") - F.lag("priceMid").over(Window.partitionBy("hour_s").orderBy("priceMid"))
    per = rows.select("hour_s", "priceMid", "usd_token0", gap.alias("gap")).groupBy("hour_s").agg(F.count("*").alias("n"), F.coalesce(F.min("gap") * 0.8, F.lit(0.0001)).alias("width"), F.min(F.when(F.col("usd_token0") > 0, F.col("priceMid"))).alias("active"))
    return spine.join(per, "hour_s", "left").select("frame", "hour_s", F.coalesce("n", F.lit(0)).alias("n"), "width", "active")


def frame_bars(liquidity: DataFrame, start_s: int, hours: int = 400) -> DataFrame:
    """(frame, hour_s, priceMid, usd_token0, usd_token1, width, active): the bars of every frame of hourly_frames(), by price. A frame without rows has one, with nulls."""
    frames = hourly_frames(liquidity, start_s, hours).select("frame", "hour_s", "width", "active")
    rows = liquidity.filter(F.col("hour_s").between(start_s, start_s + (hours - 1) * HOUR)).select("hour_s", "priceMid", "usd_token0", "usd_token1")
    return frames.join(rows, "hour_s", "left").select("frame", "hour_s", "priceMid", "usd_token0", "usd_token1", "width", "active")


def frame_limits(liquidity: DataFrame, start_s: int, hours: int = 400) -> DataFrame:
    """(xmin, xmax, ymin, ymax) that all frames share; ymax is 1 without rows. Prices and totals that aren't finite don't count."""
    rows = liquidity.filter(F.col("hour_s").between(start_s, start_s + (hours - 1) * HOUR))
    total, price = F.coalesce("usd_token0", F.lit(0.0)) + F.coalesce("usd_token1", F.lit(0.0)), F.when(finite(F.col("priceMid")), F.col("priceMid"))
    top = F.max(F.when(finite(total), total))
    return rows.agg((F.min(price) - 0.002).alias("xmin"), (F.max(price) + 0.002).alias("xmax"), F.lit(0.0).alias("ymin"), F.coalesce(top * 1.05, F.lit(1.0)).alias("ymax"))
