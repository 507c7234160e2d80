"""Candles, the depeg replay, and venue usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.operators.ordered import gaps, numbered, quantiles

OHLC = ("open", "high", "low", "close")
K_START, K_STOP, K_STEP = 2, 400, 4


def _need(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns needed: {', '.join(missing)}")


def median_gap(df: DataFrame, time: str = "hour_s", default: float = 60.0) -> DataFrame:
    """One row (gap): the median distance of neighbouring times in seconds, `default` with fewer than two."""
    return quantiles(gaps(df, time), "gap", [0.5]).select(F.coalesce(F.get("quantiles", 0), F.lit(default)).alias("gap"))


def candles(df: DataFrame, time: str = "hour_s", default_gap: float = 60.0) -> DataFrame:
    """Bodies to draw: (time, height, bottom, green, width, low, high). A candle with equal open and close isn't green."""
    _need(df, OHLC)
    height = F.col("close") - F.col("open")
    bottom = F.when(height > 0, F.col("open")).otherwise(F.col("close") + F.abs(height))
    return df.crossJoin(F.broadcast(median_gap(df, time, default_gap))).select(time, height.alias("height"), bottom.alias("bottom"), (height > 0).alias("green"), (F.col("gap") * 0.8).alias("width"), "low", "high")


def replay_frames(candle_rows: DataFrame, center: int, half: int, start: int = K_START, stop: int = K_STOP, step: int = K_STEP, time: str = "hour_s") -> DataFrame:
    """(k, rn, time, open, high, low, close): frame k shows the first k candles from center - half on."""
    frames = candle_rows.sparkSession.range(start, stop, step).select(F.col("id").alias("k"))
    rows = numbered(candle_rows, time).filter((F.col("rn") >= center - half) & (F.col("rn") < center - half + stop))
    return rows.join(F.broadcast(frames), F.col("rn") - (center - half) < F.col("k")).select("k", "rn", time, *OHLC)


def replay_prices(candle_rows: DataFrame, prices: DataFrame, center: int, half: int, start: int = K_START, stop: int = K_STOP, step: int = K_STEP, time: str = "hour_s") -> DataFrame:
    """(k, cutoff, timestamp, price): the pool prices before a frame's last candle, a row for each frame and price that it shows.

    Frames are (stop - start) / step at most, so they are sent to the prices. replay_price_sums() needs no such rows.
    A price text that isn't a number raises."""
    cutoffs = replay_frames(candle_rows, center, half, start, stop, step, time).groupBy("k").agg(F.max(time).alias("cutoff"))
    return prices.select("timestamp", F.col("token1Price").cast("double").alias("price")).join(F.broadcast(cutoffs), F.col("timestamp") < F.col("cutoff")).select("k", "cutoff", "timestamp", "price")


def replay_price_sums(candle_rows: DataFrame, prices: DataFrame, center: int, half: int, start: int = K_START, stop: int = K_STOP, step: int = K_STEP, time: str = "hour_s") -> DataFrame:
    """(k, cutoff, n, last_s, total): number, last time and sum of each frame's replay_prices, without a row for each frame and price.

    A price is counted once, at the first cutoff after it; frames then add up over the cutoffs, of which there is one for each frame at most."""
    cutoffs = replay_frames(candle_rows, center, half, start, stop, step, time).groupBy("k").agg(F.max(time).alias("cutoff"))
    edges = cutoffs.agg(F.array_sort(F.collect_set("cutoff")).alias("edges"))
    priced = prices.select("timestamp", F.col("token1Price").cast("double").alias("price")).crossJoin(F.broadcast(edges))
    first = F.get(F.filter("edges", lambda e: e > F.col("timestamp")), 0)
    sums = priced.select(first.alias("cutoff"), "timestamp", "price").filter("cutoff IS NOT NULL").groupBy("cutoff").agg(F.count("*").alias("n"), F.max("timestamp").alias("last_s"), F.sum("price").alias("total"))
    upto = Window.orderBy("cutoff").rangeBetween(Window.unboundedPreceding, 0)  # a row for each frame
    rows = cutoffs.join(F.broadcast(sums), "cutoff", "left")
    one = F.row_number().over(Window.partitionBy("cutoff").orderBy("k")) == 1  # frames of one cutoff show the same prices
    added = rows.withColumn("one", one).select("k", "cutoff", *(F.when(F.col("one"), F.col(c)).alias(c) for c in ("n", "total")), "last_s")
    return added.select("k", "cutoff", F.sum("n").over(upto).alias("n"), F.max("last_s").over(upto).alias("last_s"), F.sum("total").over(upto).alias("total")).filter("n IS NOT NULL")


def replay_bounds(candle_rows: DataFrame, center: int, half: int, stop: int = K_STOP, step: int = K_STEP, time: str = "hour_s", head_room: float = 0.04) -> DataFrame:
    """(y0, y1) for all frames: the last two candles of the last frame don't count."""
    rows = numbered(candle_rows, time).filter((F.col("rn") >= center - half) & (F.col("rn") < center - half + stop - step))
    return rows.agg(F.min("low").alias("y0"), (F.max("high") + head_room).alias("y1"))


def overlay(**series: DataFrame) -> DataFrame:
    """Series under one another with a label; their times aren't aligned."""
    out = None
    for label, df in series.items():
        df = df.withColumn("series", F.lit(label))
        out = df if out is None else out.unionByName(df)
    return out


def venue_usage(metrics: DataFrame, balances: DataFrame, fee_tier: int = 100, since_s: int = 0) -> DataFrame:
    """(series, s, usage, tvl): hourly volume over value locked for a fee tier's pool and for the stableswap pool from a time on."""
    pool = metrics.filter(F.col("feeTier") == fee_tier).select("s", ratio(F.col("net_amountUSD"), F.col("tvlUSD")).alias("usage"), F.col("tvlUSD").alias("tvl"))
    swap = balances.filter(F.col("hour_s") >= since_s).select(F.col("hour_s").alias("s"), ratio(F.col("hourlyVolumeUSD"), F.col("totalValueLockedUSD")).alias("usage"), F.col("totalValueLockedUSD").alias("tvl"))
    return overlay(concentrated=pool, stableswap=swap)
