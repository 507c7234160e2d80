"""The logical tables as projections of the stored ones, in Spark and in DuckDB's SQL.

Times are epoch seconds (`hour_s`), so that results don't depend on a session's time zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import tick_price
from tidemark.sources.tables import floored_within, load

HOUR = 3600


def events(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(event_id, event_type, value, s, hour_s) with first <= hour_s <= last; the bounds are put on the stored time, so that the scan skips the rest."""
    df = load(spark, f"{sf_dir}/events.parquet", ["event_id", "ts", "event_type", "value"])
    if first is not None or last is not None:
        df = df.filter(floored_within("ts", HOUR, first, last))
    s = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return df.select("event_id", "event_type", "value", s.alias("s"), (F.floor(s / HOUR) * HOUR).alias("hour_s"))


def klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles: (hour_s, open, high, low, close)"""
    return events(spark, sf_dir).groupBy("hour_s").agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"))


def pool_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(timestamp, token1Price as text)"""
    return events(spark, sf_dir).select("event_id", F.col("s").alias("timestamp"), F.col("value").cast("string").alias("token1Price"))


def pool_balances(spark: SparkSession, sf_dir: str, first: int | None = None) -> DataFrame:
    """Hourly balances, shares and volume from an hour on; every 50th hour has no DAI."""
    part = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0))
    df = events(spark, sf_dir, first).groupBy("hour_s").agg((part("view") + 1000).alias("bal_DAI"), (part("click") + 1000).alias("bal_USDC"), (part("purchase") + 1000).alias("bal_USDT"), part("error").alias("hourlyVolumeUSD"))
    df = df.withColumn("bal_DAI", F.when(F.col("hour_s") / HOUR % 50 == 0, 0.0).otherwise(F.col("bal_DAI")))
    total = F.col("bal_DAI") + F.col("bal_USDC") + F.col("bal_USDT")
    return df.select("*", *((F.col(f"bal_{c}") / total).alias(f"w_{c}") for c in ("DAI", "USDC", "USDT")), total.alias("totalValueLockedUSD"))


def hourly_liquidity(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """One row for each hour and tick, first <= hour_s <= last: (hour_s, tickLower, tickUpper, active_liquidity_L, poolTick, priceMid, usd_token0, usd_token1, usd_total)"""
    df = events(spark, sf_dir, first, last).groupBy("hour_s", ((F.col("event_id") * 37) % 151 - 75).cast("int").alias("tickLower")).agg(F.sum("value").alias("active_liquidity_L"))
    df = df.withColumn("poolTick", ((F.col("hour_s") / HOUR % 24 % 7) - 3).cast("int"))
    above = F.col("tickLower") >= F.col("poolTick")
    return df.select(
        "hour_s", "tickLower", (F.col("tickLower") + 1).alias("tickUpper"), "active_liquidity_L", "poolTick", tick_price(F.col("tickLower") + 0.5).alias("priceMid"),
        F.when(above, F.col("active_liquidity_L")).otherwise(0.0).alias("usd_token0"), F.when(above, 0.0).otherwise(F.col("active_liquidity_L")).alias("usd_token1"), F.col("active_liquidity_L").alias("usd_total"),
    )


def tick_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense book around tick 0: (timestamp, tickLower, tickUpper, poolTick, active_liquidity_L, entry)

    Two snapshots, the earlier one around another tick. In the later one every tenth entry is followed by a wider one that
    overlaps it and its neighbours."""
    part = load(spark, f"{sf_dir}/part.parquet", ["p_partkey", "p_retailprice"])
    half = part.agg((F.count("*") / 2).cast("int").alias("half"))
    low = (F.col("p_partkey") - F.col("half")).cast("int")
    entry = lambda time, lower, upper, pool, times, place: F.struct(F.lit(time).cast("long").alias("timestamp"), lower.alias("tickLower"), upper.alias("tickUpper"), F.lit(pool).alias("poolTick"), (F.col("p_retailprice") * (1e6 * times)).alias("active_liquidity_L"), place.alias("entry"))
    wide = F.when(F.col("p_partkey") % 10 == 0, entry(HOUR, low - 1, low + 2, 0, 2.0, F.col("p_partkey") + 1_000_000_000))
    rows = F.array(entry(0, low, low + 1, 5, 3.0, F.col("p_partkey")), entry(HOUR, low, low + 1, 0, 1.0, F.col("p_partkey")), wide)
    return part.crossJoin(F.broadcast(half)).select(F.explode(rows).alias("r")).filter("r IS NOT NULL").select("r.*")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(position, pa, pb, liquidity): price intervals of liquidity"""
    part = load(spark, f"{sf_dir}/part.parquet", ["p_partkey", "p_size", "p_retailprice"])
    return part.select(F.col("p_partkey").alias("position"), tick_price(F.col("p_size") - 50.0).alias("pa"), tick_price(F.col("p_size") - 30.0).alias("pb"), F.col("p_retailprice").alias("liquidity"))


def venue_metrics(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(s, event_id, feeTier, net_amountUSD, tvlUSD) of the hours from first to last; some tvlUSD are 0"""
    tier = F.when(F.col("event_type") == "view", 100).when(F.col("event_type") == "click", 500).otherwise(3000)
    return events(spark, sf_dir, first, last).select("event_id", "s", tier.alias("feeTier"), F.col("value").alias("net_amountUSD"), ((F.col("event_id") % 7) * 1000.0).alias("tvlUSD"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, y array<double>): one curve for each row of the embeddings"""
    return load(spark, f"{sf_dir}/embeddings.parquet", ["vec_id", "embedding"]).select(F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("y"))


#: The same projections in SQL, to stand in a WITH clause in this order.
SQL = {
    "ev": "SELECT event_id, event_type, value, epoch(ts)::BIGINT - CASE WHEN epoch(ts)::BIGINT > epoch(ts) THEN 1 ELSE 0 END AS s FROM events",
    "evh": f"SELECT *, (s // {HOUR}) * {HOUR} AS hour_s FROM ev",
    "klines": "SELECT hour_s, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close FROM evh GROUP BY 1",
    "bal": "SELECT hour_s, CASE WHEN (hour_s // 3600) % 50 = 0 THEN 0.0 ELSE sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) + 1000 END AS bal_DAI, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) + 1000 AS bal_USDC, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) + 1000 AS bal_USDT, sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS hourlyVolumeUSD FROM evh GROUP BY 1",
    "pool_balances": "SELECT *, bal_DAI / totalValueLockedUSD AS w_DAI, bal_USDC / totalValueLockedUSD AS w_USDC, bal_USDT / totalValueLockedUSD AS w_USDT FROM (SELECT *, bal_DAI + bal_USDC + bal_USDT AS totalValueLockedUSD FROM bal)",
    "liq": "SELECT hour_s, ((event_id * 37) % 151 - 75)::INT AS tickLower, sum(value) AS L, (((hour_s // 3600) % 24) % 7 - 3)::INT AS poolTick FROM evh GROUP BY ALL",
    "hourly_liquidity": "SELECT hour_s, tickLower, L AS active_liquidity_L, poolTick, power(1.0001::DOUBLE, tickLower + 0.5) AS priceMid, CASE WHEN tickLower >= poolTick THEN L ELSE 0.0 END AS usd_token0, CASE WHEN tickLower >= poolTick THEN 0.0 ELSE L END AS usd_token1 FROM liq",
    "low": "SELECT p_partkey, (p_partkey - (SELECT count(*) // 2 FROM part))::INT AS low, p_retailprice * 1e6 AS L FROM part",
    "tick_book": "SELECT 0 AS ts, low AS tickLower, low + 1 AS tickUpper, L * 3 AS L, p_partkey AS entry FROM low UNION ALL SELECT 3600, low, low + 1, L, p_partkey FROM low UNION ALL SELECT 3600, low - 1, low + 2, L * 2, p_partkey + 1000000000 FROM low WHERE p_partkey % 10 = 0",
    "latest_ticks": "SELECT tick, arg_max(L, entry) AS L, sum(L) AS total FROM (SELECT unnest(range(tickLower, tickUpper))::INT AS tick, L, entry FROM tick_book WHERE ts = (SELECT max(ts) FROM tick_book)) GROUP BY tick",
    "positions": "SELECT power(1.0001::DOUBLE, p_size - 50.0) AS pa, power(1.0001::DOUBLE, p_size - 30.0) AS pb, p_retailprice AS liquidity FROM part",
    "venue_metrics": "SELECT event_id, s, CASE event_type WHEN 'view' THEN 100 WHEN 'click' THEN 500 ELSE 3000 END AS feeTier, value AS net_amountUSD, (event_id % 7) * 1000.0::DOUBLE AS tvlUSD FROM ev",
    "cells": "SELECT vec_id AS t, unnest(range(0, len(embedding))) AS j, unnest(embedding)::DOUBLE AS y FROM embeddings",
}


def with_tables(sql: str) -> str:
    """sql with the projections it may name before it."""
    sql = sql.strip()
    recursive = "RECURSIVE " if sql.startswith("WITH RECURSIVE ") else ""
    sql = sql.replace("WITH RECURSIVE ", "WITH ", 1) if recursive else sql
    before = f"WITH {recursive}" + ",\n".join(f"{k} AS ({v})" for k, v in SQL.items())
    return f"{before},\n{sql[5:]}" if sql.startswith("WITH ") else f"{before}\n{sql}"
