"""Queries over a data folder, one for each operator, and the same in DuckDB's SQL where SQL can say it.

Floats are rounded on both sides, as sums depend on their order. Replays and windows that fit the stored tables take the
place of the much longer series that the operators' defaults are meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import curves, decompose, market, ordered, stableswap, ticks
from tidemark.plans.spectra import polynomials, spectra, smoother_sql, weights_sql
from tidemark.sources import fixtures as fx
from tidemark.sources.tables import last_of_each, last_rows, linspace, load, logspace, positioned

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CENTER, HALF = 300, 200
AFTER_S, UNTIL_S = 1704067200, 1705622400  # 2024-01-01 and 18 days on
HOUR_S, FRAMES_S = 1704456000, 1704110400
FRAMES_END_S = FRAMES_S + 399 * 3600
SINCE_S = 1704153600
SIZE, STEP = 168, 24
K4 = (100.0, 500.0, 1000.0, 4000.0)


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = fx.with_tables(sql)
        return f

    return put


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """The named columns to some digits; -0.0 becomes 0.0."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if c in names else F.col(c) for c in df.columns))


# --- sources, scans, positions ---
@query("SELECT event_id, s, hour_s, event_type, value FROM evh")
def src1_parquet_scan(spark, sf):
    return fx.events(spark, sf).select("event_id", "s", "hour_s", "event_type", "value")


@query("SELECT i, round(-1 + 2.0 * i / 1000, 9) + 0.0 AS x FROM range(1001) t(i)")
def src2_linspace(spark, sf):
    return rounded(linspace(spark, -1.0, 1.0, 1001), 9, "x")


@query("SELECT i, round(power(10::DOUBLE, log10(0.1) + (log10(5.0) - log10(0.1)) * i / 2999), 9) AS x FROM range(3000) t(i)")
def src3_logspace(spark, sf):
    return rounded(logspace(spark, 0.1, 5.0, 3000), 9, "x")


@query("""SELECT i AS bin, round(edge, 4) AS edge, count(l_orderkey) AS n FROM (SELECT i, round(power(10::DOUBLE, log10(900.0) + (log10(110000.0) - log10(900.0)) * i / 40), 4) AS edge FROM range(41) t(i))
  LEFT JOIN (SELECT l_orderkey, l_extendedprice AS v FROM lineitem WHERE l_extendedprice >= 900) ON v >= edge AND (i = 40 OR v < round(power(10::DOUBLE, log10(900.0) + (log10(110000.0) - log10(900.0)) * (i + 1) / 40), 4)) GROUP BY i, edge""")
def src3_price_bins(spark, sf):
    """How many lines have a price in each of 41 bins, even by logarithm; the last is open."""
    edges = rounded(logspace(spark, 900.0, 110000.0, 41, "edge"), 4, "edge")
    held = edges.agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    prices = load(spark, f"{sf}/lineitem.parquet", ["l_extendedprice"]).crossJoin(F.broadcast(held))
    counts = prices.groupBy((F.size(F.filter("edges", lambda e: e <= F.col("l_extendedprice"))) - 1).cast("long").alias("i")).agg(F.count("*").alias("n"))
    return edges.join(counts, "i", "left").select(F.col("i").alias("bin"), "edge", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_id, s AS timestamp, value::DOUBLE AS price FROM ev")
def prj2_cast_price(spark, sf):
    return fx.pool_price(spark, sf).select("event_id", "timestamp", F.col("token1Price").cast("double").alias("price"))


@query("SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS r FROM ev) WHERE r <= 4000")
def lim1_tail(spark, sf):
    return fx.events(spark, sf).orderBy(F.desc("event_id")).limit(4000).select("event_id", "value")


# Places in the table as it is stored, which is sorted by none of the columns.
_STORED = "SELECT row_number() OVER () - 1 AS pos, l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem"


def _stored(spark, sf):
    return positioned(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"])


@query(f"SELECT pos, l_orderkey, l_linenumber, l_extendedprice FROM ({_STORED}) QUALIFY row_number() OVER (ORDER BY pos DESC) = 1")
def lim2_last_row(spark, sf):
    return last_rows(_stored(spark, sf)).select("pos", "l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"SELECT pos, l_orderkey, l_linenumber, l_extendedprice FROM ({_STORED}) QUALIFY row_number() OVER (ORDER BY pos DESC) <= 4000")
def lim1_tail_as_stored(spark, sf):
    return last_rows(_stored(spark, sf), 4000).select("pos", "l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"SELECT pos, l_orderkey, l_linenumber, l_extendedprice FROM ({_STORED}) WHERE pos >= 1000 AND pos < 3000")
def flt12_slice_as_stored(spark, sf):
    return _stored(spark, sf).filter("pos >= 1000 AND pos < 3000").select("pos", "l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"SELECT l_partkey, arg_max(l_extendedprice, pos) AS price, max(pos) AS pos FROM ({_STORED}) GROUP BY l_partkey")
def agg9_last_as_stored(spark, sf):
    return last_of_each(_stored(spark, sf).withColumn("place", F.col("pos")), "l_partkey", place="place").select("l_partkey", F.col("l_extendedprice").alias("price"), "pos")


@query("SELECT hour_s, close FROM (SELECT *, row_number() OVER (ORDER BY hour_s) - 1 AS rn FROM klines) WHERE rn >= 100 AND rn < 300")
def flt12_positional_slice(spark, sf):
    return ordered.numbered(fx.klines(spark, sf), "hour_s").filter("rn >= 100 AND rn < 300").select("hour_s", "close")


@query("SELECT max(hour_s) AS last_hour, count(DISTINCT hour_s) AS hours FROM evh")
def agg4_distinct_hours(spark, sf):
    return fx.events(spark, sf).select("hour_s").distinct().agg(F.max("hour_s").alias("last_hour"), F.count("*").alias("hours"))


@query("SELECT event_id, round(ln(1 + value), 9) AS log1p, round(log10(value), 9) AS log10, round(sqrt(value), 9) AS root, greatest(-1.0, least(1.0, (value - 50) / 50)) AS clipped, round(s / 86400.0, 9) AS day FROM ev")
def scl_numeric(spark, sf):
    v = F.col("value")
    df = fx.events(spark, sf).select("event_id", F.when(v == -1, float("-inf")).otherwise(F.log1p(v)).alias("log1p"), scalars.log_of(v, F.log10).alias("log10"), F.sqrt(v).alias("root"), scalars.clip((v - 50) / 50, -1.0, 1.0).alias("clipped"), scalars.day_number(F.col("s")).alias("day"))
    return rounded(df, 9, "log1p", "log10", "root", "day")


@query("SELECT event_id, floor(least(value / 1000, 1) * 100)::INT || ' %' AS share, strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM ev")
def scl_labels(spark, sf):
    return fx.events(spark, sf).select("event_id", scalars.percent_label(F.least(F.col("value") / 1000, F.lit(1.0))).alias("share"), scalars.iso_label(F.col("s")).alias("iso"))


@query("""SELECT event_id, CASE WHEN v >= 1e6 THEN CASE WHEN (v / 1e6) % 1 = 0 THEN (v / 1e6)::BIGINT::VARCHAR ELSE printf('%g', v / 1e6) END || 'M'
  WHEN v >= 1e3 THEN CASE WHEN (v / 1e3) % 1 = 0 THEN (v / 1e3)::BIGINT::VARCHAR ELSE printf('%g', v / 1e3) END || 'K' ELSE printf('%g', v) END AS label FROM (SELECT event_id, value * power(10::DOUBLE, event_id % 7) AS v FROM ev)""")
def scl9_human_number(spark, sf):
    return fx.events(spark, sf).select("event_id", scalars.human_number(F.col("value") * F.pow(F.lit(10.0), (F.col("event_id") % 7).cast("double"))).alias("label"))


@query("SELECT hour_s, round((hour_s - min(hour_s) OVER ()) / (max(hour_s) OVER () - min(hour_s) OVER ())::DOUBLE, 9) AS position FROM klines")
def scl16_rescale(spark, sf):
    rows = fx.klines(spark, sf).select("hour_s")
    ends = rows.agg(F.min("hour_s").alias("lo"), F.max("hour_s").alias("hi"))
    return rounded(rows.crossJoin(F.broadcast(ends)).select("hour_s", ((F.col("hour_s") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("position")), 9, "position")


# --- candles and venues ---
@query("""SELECT hour_s, round(close - open, 6) + 0.0 AS height, CASE WHEN close > open THEN open ELSE round(close + abs(close - open), 6) END AS bottom, close > open AS green,
  (SELECT coalesce(quantile_cont(g, 0.5), 60) * 0.8 FROM (SELECT hour_s - lag(hour_s) OVER (ORDER BY hour_s) AS g FROM klines)) AS width, low, high FROM klines""")
def dom1_candles(spark, sf):
    return rounded(market.candles(fx.klines(spark, sf)), 6, "height", "bottom")


@query(f"SELECT k, rn::BIGINT AS rn, hour_s, open, high, low, close FROM (SELECT *, row_number() OVER (ORDER BY hour_s) - 1 AS rn FROM klines), range(2, 400, 4) f(k) WHERE rn >= {CENTER - HALF} AND rn < {CENTER - HALF} + k")
def dom2_replay_frames(spark, sf):
    return market.replay_frames(fx.klines(spark, sf), CENTER, HALF)


@query(f"""SELECT k, cutoff, count(*) AS n, max(s) AS last_s, round(sum(value), 4) AS total FROM (
  SELECT k, max(hour_s) AS cutoff FROM (SELECT *, row_number() OVER (ORDER BY hour_s) - 1 AS rn FROM klines), range(2, 400, 4) f(k) WHERE rn >= {CENTER - HALF} AND rn < {CENTER - HALF} + k GROUP BY k)
  JOIN ev ON s < cutoff GROUP BY ALL""")
def dom2_replay_prices(spark, sf):
    return rounded(market.replay_price_sums(fx.klines(spark, sf), fx.pool_price(spark, sf), CENTER, HALF), 4, "total")


@query(f"""SELECT k, cutoff, s AS timestamp, value AS price FROM (
  SELECT k, max(hour_s) AS cutoff FROM (SELECT *, row_number() OVER (ORDER BY hour_s) - 1 AS rn FROM klines), range(2, 12, 4) f(k) WHERE rn >= {CENTER - HALF} AND rn < {CENTER - HALF} + k GROUP BY k)
  JOIN ev ON s < cutoff""")
def dom2_replay_price_rows(spark, sf):
    return market.replay_prices(fx.klines(spark, sf), fx.pool_price(spark, sf), CENTER, HALF, stop=12)


@query(f"SELECT min(low) AS y0, round(max(high) + 0.04, 6) AS y1 FROM (SELECT *, row_number() OVER (ORDER BY hour_s) - 1 AS rn FROM klines) WHERE rn >= {CENTER - HALF} AND rn < {CENTER - HALF} + 396")
def dom2_replay_bounds(spark, sf):
    return rounded(market.replay_bounds(fx.klines(spark, sf), CENTER, HALF), 6, "y1")


@query("SELECT coalesce(quantile_cont(g, 0.5), 60)::DOUBLE AS gap FROM (SELECT s - lag(s) OVER (ORDER BY s) AS g FROM ev)")
def agg5_median_gap(spark, sf):
    return market.median_gap(fx.events(spark, sf), "s")


@query("SELECT 'candle' AS series, hour_s AS t, close AS v FROM klines UNION ALL SELECT 'pool', s, value FROM ev")
def jn7_overlay(spark, sf):
    return market.overlay(candle=fx.klines(spark, sf).select(F.col("hour_s").alias("t"), F.col("close").alias("v")), pool=fx.events(spark, sf).select(F.col("s").alias("t"), F.col("value").alias("v"))).select("series", "t", "v")


@query(f"""SELECT 'concentrated' AS series, s, round(net_amountUSD / nullif(tvlUSD, 0), 9) AS usage, tvlUSD AS tvl FROM venue_metrics WHERE feeTier = 100
  UNION ALL SELECT 'stableswap', hour_s, round(hourlyVolumeUSD / nullif(totalValueLockedUSD, 0), 9), round(totalValueLockedUSD, 4) FROM pool_balances WHERE hour_s >= {SINCE_S}""")
def dom24_venue_usage(spark, sf):
    df = market.venue_usage(fx.venue_metrics(spark, sf), fx.pool_balances(spark, sf, SINCE_S), 100, SINCE_S)
    return rounded(rounded(df, 9, "usage"), 4, "tvl").select("series", "s", "usage", "tvl")


# --- stableswap ---
_D3 = "list_reduce(range(64)::DOUBLE[], lambda d, i: (12000 * S + d * d * d * d / (27 * x * y * z) * 3) * d / (11999 * d + 4 * (d * d * d * d / (27 * x * y * z))), S)"
_QUOTES = f"""WITH p AS (SELECT hour_s, bal_DAI AS x, bal_USDC AS y, bal_USDT AS z, bal_DAI + bal_USDC + bal_USDT AS S FROM pool_balances),
q AS (SELECT *, CASE WHEN least(x, y, z) > 0 THEN {_D3} END AS d FROM p),
"""


def _quote(a: str, b: str, out: str) -> str:
    """Coin `out` for one more of coin a, with coin b left alone."""
    beta, c = f"({a} + 1 + {b} + d / 12000 - d)", f"(d * d / (({a} + 1) * 3) * d / ({b} * 3) * d / 36000)"
    return f"round({out} - (sqrt({beta} * {beta} + 4 * {c}) - {beta}) / 2, 6)"


@query(_QUOTES + f"r AS (SELECT hour_s, round(d, 5) AS d, {_quote('y', 'x', 'z')} AS usdc_usdt, {_quote('x', 'z', 'y')} AS dai_usdc, {_quote('z', 'y', 'x')} AS usdt_dai FROM q) SELECT * FROM r")
def dom6_quotes(spark, sf):
    return rounded(rounded(stableswap.quotes(fx.pool_balances(spark, sf)), 6, "usdc_usdt", "dai_usdc", "usdt_dai"), 5, "d")


_BY_TIME = """WITH p AS (SELECT hour_s, bal_DAI AS x, bal_USDC AS y, bal_USDT AS z, bal_DAI + bal_USDC + bal_USDT AS S, 2000.0 + 10 * ((hour_s // 3600) % 7) AS a FROM pool_balances),
q AS (SELECT *, CASE WHEN least(x, y, z) > 0 THEN list_reduce(range(64)::DOUBLE[], lambda d, i: (3 * a * S + d * d * d * d / (27 * x * y * z) * 3) * d / ((3 * a - 1) * d + 4 * (d * d * d * d / (27 * x * y * z))), S) END AS d FROM p),
b AS (SELECT *, y + 10 + x + d / (3 * a) - d AS beta, d * d / ((y + 10) * 3) * d / (x * 3) * d / (9 * a) AS c FROM q)
"""


@query(_BY_TIME + "SELECT hour_s, round(d, 5) AS d, round((z - (sqrt(beta * beta + 4 * c) - beta) / 2) * (1 - 0.0004) / 10, 6) AS usdc_usdt FROM b")
def dom5_quotes_by_time(spark, sf):
    """An amplification for each hour, a fee, and ten coins paid in."""
    pool = fx.pool_balances(spark, sf)
    a = pool.select("hour_s", (F.lit(2000.0) + 10 * (F.col("hour_s") / 3600 % 7).cast("int")).alias("a"))
    return rounded(rounded(stableswap.quotes(pool, a, 0.0004, 10.0).select("hour_s", "d", "usdc_usdt"), 6, "usdc_usdt"), 5, "d")


@query(_QUOTES + f"r AS (SELECT hour_s, {_quote('z', 'y', 'x')} AS usdt_dai FROM q) SELECT hour_s, usdt_dai, round(1 / nullif(usdt_dai, 0), 6) AS dai_usdt FROM r")
def prj7_reciprocal_quote(spark, sf):
    df = rounded(stableswap.quotes(fx.pool_balances(spark, sf)).select("hour_s", "usdt_dai"), 6, "usdt_dai")
    return rounded(df.withColumn("dai_usdt", scalars.ratio(F.lit(1.0), F.col("usdt_dai"))), 6, "dai_usdt")


@query("SELECT hour_s, round(w_DAI, 9) AS dai, round(w_DAI + w_USDT, 9) AS dai_usdt, round(w_DAI + w_USDT + w_USDC, 9) AS \"all\" FROM pool_balances")
def dom16_balance_shares(spark, sf):
    return rounded(stableswap.balance_shares(fx.pool_balances(spark, sf)), 9, "dai", "dai_usdt", "all")


_TWO = """WITH g AS (SELECT a::DOUBLE AS a, 0.1 + 4.9 * i / 299 AS x FROM range(300) t(i), (VALUES (100), (500), (1000), (4000)) v(a)),
h AS (SELECT a, x, 2.0 AS d, x + 2.0 / (2 * a) - 2.0 AS beta, 2.0 * 2.0 / (2 * x) * 2.0 / (4 * a) AS c, x * 1.000001 + 2.0 / (2 * a) - 2.0 AS beta2, 2.0 * 2.0 / (2 * x * 1.000001) * 2.0 / (4 * a) AS c2 FROM g),
r AS (SELECT a, x, CASE WHEN beta > 0 THEN 2 * c / (beta + sqrt(beta * beta + 4 * c)) ELSE (sqrt(beta * beta + 4 * c) - beta) / 2 END AS y,
  CASE WHEN beta2 > 0 THEN 2 * c2 / (beta2 + sqrt(beta2 * beta2 + 4 * c2)) ELSE (sqrt(beta2 * beta2 + 4 * c2) - beta2) / 2 END AS y2 FROM h)
"""


@query(_TWO + "SELECT a, round(x, 9) AS x, round(y, 9) AS y, round(-(y2 - y) / (x * 1e-6), 5) AS p FROM r")
def dom8_two_coin_price(spark, sf):
    amps = spark.createDataFrame([(a,) for a in K4], "a double").withColumn("d", stableswap.two_coin_d(F.lit(1.0), F.lit(1.0), F.col("a")))
    df = linspace(spark, 0.1, 5.0, 300).crossJoin(F.broadcast(amps))
    df = df.select("a", "x", stableswap.two_coin_y(F.col("x"), F.col("d"), F.col("a")).alias("y"), stableswap.marginal_price(F.col("x"), F.col("d"), F.col("a")).alias("p"))
    return rounded(rounded(df, 9, "x", "y"), 5, "p")


_DENSITY = """WITH g AS (SELECT a::DOUBLE AS a, power(10::DOUBLE, log10(0.1) + (log10(5.0) - log10(0.1)) * i / 2999) AS x FROM range(3000) t(i), (VALUES (100), (500), (1000), (4000)) v(a)),
h AS (SELECT a, x, x + 1 / a - 2.0 AS b, 1 / (2 * x * a) * 1.0 AS c, x * 1.000001 + 1 / a - 2.0 AS b2, 1 / (2 * x * 1.000001 * a) AS c2 FROM g),
r AS (SELECT a, x, CASE WHEN b > 0 THEN 2 * c * 2 / (b + sqrt(b * b + 8 * c)) ELSE (sqrt(b * b + 8 * c) - b) / 2 END AS y, CASE WHEN b2 > 0 THEN 2 * c2 * 2 / (b2 + sqrt(b2 * b2 + 8 * c2)) ELSE (sqrt(b2 * b2 + 8 * c2) - b2) / 2 END AS y2 FROM h),
n AS (SELECT a, x AS xx, -(y2 - y) / (x * 1e-6) AS pp FROM r),
s AS (SELECT a, pp AS p0, xx AS x0, lead(pp) OVER w AS p1, lead(xx) OVER w AS x1 FROM n WINDOW w AS (PARTITION BY a ORDER BY pp, xx)),
q AS (SELECT i, 0.98 + 0.04 * i / 599 AS p FROM range(600) t(i)),
m AS (SELECT a, i, p, CASE WHEN p1 IS NULL THEN x0 ELSE x0 + (x1 - x0) / (p1 - p0) * (p - p0) END AS x, ln(p) AS l FROM s JOIN q ON p >= p0 AND (p < p1 OR p1 IS NULL)
  UNION ALL SELECT a, i, p, x0, ln(p) FROM (SELECT a, min(p0) AS least, arg_min(x0, p0) AS x0 FROM s GROUP BY a) JOIN q ON p < least),
d AS (SELECT a, i, p, x, l, lag(x) OVER w AS xm, lag(l) OVER w AS lm, lead(x) OVER w AS xp, lead(l) OVER w AS lp FROM m WINDOW w AS (PARTITION BY a ORDER BY i)),
e AS (SELECT a, i, p, abs(CASE WHEN xm IS NULL THEN (xp - x) / (lp - l) WHEN xp IS NULL THEN (x - xm) / (l - lm)
  ELSE ((l - lm) * (l - lm) * xp + ((lp - l) * (lp - l) - (l - lm) * (l - lm)) * x - (lp - l) * (lp - l) * xm) / ((l - lm) * (lp - l) * (lp - lm)) END) AS v FROM d)
SELECT a, i, round(p, 9) AS p, round(v / max(v) OVER (PARTITION BY a), 2) AS relative FROM e"""


@query(_DENSITY)
def dom10_density(spark, sf):
    df = stableswap.liquidity_density(spark, list(K4))
    return rounded(rounded(df.select("a", F.col("i").cast("long").alias("i"), "p", "relative"), 9, "p"), 2, "relative")


#: Each hour's pool of two coins, with an amplification of its own.
_PAIRS = "SELECT hour_s, bal_USDC AS x, bal_USDT AS y, 100.0 + 300 * ((hour_s // 3600) % 13) AS a FROM pool_balances"


def _pairs(spark, sf):
    return fx.pool_balances(spark, sf).select("hour_s", F.col("bal_USDC").alias("x"), F.col("bal_USDT").alias("y"), (F.lit(100.0) + 300 * (F.col("hour_s") / 3600 % 13)).alias("a"))


#: The steps of Newton's iteration for a pool (x, y, a).
_D2 = "list_reduce(range(64)::DOUBLE[], lambda d, i: (2 * a * (x + y) + d * d / (x * 2) * d / (y * 2) * 2) * d / ((2 * a - 1) * d + d * d / (x * 2) * d / (y * 2) * 3), x + y)"


def _other(x: str) -> str:
    """The other balance of a pool (d, a) that holds x."""
    beta, c = f"({x} + d / (2 * a) - d)", f"(d * d / (({x}) * 2) * d / (4 * a))"
    return f"(CASE WHEN {beta} > 0 THEN 2 * {c} / ({beta} + sqrt({beta} * {beta} + 4 * {c})) ELSE (sqrt({beta} * {beta} + 4 * {c}) - {beta}) / 2 END)"


@query(f"""WITH p AS ({_PAIRS}), q AS (SELECT *, {_D2} AS d FROM p), r AS (SELECT *, {_other('x')} AS y0, {_other('x * 1.001')} AS y1 FROM q)
SELECT hour_s, round(d, 6) AS d, round(y0, 6) AS y, round(-(y1 - y0) / (x * 0.001), 6) AS price FROM r""")
def dom7_two_coin_pools(spark, sf):
    """D, the balance that it implies for the other coin, and the price of a move by a thousandth, of each hour's pool."""
    x, d, a = F.col("x"), F.col("d"), F.col("a")
    pools = _pairs(spark, sf).withColumn("d", stableswap.two_coin_d(x, F.col("y"), a))
    found = pools.select("hour_s", "d", stableswap.two_coin_y(x, d, a).alias("y"), stableswap.marginal_price(x, d, a, 1e-3).alias("price"))
    return rounded(found, 6, "d", "y", "price")


@query(f"""WITH b AS (SELECT hour_s // 86400 AS pool, 100.0 + 150 * ((hour_s // 86400) % 6) AS a, round(bal_USDC / (bal_USDC + bal_USDT) * 2, 6) AS x, round(bal_USDT / (bal_USDC + bal_USDT) * 2, 6) AS y FROM pool_balances QUALIFY row_number() OVER (PARTITION BY hour_s // 86400 ORDER BY hour_s DESC) = 1),
k AS (SELECT *, {_D2} AS d FROM b), g AS (SELECT round(power(10::DOUBLE, log10(0.1) + (log10(5.0) - log10(0.1)) * i / 2999), 9) AS x FROM range(3000) t(i)),
h AS (SELECT pool, a, d, g.x AS x FROM k, g), r AS (SELECT pool, x, {_other('x')} AS y, {_other('x * 1.000001')} AS y2 FROM h),
n AS (SELECT pool, x AS xx, -(y2 - y) / (x * 1e-6) AS pp FROM r), s AS (SELECT pool, pp AS p0, xx AS x0, lead(pp) OVER w AS p1, lead(xx) OVER w AS x1 FROM n WINDOW w AS (PARTITION BY pool ORDER BY pp, xx)),
q AS (SELECT pool, i, 0.98::DOUBLE + (0.04::DOUBLE / 599) * i AS p FROM k, range(600) t(i)), f AS (SELECT pool, min(p0) AS least, arg_min(x0, p0) AS x0 FROM s GROUP BY pool),
m AS (SELECT q.pool, i, p, CASE WHEN s.p0 IS NULL THEN f.x0 WHEN s.p1 IS NULL THEN s.x0 ELSE s.x0 + (s.x1 - s.x0) / (s.p1 - s.p0) * (p - s.p0) END AS x, ln(p) AS l FROM q ASOF LEFT JOIN s ON q.pool = s.pool AND q.p >= s.p0 JOIN f ON f.pool = q.pool),
d AS (SELECT pool, i, p, x, l, lag(x) OVER w AS xm, lag(l) OVER w AS lm, lead(x) OVER w AS xp, lead(l) OVER w AS lp FROM m WINDOW w AS (PARTITION BY pool ORDER BY i)),
e AS (SELECT pool, i, p, abs(CASE WHEN xm IS NULL THEN (xp - x) / (lp - l) WHEN xp IS NULL THEN (x - xm) / (l - lm) ELSE ((l - lm) * (l - lm) * xp + ((lp - l) * (lp - l) - (l - lm) * (l - lm)) * x - (lp - l) * (lp - l) * xm) / ((l - lm) * (lp - l) * (lp - lm)) END) AS v FROM d)
SELECT pool, i, round(p, 9) AS p, round(v / max(v) OVER (PARTITION BY pool), 4) AS relative FROM e""")
def dom10_pool_densities(spark, sf):
    """The density of liquidity of each day's last pool, in units of half its balances, as a share of its maximum."""
    total = F.col("bal_USDC") + F.col("bal_USDT")
    day = F.floor(F.col("hour_s") / 86400)
    last = fx.pool_balances(spark, sf).groupBy(day.alias("pool")).agg(F.max_by(F.struct(*(F.round(F.col(f"bal_{c}") / total * 2, 6).alias(n) for c, n in (("USDC", "x0"), ("USDT", "y0")))), "hour_s").alias("b"))
    pools = last.select("pool", (F.lit(100.0) + 150 * (F.col("pool") % 6)).alias("a"), "b.x0", "b.y0")
    found = stableswap.pool_densities(pools, rounded(logspace(spark, 0.1, 5.0, 3000), 9, "x"), linspace(spark, 0.98, 1.02, 600, "p"))
    return rounded(rounded(found.drop("liquidity"), 9, "p"), 4, "relative")


_NODES = "SELECT epoch(l_shipdate)::BIGINT AS s, max(l_extendedprice) AS v FROM lineitem GROUP BY 1"


@query(f"""WITH n AS ({_NODES}), o AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS s FROM orders),
b AS (SELECT o_orderkey, o.s, n.s AS s0, n.v AS v0 FROM o ASOF LEFT JOIN n ON o.s >= n.s), c AS (SELECT b.*, n.s AS s1, n.v AS v1 FROM b ASOF LEFT JOIN n ON b.s < n.s)
SELECT o_orderkey, s, round(CASE WHEN s0 IS NULL THEN v1 WHEN s1 IS NULL OR s = s0 THEN v0 ELSE v0 + (v1 - v0) / (s1 - s0) * (s - s0) END, 6) AS price FROM c""")
def jn8_interpolated_series(spark, sf):
    """The highest price by day of shipment, read at the time of each order: one key for all rows."""
    seconds = lambda c: F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")
    lines = load(spark, f"{sf}/lineitem.parquet", ["l_shipdate", "l_extendedprice"])
    nodes = lines.groupBy(seconds("l_shipdate").alias("s")).agg(F.max("l_extendedprice").alias("price")).withColumn("key", F.lit(0))
    points = load(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_orderdate"]).select("o_orderkey", seconds("o_orderdate").alias("s"), F.lit(0).alias("key"))
    return rounded(stableswap.interpolated(nodes, points, "key", "s", "price", "s").drop("key"), 6, "price")


_GRADIENT = """CASE WHEN xm IS NULL THEN (fp - f) / (xp - x) WHEN xp IS NULL THEN (f - fm) / (x - xm)
  ELSE ((x - xm) * (x - xm) * fp + ((xp - x) * (xp - x) - (x - xm) * (x - xm)) * f - (xp - x) * (xp - x) * fm) / ((x - xm) * (xp - x) * ((x - xm) + (xp - x))) END"""


@query(f"""SELECT part, t, round({_GRADIENT}, 9) + 0.0 AS slope FROM (SELECT part, t, t::DOUBLE AS x, v AS f, lag(t::DOUBLE) OVER w AS xm, lead(t::DOUBLE) OVER w AS xp, lag(v) OVER w AS fm, lead(v) OVER w AS fp
  FROM (SELECT l_partkey AS part, epoch(l_shipdate)::BIGINT // 86400 AS t, ln(max(l_extendedprice)) AS v FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY part ORDER BY t))""")
def win8_price_gradient(spark, sf):
    """The slope of the logarithm of each part's price by day of shipment; the days are unevenly apart."""
    lines = load(spark, f"{sf}/lineitem.parquet", ["l_partkey", "l_shipdate", "l_extendedprice"])
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    prices = lines.groupBy(F.col("l_partkey").alias("part"), day.alias("t")).agg(F.log(F.max("l_extendedprice")).alias("v")).withColumn("x", F.col("t").cast("double"))
    return rounded(prices.withColumn("slope", stableswap.gradient(prices, "part", "t", "v", "x")).select("part", "t", "slope"), 9, "slope")


@query(f"""SELECT hour_s, round(x, 6) AS x, round(k - x, 6) AS y_sum, round(c / x, 6) AS y_product, round((a * k + c - a * x) / (a + x), 6) AS y_hybrid, 1.0::DOUBLE AS p_sum, round(c / (x * x), 6) AS p_product, round((a * a + a * k + c) / ((a + x) * (a + x)), 6) AS p_hybrid
  FROM (SELECT hour_s, x, a, x + y AS k, (x + y) / 2 * ((x + y) / 2) AS c FROM ({_PAIRS}))""")
def dom12_pool_invariants(spark, sf):
    """What each hour's pool would hold of the other coin, and its price, under the sum, the product and the hybrid of both."""
    found = stableswap.invariant_curves(_pairs(spark, sf), F.col("x") + F.col("y"), F.col("a"), "hour_s")
    return rounded(found, 6, *(c for c in found.columns if c != "hour_s"))


@query(f"SELECT hour_s, round(x + y, 6) AS empty_sum, round((a * (x + y) + (x + y) / 2 * ((x + y) / 2)) / a, 6) AS empty_hybrid FROM ({_PAIRS})")
def dom14_pool_empty_points(spark, sf):
    ends = stableswap.empty_at(F.col("x") + F.col("y"), F.col("a"))
    return rounded(_pairs(spark, sf).select("hour_s", *(v.alias(f"empty_{c}") for c, v in ends.items())), 6, "empty_sum", "empty_hybrid")


@query(f"""SELECT hour_s, a, round(x, 6) AS x, round(0.5 * (sqrt(u * u + k * k * k * k / (4 * a * x)) - u), 5) AS y FROM (SELECT hour_s, x, v.a::DOUBLE AS a, k, x + k * k / (4 * v.a::DOUBLE) - k AS u FROM (SELECT hour_s, x, x + y AS k FROM ({_PAIRS})), (VALUES (1), (4), (10), (100)) v(a))""")
def dom15_pool_curves(spark, sf):
    pools = _pairs(spark, sf).drop("a")
    return rounded(rounded(stableswap.stableswap_curves(pools, [1, 4, 10, 100], F.col("x") + F.col("y"), "hour_s"), 6, "x"), 5, "y")


@query("SELECT round(x, 9) AS x, round(6 - x, 9) AS y_sum, round(9 / x, 9) AS y_product, round((33 - 4 * x) / (4 + x), 9) AS y_hybrid, 1.0::DOUBLE AS p_sum, round(9 / (x * x), 9) AS p_product, round(49 / ((4 + x) * (4 + x)), 9) AS p_hybrid FROM (SELECT 0.1 + 8.9 * i / 499 AS x FROM range(500) t(i))")
def dom12_invariants(spark, sf):
    df = stableswap.invariant_curves(linspace(spark, 0.1, 9.0, 500))
    return rounded(df, 9, *df.columns)


@query("SELECT * FROM (VALUES ('sum', 6.0::DOUBLE), ('hybrid', 8.25::DOUBLE)) v(curve, x)")
def dom14_empty_points(spark, sf):
    return stableswap.empty_points(spark)


@query("SELECT a::DOUBLE AS a, round(x, 9) AS x, round(0.5 * (sqrt(u * u + 1296 / (4.0 * a * x)) - u), 7) AS y FROM (SELECT a, x, x + 36 / (4.0 * a) - 6 AS u FROM (SELECT 0.05 + 11.95 * i / 499 AS x FROM range(500) t(i)), (VALUES (1), (4), (10), (100)) v(a))")
def dom15_stableswap_curves(spark, sf):
    return rounded(rounded(stableswap.stableswap_curves(linspace(spark, 0.05, 12.0, 500), [1, 4, 10, 100]), 9, "x"), 7, "y")


@query("SELECT tickLower AS tick, round(power(1.0001::DOUBLE, tickLower), 10) AS price, round(power(1.0001::DOUBLE, tickLower / 2.0), 10) AS root FROM tick_book WHERE ts = 0")
def dom17_tick_prices(spark, sf):
    df = fx.tick_book(spark, sf).filter("timestamp = 0").select(F.col("tickLower").alias("tick"), scalars.tick_price(F.col("tickLower")).alias("price"), scalars.tick_sqrt_price(F.col("tickLower")).alias("root"))
    return rounded(df, 10, "price", "root")


# --- ticks ---
@query("SELECT i, round(0.995 + 0.01 * i / 599, 9) AS p, round(coalesce(sum(liquidity), 0), 2) AS liquidity FROM range(600) t(i) LEFT JOIN positions ON 0.995 + (0.01 / 599) * i >= pa AND 0.995 + (0.01 / 599) * i <= pb GROUP BY i")
def dom11_position_liquidity(spark, sf):
    df = ticks.position_liquidity(linspace(spark, 0.995, 1.005, 600, "p"), fx.positions(spark, sf))
    df = df.select(F.round((F.col("p") - 0.995) / 0.01 * 599).cast("long").alias("i"), "p", "liquidity")
    return rounded(rounded(df, 9, "p"), 2, "liquidity")


@query(f"""SELECT round(priceMid, 9) AS priceMid, round(usd_token0, 4) AS usd_token0, round(usd_token1, 4) AS usd_token1,
  round(0.8 * (SELECT min(g) FROM (SELECT priceMid - lag(priceMid) OVER (ORDER BY priceMid) AS g FROM hourly_liquidity WHERE hour_s = {HOUR_S})), 9) AS width,
  round((SELECT min(priceMid) FROM hourly_liquidity WHERE hour_s = {HOUR_S} AND usd_token0 > 0), 9) AS active FROM hourly_liquidity WHERE hour_s = {HOUR_S}""")
def dom18_tick_bars(spark, sf):
    return rounded(rounded(ticks.tick_bars(fx.hourly_liquidity(spark, sf, HOUR_S, HOUR_S), HOUR_S), 9, "priceMid", "width", "active"), 4, "usd_token0", "usd_token1")


@query("SELECT tick, round(L, 4) AS L FROM latest_ticks")
def dom20_liquidity_by_tick(spark, sf):
    return rounded(ticks.liquidity_by_tick(ticks.latest_snapshot(fx.tick_book(spark, sf)), "entry"), 4, "L")


@query("SELECT tick, round(total, 4) AS L FROM latest_ticks")
def dom20_liquidity_summed(spark, sf):
    return rounded(ticks.liquidity_by_tick(ticks.latest_snapshot(fx.tick_book(spark, sf)), "entry", "sum"), 4, "L")


@query("""SELECT k AS k_ticks, round(sum(u) OVER w, 2) AS token1_in_to_move_up, round(sum(v) OVER w, 2) AS token0_in_to_move_down, k::INT AS tick_up, -k::INT AS tick_down, 3600 AS timestamp
  FROM (SELECT a.k, a.L * (power(1.0001::DOUBLE, a.k / 2.0) - power(1.0001::DOUBLE, (a.k - 1) / 2.0)) AS u, b.L * (1 / power(1.0001::DOUBLE, -a.k / 2.0) - 1 / power(1.0001::DOUBLE, (1 - a.k) / 2.0)) AS v
    FROM (SELECT tick + 1 AS k, L FROM latest_ticks) a JOIN (SELECT -tick AS k, L FROM latest_ticks) b ON a.k = b.k WHERE a.k BETWEEN 1 AND 50)
  WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)""")
def dom21_swap_size_curve(spark, sf):
    df = rounded(ticks.swap_size_curve(fx.tick_book(spark, sf), order="entry"), 2, "token1_in_to_move_up", "token0_in_to_move_down")
    return df.select(F.col("k_ticks").cast("int"), "token1_in_to_move_up", "token0_in_to_move_down", F.col("tick_up").cast("int"), F.col("tick_down").cast("int"), "timestamp")


@query(f"SELECT round(priceMid, 9) AS priceMid, round(active_liquidity_L, 4) AS usd_total FROM hourly_liquidity WHERE hour_s = {HOUR_S}")
def dom22_total_curve(spark, sf):
    return rounded(rounded(ticks.total_curve(fx.hourly_liquidity(spark, sf, HOUR_S, HOUR_S), HOUR_S), 9, "priceMid"), 4, "usd_total")


@query(f"""SELECT f AS frame, {FRAMES_S} + f * 3600 AS hour_s, coalesce(n, 0)::BIGINT AS n, round(width, 9) AS width, round(active, 9) AS active FROM range(400) t(f) LEFT JOIN (
  SELECT hour_s, count(*) AS n, coalesce(min(g) * 0.8, 0.0001) AS width, min(CASE WHEN usd_token0 > 0 THEN priceMid END) AS active FROM (SELECT *, priceMid - lag(priceMid) OVER (PARTITION BY hour_s ORDER BY priceMid) AS g FROM hourly_liquidity) GROUP BY hour_s
  ) h ON h.hour_s = {FRAMES_S} + f * 3600""")
def dom23_hourly_frames(spark, sf):
    return rounded(ticks.hourly_frames(fx.hourly_liquidity(spark, sf, FRAMES_S, FRAMES_END_S), FRAMES_S), 9, "width", "active")


@query(f"""SELECT f AS frame, {FRAMES_S} + f * 3600 AS hour_s, round(priceMid, 9) AS priceMid, round(usd_token0, 4) AS usd_token0, round(usd_token1, 4) AS usd_token1, round(width, 9) AS width, round(active, 9) AS active FROM range(400) t(f) LEFT JOIN (
  SELECT hour_s, priceMid, usd_token0, usd_token1, coalesce(min(g) OVER h * 0.8, 0.0001) AS width, min(CASE WHEN usd_token0 > 0 THEN priceMid END) OVER h AS active
  FROM (SELECT *, priceMid - lag(priceMid) OVER (PARTITION BY hour_s ORDER BY priceMid) AS g FROM hourly_liquidity) WINDOW h AS (PARTITION BY hour_s)) b ON b.hour_s = {FRAMES_S} + f * 3600""")
def dom23_frame_bars(spark, sf):
    df = ticks.frame_bars(fx.hourly_liquidity(spark, sf, FRAMES_S, FRAMES_END_S), FRAMES_S)
    return rounded(rounded(df, 9, "priceMid", "width", "active"), 4, "usd_token0", "usd_token1")


@query(f"SELECT round(min(priceMid) - 0.002, 9) AS xmin, round(max(priceMid) + 0.002, 9) AS xmax, 0.0::DOUBLE AS ymin, round(1.05 * max(coalesce(usd_token0, 0) + coalesce(usd_token1, 0)), 4) AS ymax FROM hourly_liquidity WHERE hour_s BETWEEN {FRAMES_S} AND {FRAMES_S + 399 * 3600}")
def agg2_frame_limits(spark, sf):
    return rounded(rounded(ticks.frame_limits(fx.hourly_liquidity(spark, sf, FRAMES_S, FRAMES_END_S), FRAMES_S), 9, "xmin", "xmax"), 4, "ymax")


# --- curves ---
def _norm(centered: bool, until: str = str(UNTIL_S)) -> str:
    ref = "0.0" if centered else "poolTick"
    return f"SELECT hour_s, greatest(-1.0, least(1.0, (tickLower - {ref}) / 50.0))::DOUBLE AS tick_norm, ln(1 + active_liquidity_L) AS logl, active_liquidity_L AS total FROM hourly_liquidity WHERE hour_s > {AFTER_S} AND hour_s <= {until}"


def _curves(spark, sf, centered=False, until_s=UNTIL_S):
    return curves.normalised(fx.hourly_liquidity(spark, sf, AFTER_S + 1, until_s), AFTER_S, until_s, centered)


#: The upper bound that the table itself has.
_LAST = "(SELECT max(hour_s) FROM hourly_liquidity)"


@query(f"SELECT hour_s, round(tick_norm, 6) + 0.0 AS tick_norm, round(logl, 6) AS logl FROM ({_norm(True)})")
def dom26_transform(spark, sf):
    return rounded(_curves(spark, sf, True).select("hour_s", "tick_norm", "logl"), 6, "tick_norm", "logl")


@query(f"SELECT hour_s, round(tick_norm, 6) + 0.0 AS tick_norm, round(avg(logl), 6) AS logl FROM ({_norm(False)}) GROUP BY hour_s, tick_norm")
def dom25_surface(spark, sf):
    return rounded(curves.surface(_curves(spark, sf)), 6, "tick_norm", "logl")


@query(f"""WITH c AS ({_norm(False)}), x AS (SELECT tick_norm, row_number() OVER (ORDER BY tick_norm) - 1 AS j FROM (SELECT DISTINCT tick_norm FROM c))
SELECT h.hour_s, j::INT AS j, round(x.tick_norm, 6) + 0.0 AS tick_norm, round(ln(1 + coalesce(v, 0)), 6) AS value FROM (SELECT DISTINCT hour_s FROM c) h CROSS JOIN x LEFT JOIN (SELECT hour_s, tick_norm, sum(total) AS v FROM c GROUP BY 1, 2) s ON s.hour_s = h.hour_s AND s.tick_norm = x.tick_norm""")
def agg11_dense_matrix(spark, sf):
    return rounded(curves.dense(_curves(spark, sf)), 6, "tick_norm", "value")


@query(f"SELECT round(tick_norm, 6) + 0.0 AS tick_norm, round(avg(logl), 6) AS mean, round(stddev_samp(logl), 6) AS std FROM ({_norm(True)}) GROUP BY tick_norm")
def dom27_statistics(spark, sf):
    return rounded(curves.statistics(_curves(spark, sf, True), "tick_norm"), 6, "tick_norm", "mean", "std")


@query(f"""WITH c AS ({_norm(True)}), q AS (SELECT quantile_cont(hour_s, [0.25, 0.5, 0.75]) AS e FROM c)
SELECT "window", round(tick_norm, 6) + 0.0 AS tick_norm, round(avg(logl), 6) AS mean, round(stddev_samp(logl), 6) AS std FROM (SELECT c.*, (hour_s > e[1])::INT + (hour_s > e[2])::INT + (hour_s > e[3])::INT AS "window" FROM c, q) GROUP BY "window", tick_norm""")
def dom27_window_statistics(spark, sf):
    return rounded(curves.statistics(curves.quantile_windows(_curves(spark, sf, True)), "window", "tick_norm"), 6, "tick_norm", "mean", "std")


# The same from the stated start to the table's own last hour.
def _whole(name: str, centered: bool):
    def put(f: Query) -> Query:
        SQL[f.__name__] = SQL[name].replace(_norm(centered), _norm(centered, _LAST))
        return query()(f)

    return put


@_whole("dom26_transform", True)
def dom26_transform_whole(spark, sf):
    return rounded(_curves(spark, sf, True, None).select("hour_s", "tick_norm", "logl"), 6, "tick_norm", "logl")


@_whole("dom25_surface", False)
def dom25_surface_whole(spark, sf):
    return rounded(curves.surface(_curves(spark, sf, until_s=None)), 6, "tick_norm", "logl")


@_whole("agg11_dense_matrix", False)
def agg11_dense_matrix_whole(spark, sf):
    return rounded(curves.dense(_curves(spark, sf, until_s=None)), 6, "tick_norm", "value")


@_whole("dom27_statistics", True)
def dom27_statistics_whole(spark, sf):
    return rounded(curves.statistics(_curves(spark, sf, True, None), "tick_norm"), 6, "tick_norm", "mean", "std")


@_whole("dom27_window_statistics", True)
def dom27_window_statistics_whole(spark, sf):
    return rounded(curves.statistics(curves.quantile_windows(_curves(spark, sf, True, None)), "window", "tick_norm"), 6, "tick_norm", "mean", "std")


@query(f"SELECT hour_s, round(tick_norm, 6) + 0.0 AS tick_norm, round(logl, 6) AS logl FROM ({_norm(True, '(SELECT max((s // 3600) * 3600) FROM venue_metrics WHERE tvlUSD = 0 AND s < ' + str(UNTIL_S) + ')')})")
def jn6_bound_of_another_table(spark, sf):
    """Curves up to the last hour in which another table has what is looked for."""
    other = fx.venue_metrics(spark, sf).filter((F.col("tvlUSD") == 0) & (F.col("s") < UNTIL_S)).select((F.floor(F.col("s") / 3600) * 3600).alias("hour_s"))
    return rounded(curves.normalised(fx.hourly_liquidity(spark, sf, AFTER_S + 1), AFTER_S, other, True).select("hour_s", "tick_norm", "logl"), 6, "tick_norm", "logl")


@query(f"SELECT t, (r // (n // 4))::INT AS \"window\" FROM (SELECT vec_id AS t, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings) WHERE r // (n // 4) < 4")
def win6_equal_windows(spark, sf):
    rows = fx.matrix(spark, sf)
    return curves.equal_windows(ordered.numbered(rows.select("t"), "t"), rows.count()).select("t", "window")


@query(f"SELECT w::INT AS window_id, t FROM (SELECT vec_id AS t, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings), range(1000) f(w) WHERE w * {STEP} + {SIZE} <= n AND r >= w * {STEP} AND r < w * {STEP} + {SIZE}")
def win4_hopping_windows(spark, sf):
    return decompose.rolling_windows(fx.matrix(spark, sf), SIZE, STEP).select("window_id", "t")


# --- decomposition ---
_ALL = "SELECT 0 AS w, t, j, y FROM cells"


@query(spectra(_ALL, 5) + " SELECT 0 AS window_id, t_start, t_end, k, round(e, 9) AS eigenvalue, round(sum(e) OVER (ORDER BY k) / total, 9) AS cpve FROM spectra JOIN totals USING (w)")
def dom28_pca(spark, sf):
    return rounded(decompose.pca(fx.matrix(spark, sf)), 9, "eigenvalue", "cpve").drop("loading")


@query(spectra(_ALL, 5) + " SELECT k, unnest(range(len(u)))::INT AS j, round(unnest(u), 6) + 0.0 AS loading FROM spectra")
def dom28_loadings(spark, sf):
    found = decompose.sign_fixed(decompose.pca(fx.matrix(spark, sf)))
    return rounded(found.select("k", F.posexplode("loading").alias("j", "loading")), 6, "loading")


@query(spectra(_ALL, 5) + " SELECT n0.t[i]::BIGINT AS t, k, round(sum(n0.v[i] * u[j + 1]), 6) + 0.0 AS score FROM n0, (SELECT unnest(range(1, max(n) + 1)) AS i FROM n0), spectra GROUP BY n0.t[i], k")
def dom28_scores(spark, sf):
    rows = fx.matrix(spark, sf)
    return rounded(decompose.scores(rows, decompose.sign_fixed(decompose.pca(rows))), 6, "score")


@query("SELECT t, round(sqrt(sum((y - m) * (y - m))), 6) AS norm FROM cells JOIN (SELECT j, avg(y) AS m FROM cells GROUP BY j) USING (j) GROUP BY t")
def dom28_scores_keep_norm(spark, sf):
    """Scores on all components are a rotation: their length is that of the centred curve."""
    rows = fx.matrix(spark, sf)
    found = decompose.scores(rows, decompose.pca(rows, 64))
    return rounded(found.groupBy("t").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm")), 6, "norm")


_WINDOWS = f"WITH o AS (SELECT vec_id AS t, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings), w AS (SELECT w::INT AS window_id, t FROM o, range(1000) f(w) WHERE w * {STEP} + {SIZE} <= n AND r >= w * {STEP} AND r < w * {STEP} + {SIZE})"


@query(_WINDOWS + " SELECT window_id, round(sum(v), 8) AS total FROM (SELECT window_id, j, var_samp(y) AS v FROM w JOIN cells USING (t) GROUP BY 1, 2) GROUP BY 1")
def dom29_rolling_trace(spark, sf):
    """Eigenvalues of a window sum to the variance of its columns."""
    found = decompose.rolling_components(fx.matrix(spark, sf), SIZE, STEP)
    return rounded(found.groupBy("window_id").agg(F.sum("eigenvalue").alias("total")), 8, "total")


_ROLLED = "SELECT window_id AS w, t, j, y FROM (" + _WINDOWS + " SELECT * FROM w) JOIN cells USING (t)"


@query(spectra(_ROLLED, 7) + " SELECT * FROM (SELECT w AS window_id, t_start, t_end, k, round(sum(e) OVER (PARTITION BY w ORDER BY k) / total, 9) AS cpve FROM spectra JOIN totals USING (w)) WHERE k >= 3")
def dom29_rolling_cpve(spark, sf):
    return rounded(decompose.cpve(decompose.rolling_components(fx.matrix(spark, sf), SIZE, STEP), [3, 4, 5, 6, 7]), 9, "cpve")


@query(_WINDOWS + " SELECT k::INT AS k, (SELECT count(DISTINCT window_id) FROM w)::BIGINT AS windows, 0::BIGINT AS against FROM range(1, 6) f(k)")
def dom30_aligned_signs(spark, sf):
    """No aligned loading points against the one before it."""
    found = decompose.aligned(decompose.rolling_components(fx.matrix(spark, sf), SIZE, STEP, 5))
    turn = curves.dot(F.lag("loading").over(Window.partitionBy("k").orderBy("window_id")), F.col("loading"))
    return found.select("k", turn.alias("d")).groupBy("k").agg(F.count("*").alias("windows"), F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("against"))


@query(spectra(_ROLLED, 5) + " SELECT a.k, a.w AS window_id, round(abs(list_dot_product(a.u, b.u)), 6) AS product FROM spectra a JOIN spectra b ON a.k = b.k AND a.w = b.w + 1")
def dom30_aligned_products(spark, sf):
    """Each aligned loading's product with the one of the window before, which alignment makes positive."""
    found = decompose.aligned(decompose.rolling_components(fx.matrix(spark, sf), SIZE, STEP, 5))
    turn = curves.dot(F.lag("loading").over(Window.partitionBy("k").orderBy("window_id")), F.col("loading"))
    return rounded(found.select("k", "window_id", turn.alias("product")).filter("product IS NOT NULL"), 6, "product")


def _compared(window: str, kept: str) -> str:
    return f"""WITH o AS (SELECT vec_id AS t, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings), w AS (SELECT t, ({window})::INT AS window_id FROM o WHERE {kept})
    SELECT window_id, round(sum(v), 8) AS total, 64.0::DOUBLE AS length FROM (SELECT window_id, j, var_samp(y) AS v FROM w JOIN cells USING (t) GROUP BY 1, 2) GROUP BY 1"""


def _totals(found: DataFrame) -> DataFrame:
    """Each window's eigenvalues add up to the variance of its columns, its aligned loadings have unit length."""
    length = curves.dot(F.col("loading"), F.col("loading"))
    return rounded(rounded(found.groupBy("window_id").agg(F.sum("eigenvalue").alias("total"), F.sum(length).alias("length")), 8, "total"), 6, "length")


@query(_compared("r // (n // 4)", "r // (n // 4) < 4"))
def dom31_compared_windows(spark, sf):
    return _totals(decompose.compared_windows(fx.matrix(spark, sf), k=64))


@query(_compared("least(r // (n // 3), 2)", "true"))
def dom31_compared_windows_rest(spark, sf):
    """The rows that are left over go to the last window."""
    return _totals(decompose.compared_windows(fx.matrix(spark, sf), 3, 64, "last"))


@query("""WITH c AS (SELECT a.j AS i, b.j AS j, covar_samp(a.y, b.y) AS v FROM cells a JOIN cells b USING (t) GROUP BY 1, 2) SELECT round(sum(CASE WHEN i = j THEN v END), 8) AS total, round(sum(v * v), 8) AS squares FROM c""")
def dom28_spectrum(spark, sf):
    """Eigenvalues and their squares add up to the trace and the squared norm of the covariance."""
    found = decompose.pca(fx.matrix(spark, sf), 64)
    return rounded(found.agg(F.sum("eigenvalue").alias("total"), F.sum(F.col("eigenvalue") * F.col("eigenvalue")).alias("squares")), 8, "total", "squares")


@query("SELECT t, round(sum((y - m) * (y - m)), 7) AS energy, 0.0::DOUBLE AS gap FROM cells JOIN (SELECT j, avg(y) AS m FROM cells GROUP BY j) USING (j) GROUP BY t")
def dom28_fitted_and_residual(spark, sf):
    """Fitted curves and residuals are at right angles and add up to the curve."""
    rows = fx.matrix(spark, sf)
    fit = decompose.pca_fit(rows, decompose.pca(rows, 5)).crossJoin(F.broadcast(decompose.column_means(rows)))
    moved = F.zip_with("fitted", "means", lambda a, m: a - m)
    both = fit.select("t", (curves.dot(moved, moved) + curves.dot(F.col("residual"), F.col("residual"))).alias("energy"), F.aggregate(F.arrays_zip("y", "fitted", "residual"), F.lit(0.0), lambda s, v: s + F.abs(v["y"] - v["fitted"] - v["residual"])).alias("gap"))
    return rounded(both, 7, "energy", "gap")


@query(_WINDOWS + " SELECT window_id, min(t) AS t_start, max(t) AS t_end, k::INT AS k, 1.0::DOUBLE AS cpve FROM w, (VALUES (64), (100)) f(k) GROUP BY window_id, k")
def agg14_cumulative_share(spark, sf):
    """All components hold all of the variance; a number above theirs takes the last."""
    return rounded(decompose.cpve(decompose.rolling_components(fx.matrix(spark, sf), SIZE, STEP), [64, 100]), 9, "cpve")


@query(spectra(_ROLLED, 5) + f""", q AS ({polynomials(64)} SELECT unnest(range(5)) AS d, unnest([q0, q1, q2, q3, q4]) AS q FROM q)
SELECT t_end AS window_time, f::INT AS k, round(sqrt(2 * greatest(0, f - sum(list_dot_product(u, q.q) ** 2))), 9) AS distance FROM range(1, 6) r(f) JOIN spectra s ON s.k <= f JOIN q ON q.d < f JOIN totals USING (w) GROUP BY w, t_end, f""")
def dom34_rolling_distance(spark, sf):
    return rounded(decompose.rolling_distance(fx.matrix(spark, sf), SIZE, STEP), 9, "distance")


@query(_WINDOWS + " SELECT last AS window_time, k::INT AS k, true AS bounded FROM (SELECT window_id, max(t) AS last FROM w GROUP BY 1), range(1, 6) f(k)")
def dom32_distance_bounds(spark, sf):
    """0 <= distance <= sqrt(2 k), for each window and k."""
    found = decompose.rolling_distance(fx.matrix(spark, sf), SIZE, STEP)
    return found.select("window_time", "k", ((F.col("distance") >= 0) & (F.col("distance") <= F.sqrt(F.col("k") * 2) + 1e-9)).alias("bounded"))


_X = "SELECT i::INT AS j, -1 + 2.0 * i / 63 AS x FROM range(64) t(i)"


@query("""WITH x AS (SELECT i::INT AS j, -1 + 2.0 * i / 100 AS x FROM range(101) t(i)) SELECT j, round(x, 9) + 0.0 AS x, degree::INT AS degree, round(CASE degree WHEN 0 THEN 1 WHEN 1 THEN x WHEN 2 THEN (3 * x * x - 1) / 2 WHEN 3 THEN (5 * x * x * x - 3 * x) / 2 ELSE (35 * x * x * x * x - 30 * x * x + 3) / 8 END, 9) + 0.0 AS value FROM x, range(5) d(degree)""")
def dom38_basis(spark, sf):
    return rounded(decompose.basis_table(spark), 9, "x", "value")


@query(f"""WITH b AS ({_X}) SELECT k::INT AS k, i::INT AS i, CASE WHEN k = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS product FROM range(5) a(k), range(5) c(i)""")
def dom33_orthonormal_basis(spark, sf):
    """Columns of the orthonormal basis have unit length and no product with each other."""
    q = decompose.orthonormal_basis(64, 5)
    rows = spark.createDataFrame([(i, q[:, i].tolist()) for i in range(5)], "k int, v array<double>")
    other = rows.select(F.col("k").alias("i"), F.col("v").alias("u"))
    return rounded(rows.crossJoin(F.broadcast(other)).select("k", "i", curves.dot(F.col("v"), F.col("u")).alias("product")), 9, "product")


@query(f"WITH q AS ({polynomials(64)} SELECT unnest(range(1, 6)) AS k, unnest([q0, q1, q2, q3, q4]) AS q FROM q) SELECT vec_id AS t, k::INT AS k, round(list_dot_product(embedding::DOUBLE[], q.q) ** 2, 7) AS energy FROM embeddings, q")
def dom33_projected_energy(spark, sf):
    """The squared score of each curve on the orthonormal polynomials."""
    found = decompose.projections(fx.matrix(spark, sf), 5, 64)
    return rounded(found.select("t", "k", (F.col("score") * F.col("score")).alias("energy")), 7, "energy")


_AT_TICKS = "SELECT DISTINCT greatest(-1.0, least(1.0, (tickLower - poolTick) / 50.0))::DOUBLE AS x FROM hourly_liquidity"


@query(f"""SELECT round(x, 9) + 0.0 AS x, degree::INT AS degree, round(CASE degree WHEN 0 THEN 1 WHEN 1 THEN x WHEN 2 THEN (3 * x * x - 1) / 2 WHEN 3 THEN (5 * x * x * x - 3 * x) / 2 ELSE (35 * x * x * x * x - 30 * x * x + 3) / 8 END, 9) + 0.0 AS value FROM ({_AT_TICKS}), range(5) d(degree)""")
def dom38_basis_at_ticks(spark, sf):
    """The polynomials at every place that a stored tick takes."""
    points = curves.normalised(fx.hourly_liquidity(spark, sf), -1, None).select(F.col("tick_norm").alias("x")).distinct()
    return rounded(decompose.basis_at(points), 9, "x", "value")


@query(f"WITH w AS ({weights_sql()}) SELECT t, degree::INT AS degree, round(sum((y - m) * w), 7) + 0.0 AS score FROM cells JOIN (SELECT j, avg(y) AS m FROM cells GROUP BY j) USING (j) JOIN w USING (j) GROUP BY t, degree")
def dom35_legendre_scores(spark, sf):
    return rounded(decompose.legendre_scores(fx.matrix(spark, sf)), 7, "score")


@query(f"WITH w AS ({weights_sql()}) SELECT t, " + ", ".join(f"round(sum((y - m) * w) FILTER (degree = {d}), 7) + 0.0 AS Legendre_deg{d}" for d in range(6)) + " FROM cells JOIN (SELECT j, avg(y) AS m FROM cells GROUP BY j) USING (j) JOIN w USING (j) GROUP BY t")
def scl12_score_columns(spark, sf):
    return decompose.score_columns(rounded(decompose.legendre_scores(fx.matrix(spark, sf), p=64), 7, "score"))


def _series(variant: str, centered: bool) -> str:
    return f"""SELECT '{variant}' AS variant, hour_s AS t, degree::INT AS degree, round(sum((value - m) * w), 6) + 0.0 AS score FROM (
    WITH c AS ({_norm(centered, _LAST)}), x AS (SELECT tick_norm, row_number() OVER (ORDER BY tick_norm) - 1 AS j FROM (SELECT DISTINCT tick_norm FROM c)),
    d AS (SELECT h.hour_s, j, ln(1 + coalesce(v, 0)) AS value FROM (SELECT DISTINCT hour_s FROM c) h CROSS JOIN x LEFT JOIN (SELECT hour_s, tick_norm, sum(total) AS v FROM c GROUP BY 1, 2) s ON s.hour_s = h.hour_s AND s.tick_norm = x.tick_norm)
    SELECT d.*, avg(value) OVER (PARTITION BY j) AS m FROM d) JOIN weights101 USING (j) GROUP BY hour_s, degree"""


@query(f"WITH weights101 AS ({weights_sql(2 * curves.HALF_WIDTH + 1)}) {_series('price', False)} UNION ALL {_series('peg', True)}")
def dom39_score_series(spark, sf):
    price, peg = (curves.dense_rows(_curves(spark, sf, c, None)) for c in (False, True))
    return rounded(decompose.score_series(5, 2 * curves.HALF_WIDTH + 1, price=price, peg=peg), 6, "score")


@query(f"WITH s AS ({smoother_sql(64)}), m AS (SELECT j, avg(y) AS m FROM cells GROUP BY j), c AS (SELECT j, y, m FROM cells JOIN m USING (j) WHERE t = 7) SELECT i::INT AS j, round(b.y, 7) AS y, round(sum(s * (c.y - c.m)) + b.m, 7) AS fitted, round(b.y - sum(s * (c.y - c.m)) - b.m, 7) + 0.0 AS residual FROM s JOIN c USING (j) JOIN c b ON b.j = i GROUP BY i, b.y, b.m")
def dom37_reconstruction(spark, sf):
    return rounded(decompose.reconstruction(fx.matrix(spark, sf), 7), 7, "y", "fitted", "residual")


@query(f"WITH s AS ({smoother_sql(64)}), m AS (SELECT j, avg(y) AS m FROM cells GROUP BY j), c AS (SELECT t, j, y, y - m AS x FROM cells JOIN m USING (j)), f AS (SELECT c.t, s.i, sum(s.s * c.x) AS f FROM c JOIN s USING (j) GROUP BY 1, 2) SELECT c.t, round(sum((c.x - f.f) * (c.x - f.f)), 6) AS residual, round(sum(c.y - c.x + f.f), 6) + 0.0 AS fitted FROM f JOIN c ON c.t = f.t AND c.j = f.i GROUP BY 1")
def dom35_fitted_and_residual(spark, sf):
    """Sums over the fitted curve and the squared residuals of every curve."""
    fit = decompose.legendre_fit(fx.matrix(spark, sf), p=64)
    total = F.aggregate("fitted", F.lit(0.0), lambda s, v: s + v)
    return rounded(fit.select("t", curves.dot(F.col("residual"), F.col("residual")).alias("residual"), total.alias("fitted")), 6, "residual", "fitted")


@query("SELECT event_id, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS at, s AS back FROM ev")
def prj4_timestamps(spark, sf):
    df = fx.events(spark, sf).withColumn("at", scalars.timestamp_of(F.col("s")))
    return df.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), scalars.epoch_of(F.col("at")).alias("back"))


@query("SELECT event_id, (value % 7 >= 1)::INT AS finite FROM ev")
def scl8_finite(spark, sf):
    """What a division by zero, an overflow or a logarithm leaves isn't finite."""
    v = F.col("value")
    odd = F.when(v % 7 < 0.25, F.lit(None).cast("double")).when(v % 7 < 0.5, F.lit(float("nan"))).when(v % 7 < 0.75, F.lit(float("inf"))).when(v % 7 < 1, F.lit(float("-inf"))).otherwise(v)
    return fx.events(spark, sf).select("event_id", scalars.finite(odd).cast("int").alias("finite"))
