"""Closed forms, NumPy counterparts and the traps of null, NaN, ties and empty input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import curves, decompose, market, ordered, stableswap, ticks
from tidemark.sources.tables import linspace, load, logspace


def column(df, name):
    return [r[name] for r in df.collect()]


# --- sources and scalars ---
def test_grids(spark):
    assert np.allclose(column(linspace(spark, -1, 1, 101), "x"), np.linspace(-1, 1, 101))
    assert np.allclose(column(logspace(spark, 0.1, 5, 50), "x"), np.logspace(np.log10(0.1), np.log10(5), 50))
    assert column(linspace(spark, 3, 9, 1), "x") == [3.0]


def test_load_names_missing_columns_and_turns_nan_into_null(spark, tmp_path):
    spark.createDataFrame([(1, float("nan")), (2, 1.5)], "a int, b double").write.parquet(str(tmp_path / "t"))
    assert sorted(column(load(spark, str(tmp_path / "t")), "b"), key=str) == [1.5, None]
    with pytest.raises(ValueError, match="c"):
        load(spark, str(tmp_path / "t"), ["a", "c"])


def test_clip_keeps_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-5.0,), (0.5,), (7.0,)], "x double")
    got = column(df.select(scalars.clip(F.col("x"), -1.0, 1.0).alias("x")), "x")
    assert got[0] is None and np.isnan(got[1]) and got[2:] == [-1.0, 0.5, 1.0]


def test_labels(spark):
    df = spark.createDataFrame([(1234567.0,), (1500.0,), (0.25,), (12.0,), (None,), (-2e6,), (1234567e6,)], "x double")
    assert column(df.select(scalars.human_number(F.col("x")).alias("x")), "x") == ["1.23457M", "1.5K", "0.25", "12", None, "-2M", "1234567M"]
    assert column(spark.range(1).select(scalars.percent_label(F.lit(0.256)).alias("x")), "x") == ["25 %"]
    assert column(spark.range(1).select(scalars.iso_label(F.lit(1704071045)).alias("x")), "x") == ["2024-01-01T01:04:05+00:00"]
    assert column(spark.range(1).select(scalars.ratio(F.lit(1.0), F.lit(0.0)).alias("x")), "x") == [None]


# --- ordered passes ---
def test_numbered_and_gaps_equal_one_ordered_pass(spark):
    values = [int(v) for v in np.random.default_rng(1).permutation(500) * 7]
    df = spark.createDataFrame([(v,) for v in values], "s long")
    got = sorted((r["s"], r["rn"]) for r in ordered.numbered(df, "s", 100).collect())
    assert got == [(v, i) for i, v in enumerate(sorted(values))]
    assert column(ordered.gaps(df, "s", 100), "gap") == [7] * 499
    assert market.median_gap(df.limit(1), "s").first()["gap"] == 60.0
    assert ordered.numbered(df.limit(0), "s").count() == 0


# --- candles ---
def test_candles_need_their_columns_and_doji_is_not_green(spark):
    with pytest.raises(ValueError):
        market.candles(spark.range(1))
    df = spark.createDataFrame([(0, 1.0, 2.0, 0.5, 1.0), (60, 1.0, 3.0, 1.0, 2.0)], "hour_s long, open double, high double, low double, close double")
    rows = market.candles(df).orderBy("hour_s").collect()
    assert [r["green"] for r in rows] == [False, True] and [r["bottom"] for r in rows] == [1.0, 1.0] and rows[0]["width"] == 48.0


def test_bad_price_text_raises(spark):
    candle = spark.createDataFrame([(h * 3600, 1.0, 1.0, 1.0, 1.0) for h in range(10)], "hour_s long, open double, high double, low double, close double")
    prices = spark.createDataFrame([(1, "x")], "timestamp long, token1Price string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        market.replay_prices(candle, prices, 5, 5).collect()


# --- stableswap ---
def newton_d(x, a):
    d, n = sum(x), len(x)
    for _ in range(256):
        p = d
        for v in x:
            p = p * d / (v * n)
        d = (a * n * sum(x) + p * n) * d / ((a * n - 1) * d + (n + 1) * p)
    return d


def test_invariant_is_newtons_fixed_point_and_quotes_keep_it(spark):
    pools = [(i, *map(float, v)) for i, v in enumerate(np.random.default_rng(2).uniform(100, 9000, (20, 3)))]
    df = spark.createDataFrame(pools, "hour_s long, bal_DAI double, bal_USDC double, bal_USDT double")
    for r, (_, *x) in zip(stableswap.quotes(df, 200.0).orderBy("hour_s").collect(), pools, strict=True):
        assert r["d"] == pytest.approx(newton_d(x, 200.0), rel=1e-12)
        after = [x[0], x[1] + 1, x[2] - r["usdc_usdt"]]
        assert newton_d(after, 200.0) == pytest.approx(r["d"], rel=1e-9)


def test_balanced_pool_and_broken_pools(spark):
    rows = [(0, 5.0, 5.0, 5.0), (1, 0.0, 5.0, 5.0), (2, None, 5.0, 5.0), (3, float("nan"), 5.0, 5.0), (4, -1.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "hour_s long, bal_DAI double, bal_USDC double, bal_USDT double")
    got = stableswap.quotes(df).orderBy("hour_s").collect()
    assert got[0]["d"] == pytest.approx(15.0) and all(r["d"] is None and r["usdc_usdt"] is None for r in got[1:])
    assert spark.range(1).select(stableswap.invariant_d([F.lit(0.0), F.lit(0.0)], F.lit(10.0)).alias("d")).first()["d"] == 0.0


def test_amplification_by_time_must_be_there(spark):
    df = spark.createDataFrame([(0, 5.0, 5.0, 5.0), (1, 5.0, 5.0, 5.0)], "hour_s long, bal_DAI double, bal_USDC double, bal_USDT double")
    some = spark.createDataFrame([(0, 100.0)], "hour_s long, a double")
    assert stableswap.quotes(df.limit(1), some).count() == 1
    with pytest.raises(Exception, match="no amplification"):
        stableswap.quotes(df, some).collect()


def test_interpolation_and_gradient_like_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.sort(rng.uniform(0, 10, 40))
    y, at = rng.normal(size=40), np.linspace(-1, 11, 77)
    nodes = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "k int, x double, y double")
    points = spark.createDataFrame([(1, float(a)) for a in at], "k int, at double")
    got = stableswap.interpolated(nodes, points, "k", "x", "y", "at").orderBy("at")
    assert np.allclose(column(got, "y"), np.interp(at, x, y))
    assert np.allclose(column(nodes.orderBy("x").withColumn("g", stableswap.gradient(nodes, "k", "x", "y", "x")).orderBy("x"), "g"), np.gradient(y, x))


def test_balanced_marginal_price_is_one(spark):
    p = stableswap.marginal_price(F.lit(1.0), F.lit(2.0), F.lit(100.0))
    assert spark.range(1).select(p.alias("p")).first()["p"] == pytest.approx(1.0, abs=1e-5)


# --- ticks ---
def book(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], "timestamp long, tickLower int, tickUpper int, poolTick int, active_liquidity_L double, entry int")


def test_one_interval_telescopes(spark):
    df = ticks.swap_size_curve(book(spark, [(-100, 100, 0, 7.0, 1)]), 20, order="entry").orderBy("k_ticks").collect()
    for k, r in enumerate(df, 1):
        assert r["token1_in_to_move_up"] == pytest.approx(7 * (1.0001 ** (k / 2) - 1))
        assert r["token0_in_to_move_down"] == pytest.approx(7 * (1.0001 ** (k / 2) - 1))
    charged = ticks.swap_size_curve(book(spark, [(-100, 100, 0, 7.0, 1)]), 20, 0.5, order="entry").orderBy("k_ticks").collect()
    assert charged[4]["token1_in_to_move_up"] == pytest.approx(2 * df[4]["token1_in_to_move_up"])
    wide = ticks.swap_size_curve(book(spark, [(-100, 100, 0, 7.0, 1)]), 4, tick_step=5, order="entry").orderBy("k_ticks").collect()
    assert [r["k_ticks"] for r in wide] == [5, 10, 15, 20] and wide[3]["token1_in_to_move_up"] == pytest.approx(df[19]["token1_in_to_move_up"])


def test_missing_tick_raises(spark):
    with pytest.raises(Exception, match="no liquidity"):
        ticks.swap_size_curve(book(spark, [(-3, 100, 0, 7.0, 1)]), 5, order="entry").collect()


def test_overlapping_intervals(spark):
    df = book(spark, [(0, 3, 0, 1.0, 1), (1, 2, 0, 5.0, 2), (4, 4, 0, 9.0, 3), (6, 5, 0, 9.0, 4)])
    assert sorted(map(tuple, ticks.liquidity_by_tick(df, "entry").collect())) == [(0, 1.0), (1, 5.0), (2, 1.0)]
    assert sorted(map(tuple, ticks.liquidity_by_tick(df, "entry", "sum").collect())) == [(0, 1.0), (1, 6.0), (2, 1.0)]


def test_positions_cover_both_ends(spark):
    grid = spark.createDataFrame([(v,) for v in (0.5, 1.0, 1.5, 2.0, 3.0)], "p double")
    rows = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 2.5, 1.0), (9.0, 8.0, 4.0)], "pa double, pb double, liquidity double")
    assert column(ticks.position_liquidity(grid, rows).orderBy("p"), "liquidity") == [0.0, 5.0, 5.0, 6.0, 0.0]


def test_frames_without_rows_stay(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.0, 0.0), (7200, 1.0, 0.0, 1.0), (7200, 1.5, 0.0, 1.0)], "hour_s long, priceMid double, usd_token0 double, usd_token1 double")
    got = ticks.hourly_frames(rows, 0, 4).orderBy("frame").collect()
    assert [r["n"] for r in got] == [1, 0, 2, 0] and got[0]["width"] == 0.0001 and got[2]["width"] == pytest.approx(0.4) and got[2]["active"] is None
    assert ticks.frame_limits(rows.limit(0), 0, 4).first()["ymax"] == 1.0


# --- curves ---
def test_quantile_windows_keep_ties_and_refuse_equal_edges(spark):
    df = spark.createDataFrame([(v,) for v in [1, 1, 2, 3, 4, 5, 6, 7, 7, 9]], "v int")
    import pandas as pd

    want = pd.qcut(pd.Series([1, 1, 2, 3, 4, 5, 6, 7, 7, 9]), 4, labels=False).tolist()
    assert column(curves.quantile_windows(df, "v").orderBy("v"), "window") == want
    with pytest.raises(Exception, match="coincide"):
        curves.quantile_windows(spark.createDataFrame([(1,), (1,), (1,)], "v int"), "v").collect()


@pytest.mark.parametrize("n,size,step", [(50, 10, 3), (10, 10, 1), (9, 10, 1), (100, 7, 10)])
def test_hopping_windows_equal_a_loop(spark, n, size, step):
    rows = spark.range(n).select(F.col("id").alias("rn"))
    got = sorted((r["window_id"], r["rn"]) for r in curves.hopping_windows(rows, n, size, step).collect())
    assert got == [(i, r) for i, s in enumerate(range(0, n - size + 1, step)) for r in range(s, s + size)]


def test_equal_windows(spark):
    rows = spark.range(11).select(F.col("id").alias("rn"))
    assert curves.equal_windows(rows, 11).count() == 8
    assert column(curves.equal_windows(rows, 11, rest="last").orderBy("rn"), "window") == [0, 0, 1, 1, 2, 2, 3, 3, 3, 3, 3]
    with pytest.raises(ValueError):
        curves.equal_windows(rows, 3)


# --- decomposition ---
def frame(spark, y):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(y)], "t long, y array<double>")


def test_tall_and_plain_components_like_numpy(spark):
    y = np.random.default_rng(4).normal(size=(60, 6)) * [5, 4, 3, 2, 1, 0.5]
    eigen = np.linalg.svd(y - y.mean(0))[1] ** 2 / 59
    for df in (decompose.pca(frame(spark, y).repartition(5), 6), decompose.components(frame(spark, y).withColumn("window_id", F.lit(0)))):
        rows = df.orderBy("k").collect()
        assert np.allclose([r["eigenvalue"] for r in rows], eigen) and rows[-1]["cpve"] == pytest.approx(1.0)
        v = np.array([r["loading"] for r in rows])
        assert np.allclose(v @ v.T, np.eye(6))
    with pytest.raises(Exception, match="7 components"):
        decompose.pca(frame(spark, y), 7).collect()


def test_alignment_like_a_loop_also_with_zero_products(spark):
    v = np.random.default_rng(5).normal(size=(30, 4))
    v[11] = 0
    df = spark.createDataFrame([(i, 1, r.tolist()) for i, r in enumerate(v)], "window_id int, k int, loading array<double>")
    for i in range(1, 30):
        if v[i - 1] @ v[i] < 0:
            v[i] = -v[i]
    assert np.allclose(column(decompose.aligned(df).orderBy("window_id"), "loading"), v)


def test_distance_like_singular_values(spark):
    y = np.random.default_rng(6).normal(size=(40, 9))
    got = decompose.rolling_distance(frame(spark, y), 20, 10, (1, 3), "chordal").orderBy("window_time", "k").collect()
    want = []
    for s in (0, 10, 20):
        x = y[s : s + 20] - y[s : s + 20].mean(0)
        v = np.linalg.svd(x, full_matrices=False)[2]
        for k in (1, 3):
            sigma = np.linalg.svd(v[:k] @ decompose.orthonormal_basis(9, k))[1]
            want.append((s + 19, k, np.sqrt((1 - np.clip(sigma, 0, 1) ** 2).sum())))
    assert [(r[0], r[1]) for r in got] == [w[:2] for w in want] and np.allclose([r[2] for r in got], [w[2] for w in want])
    assert decompose.rolling_distance(frame(spark, y), 41).count() == 0
    for bad in ({"metric": "x"}, {"time_index": "x"}):
        with pytest.raises(ValueError):
            decompose.rolling_distance(frame(spark, y), **bad).collect()


def test_polynomials_are_reconstructed(spark):
    x = np.linspace(-1, 1, 11)
    y = np.array([[1 + a * x[j] ** 5 - a * x[j] ** 2 for j in range(11)] for a in range(7)])
    assert max(abs(r["residual"]) for r in decompose.reconstruction(frame(spark, y), 3).collect()) < 1e-7
    with pytest.raises(KeyError):
        decompose.reconstruction(frame(spark, y), 99)
    with pytest.raises(ValueError):
        decompose.legendre_scores(frame(spark, y), kind="chebyshev")


# --- traps of magnitude, order and several snapshots ---
def test_small_positions_stay_beside_large_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(1.0, 2.0, 1e18), (1.0, 2.5, 0.1), (1.0, 1.0, 3.0), (None, 2.0, 1.0), (float("nan"), 2.0, 1.0)]
    rows += [(float(a), float(a + w), float(v)) for a, w, v in zip(rng.integers(0, 60, 300) / 10, rng.integers(0, 30, 300) / 10, 10.0 ** rng.integers(-3, 18, 300), strict=True)]
    points = sorted([2.2, 3.0, 1.0, 2.5, *(rng.integers(-5, 110, 200) / 10).tolist()])
    df = spark.createDataFrame(rows, "pa double, pb double, liquidity double")
    got = ticks.position_liquidity(spark.createDataFrame([(p,) for p in points] + [(None,)], "p double"), df).collect()
    want = [sum(v for a, b, v in rows if a is not None and a <= p <= b) for p in points]
    assert [r["p"] for r in sorted(got, key=lambda r: (r["p"] is not None, r["p"]))] == [None, *points]
    assert [r["liquidity"] for r in sorted((r for r in got if r["p"] is not None), key=lambda r: r["p"])] == pytest.approx(want, rel=1e-12)
    assert [r["liquidity"] for r in ticks.position_liquidity(spark.createDataFrame([(2.2,), (3.0,)], "p double"), df.limit(2)).orderBy("p").collect()] == [0.1, 0.0]
    assert column(ticks.position_liquidity(spark.createDataFrame([(1.0,)], "p double"), df.limit(0)), "liquidity") == [0.0]


def test_long_interpolations_are_one_pass(spark):
    import time

    nodes = spark.range(24_000).select(F.lit(1).alias("a"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    points = spark.range(600).select(F.lit(1).alias("a"), (F.col("id") * 40 + 0.5).alias("p"))
    began = time.perf_counter()
    got = stableswap.interpolated(nodes, points, "a", "x", "y", "p").collect()
    assert time.perf_counter() - began < 10 and all(r["y"] == pytest.approx(2 * r["p"]) for r in got if r["p"] < 23_999) and len(got) == 600


def test_a_short_time_is_dealt_to_many_cells(spark):
    df = spark.range(20_000).select((F.col("id") % 2_000_000).alias("s"))
    sizes = column(ordered.dealt(df, "s", cells=500).groupBy("_cell").count(), "count")
    assert len(sizes) > 400 and max(sizes) < 4 * 20_000 / len(sizes)
    ties = spark.createDataFrame([(5,)] * 7 + [(None,), (9,)], "s long")
    assert sorted((r["rn"], r["s"]) for r in ordered.numbered(ties, "s").collect()) == [(0, None), *((i, 5) for i in range(1, 8)), (8, 9)]
    assert sorted(column(ordered.gaps(ties, "s"), "gap")) == [0] * 6 + [4]


def test_a_snapshot_has_one_pool_tick_and_wide_intervals_are_cut(spark):
    two = book(spark, [(-10, 10, 0, 7.0, 1), (-10, 10, 1, 7.0, 2)])
    with pytest.raises(Exception, match="several pool ticks"):
        ticks.swap_size_curve(two, 3, order="entry").collect()
    wide = book(spark, [(-887_272, 887_272, 0, 7.0, 1)])
    assert ticks.liquidity_by_tick(wide, "entry", reach=5).count() == 10 and ticks.swap_size_curve(wide, 3, order="entry").count() == 3


def test_replay_sums_equal_the_rows(spark):
    candle_rows = spark.createDataFrame([(i * 10, 1.0, 2.0, 0.5, 1.5) for i in range(12)], "hour_s long, open double, high double, low double, close double")
    prices = spark.createDataFrame([(i * 3, str(i / 2)) for i in range(60)], "timestamp long, token1Price string")
    args = (candle_rows, prices, 4, 4, 1, 20, 2)
    rows = market.replay_prices(*args).groupBy("k", "cutoff").agg(F.count("*").alias("n"), F.max("timestamp").alias("last_s"), F.sum("price").alias("total"))
    assert sorted(map(tuple, market.replay_price_sums(*args).collect())) == sorted(map(tuple, rows.collect()))


def test_fits_like_numpy_also_on_other_points(spark):
    rng = np.random.default_rng(8)
    y = rng.normal(size=(40, 7)).cumsum(1)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y)], "t long, y array<double>")
    m = y.mean(0)
    v = np.linalg.svd(y - m, full_matrices=False)[2][:3]
    got = {r["t"]: r for r in decompose.pca_fit(df, decompose.pca(df, 3)).collect()}
    assert np.allclose([got[i]["fitted"] for i in range(40)], m + (y - m) @ v.T @ v) and np.allclose([got[i]["residual"] for i in range(40)], (y - m) - (y - m) @ v.T @ v)
    x = [-1.0, -0.8, -0.1, 0.0, 0.3, 0.9, 1.0]
    phi = np.polynomial.legendre.legvander(x, 2)
    smooth = phi @ np.linalg.inv(phi.T @ phi + 1e-10 * np.eye(3)) @ phi.T
    got = {r["t"]: r for r in decompose.legendre_fit(df, 2, x=x).collect()}
    assert np.allclose([got[i]["fitted"] for i in range(40)], m + (y - m) @ smooth.T)
    for bad in (x[:-1], [*x[:-1], 1.5]):
        with pytest.raises(ValueError):
            decompose.legendre_scores(df, 2, x=bad)
    with pytest.raises(Exception, match="points"):
        decompose.legendre_scores(df, 2, p=5).collect()
    assert decompose.cpve(decompose.pca(df, 7), [3, 99]).filter("k = 99").first()["cpve"] == pytest.approx(1.0)
