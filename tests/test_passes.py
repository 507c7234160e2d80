"""Orders by splitters, quantiles, places in stored tables, pushed bounds, exact sums and rolling factors."""

import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import curves, decompose, ordered, stableswap, ticks
from tidemark.plans import queries
from tidemark.sources import fixtures as fx
from tidemark.sources.tables import floored_within, last_of_each, last_rows, positioned

N = 20_000
VALUES = {
    "outlier": "CASE WHEN id = 5 THEN 1e15 ELSE double(id % 1000) END",
    "tied": "3.0D",
    "skewed": "power(1.002D, id % 10000)",
    "odd": "CASE WHEN id % 3 = 0 THEN null WHEN id % 7 = 0 THEN double('NaN') ELSE -double(id) END",
}


@pytest.mark.parametrize("kind", VALUES)
def test_cells_are_even_and_numbers_the_same_at_every_run(spark, kind):
    df = spark.range(N).select(F.expr(VALUES[kind]).alias("v"), "id")
    sizes = [r["count"] for r in ordered.dealt(df, "v", cells=100).groupBy("_cell").count().collect()]
    assert len(sizes) > 80 and max(sizes) < 4 * N / len(sizes)
    first, again = (sorted(map(str, ordered.numbered(d, "v", 100).collect())) for d in (df, df.repartition(7, "v")))
    assert first == again
    rows = sorted(ordered.numbered(df, "v", 100, ("id",)).collect(), key=lambda r: r["rn"])
    place = lambda r: (r["v"] is not None, math.isnan(r["v"] or 0), 0 if r["v"] is None or math.isnan(r["v"]) else r["v"], r["id"])
    assert [r["rn"] for r in rows] == list(range(N)) and [r["id"] for r in rows] == [r["id"] for r in sorted(rows, key=place)]
    whole = sorted(ordered.numbered(df, "v", N, ("id",)).collect(), key=lambda r: r["rn"])  # one window
    assert [r["id"] for r in whole] == [r["id"] for r in rows]


def test_repeated_rows_stay_together_and_are_all_numbered(spark):
    df = spark.range(9_000).select((F.col("id") % 3).alias("v"))
    assert sorted(map(tuple, ordered.numbered(df, "v", 10).collect())) == sorted((i // 3000, i) for i in range(9_000))
    assert ordered.numbered(df.limit(0), "v", 1).collect() == []


def test_running_sums_within_groups(spark):
    df = spark.range(5_000).select((F.col("id") % 4).alias("g"), (F.col("id") * 7919 % 5_000).alias("v"))
    for cells in (20, 4096):
        rows = ordered.running_sum(df, ["v"], "v", "total", cells, ["g"]).collect()
        for g in range(4):
            mine = sorted((r for r in rows if r["g"] == g), key=lambda r: r["v"])
            assert [r["total"] for r in mine] == np.cumsum([r["v"] for r in mine]).tolist()


@pytest.mark.parametrize("cells", [5, 4096])
def test_quantiles_like_numpy(spark, cells):
    rng = np.random.default_rng(2)
    for values in (rng.integers(0, 40, 3_001).astype(float), rng.normal(size=2_000) ** 9, np.full(700, 2.5), np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        got = ordered.quantiles(df, "v", [0, 0.25, 0.5, 0.9, 1], cells).first()
        want = np.quantile(values, [0, 0.25, 0.5, 0.9, 1])
        assert got["n"] == len(values) and got["quantiles"] == pytest.approx(want, rel=1e-12)
    assert tuple(ordered.quantiles(spark.createDataFrame([], "v double"), "v", [0.5], cells).first()) == (0, None)


def test_places_in_files_that_are_not_sorted(spark, sf, tmp_path):
    rng = random.Random(4)
    path = str(tmp_path / "t")
    for part in ("b", "a", "c"):
        spark.createDataFrame([(rng.randint(0, 9), rng.random()) for _ in range(50)], "k int, v double").coalesce(1).write.mode("append").parquet(f"{path}/{part}")
    df = positioned(spark.newSession(), f"{path}/*", ["k", "v"], "place")
    want = duckdb.sql(f"SELECT k, v, row_number() OVER (ORDER BY filename, file_row_number) - 1 AS place FROM read_parquet('{path}/*/*.parquet', filename = true, file_row_number = true)").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert [tuple(r) for r in last_rows(df, 3, "place").collect()] == sorted(want, key=lambda r: -r[2])[:3]
    assert {r["k"]: r["v"] for r in last_of_each(df, "k", place="place").collect()} == {k: v for k, v, _ in sorted(want, key=lambda r: r[2])}
    one = duckdb.sql(f"SELECT l_orderkey, l_linenumber, file_row_number FROM read_parquet('{sf}/lineitem.parquet', file_row_number = true)").fetchall()
    assert sorted(map(tuple, positioned(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber"]).collect())) == sorted(one)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Sort [place" not in plan and "rangepartitioning" not in plan
    with pytest.raises(ValueError, match="no x"):
        positioned(spark, f"{sf}/lineitem.parquet", ["x"])


def test_bounds_of_logical_hours_reach_the_scan(spark, sf):
    low, high = 1704456000, 1704463200
    for make in (fx.events, fx.hourly_liquidity, fx.venue_metrics):
        pushed = [line for line in make(spark, sf, low, high)._jdf.queryExecution().executedPlan().toString().splitlines() if "PushedFilters" in line]
        assert pushed and all("GreaterThanOrEqual(ts," in line and "LessThan(ts," in line for line in pushed)
    whole = fx.hourly_liquidity(spark, sf)
    for first, last in ((low, high), (low + 1, high + 1), (low - 1, high - 1), (None, high), (low, None), (low + 1, low + 3598)):
        kept = whole.filter(F.lit(True) if first is None else F.col("hour_s") >= first).filter(F.lit(True) if last is None else F.col("hour_s") <= last)
        assert sorted(map(str, fx.hourly_liquidity(spark, sf, first, last).collect())) == sorted(map(str, kept.collect()))
    assert str(floored_within("ts", 3600)) == str(F.lit(True))


def test_limbs_add_and_take_off_without_a_trace(spark):
    rng = random.Random(9)
    values = [0.0, 1.0, -1.0, 5e-324, -5e-324, 1.7976931348623157e308, 2.0**31, 2.0**32, 2.0**-32, 0.1, 1e300, 1e-300, 2.2250738585072014e-308]
    values += [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(-1000, 1000) for _ in range(300)] + [2.0**e for e in range(-1074, 1024, 31)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ticks.limbs(F.col("v")).alias("x"), ticks.from_limbs(ticks.limbs(F.col("v"))).alias("back")).collect()
    for r in rows:
        assert sum((Fraction(x["limb"]) * Fraction(2) ** (ticks.LIMB * x["bin"]) for x in r["x"] or []), Fraction(0)) == Fraction(r["v"])
        assert (r["back"] or 0.0) == r["v"]


def test_position_liquidity_is_exact_beside_large_positions(spark):
    rng = random.Random(10)
    made = [(a, a + rng.randint(0, 30), rng.choice([1e-9, 0.1, 3.0, 1e18, 1e120]) * rng.random()) for a in (rng.randint(0, 100) for _ in range(400))]
    points = [rng.randint(-2, 140) + rng.choice([0.0, 0.5]) for _ in range(100)] + [None, float("nan"), 7.0, 7.0]
    df = spark.createDataFrame([(float(a), float(b), v) for a, b, v in made] + [(None, 1.0, 1.0), (3.0, 2.0, 1.0), (float("nan"), 1.0, 1.0), (1.0, 2.0, None)], "pa double, pb double, liquidity double")
    got = ticks.position_liquidity(spark.createDataFrame([(p,) for p in points], "p double"), df).collect()
    assert len(got) == len(points)
    for r in got:
        want = sum((Fraction(v) for a, b, v in made if r["p"] is not None and a <= r["p"] <= b), Fraction(0))
        assert r["liquidity"] == pytest.approx(float(want), rel=1e-15)
    with pytest.raises(Exception, match="finite"):
        ticks.position_liquidity(spark.createDataFrame([(1.0,)], "p double"), spark.createDataFrame([(0.0, 2.0, float("inf"))], "pa double, pb double, liquidity double")).collect()


def curves_of(spark, y):
    return spark.createDataFrame([(3 * i, r.tolist()) for i, r in enumerate(y)], "t long, y array<double>").repartition(5)


@pytest.mark.parametrize(("n", "p", "size", "step", "k", "center"), [(50, 4, 10, 3, None, True), (50, 4, 10, 10, None, True), (50, 4, 10, 25, None, True), (47, 6, 5, 1, 2, True), (9, 4, 10, 1, None, True), (60, 5, 12, 4, 3, False), (760, 5, 720, 1, None, True), (1500, 3, 720, 24, 2, True)])
def test_rolling_factors_equal_the_copying_form(spark, n, p, size, step, k, center):
    y = np.random.default_rng(n).normal(size=(n, p)).cumsum(0) + 1000
    df = curves_of(spark, y)
    rows = decompose.rolling_components(df, size, step, k, center).orderBy("window_id", "k").collect()
    copied = decompose.components(decompose.rolling_windows(df, size, step, n), k, center).orderBy("window_id", "k").collect()
    assert [r[:4] for r in rows] == [r[:4] for r in copied] and len({r["window_id"] for r in rows}) == (max(0, (n - size) // step + 1) if n >= size else 0)
    for name in ("eigenvalue", "cpve"):
        assert np.allclose([r[name] for r in rows], [r[name] for r in copied], rtol=1e-9, atol=1e-9 * max([1.0, *(r["eigenvalue"] for r in copied)]))
    for a, b in zip(rows, copied, strict=True):
        assert abs(np.dot(a["loading"], b["loading"])) == pytest.approx(1, abs=1e-6) or a["eigenvalue"] < 1e-6


def test_rolling_plans_copy_no_row(spark):
    plan = decompose.rolling_components(curves_of(spark, np.eye(4)), 2, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    with pytest.raises(ValueError):
        decompose.rolling_components(curves_of(spark, np.eye(4)), 0, 1)
    with pytest.raises(Exception, match="components of"):
        decompose.rolling_components(curves_of(spark, np.eye(4)), 2, 1, 3).collect()


def test_bars_of_frames_keep_empty_ones(spark):
    rows = spark.createDataFrame([(0, 1.0, 0.0, 2.0), (0, 1.5, 3.0, 0.0), (7200, 2.0, 1.0, 1.0)], "hour_s long, priceMid double, usd_token0 double, usd_token1 double")
    got = sorted(map(tuple, ticks.frame_bars(rows, 0, 4).collect()), key=str)
    assert got == sorted([(0, 0, 1.0, 0.0, 2.0, 0.4, 1.5), (0, 0, 1.5, 3.0, 0.0, 0.4, 1.5), (1, 3600, None, None, None, None, None), (2, 7200, 2.0, 1.0, 1.0, 0.0001, 2.0), (3, 10800, None, None, None, None, None)], key=str)


@pytest.mark.parametrize("kind", VALUES)
@pytest.mark.parametrize("by", [None, ["g"]])
def test_neighbours_are_carried_across_cells(spark, kind, by):
    rows = spark.range(3_000).select(F.expr(VALUES[kind]).alias("v"), "id", F.expr("CASE WHEN id % 5 > 0 THEN id % 2 END").alias("g"), F.expr("CASE WHEN id % 41 = 0 OR id BETWEEN 900 AND 1100 THEN id END").alias("held"))
    rows = rows.cache()
    few, many = (sorted((tuple(map(str, r)) for r in ordered.around(rows, ["v", "id"], "held", "left", "right", cells, by).select("id", "g", "left", "right").collect()), key=str) for cells in (4096, 40))
    assert few == many and len(few) == 3_000
    kept = {r["id"]: r for r in rows.collect()}
    order = sorted(kept, key=lambda i: (kept[i]["v"] is not None, kept[i]["v"] is not None and math.isnan(kept[i]["v"]), 0 if kept[i]["v"] is None or math.isnan(kept[i]["v"]) else kept[i]["v"], i))
    last, want = {}, {}
    for i in order:
        g = kept[i]["g"] if by else 0
        last[g] = kept[i]["held"] if kept[i]["held"] is not None else last.get(g)
        want[i] = [last[g]]
    last = {}
    for i in reversed(order):
        g = kept[i]["g"] if by else 0
        want[i].append(last.get(g))
        last[g] = kept[i]["held"] if kept[i]["held"] is not None else last.get(g)
    assert {int(r[0]): list(r[2:]) for r in many} == {i: [str(x) for x in w] for i, w in want.items()}


def test_one_key_is_interpolated_in_many_cells(spark):
    rng = np.random.default_rng(4)
    x, at = rng.choice(5_000, 1_500, False), rng.integers(-50, 5_050, 4_000)
    y = rng.normal(size=1_500)
    nodes = spark.createDataFrame([(None, int(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, None, 9.0)], "k int, x long, y double")
    points = spark.createDataFrame([(None, int(a), i) for i, a in enumerate(at)] + [(None, None, -1), (7, 3, -2)], "k int, at long, name long")
    df = stableswap.interpolated(nodes, points, "k", "x", "y", "at", 50)
    got = {r["name"]: r["y"] for r in df.collect()}
    order = np.argsort(x)
    assert got.pop(-1) is None and got.pop(-2) is None
    assert np.allclose([got[i] for i in range(4_000)], np.interp(at, x[order], y[order]), rtol=1e-12) and len(got) == 4_000
    assert df.columns == ["k", "at", "name", "y"]
    both = nodes.select("x").unionByName(points.select(F.col("at").alias("x")))
    sizes = [r["count"] for r in ordered.dealt(both, "x", cells=50).groupBy("_cell").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 4 * 5_502 / len(sizes)
    assert stableswap.interpolated(nodes.limit(0), points, "k", "x", "y", "at").filter("y IS NOT NULL").isEmpty()


def test_cells_are_scattered_without_a_grid(spark, sf):
    rows = curves.normalised(fx.hourly_liquidity(spark, sf), 0, None)
    plan = curves.dense_rows(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan
    got = {r["t"]: r["y"] for r in curves.dense_rows(rows).collect()}
    held = {(r["hour_s"], r["tick_norm"]): r["v"] for r in rows.groupBy("hour_s", "tick_norm").agg(F.sum("active_liquidity_L").alias("v")).collect()}
    axis = sorted({x for _, x in held})
    for t in {h for h, _ in held}:
        assert got[t] == pytest.approx([math.log1p(held.get((t, x), 0.0)) for x in axis], rel=1e-12)
    assert len(got) == len({h for h, _ in held}) and curves.dense(rows.limit(0)).isEmpty()


def test_pools_that_lack_a_coin_have_no_price_or_density(spark):
    pools = spark.createDataFrame([(1, 100.0, 1.0, 1.0), (2, 100.0, 0.0, 0.0), (3, 100.0, None, 1.0)], "pool int, a double, x0 double, y0 double")
    xs, prices = (spark.createDataFrame([(i, v) for i, v in enumerate(vs)], f"i int, {n} double") for n, vs in (("x", [0.5, 0.9, 1.1, 2.0]), ("p", [0.98, 1.0, 1.02])))
    found = stableswap.pool_densities(pools, xs, prices)
    assert found.count() == 9
    assert {r["pool"] for r in found.filter("relative IS NOT NULL AND NOT isnan(relative)").collect()} == {1}
    held = stableswap.invariant_curves(spark.createDataFrame([(5, 0.0, 6.0), (6, 2.0, 6.0), (7, None, 6.0)], "h int, x double, k double"), F.col("k"), 4.0, "h")
    rows = {r["h"]: r for r in held.collect()}
    assert rows[5]["y_product"] is None and rows[5]["y_sum"] == 6.0 and rows[7]["y_sum"] is None and rows[6]["y_product"] == 4.5


def test_loadings_are_turned_by_their_farthest_entry(spark):
    found = spark.createDataFrame([(1, [0.1, -0.9, 0.9]), (2, [-0.2, 0.8]), (3, [0.0, 0.0])], "k int, loading array<double>")
    got = {r["k"]: r["loading"] for r in decompose.sign_fixed(found).collect()}
    assert got == {1: [-0.1, 0.9, -0.9], 2: [-0.2, 0.8], 3: [0.0, 0.0]}


def test_rows_of_a_stored_table_are_not_dealt_by_file(spark, sf):
    for name in ("flt12_slice_as_stored", "lim1_tail_as_stored", "lim2_last_row", "agg9_last_as_stored"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin [_file" in plan and "SortAggregate" not in plan
    places = positioned(spark, f"{sf}/lineitem.parquet", ["l_orderkey"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning(_file" not in places.select("l_orderkey", "pos")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_last_row_of_a_key_keeps_its_nulls(spark):
    rows = spark.createDataFrame([(1, 5, "a", 1.0), (1, 9, None, None), (2, 3, "b", 2.0), (2, 1, "c", None)], "k int, pos long, s string, v double")
    assert sorted(map(tuple, last_of_each(rows, "k").collect())) == [(1, 9, None, None), (2, 3, "b", 2.0)]
