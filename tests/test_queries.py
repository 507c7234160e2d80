"""Every registered query against its SQL."""

import pytest
from conftest import same

import __spark_entry__
from tidemark.operators import stableswap
from tidemark.plans import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf), duck.sql(queries.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).limit(1).count() == 1


def test_whole_curves_reach_the_last_hour(spark, sf, duck):
    last = duck.sql("SELECT max(epoch(date_trunc('hour', ts))::BIGINT) FROM events").fetchall()[0][0]
    assert last > queries.UNTIL_S
    for name in ("dom26_transform_whole", "dom25_surface_whole", "agg11_dense_matrix_whole"):
        assert queries.QUERIES[name](spark, sf).agg({"hour_s": "max"}).first()[0] == last
    assert queries.QUERIES["dom39_score_series"](spark, sf).agg({"t": "max"}).first()[0] == last


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_series_of_many_cells_is_searched_once(spark, sf, duck, monkeypatch):
    monkeypatch.setattr(stableswap.interpolated, "__defaults__", (20,))
    df = queries.QUERIES["jn8_interpolated_series"](spark, sf)
    assert "isnotnull(aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()  # a copy of the search below the union, which the optimizer may fail on
    same(df, duck.sql(queries.SQL["jn8_interpolated_series"]))


def test_logarithms_of_nothing(spark, tmp_path):
    values = [0.0, -0.0, -1.0, 2.5, None]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").selectExpr("event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts", "'view' AS event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: (r["log1p"], r["log10"]) for r in queries.QUERIES["scl_numeric"](spark, str(tmp_path)).collect()}
    low = float("-inf")
    assert got == {0: (0.0, low), 1: (0.0, low), 2: (low, None), 3: (1.252762968, 0.397940009), 4: (None, None)}
