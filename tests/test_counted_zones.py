"""Counts kept by day, and files left out by their ranges."""

import datetime as dt
import random

import pytest

from emberlattice.operators import counted as K
from emberlattice.operators import order_stats as O
from emberlattice.sources import zones

DAYS = [dt.date(2020, 1, d) for d in (1, 2, 3)]
SCHEMA = "date date, x double, y double"


def rows_of(seed, n, days=DAYS):
    rng = random.Random(seed)
    return [(rng.choice(days), rng.choice([None, 0.0, -0.0, 1.5, float(rng.randrange(9))]), None) for _ in range(n)]


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merged_counts_equal_a_recount(spark):
    """A third of all rows may hold one value; parts may share days; a measure without values has no row."""
    a, b = (spark.createDataFrame(rows_of(k, 300) + [(DAYS[0], 7.0, None)] * 150, SCHEMA) for k in (1, 2))
    whole = K.value_counts(a.union(b), ["x", "y"])
    merged = K.merge_counts([K.value_counts(b, ["x", "y"]), K.value_counts(a, ["x", "y"])])
    assert values(merged.select(*whole.columns)) == values(whole)
    want = O.quantiles(a.union(b), "x", [0.1, 0.5, 0.9], ["p", "q", "r"]).first()
    got = K.counted_quantiles(merged, [0.1, 0.5, 0.9], ["p", "q", "r"]).collect()
    assert [tuple(r)[1:] for r in got] == [tuple(want)]
    steps = O.ecdf(a.union(b), "x").select("k", "value", "cumulative")
    assert values(K.counted_ecdf(merged).select("k", "value", "cumulative")) == values(steps)


def test_update_replaces_days(spark, tmp_path):
    path = str(tmp_path / "state")
    first, again = rows_of(3, 200), rows_of(4, 50, DAYS[1:2])
    for part in (first, again, again):
        K.update_counts(spark.createDataFrame(part, SCHEMA), path, ["x"])
    left = [r for r in first if r[0] != DAYS[1]] + again
    want = K.value_counts(spark.createDataFrame(left, SCHEMA), ["x"])
    assert values(spark.read.parquet(path).select(*want.columns)) == values(want)


def test_stats_of_few_rows(spark):
    empty = K.value_counts(spark.createDataFrame([], SCHEMA), ["x"])
    assert K.counted_stats(empty).count() == 0
    one = K.counted_stats(K.value_counts(spark.createDataFrame([(DAYS[0], 2.0, None)], SCHEMA), ["x"])).first()
    assert (one["count"], one["mean"], one["median"], one["std"], one["skewness"]) == (1, 2.0, 2.0, None, None)
    filled = K.impute_from_counts(spark.createDataFrame([(DAYS[0], None, None)], SCHEMA), empty, ["x"], 4.0).first()
    assert filled["x"] == 4.0


@pytest.fixture
def zoned(spark, tmp_path):
    path, state = str(tmp_path / "table of cells"), str(tmp_path / "zones")
    for low in (0, 10, 20):
        part = spark.range(low, low + 10).selectExpr("id", "CASE WHEN id = 13 THEN NULL ELSE CAST(id AS DOUBLE) END AS x", "id % 2 AS half")
        part.coalesce(1).write.mode("append").partitionBy("half").parquet(path)
    return path, state


def test_files_outside_are_not_opened(spark, zoned):
    path, state = zoned
    assert zones.extend_zones(spark, path, state, ["x"]) == 6
    assert zones.extend_zones(spark, path, state, ["x"]) == 0
    seen = zones.scan_zones(spark, path, spark.read.parquet(state), {"x": (12.0, 21.0)})
    assert len(seen.inputFiles()) == 4
    assert sorted((r.id, r.half) for r in seen.collect()) == [(i, i % 2) for i in range(12, 22) if i != 13]
    assert zones.scan_zones(spark, path, spark.read.parquet(state), {"x": (90.0, 99.0)}).count() == 0
    assert zones.scan_zones(spark, path, spark.read.parquet(state), {}).count() == 30


def test_unknown_files_are_read(spark, zoned):
    path, state = zoned
    zones.extend_zones(spark, path, state, ["x"])
    spark.range(15, 16).selectExpr("id", "CAST(id AS DOUBLE) AS x", "1L AS half").write.mode("append").partitionBy("half").parquet(path)
    seen = zones.scan_zones(spark, path, spark.read.parquet(state), {"x": (15.0, 15.0)})
    assert [r.id for r in seen.collect()] == [15, 15]
    assert zones.extend_zones(spark, path, state, ["x"]) > 0
