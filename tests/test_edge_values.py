"""Inputs off the lattice, with float noise, with large offsets or far apart."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlattice.operators import aggregate as A
from emberlattice.operators import clean as C
from emberlattice.operators import distribution as X
from emberlattice.operators import joins as J
from emberlattice.operators import learn as N
from emberlattice.operators import spatial as S
from emberlattice.schema import FWI_DAILY
from emberlattice.sources import tables

DAY = dt.date(2017, 7, 1)


def points(spark, rows, value="fwi"):
    return spark.createDataFrame([(DAY, *r) for r in rows], f"date date, latitude double, longitude double, {value} double")


def test_points_off_the_lattice_are_no_corners(spark):
    source = points(spark, [(40.01, -8.0, 9.0), (40.20, -8.0, 5.0)])
    target = points(spark, [(40.0, -8.0, 0.0)]).drop("fwi")
    assert S.lattice_interpolate(target, source, "fwi", 0.25).first()["interpolated"] == 9.0


def test_noisy_coordinates_meet(spark):
    a, b = points(spark, [(0.1 + 0.2, 1.0, 5.0)]), points(spark, [(0.3, 1.0, 7.0)], "temp")
    assert [tuple(r)[1:] for r in J.merge_variables([a, b]).collect()] == [(0.3, 1.0, 5.0, 7.0)]
    assert [tuple(r)[1:] for r in J.overlay_last_wins([a, b]).collect()] == [(0.3, 1.0, 5.0, 7.0)]


def test_deviation_does_not_cancel(spark):
    fine = points(spark, [(40.0 + 0.001 * i, -8.0, 1e8 + 0.1 * (i % 2)) for i in range(40)])
    row = A.radius_stats(points(spark, [(40.02, -8.0, 0.0)]), fine, "fwi").first()
    assert row["fwi_std"] == pytest.approx(0.05, rel=1e-3) and row["fwi_aggregated_median"] == pytest.approx(1e8 + 0.05)


def test_far_search_matches_brute_force_and_stays_small(spark):
    rng = random.Random(1)
    sites = sorted({(round(rng.uniform(40, 43), 3), round(rng.uniform(-9, -6), 3)) for _ in range(1500)})
    targets = sorted({(round(rng.uniform(-60, -20), 3), round(rng.uniform(60, 150), 3)) for _ in range(300)})
    left = points(spark, [(a, b, 0.0) for a, b in targets]).drop("fwi")
    right = points(spark, [(a, b, float(i)) for i, (a, b) in enumerate(sites)])
    near = S.nearest_join(left, right, ["fwi"])
    got = {(r.latitude, r.longitude): (r.near_latitude, r.near_longitude) for r in near.collect()}
    for t in targets:
        best = min(sites, key=lambda s: (round((s[0] - t[0]) * 1e4) ** 2 + round((s[1] - t[1]) * 1e4) ** 2, s))
        assert got[t] == best
    rows = joined_rows(near)
    # On every level a few cells are opened, with 64 children each; all pairs would be 450,000.
    assert rows < 4 * 64 * len(targets), rows


def test_far_search_of_crowded_cells_is_made_once_a_cell(spark):
    """1,800 coordinates of three cells, 200 sites 2 degrees off: the levels are joined by cell, and ties hold."""
    rng = random.Random(2)
    targets = sorted({(round(41 + rng.uniform(0, 0.29), 3), round(-8.9 + rng.uniform(0, 0.5), 3)) for _ in range(1800)})
    sites = [(36.0 + 0.25 * i, -7.0 + 0.3 * j) for i in range(20) for j in range(10)]
    left = points(spark, [(a, b, 0.0) for a, b in targets]).drop("fwi")
    near = S.nearest_join(left, points(spark, [(a, b, float(i)) for i, (a, b) in enumerate(sites)]), ["fwi"])
    got = {(r.latitude, r.longitude): (r.near_latitude, r.near_longitude) for r in near.collect()}
    place = np.rint(np.array(sites) * 1e4).astype(np.int64)
    for t in targets:
        d2 = ((place - np.rint(np.array(t) * 1e4).astype(np.int64)) ** 2).sum(axis=1)
        best = min(zip(d2.tolist(), place.tolist()))[1]
        assert [round(c * 1e4) for c in got[t]] == best
    rows = joined_rows(near)
    assert rows < 8 * len(targets), rows


def joined_rows(df):
    """Largest number of rows any join of the executed plan put out."""
    df._jdf.queryExecution().executedPlan().execute().count()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_box_stats_join_no_rows_of_a_hot_group(spark):
    """A group of 20,000 rows and 50 values: counted values are joined, not the rows."""
    df = spark.range(20_020).select(F.when(F.col("id") < 20_000, "hot").otherwise("few").alias("g"), (F.col("id") % 50).cast("double").alias("x"))
    df = df.unionByName(spark.createDataFrame([("hot", 500.0), ("hot", -400.0), ("hot", 500.0), ("few", None)], "g string, x double"))
    stats = X.box_stats(df, "x", ["g"])
    got = {r.g: r for r in stats.collect()}
    hot = np.sort(np.concatenate([np.tile(np.arange(50.0), 400), [500.0, -400.0, 500.0]]))
    assert [got["hot"].q1, got["hot"].median, got["hot"].q3] == pytest.approx(np.quantile(hot, [0.25, 0.5, 0.75]).tolist())
    assert (got["hot"].whisker_low, got["hot"].whisker_high, got["hot"].n_outliers, got["few"].n_outliers) == (0.0, 49.0, 3, 0)
    assert joined_rows(stats) <= 200


def test_box_and_dates_reach_the_scan(spark, tmp_path):
    rows = points(spark, [(40.0, -8.0, 1.0)]).select(F.col("date").cast("timestamp_ntz").alias("time"), "latitude", "longitude", "fwi")
    rows.write.parquet(str(tmp_path / "t"))
    table = tables.read_daily_table(spark, str(tmp_path / "t"), FWI_DAILY, "parquet")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = C.filter_bbox(table, (36, 43, -10, -6))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    for name in ("latitude", "longitude"):
        assert f"GreaterThanOrEqual({name}" in pushed and f"LessThanOrEqual({name}" in pushed


def test_permutation_uses_all_rows(spark):
    df = spark.range(3000).select("id", F.rand(3).alias("a"), F.rand(4).alias("b")).withColumn("label", 3 * F.col("a"))
    placed = N.hash_places(df).cache()
    assert placed.select("_place").distinct().count() == 3000 and placed.agg(F.max("_place")).first()[0] == 2999
    rows = N.assemble(df, ["a", "b"], "label")
    got = {r.feature: r.importance for r in N.permutation_importance(N.fit_ridge(rows), rows, ["a", "b"], ["id"]).collect()}
    assert got["a"] == pytest.approx(2.0, abs=0.15) and abs(got["b"]) < 0.01
