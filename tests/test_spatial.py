"""Spatial joins against brute force, with clusters, duplicates, ties and one hot cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlattice.operators import aggregate as A
from emberlattice.operators import features as E
from emberlattice.operators import lattice as L
from emberlattice.operators import spatial as S


def points(spark, rows, extra="v double"):
    return spark.createDataFrame(rows, f"date string, latitude double, longitude double, {extra}")


def cloud(seed, n, spread, centre=(39.0, -8.0), hot=0):
    rng = np.random.default_rng(seed)
    lat = np.round(centre[0] + rng.normal(0, spread, n), 3)
    lon = np.round(centre[1] + rng.normal(0, spread, n), 3)
    rows = [("d", float(a), float(o), float(i)) for i, (a, o) in enumerate(zip(lat, lon))]
    return rows + [("d", centre[0], centre[1], 1000.0 + i) for i in range(hot)]


def ticks(x):
    return int(np.rint(x * 10000))


def brute_nearest(left, right, limit=None):
    out = {}
    for d, a, o, _ in left:
        best = None
        for d2, b, p, v in right:
            if d == d2:
                q = (ticks(a) - ticks(b)) ** 2 + (ticks(o) - ticks(p)) ** 2
                key = (q, ticks(b), ticks(p), v)
                best = key if best is None or key < best else best
        if best is not None and (limit is None or best[0] <= ticks(limit) ** 2):
            out[(a, o)] = (best[0], best[3])
    return out


@pytest.mark.parametrize("expand", ["left", "right"])
@pytest.mark.parametrize("limit", [None, 0.05, 0.4])
def test_nearest_matches_brute_force(spark, expand, limit):
    left = cloud(1, 150, 0.6, hot=40) + [("d", 70.0, 120.0, 0.0), ("d", -55.5, -179.0, 0.0), ("d", 39.0, 30.0, 0.0)]
    right = cloud(2, 120, 0.3, hot=30) + cloud(5, 40, 0.05, centre=(60.0, 20.0)) + [("other", 0.0, 0.0, 1.0)]
    near = S.nearest_join(points(spark, left, "w double"), points(spark, right), ["v"], max_distance=limit, expand=expand)
    got = {(r["latitude"], r["longitude"]): (round((r["distance"] * 10000) ** 2), r["v"]) for r in near.collect()}
    assert got == brute_nearest(left, right, limit)
    assert near.count() == sum((a, o) in got for _, a, o, _ in left)  # hot rows are all kept


def test_unbounded_search_over_scattered_right(spark):
    left = cloud(11, 60, 8.0) + cloud(12, 20, 0.01, centre=(-30.0, 140.0))
    right = cloud(13, 25, 20.0, centre=(10.0, 20.0))
    near = S.nearest_join(points(spark, left, "w double"), points(spark, right), ["v"], first_radius=0.05, expand="right")
    got = {(r["latitude"], r["longitude"]): (round((r["distance"] * 10000) ** 2), r["v"]) for r in near.collect()}
    assert got == brute_nearest(left, right)


def test_tie_goes_to_lowest_latitude_then_longitude(spark):
    left = points(spark, [("d", 40.0, -8.0, 0.0)], "w double")
    right = points(spark, [("d", 40.1, -8.0, 1.0), ("d", 39.9, -8.0, 2.0), ("d", 40.0, -8.1, 3.0), ("d", 40.0, -7.9, 4.0)])
    assert S.nearest_join(left, right, ["v"]).first()["v"] == 2.0


@pytest.mark.parametrize("expand", ["left", "right"])
def test_radius_join_with_fallback(spark, expand):
    left, right = cloud(21, 80, 0.8), cloud(22, 90, 0.4, hot=10)
    pairs = S.radius_join(points(spark, left, "w double"), points(spark, right), ["v"], 0.15, expand=expand).collect()
    got = {}
    for r in pairs:
        got.setdefault((r["ly"], r["lx"]), []).append((r["d2"], r["v"], r["fallback"]))
    for _, a, o, _ in left:
        dist = [((ticks(a) - ticks(b)) ** 2 + (ticks(o) - ticks(p)) ** 2, v) for _, b, p, v in right]
        inside = sorted(x for x in dist if x[0] <= 1500**2)
        mine = sorted((d, v) for d, v, _ in got[(ticks(a), ticks(o))])
        if inside:
            assert mine == inside
        else:
            assert len(mine) == 1 and mine[0][0] == min(dist)[0] and got[(ticks(a), ticks(o))][0][2]


def test_closed_windows_share_edges(spark):
    p = points(spark, [("d", 36.75, -9.0, 1.0), ("d", 36.75, -8.75, 1.0), ("d", 36.8, -9.0, 1.0)])
    n = {(r["latitude"], r["longitude"]): r["count"] for r in L.window_overlap(p, 0.5).groupBy("latitude", "longitude").count().collect()}
    assert n == {(36.75, -9.0): 2, (36.75, -8.75): 4, (36.8, -9.0): 1}
    assert L.window_overlap(p, 0.5, closed="left").count() == 3


def test_half_open_boxes(spark):
    ref = points(spark, [("d", 40.0, -8.0, 0.0)])
    p = points(spark, [("d", 39.8875, -8.0, 1.0), ("d", 40.1125, -8.0, 1.0), ("d", 40.0, -7.8875, 1.0), ("d", 40.0, -8.1125, 1.0)])
    assert S.points_in_boxes(p, ref, 0.1125, "left").count() == 2
    assert S.points_in_boxes(p, ref, 0.1125, "both").count() == 4


def test_radius_stats_single_and_lonely(spark):
    targets = points(spark, [("d", 40.0, -8.0, 0.0), ("d", 42.0, -8.0, 0.0), ("d", 37.0, -8.0, 0.0)])
    fine = points(spark, [("d", 40.05, -8.0, 3.0), ("d", 42.0, -8.0, 1.0), ("d", 42.0, -8.0, 2.0), ("d", 42.1, -8.0, 9.0), ("d", 37.9, -8.0, 5.0)])
    rows = {r["latitude"]: r for r in A.radius_stats(targets, fine, "v").collect()}
    assert (rows[40.0]["count_1km_points"], rows[40.0]["fwi_std"], rows[40.0]["fwi_aggregated_weighted"]) == (1, 0.0, 3.0)
    assert (rows[42.0]["count_1km_points"], rows[42.0]["fwi_aggregated_median"]) == (3, 2.0)
    assert abs(rows[42.0]["fwi_aggregated_weighted"] - 1.5) < 1e-6
    assert abs(rows[42.0]["fwi_std"] - np.std([1, 2, 9])) < 1e-9
    assert (rows[37.0]["count_1km_points"], rows[37.0]["fwi_aggregated_mean"]) == (1, 5.0)


def test_gradient_matches_numpy_on_a_line(spark):
    lats, vals = [39.9, 40.0, 40.15, 40.2], [1.0, 4.0, 2.0, 8.0]
    src = points(spark, [("d", a, -8.0, v) for a, v in zip(lats, vals)])
    tgt = points(spark, [("d", 40.05, -8.0, 0.0)])
    r = E.neighbour_gradient(tgt, src, "v", 0.5).first()
    assert abs(r["lat_gradient"] - np.mean(np.gradient(vals, lats))) < 1e-9
    assert r["lon_gradient"] is None  # zero spacing


def test_idw_features_few_neighbours(spark):
    src = points(spark, [("d", 40.0, -8.0, 2.0), ("d", 40.0, -7.9, 6.0)])
    r = E.idw_features(points(spark, [("d", 40.0, -7.98, 0.0)]), src, ["v"], gradient_of="v").first()
    w = np.array([1 / 0.021, 1 / 0.081])
    assert abs(r["coarse_v"] - (w * [2, 6]).sum() / w.sum()) < 1e-9
    assert r["coarse_v_mean"] is None and r["coarse_v_lat_gradient"] is None and r["coarse_n"] == 2


def test_lattice_counts_and_cap(spark):
    p = points(spark, [("d", 40.0, -8.0, 0.0), ("d", 40.02, -7.97, 0.0)])
    # 0.02 / 0.009 and 0.03 / 0.012 steps, end point covered
    assert L.fine_lattice(p).count() == 4 * 4
    assert L.fine_lattice(p, cap=15).count() == 3 * 3


def test_downsample_identity_at_source_step(spark):
    p = points(spark, [("d", 36.75 + 0.25 * i, -9.5 + 0.25 * j, float(i * 7 + j)) for i in range(5) for j in range(4)])
    out = A.downsample(p, ["v"], 0.25, closed="left")
    key = ["latitude", "longitude", "v"]
    assert sorted(map(tuple, out.select(*key).collect())) == sorted(map(tuple, p.select(*key).collect()))
