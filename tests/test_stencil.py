import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberlattice.operators.features import idw_features
from emberlattice.operators.lattice import expand_lattice, lattice_spec
from emberlattice.operators.learn import assemble, fit_ridge, predict_fine
from emberlattice.operators.stencil import is_regular, kernel_table, stencil_features

M = ["fwi", "rain"]


def grid(spark, share, origin=(37.0, -9.5), days=3, size=7, seed=1):
    rng = random.Random(seed)
    rows = [(dt.date(2017, 1, d + 1), origin[0] + 0.25 * i, origin[1] + 0.25 * j, rng.uniform(0, 50), rng.choice([None, rng.uniform(0, 9)]))
            for d in range(days) for i in range(size - d) for j in range(size + d) if rng.random() < share]
    return spark.createDataFrame(rows, "date date, latitude double, longitude double, fwi double, rain double")


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())


def same(a, b):
    a, b = rounded(a), rounded(b)
    assert len(a) == len(b) and a
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 1e-7 * max(1, abs(u))), (x, y)


@pytest.mark.parametrize("share,radius,origin,cap", [
(0.6, 0.3, (36.95, -9.4), None), (0.06, 0.3, (-0.5, -0.25), None), (0.7, 0.6, (37.0, -9.5), 300), (0.5, 0.1, (37.0, 0.1), None)])
def test_like_the_radius_join(spark, share, radius, origin, cap):
    source = grid(spark, share, origin)
    spec = lattice_spec(source, 0.09, 0.12, ["date"], cap)
    same(stencil_features(spec, source, M, radius), idw_features(expand_lattice(spec, ["date"]), source, M, radius))


def test_regular_or_not(spark):
    source = grid(spark, 0.5)
    assert is_regular(source, 0.25) and not is_regular(source.withColumn("latitude", F.col("latitude") + F.when(F.col("fwi") > 25, 0.01).otherwise(0)), 0.25)
    with pytest.raises(ValueError):
        predict_fine(source.withColumn("longitude", F.col("longitude") * 1.1), None, [], M, source_step=0.25)


def test_kernel_holds_each_place_once(spark):
    kernel = kernel_table(spark, 2500, 3000, 100, 100).collect()
    assert len(kernel) == 625 and len({(r.fy, r.fx) for r in kernel}) == 625
    corner = next(r for r in kernel if r.fy == r.fx == 0)
    assert [k.d2 for k in corner.kernel] == [6250000, 6250000, 0, 6250000, 6250000]


def test_empty_and_repeated_points(spark):
    source = grid(spark, 0.5)
    spec = lattice_spec(source, 0.09, 0.12, ["date"])
    none = source.limit(0)
    assert stencil_features(lattice_spec(none, 0.09, 0.12, ["date"]), none, M).collect() == []
    once = stencil_features(spec, source, M)
    same(stencil_features(spec, source.unionByName(source).withColumn("extra", F.lit(1)), M), once)


def test_predictions_like_the_radius_join(spark):
    source = grid(spark, 0.8)
    names = ["coarse_fwi", "coarse_fwi_std", "coarse_distance"]
    spec = lattice_spec(source, 0.25, 0.25, ["date"])
    rows = idw_features(expand_lattice(spec, ["date"]), source, M).fillna(0.0)
    model = fit_ridge(assemble(rows.withColumn("y", F.col("coarse_fwi") * 2 + F.col("coarse_distance")), names, "y"))
    a, b = (predict_fine(source, model, names, M, 0.05, 0.05, source_step=s) for s in (None, 0.25))
    same(a, b)
