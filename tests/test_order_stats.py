import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlattice.operators import distribution as X
from emberlattice.operators import order_stats as O
from emberlattice.operators.metrics import pearson_p_value


def frame(spark, groups):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, x double")


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    groups = {
        "hot": np.concatenate([np.full(3000, 7.25), rng.normal(20, 9, 4000)]),
        "long": rng.pareto(0.6, 2500), "one": [4.0], "two": [1.0, 9.0], "same": [2.0] * 50,
    }
    return groups, frame(spark, groups)


@pytest.mark.parametrize("buckets", [4, 8, 64])
def test_quantiles_equal_numpy(skewed, buckets):
    groups, df = skewed
    probs = [0, 0.001, 0.25, 0.5, 0.9, 0.999, 1]
    got = {r["g"]: list(r)[1:] for r in O.quantiles(df, "x", probs, [f"q{i}" for i in range(7)], ["g"], buckets).collect()}
    for g, v in groups.items():
        np.testing.assert_allclose(got[g], np.quantile(v, probs), rtol=1e-12)


def test_global_quantile_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (10.0,)], "x double")
    assert O.quantiles(df, "x", [0.5], ["m"]).first()["m"] == 2.0


def test_average_rank_matches_pandas(skewed):
    groups, df = skewed
    v = groups["hot"]
    got = sorted(r["p"] for r in O.percent_rank_average(df.where("g = 'hot'").select("x"), "x", "p").collect())
    np.testing.assert_allclose(got, sorted(pd.Series(v).rank(pct=True) * 100), rtol=1e-12)


def test_ecdf_splits_hot_values(skewed):
    groups, df = skewed
    rows = O.ecdf(df.where("g = 'hot'").select("x"), "x", chunk=500).orderBy("k").collect()
    assert [r["k"] for r in rows] == list(range(1, 7001))
    np.testing.assert_array_equal([r["value"] for r in rows], np.sort(groups["hot"]))


def test_quantile_grid_matches_numpy(spark, skewed):
    groups, _ = skewed
    rows = [("coarse", float(v)) for v in groups["hot"]] + [("fine", 3.0)]
    st = spark.createDataFrame(rows, "source string, x double")
    for m in (2, 11, 1000):
        got = X.quantile_grid(st, m).where("source = 'coarse'").orderBy("k").collect()
        assert [r["k"] for r in got] == list(range(m))
        np.testing.assert_allclose([r["x"] for r in got], np.quantile(groups["hot"], np.linspace(0, 1, m)), rtol=1e-9)
        assert X.quantile_grid(st, m).where("source = 'fine' AND x = 3.0").count() == m


def test_inverse_normal(spark):
    ps = [1e-12, 1e-5, 0.02, 0.3, 0.5, 0.8, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in df.select("p", X.inverse_normal(F.col("p")).alias("z")).collect():
        assert math.isclose(r["z"], NormalDist().inv_cdf(r["p"]), rel_tol=1e-12, abs_tol=1e-15)


def test_p_value_known_cases(spark):
    # Exact tails: 1 df is Cauchy, 2 df has the closed form 1 - |r|.
    df = spark.createDataFrame([(0.5, 3), (0.3, 4), (0.9, 1_000_000_000), (0.0, 10), (None, 5), (0.1, 2)], "r double, n long")
    got = [r["p"] for r in df.select(pearson_p_value(F.col("r"), F.col("n")).alias("p")).collect()]
    assert math.isclose(got[0], 1 - 2 * math.asin(0.5) / math.pi, rel_tol=1e-9)
    assert math.isclose(got[1], 0.7, rel_tol=1e-9)
    assert got[2] == 0.0 and math.isclose(got[3], 1.0, rel_tol=1e-9)
    assert got[5] is None


def test_p_value_large_n(spark):
    n, r = 10_000, 0.02
    t = r * math.sqrt((n - 2) / (1 - r * r))
    df = spark.createDataFrame([(r, n)], "r double, n long")
    got = df.select(pearson_p_value(F.col("r"), F.col("n")).alias("p")).first()["p"]
    assert abs(got - 2 * (1 - NormalDist().cdf(t))) < 1e-4


def test_min_max_scale_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = O.min_max_scale(df, ["a", "b"]).orderBy("a").collect()
    assert [r["a_normalized"] for r in rows] == [0.0, 1.0] and rows[0]["b_normalized"] is None
