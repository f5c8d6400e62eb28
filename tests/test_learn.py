import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlattice.operators import clean as C
from emberlattice.operators import learn as N
from emberlattice.plans.downscale import prepare_training, train
from emberlattice.sources import derived as D

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=400)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double").cache()
    return x, y, df


def test_ridge_closed_form(data):
    x, y, df = data
    for alpha in (0.0, 1.0, 50.0):
        model = N.fit_ridge(N.assemble(df, ["a", "b", "c"], "y"), alpha)
        xc, yc = x - x.mean(0), y - y.mean()
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        np.testing.assert_allclose(model.coefficients.toArray(), w, rtol=1e-6)


def test_trees_learn(data):
    _, _, df = data
    rows = N.assemble(df, ["a", "b", "c"], "y")
    for model in (N.fit_gbt(rows, trees=15, depth=4), N.fit_forest(rows, trees=10, depth=8)):
        assert N.evaluate(model, rows).first()["r_squared"] > 0.8
        imp = {r["feature"]: r["importance"] for r in N.feature_importance(model, ["a", "b", "c"], df.sparkSession).collect()}
        assert imp["a"] > imp["b"] > imp["c"]


def test_permutation_importance_ranks_features(data):
    _, _, df = data
    rows = N.assemble(df, ["a", "b", "c"], "y")
    got = {r["feature"]: r["importance"] for r in N.permutation_importance(N.fit_ridge(rows), rows, ["a", "b", "c"], ["id"], 300).collect()}
    assert got["a"] > got["b"] > 0.1 and abs(got["c"]) < 0.05


def test_split_is_stable_and_near_share(data):
    _, _, df = data
    a = {r["id"] for r in N.split_rows(df.repartition(7), ["id"])[1].collect()}
    b = {r["id"] for r in N.split_rows(df.coalesce(1), ["id"])[1].collect()}
    assert a == b and 50 < len(a) < 110


def test_folds_are_contiguous(spark):
    df = spark.range(23).withColumn("v", F.lit(1.0))
    rows = sorted((r["id"], r["fold"]) for r in N.fold_column(df, F.col("id")).collect())
    want = [k for k, n in enumerate((5, 5, 5, 4, 4)) for _ in range(n)]
    assert [f for _, f in rows] == want


def test_exact_scaling_and_imputation(data):
    x, _, df = data
    med, iqr = np.median(x[:, 0]), np.subtract(*np.percentile(x[:, 0], [75, 25]))
    got = sorted(r["a"] for r in N.robust_scale(df, ["a", "b"]).collect())
    np.testing.assert_allclose(got, sorted((x[:, 0] - med) / iqr), rtol=1e-9, atol=1e-12)
    holes = df.withColumn("a", F.when(F.col("id") % 3 > 0, F.col("a")))
    fill = np.median([v for i, v in enumerate(x[:, 0]) if i % 3 > 0])
    assert abs(C.impute_median(holes, ["a"]).where("id = 0").first()["a"] - fill) < 1e-12


def test_drop_constant_features(data):
    _, _, df = data
    out = C.drop_constant_features(df.withColumn("k", F.lit(4.0)), ["a", "k"])
    assert "k" not in out.columns and "a" in out.columns


def test_training_to_scores(spark):
    daily = D.grid_daily(spark, SF)
    table, names, _ = prepare_training(daily, ["fwi", "temperature_max"], include_target=True)
    model, scores = train(table, "ridge")
    row = scores.first()
    # The coarse mean holds the target, so this closure must explain some of it.
    assert row["test_r2"] > 0.2 and row["n_train"] > row["n_test"] > 0 and len(names) == 11


def test_the_best_of_three_models_predicts(spark):
    import datetime as dt
    import math

    from emberlattice.plans.downscale import downscale_best

    rows = [(dt.date(2017, 7, d + 1), 40 + 0.25 * i, -8 + 0.25 * j, 20 + 5 * math.sin(i + d) + j, 290 + 2 * math.sin(i + d) + 0.4 * j)
            for d in range(4) for i in range(8) for j in range(8)]
    daily = spark.createDataFrame(rows, "date date, latitude double, longitude double, fwi double, temperature_max double")
    got = downscale_best(daily, ["fwi", "temperature_max"], dlat=0.2, dlon=0.2,
                         params={"gradient_boosting": {"trees": 3}, "random_forest": {"trees": 3, "depth": 4}})
    first = got.first()
    assert first["model_cv_score"] > 0 and first["prediction_method"] in ("ridge", "gradient_boosting", "random_forest") and got.count() == 4 * 10 * 10
