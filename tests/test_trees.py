import duckdb
import numpy as np
import pytest

from emberlattice.operators import learn as N
from emberlattice.operators.trees import node_table, score_nodes

NAMES = ["a", "b", "c"]
WALK = """
WITH RECURSIVE w AS (
  SELECT r.id, [r.a, r.b, r.c] AS x, n.* FROM points r JOIN nodes n ON n.node = 0
  UNION ALL
  SELECT w.id, w.x, n.* FROM w JOIN nodes n ON n.tree = w.tree AND n.node = CASE WHEN w.x[CAST(w.feature AS BIGINT) + 1] <= w.threshold THEN w."left" ELSE w."right" END
)
SELECT id, sum(weight * value) AS p FROM w WHERE feature IS NULL GROUP BY id ORDER BY id
"""


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 3))
    y = 2 * x[:, 0] - x[:, 1] * x[:, 2] + 0.1 * rng.normal(size=600)
    rows = [(i, *map(float, r), float(t), i * 5 // 600) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, fold int").cache()


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_walked_nodes_predict_like_the_model(spark, data, kind):
    rows = N.assemble(data, NAMES, "y")
    model, depth = (N.fit_gbt(rows, trees=12, depth=6), 6) if kind == "boosted" else (N.fit_forest(rows, trees=8, depth=9), 9)
    want = {r["id"]: r["prediction"] for r in model.transform(rows).collect()}
    nodes = node_table(model, spark)
    got = {r["id"]: r["prediction"] for r in score_nodes(data, nodes, NAMES, ["id"], depth).collect()}
    con = duckdb.connect()
    con.register("nodes", nodes.toPandas())
    con.register("points", data.select("id", "a", "b", "c").toPandas())
    walked = dict(con.sql(WALK).fetchall())
    assert got.keys() == walked.keys() == want.keys()
    for i, p in want.items():
        assert abs(got[i] - p) < 1e-9 and abs(walked[i] - p) < 1e-9


def test_folds_of_moments_like_refits(data):
    rows = N.assemble(data.selectExpr("id", "a + 10 AS a", "b", "c * 1e-3 AS c", "y", "fold"), NAMES, "y")
    for alpha in (0.5, 20.0):
        a = N.cv_r2_ridge(rows, 3, alpha).first()
        b = N.cv_r2(rows, lambda r, alpha=alpha: N.fit_ridge(r, alpha)).first()
        assert a["n_folds"] == b["n_folds"] == 5
        assert abs(a["cv_r2"] - b["cv_r2"]) < 1e-6 and abs(a["cv_std"] - b["cv_std"]) < 1e-6
    constant = N.cv_r2_ridge(rows, 3, N.NO_SLOPE).first()["cv_r2"]
    assert constant < 0.01 and abs(constant - N.cv_r2(rows, N.fit_constant).first()["cv_r2"]) < 1e-6


def test_folds_without_rows_or_variance(data):
    rows = N.assemble(data, NAMES, "y")
    assert N.cv_r2_ridge(rows.limit(0), 3).first()["n_folds"] == 0
    assert N.cv_r2_ridge(rows.where("fold = 1"), 3).first()["n_folds"] == 0
    assert N.cv_r2_ridge(N.assemble(data.selectExpr("*", "IF(fold = 2, 7, y) AS z"), NAMES, "z"), 3).first()["n_folds"] == 4


def test_permutation_order_is_the_digests(spark, data):
    import hashlib

    got = {r["id"]: (r["_place"], r["_total"]) for r in N.hash_places(data.select("id", "a"), ["id"]).collect()}
    order = sorted(got, key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest()[:15])
    assert [got[i] for i in order] == [(k, 600) for k in range(600)]
