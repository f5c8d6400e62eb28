"""Neighbourhood features, training pairs, model fitting and fine prediction."""

from pyspark.sql import functions as F

from checks.base import DIGEST, build, check
from checks.spatial import _SPEC, _xy, nodes_sql
from emberlattice.operators import features as E
from emberlattice.operators import learn as N
from emberlattice.operators.aggregate import downsample
from emberlattice.operators.metrics import best_row
from emberlattice.operators.order_stats import quantiles
from emberlattice.operators.lattice import lattice_spec
from emberlattice.operators.spatial import nearest_join
from emberlattice.operators.stencil import stencil_features
from emberlattice.operators.trees import node_table, score_nodes
from emberlattice.plans import closure, downscale
from emberlattice.session import materialise
from emberlattice.sources import derived as D

G, FP, B = ["grid_daily"], ["fine_pred"], ["grid_daily", "fine_pred"]
M = ["fwi", "temperature_max", "total_precipitation", "dewpoint"]
KEYS = ["date", "latitude", "longitude"]


def node_steps(measures, step=5000):
    """n: node memberships; nd: node means (date, y, x, measures)."""
    return [("n", nodes_sql("grid_daily", step)),
            ("nd", f"SELECT date, i*{step} AS y, j*{step} AS x, " + ", ".join(f"avg({m}) AS {m}" for m in measures) + " FROM n GROUP BY date, i, j")]


def pairs_sql(left: str, right: str, cols, radius: int) -> str:
    """All neighbours within the radius, else the nearest: (date, ly, lx, ry, rx, d2, cols)."""
    c = ", ".join(cols)
    return (f"SELECT date, ly, lx, ry, rx, d2, {c} FROM (SELECT *, min(d2) OVER (PARTITION BY date, ly, lx) AS m, row_number() OVER (PARTITION BY date, ly, lx ORDER BY d2, ry, rx) AS k FROM ("
            f"SELECT l.date, l.y AS ly, l.x AS lx, r.y AS ry, r.x AS rx, (l.y-r.y)*(l.y-r.y)+(l.x-r.x)*(l.x-r.x) AS d2, " + ", ".join(f"r.{x}" for x in cols)
            + f" FROM {left} l JOIN {right} r ON l.date=r.date)) WHERE d2<={radius}*{radius} OR (m>{radius}*{radius} AND k=1)")


def coarse_sql(measures, pick: str) -> str:
    order = "d2, ry, rx" if pick == "nearest" else "ry, rx"
    parts = [f"first({m} ORDER BY {order}) AS coarse_{m}, CASE WHEN count(*)>1 THEN avg({m}) END AS coarse_{m}_mean, CASE WHEN count(*)>1 AND count({m})>1 THEN stddev_samp({m}) END AS coarse_{m}_std" for m in measures]
    return ("SELECT date, sqrt(min(d2))/10000 AS coarse_distance, first(ry ORDER BY " + order + ")/10000.0::DOUBLE AS coarse_lat, first(rx ORDER BY " + order + ")/10000.0::DOUBLE AS coarse_lon, count(*) AS coarse_n, "
            + ", ".join(parts) + ", ly/10000.0::DOUBLE AS target_lat, lx/10000.0::DOUBLE AS target_lon FROM pr GROUP BY date, ly, lx")


_COARSE = [f"coarse_{m}{s}" for m in M for s in ("", "_mean", "_std")] + ["coarse_distance"]
_GL = ("gl", _xy("grid_daily", "DISTINCT date"))
_PAIR_STEPS = [*node_steps(M), _GL, ("pr", pairs_sql("gl", "nd", M, 7500))]

for _pick in ("nearest", "first"):
    @check(f"M02_coarse_features_{_pick}", build(coarse_sql(M, _pick), G, _PAIR_STEPS), _COARSE)
    def _(spark, sf, pick=_pick):
        g = D.grid_daily(spark, sf)
        return E.coarse_features(g, downsample(g, M, 0.5), M, 0.75, pick)

_FINE = ", ".join(f"g.{m} AS fine_{m}" for m in M)


@check("M01_training_pairs", build(
    f"SELECT g.latitude AS fine_lat, g.longitude AS fine_lon, {_FINE}, cf.* FROM grid_daily g JOIN cf ON g.date=cf.date AND g.latitude=cf.target_lat AND g.longitude=cf.target_lon", G,
    [*_PAIR_STEPS, ("cf", coarse_sql(M, "nearest"))]), [*_COARSE, *[f"fine_{m}" for m in M if m != "fwi"]])
def _(spark, sf):
    return E.training_pairs(D.grid_daily(spark, sf), M, 0.5, include_target=True)


_M75 = ["temperature_max", "dewpoint"]


@check("M01_training_pairs_75km_no_leak", build(
    "SELECT g.latitude AS fine_lat, g.longitude AS fine_lon, g.fwi AS fine_fwi, g.temperature_max AS fine_temperature_max, g.dewpoint AS fine_dewpoint, cf.* FROM grid_daily g JOIN cf ON g.date=cf.date AND g.latitude=cf.target_lat AND g.longitude=cf.target_lon", G,
    [("n", nodes_sql("grid_daily", 7500).replace("range(60, 100)", "range(40, 70)").replace("range(-30, -8)", "range(-20, -4)")),
     ("nd", "SELECT date, i*7500 AS y, j*7500 AS x, avg(temperature_max) AS temperature_max, avg(dewpoint) AS dewpoint FROM n GROUP BY date, i, j"),
     _GL, ("pr", pairs_sql("gl", "nd", _M75, 11250)), ("cf", coarse_sql(_M75, "nearest"))]),
    ["coarse_distance", "fine_temperature_max", "fine_dewpoint", *[f"coarse_{m}{s}" for m in _M75 for s in ("", "_mean", "_std")]])
def _(spark, sf):
    return E.training_pairs(D.grid_daily(spark, sf), ["fwi", *_M75], 0.75)


def slopes_sql(src: str, m: str, name: str) -> str:
    """Mean neighbour slopes of one measure in (lat, lon) order."""

    def slope(axis):
        hs, hd = f"({axis}-lag({axis}) OVER w)::DOUBLE", f"(lead({axis}) OVER w-{axis})::DOUBLE"
        return (f"10000*CASE WHEN lag({axis}) OVER w IS NOT NULL AND lead({axis}) OVER w IS NOT NULL THEN ({hs}*{hs}*lead({m}) OVER w+({hd}*{hd}-{hs}*{hs})*{m}-{hd}*{hd}*lag({m}) OVER w)/nullif({hs}*{hd}*({hd}+{hs}),0)"
                f" WHEN lag({axis}) OVER w IS NOT NULL THEN ({m}-lag({m}) OVER w)/nullif({hs},0) ELSE (lead({m}) OVER w-{m})/nullif({hd},0) END")

    return (f"SELECT date, ly, lx, count(*) AS known, avg(a) AS {name}_lat, avg(o) AS {name}_lon FROM (SELECT date, ly, lx, {slope('ry')} AS a, {slope('rx')} AS o FROM {src} WHERE {m} IS NOT NULL"
            f" WINDOW w AS (PARTITION BY date, ly, lx ORDER BY ry, rx)) GROUP BY 1,2,3")


def idw_sql(measures, src: str = "pr", slopes: str = "sl") -> str:
    w = "(1/(sqrt(d2)/10000+0.001))"
    parts = []
    for m in measures:
        parts.append(f"sum({m}*{w})/sum({w}) AS coarse_{m}, CASE WHEN count(*)>2 THEN avg({m}) END AS coarse_{m}_mean, CASE WHEN count(*)>2 THEN min({m}) END AS coarse_{m}_min, CASE WHEN count(*)>2 THEN max({m}) END AS coarse_{m}_max,"
                     f" CASE WHEN count(*)>2 AND count({m})>1 THEN stddev_samp({m}) END AS coarse_{m}_std, CASE WHEN count(*)>2 AND count({m})>1 THEN max({m})-min({m}) END AS coarse_{m}_range")
    return ("SELECT q.* EXCLUDE (ly, lx), CASE WHEN coarse_n>=3 THEN g_lat END AS coarse_fwi_lat_gradient, CASE WHEN coarse_n>=3 THEN g_lon END AS coarse_fwi_lon_gradient, ly/10000.0::DOUBLE AS target_lat, lx/10000.0::DOUBLE AS target_lon FROM ("
            "SELECT date, ly, lx, sqrt(min(d2))/10000 AS coarse_distance, avg(ry)/10000 AS coarse_lat, avg(rx)/10000 AS coarse_lon, count(*) AS coarse_n, "
            + ", ".join(parts) + f" FROM {src} GROUP BY 1,2,3) q JOIN {slopes} USING (date, ly, lx)")


_IM = ["fwi", "total_precipitation"]
_IDW = [f"coarse_{m}{s}" for m in _IM for s in ("", "_mean", "_min", "_max", "_std", "_range")] + ["coarse_distance", "coarse_lat", "coarse_lon", "coarse_fwi_lat_gradient", "coarse_fwi_lon_gradient"]
_FL = ("fl", _xy("fine_pred", "DISTINCT date"))
_GR = ("gr", _xy("grid_daily", "date, " + ", ".join(_IM)))


@check("M03_idw_features", build(idw_sql(_IM), B, [_FL, _GR, ("pr", pairs_sql("fl", "gr", _IM, 3000)), ("sl", slopes_sql("pr", "fwi", "g"))]), _IDW)
def _(spark, sf):
    return E.idw_features(D.fine_pred(spark, sf), D.grid_daily(spark, sf), _IM)


@check("W04_neighbour_gradient", build(
    "SELECT date, ly/10000.0::DOUBLE AS target_lat, lx/10000.0::DOUBLE AS target_lon, known AS n, CASE WHEN known>=3 THEN g_lat END AS lat_gradient, CASE WHEN known>=3 THEN g_lon END AS lon_gradient FROM sl", G,
    [_GL, ("gr", _xy("grid_daily", "date, temperature_max")), ("pr", pairs_sql("gl", "gr", ["temperature_max"], 6000)), ("sl", slopes_sql("pr", "temperature_max", "g"))]), ["lat_gradient", "lon_gradient"])
def _(spark, sf):
    g = D.grid_daily(spark, sf)
    return E.neighbour_gradient(g, g, "temperature_max", 0.6)


@check("W06_first_neighbour", build("SELECT date, target_lat, target_lon, coarse_fwi, coarse_lat, coarse_lon FROM (" + coarse_sql(["fwi"], "first") + ")", G,
                                    [*node_steps(["fwi"]), _GL, ("pr", pairs_sql("gl", "nd", ["fwi"], 7500))]), ["coarse_fwi"])
def _(spark, sf):
    g = D.grid_daily(spark, sf)
    return E.coarse_features(g, downsample(g, ["fwi"], 0.5), ["fwi"], 0.75, "first").select(
        "date", "target_lat", "target_lon", "coarse_fwi", "coarse_lat", "coarse_lon")


@check("M04_default_features", build(
    "SELECT date, latitude, longitude, v AS coarse_fwi, sqrt(d2)/10000 AS coarse_distance, ry/10000.0::DOUBLE AS coarse_lat, rx/10000.0::DOUBLE AS coarse_lon, latitude AS target_lat, longitude AS target_lon FROM ("
    "SELECT *, row_number() OVER (PARTITION BY date, latitude, longitude ORDER BY d2, ry, rx) AS k FROM (SELECT l.date, l.latitude, l.longitude, r.y AS ry, r.x AS rx, r.v, (l.y-r.y)*(l.y-r.y)+(l.x-r.x)*(l.x-r.x) AS d2 FROM l JOIN r ON l.date=r.date)) WHERE k=1"
    " UNION ALL SELECT date, latitude, longitude, 10.0, 0.1, latitude, longitude, latitude, longitude FROM l WHERE date NOT IN (SELECT date FROM r)", G,
    [("l", _xy("grid_daily", "date, latitude, longitude")), ("r", _xy("grid_daily", "date, fwi AS v", "WHERE fwi >= (SELECT quantile_cont(fwi, 0.995) FROM grid_daily)"))]), ["coarse_fwi", "coarse_distance"])
def _(spark, sf):
    g = D.grid_daily(spark, sf)
    rare = g.where(F.col("fwi") >= quantiles(g, "fwi", [0.995], ["q"]).scalar())
    return E.default_features(g.select(*KEYS), rare, ["fwi"])


@check("M05_fill_missing_features", build(
    "SELECT f.date, f.target_lat, f.target_lon, coalesce(f.coarse_precip,0) AS coarse_precip, q.m AS coarse_fwi_max, a.y AS node_lat, a.x AS node_lon, 0.0::DOUBLE AS other FROM t f JOIN (SELECT date, median(fwi) AS m FROM grid_daily GROUP BY 1) q USING (date)"
    " JOIN (SELECT date, avg(target_lat) AS y, avg(target_lon) AS x FROM t GROUP BY 1) a USING (date)", G,
    [("t", "SELECT date, latitude AS target_lat, longitude AS target_lon, total_precipitation AS coarse_precip FROM grid_daily")]), ["coarse_precip", "coarse_fwi_max", "node_lat", "node_lon"])
def _(spark, sf):
    g = D.grid_daily(spark, sf)
    t = g.select("date", F.col("latitude").alias("target_lat"), F.col("longitude").alias("target_lon"), F.col("total_precipitation").alias("coarse_precip"))
    return E.fill_missing_features(t, ["coarse_precip", "coarse_fwi_max", "node_lat", "node_lon", "other"], g)


_DM = ["total_precipitation", "dewpoint"]


def downscaled_sql() -> str:
    w = "(1/(sqrt(d2)/10000+0.001))"

    def weighted(c):
        return f"sum({c}*{w})/sum(CASE WHEN {c} IS NOT NULL THEN {w} END)"

    parts = [f"{weighted(m)} AS feature_downscaled_{m}, {weighted(m + '_std')} AS feature_downscaled_{m}_variability, CASE WHEN count(*)=1 THEN max({m}_range) END AS feature_downscaled_{m}_spatial_range" for m in _DM]
    joins = " ".join(f"LEFT JOIN s_{m} USING (date, ly, lx)" for m in _DM)
    grads = ", ".join(f"CASE WHEN s_{m}.known>=3 THEN s_{m}.g_{m}_lat END AS feature_gradient_{m}_lat, CASE WHEN s_{m}.known>=3 THEN s_{m}.g_{m}_lon END AS feature_gradient_{m}_lon" for m in _DM)
    return (f"SELECT q.* EXCLUDE (ly, lx), {grads}, ly/10000.0::DOUBLE AS target_lat, lx/10000.0::DOUBLE AS target_lon FROM (SELECT date, ly, lx, sqrt(min(d2))/10000 AS feature_spatial_distance_to_50km, count(*) AS feature_spatial_num_50km_points,"
            " avg(ry)/10000 AS feature_spatial_lat_50km, avg(rx)/10000 AS feature_spatial_lon_50km, " + ", ".join(parts) + f" FROM pr GROUP BY 1,2,3) q {joins}")


_SPREAD = ("nd", "SELECT date, i*5000 AS y, j*5000 AS x, " + ", ".join(
    f"avg({m}) AS {m}, CASE WHEN count({m})>1 THEN stddev_samp({m}) END AS {m}_std, CASE WHEN count({m})>1 THEN max({m})-min({m}) END AS {m}_range" for m in _DM) + " FROM n GROUP BY date, i, j")


@check("M06_downscaled_features", build(downscaled_sql(), G, [
    ("n", nodes_sql("grid_daily", 5000)), _SPREAD, _GL, ("pr", pairs_sql("gl", "nd", [f"{m}{s}" for m in _DM for s in ("", "_std", "_range")], 7500)),
    *[(f"s_{m}", slopes_sql("pr", m, f"g_{m}")) for m in _DM]]),
    [*[f"feature_downscaled_{m}{s}" for m in _DM for s in ("", "_variability", "_spatial_range")], *[f"feature_gradient_{m}_{a}" for m in _DM for a in ("lat", "lon")],
     "feature_spatial_distance_to_50km", "feature_spatial_lat_50km", "feature_spatial_lon_50km"])
def _(spark, sf):
    g = D.grid_daily(spark, sf)
    return E.downscaled_features(g, g, _DM)


@check("M07_robust_scale", build(
    "SELECT date, latitude, longitude, (fwi-a)/b AS fwi, (temperature_max-c)/d AS temperature_max FROM grid_daily, (SELECT median(fwi) AS a, quantile_cont(fwi,0.75)-quantile_cont(fwi,0.25) AS b, median(temperature_max) AS c, quantile_cont(temperature_max,0.75)-quantile_cont(temperature_max,0.25) AS d FROM grid_daily)", G),
    ["fwi", "temperature_max"])
def _(spark, sf):
    return N.robust_scale(D.grid_daily(spark, sf).select(*KEYS, "fwi", "temperature_max"), ["fwi", "temperature_max"])


@check("M08_split_rows", build(
    f"SELECT date, latitude, longitude, fwi, CASE WHEN CAST('0x' || substr({DIGEST}, 1, 8) AS BIGINT) % 10000 < 2000 THEN 'test' ELSE 'train' END AS part FROM grid_daily", G))
def _(spark, sf):
    train, test = N.split_rows(D.grid_daily(spark, sf).select(*KEYS, "fwi"), KEYS)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


_FOLD = "SELECT *, CAST(CASE WHEN r<(n%5)*(n//5+1) THEN r//(n//5+1) ELSE n%5+(r-(n%5)*(n//5+1))//(n//5) END AS INTEGER) AS fold FROM (SELECT *, row_number() OVER (ORDER BY date, latitude, longitude)-1 AS r, count(*) OVER () AS n FROM grid_daily)"


@check("M12_fold_column", build(f"SELECT date, latitude, longitude, fold FROM ({_FOLD})", G))
def _(spark, sf):
    return N.fold_column(D.grid_daily(spark, sf).select(*KEYS, "fwi"), N.row_order()).select(*KEYS, "fold")


def table(spark, sf, cols, label="fwi"):
    """Feature vector and label over the whole source grid."""
    extra = [c for c in [*cols, label] if c not in KEYS]
    return N.assemble(D.grid_daily(spark, sf).select(*KEYS, *extra), cols, label)


_TWO = ("SELECT *, (sxy*(szz+1)-szy*sxz)/((sxx+1)*(szz+1)-sxz*sxz) AS b1, (szy*(sxx+1)-sxy*sxz)/((sxx+1)*(szz+1)-sxz*sxz) AS b2 FROM ("
        "SELECT var_pop(temperature_max)*count(*) AS sxx, var_pop(dewpoint)*count(*) AS szz, covar_pop(temperature_max, dewpoint)*count(*) AS sxz, covar_pop(temperature_max, fwi)*count(*) AS sxy, covar_pop(dewpoint, fwi)*count(*) AS szy,"
        " avg(fwi) AS my, avg(temperature_max) AS mx, avg(dewpoint) AS mz FROM grid_daily)")


@check("M11_fit_ridge", build(
    f"SELECT date, latitude, longitude, my+b1*(temperature_max-mx)+b2*(dewpoint-mz) AS prediction FROM grid_daily, ({_TWO})", G), {"prediction": 5})
def _(spark, sf):
    rows = table(spark, sf, ["temperature_max", "dewpoint"])
    return N.fit_ridge(rows).transform(rows).select(*KEYS, "prediction")


@check("M18_feature_importance", build(
    f"SELECT 'temperature_max' AS feature, abs(b1) AS importance FROM ({_TWO}) UNION ALL SELECT 'dewpoint', abs(b2) FROM ({_TWO})", G), ["importance"])
def _(spark, sf):
    cols = ["temperature_max", "dewpoint"]
    return N.feature_importance(N.fit_ridge(table(spark, sf, cols)), cols, spark)


def cv_sql(x: str) -> str:
    return (f"SELECT avg(r2) AS cv_r2, stddev_pop(r2) AS cv_std, count(r2) AS n_folds FROM (SELECT f.fold, 1-sum((fwi-(my+b*({x}-mx)))*(fwi-(my+b*({x}-mx))))/(var_pop(fwi)*count(*)) AS r2 FROM fd f JOIN ("
            f"SELECT k.fold, covar_pop({x}, fwi)*count(*)/(var_pop({x})*count(*)+1) AS b, avg({x}) AS mx, avg(fwi) AS my FROM fd JOIN (SELECT DISTINCT fold FROM fd) k ON fd.fold<>k.fold GROUP BY k.fold) t ON f.fold=t.fold GROUP BY f.fold)")


def cross_validate(spark, sf, x):
    return N.cv_r2_ridge(N.fold_column(table(spark, sf, [x]), N.row_order()), 1)


@check("M12_cv_r2", build(cv_sql("dewpoint"), G, [("fd", _FOLD)]), ["cv_r2", "cv_std"])
def _(spark, sf):
    return cross_validate(spark, sf, "dewpoint")


_TWO_FOLDS = (
    "SELECT f.fold, 1-sum(pow(fwi-my-b1*(temperature_max-mx)-b2*(dewpoint-mz), 2))/(var_pop(fwi)*count(*)) AS r2 FROM fd f JOIN ("
    + _TWO.replace("FROM grid_daily)", "FROM fd JOIN (SELECT DISTINCT fold AS held FROM fd) ON fold<>held GROUP BY held)").replace(
        "SELECT var_pop", "SELECT held, var_pop") + ") t ON f.fold=t.held GROUP BY f.fold")


@check("M12_cv_r2_two_features", build(
    f"SELECT avg(r2) AS cv_r2, stddev_pop(r2) AS cv_std, count(r2) AS n_folds FROM ({_TWO_FOLDS})", G, [("fd", _FOLD)]), ["cv_r2", "cv_std"])
def _(spark, sf):
    return N.cv_r2_ridge(N.fold_column(table(spark, sf, ["temperature_max", "dewpoint"]), N.row_order()), 2)


@check("M14_best_model", build(
    f"SELECT model, cv_r2 FROM (SELECT 'dewpoint' AS model, * FROM ({cv_sql('dewpoint')}) UNION ALL SELECT 'temperature', * FROM ({cv_sql('temperature_max')})) ORDER BY cv_r2 DESC, model LIMIT 1", G, [("fd", _FOLD)]), ["cv_r2"])
def _(spark, sf):
    both = [cross_validate(spark, sf, x).withColumn("model", F.lit(n)) for n, x in (("dewpoint", "dewpoint"), ("temperature", "temperature_max"))]
    return best_row(both[0].unionByName(both[1]), "cv_r2").select("model", "cv_r2")


@check("M13_evaluate_model", build(
    "SELECT max(r2) FILTER (fold<4) AS train_r2, max(r2) FILTER (fold=4) AS test_r2, max(rmse) FILTER (fold=4) AS rmse, max(mae) FILTER (fold=4) AS mae, max(c) FILTER (fold<4) AS n_train, max(c) FILTER (fold=4) AS n_test FROM ("
    "SELECT CASE WHEN fold=4 THEN 4 ELSE 0 END AS fold, 1-sum(e*e)/(var_pop(fwi)*count(*)) AS r2, sqrt(avg(e*e)) AS rmse, avg(abs(e)) AS mae, count(*) AS c FROM (SELECT fd.*, fwi-(my+b*(dewpoint-mx)) AS e FROM fd, ("
    "SELECT covar_pop(dewpoint, fwi)*count(*)/(var_pop(dewpoint)*count(*)+1) AS b, avg(dewpoint) AS mx, avg(fwi) AS my FROM fd WHERE fold<4)) GROUP BY 1)", G, [("fd", _FOLD)]), ["train_r2", "test_r2", "rmse", "mae"])
def _(spark, sf):
    rows = materialise(N.fold_column(table(spark, sf, ["dewpoint"]), N.row_order()))
    train, test = rows.where("fold < 4"), rows.where("fold = 4")
    return N.evaluate_model(N.fit_ridge(train), train, test)


@check("M16_prediction_uncertainty", build(
    "SELECT f.date, s/sqrt(n) AS prediction_uncertainty FROM (SELECT date, stddev_pop(fwi_predicted) AS s FROM fine_pred GROUP BY 1) f JOIN (SELECT date, count(*) AS n FROM grid_daily GROUP BY 1) g USING (date)", B), ["prediction_uncertainty"])
def _(spark, sf):
    return N.prediction_uncertainty(D.fine_pred(spark, sf), D.grid_daily(spark, sf))


@check("M17_quality_score", build(
    "SELECT l.date, l.y/10000.0::DOUBLE AS latitude, l.x/10000.0::DOUBLE AS longitude, greatest(0.3, 1-sqrt(min((l.y-r.y)*(l.y-r.y)+(l.x-r.x)*(l.x-r.x)))/10000/0.5) AS quality_score FROM l JOIN r ON l.date=r.date GROUP BY l.date, l.y, l.x", B,
    [("l", _xy("fine_pred", "DISTINCT date")), ("r", _xy("grid_daily", "date", "WHERE fwi > 0.000001 + (SELECT avg(o.fwi) FROM grid_daily o WHERE o.date = grid_daily.date)"))]), ["quality_score"])
def _(spark, sf):
    f = D.fine_pred(spark, sf).select(*KEYS).distinct()
    g = D.grid_daily(spark, sf)
    mean = g.groupBy("date").agg(F.avg("fwi").alias("mean"))
    near = nearest_join(f, g.join(mean, "date").where("fwi > mean + 0.000001").drop("mean"), ["fwi"], expand="right")
    return near.select(*KEYS, N.quality_score("distance").alias("quality_score"))


_LAT = ("lt", "SELECT date, lat0+i*900 AS y, lon0+j*1200 AS x FROM (SELECT *, unnest(range(0, CAST(ceil((lon1-lon0)/1200.0) AS BIGINT)+1)) AS j FROM (SELECT *, unnest(range(0, CAST(ceil((lat1-lat0)/900.0) AS BIGINT)+1)) AS i FROM spec))")
_RIDGE1 = ("rg", "SELECT covar_pop(cf.coarse_fwi, g.fwi)*count(*)/(var_pop(cf.coarse_fwi)*count(*)+1) AS b, avg(cf.coarse_fwi) AS mx, avg(g.fwi) AS my FROM grid_daily g JOIN cf ON g.date=cf.date AND g.latitude=cf.target_lat AND g.longitude=cf.target_lon")
_PRED = ("pd", "SELECT date, ly/10000.0::DOUBLE AS latitude, lx/10000.0::DOUBLE AS longitude, greatest(0, least(100, my+b*(cfwi-mx))) AS fwi_predicted, greatest(0.3, 1-cd/0.5) AS quality_score FROM ("
         "SELECT date, ly, lx, sum(fwi/(sqrt(d2)/10000+0.001))/sum(1/(sqrt(d2)/10000+0.001)) AS cfwi, sqrt(min(d2))/10000 AS cd FROM pl GROUP BY 1,2,3), rg")
_PREDICT_STEPS = [*node_steps(["fwi"]), _GL, ("pr", pairs_sql("gl", "nd", ["fwi"], 7500)), ("cf", coarse_sql(["fwi"], "nearest")), _RIDGE1, ("spec", _SPEC), _LAT,
                  ("gr", _xy("grid_daily", "date, fwi")), ("pl", pairs_sql("lt", "gr", ["fwi"], 3000)), _PRED]


@check("M15_predict_fine", build(
    "SELECT pd.*, s/sqrt(n) AS prediction_uncertainty FROM pd JOIN (SELECT date, stddev_pop(fwi_predicted) AS s FROM pd GROUP BY 1) USING (date) JOIN (SELECT date, count(*) AS n FROM grid_daily GROUP BY 1) USING (date)", G, _PREDICT_STEPS),
    ["fwi_predicted", "quality_score", "prediction_uncertainty"])
def _(spark, sf):
    """Ridge on the coarse mean, applied to a 0.09 x 0.12 degree lattice of every day, node by node."""
    return _predicted(spark, sf, 0.09, 0.12)


def _predicted(spark, sf, dlat, dlon, source_step=None):
    g = D.grid_daily(spark, sf)
    pairs = materialise(E.training_pairs(g, ["fwi"], 0.5, include_target=True))
    model = N.fit_ridge(N.assemble(pairs.select("coarse_fwi", "fine_fwi"), ["coarse_fwi"], "fine_fwi"))
    return N.predict_fine(g, model, ["coarse_fwi"], ["fwi"], dlat, dlon, source_step=source_step)


# The lattice of 0.009 x 0.012 degrees, joined with the source by cells of 0.3 degrees.
_LAT1 = ("lt", _LAT[1].replace("900", "90").replace("1200", "120"))
_CELLS = [("sc", "SELECT *, floor(y/3000)+a AS cy, floor(x/3000)+b AS cx FROM gr, (SELECT unnest([-1,0,1]) AS a), (SELECT unnest([-1,0,1]) AS b)"),
          ("ps", "SELECT l.date, l.y AS ly, l.x AS lx, s.* EXCLUDE (date, y, x, a, b, cy, cx), s.y AS ry, s.x AS rx, (l.y-s.y)*(l.y-s.y)+(l.x-s.x)*(l.x-s.x) AS d2 FROM lt l JOIN sc s"
           " ON l.date=s.date AND floor(l.y/3000)=s.cy AND floor(l.x/3000)=s.cx WHERE (l.y-s.y)*(l.y-s.y)+(l.x-s.x)*(l.x-s.x)<=9000000"),
          ("lo", "SELECT * FROM lt l WHERE NOT EXISTS (SELECT 1 FROM sc s WHERE l.date=s.date AND floor(l.y/3000)=s.cy AND floor(l.x/3000)=s.cx AND (l.y-s.y)*(l.y-s.y)+(l.x-s.x)*(l.x-s.x)<=9000000)"),
          ("pl", "SELECT * FROM ps UNION ALL SELECT * EXCLUDE (k) FROM (SELECT l.date, l.y AS ly, l.x AS lx, s.* EXCLUDE (date, y, x), s.y AS ry, s.x AS rx, (l.y-s.y)*(l.y-s.y)+(l.x-s.x)*(l.x-s.x) AS d2,"
           " row_number() OVER (PARTITION BY l.date, l.y, l.x ORDER BY (l.y-s.y)*(l.y-s.y)+(l.x-s.x)*(l.x-s.x), s.y, s.x) AS k FROM lo l JOIN gr s ON l.date=s.date) WHERE k=1")]
_FINE1 = [("spec", _SPEC), _LAT1, ("gr", _xy("grid_daily", "date, fwi")), *_CELLS]


@check("M15_predict_fine_1km", build(
    "SELECT date, count(*) AS n, min(fwi_predicted) AS low, max(fwi_predicted) AS high, avg(fwi_predicted) AS mean, stddev_pop(fwi_predicted)/sqrt(any_value(g.n)) AS prediction_uncertainty"
    " FROM pd JOIN (SELECT date, count(*) AS n FROM grid_daily GROUP BY 1) g USING (date) GROUP BY date", G,
    [*node_steps(["fwi"]), _GL, ("pr", pairs_sql("gl", "nd", ["fwi"], 7500)), ("cf", coarse_sql(["fwi"], "nearest")), _RIDGE1, *_FINE1, _PRED]),
    ["low", "high", "mean", "prediction_uncertainty"])
def _(spark, sf):
    """The same at the 0.009 x 0.012 degree lattice, features by stencil kernels, summed up by day."""
    p = F.col("fwi_predicted")
    return _predicted(spark, sf, 0.009, 0.012, 0.25).groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.min(p).alias("low"), F.max(p).alias("high"), F.avg(p).alias("mean"),
        F.max("prediction_uncertainty").alias("prediction_uncertainty"))


@check("M15_downscale_full_features", None)
def _(spark, sf):
    """All features, exact robust scaling and ridge; the ML path has no SQL form."""
    return downscale.downscale(D.grid_daily(spark, sf), ["fwi", "temperature_max", "dewpoint"], "ridge", dlat=0.18, dlon=0.24)


_FEATURES3 = [f"coarse_{m}{s}" for m in ("fwi", "temperature_max", "dewpoint") for s in ("", "_mean", "_std")] + ["coarse_distance", "coarse_lat", "coarse_lon"]
_STATS3 = ", ".join(
    f"sum({m}*w)/sum(w) AS coarse_{m}, CASE WHEN count(*)>2 THEN avg({m}) END AS coarse_{m}_mean, CASE WHEN count(*)>2 THEN stddev_samp({m}) END AS coarse_{m}_std"
    for m in ("fwi", "temperature_max", "dewpoint"))


@check("M15_stencil_features", build(
    idw_sql(_IM, "pl", "sl"), G, [("spec", _SPEC), _LAT, _GR, ("pl", pairs_sql("lt", "gr", _IM, 3000)), ("sl", slopes_sql("pl", "fwi", "g"))]), _IDW)
def _(spark, sf):
    """Every feature of a 0.09 x 0.12 degree lattice from stencil kernels, node by node."""
    g = D.grid_daily(spark, sf)
    return stencil_features(lattice_spec(g, 0.09, 0.12, ["date"]), g, _IM)


@check("M15_stencil_features_1km", build(
    "SELECT date, count(*) AS n, " + ", ".join(f"avg({c}) AS {c}, count({c}) AS n_{c}" for c in _FEATURES3) + f" FROM (SELECT date, {_STATS3}, sqrt(min(d2))/10000 AS coarse_distance, avg(ry)/10000 AS coarse_lat,"
    " avg(rx)/10000 AS coarse_lon FROM (SELECT *, 1/(sqrt(d2)/10000+0.001) AS w FROM pl) GROUP BY date, ly, lx) GROUP BY date", G,
    [("spec", _SPEC), _LAT1, ("gr", _xy("grid_daily", "date, fwi, temperature_max, dewpoint")), *_CELLS]), _FEATURES3)
def _(spark, sf):
    """The features that models take, of the 0.009 x 0.012 degree lattice of every day, as means and counts by day."""
    g = D.grid_daily(spark, sf)
    rows = stencil_features(lattice_spec(g, 0.009, 0.012, ["date"]), g, ["fwi", "temperature_max", "dewpoint"], gradient_of=None)
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(p + c) for c in _FEATURES3 for f, p in ((F.avg, ""), (F.count, "n_"))])


_PAIRS1 = [*node_steps(["fwi"]), _GL, ("pr", pairs_sql("gl", "nd", ["fwi"], 7500)), ("cf", coarse_sql(["fwi"], "nearest")),
           ("tp", "SELECT * FROM (SELECT g.date, g.latitude, g.longitude, g.fwi, cf.coarse_fwi AS dewpoint FROM grid_daily g JOIN cf ON g.date=cf.date AND g.latitude=cf.target_lat AND g.longitude=cf.target_lon)"
            f" WHERE CAST('0x' || substr({DIGEST}, 1, 8) AS BIGINT) % 10000 >= 2000"),
           ("fd", _FOLD.replace("grid_daily", "tp"))]


@check("M14_select_model", build(
    "SELECT CASE WHEN r.cv_r2 > c.cv_r2 THEN 'ridge' ELSE 'constant' END AS model, greatest(r.cv_r2, c.cv_r2) AS cv_r2, r.cv_r2 AS ridge_cv_r2, c.cv_r2 AS constant_cv_r2, c.n_folds FROM ("
    + cv_sql("dewpoint") + ") r, (SELECT avg(r2) AS cv_r2, count(r2) AS n_folds FROM (SELECT f.fold, 1-sum(pow(fwi-my, 2))/(var_pop(fwi)*count(*)) AS r2 FROM fd f JOIN ("
    "SELECT k.fold, avg(fwi) AS my FROM fd JOIN (SELECT DISTINCT fold FROM fd) k ON fd.fold<>k.fold GROUP BY k.fold) t ON f.fold=t.fold GROUP BY f.fold)) c", G, _PAIRS1),
    ["cv_r2", "ridge_cv_r2", "constant_cv_r2"])
def _(spark, sf):
    """Ridge on the coarse mean against the labels' mean, on the 80 % part of the training pairs."""
    pairs = E.training_pairs(D.grid_daily(spark, sf), ["fwi"], 0.5, include_target=True)
    best, _, scores = downscale.select_model(N.assemble(pairs, ["coarse_fwi"], "fine_fwi"), ("ridge", "constant"))
    row = (best, scores[best]["cv_r2"], scores["ridge"]["cv_r2"], scores["constant"]["cv_r2"], scores["constant"]["n_folds"])
    return spark.createDataFrame([row], "model string, cv_r2 double, ridge_cv_r2 double, constant_cv_r2 double, n_folds bigint")


@check("M14_downscale_best", None)
def _(spark, sf):
    """The better of ridge and constant, all features, at a 0.09 x 0.12 degree lattice, summed up by day."""
    fine = downscale.downscale_best(D.grid_daily(spark, sf), ["fwi", "temperature_max"], dlat=0.09, dlon=0.12, names=("ridge", "constant"), source_step=0.25)
    return fine.groupBy("date", "prediction_method", "model_cv_score").agg(F.count(F.lit(1)).alias("n"), F.avg("fwi_predicted").alias("mean"))


def tree_steps(name: str, src: str, depth: int, least: int) -> list[tuple[str, str]]:
    """A regression tree on latitude and longitude over ``src`` (date, latitude, longitude, y): (..., p) as ``name``.

    Each level splits every node at the value that lowers the squared error most; rows up to it go left.
    """
    steps = [(f"{name}_0", f"SELECT *, 0 AS node FROM {src}")]
    for k in range(depth):
        n = f"{name}_{k}"
        steps += [
            (f"{n}_u", f"SELECT node, f, v, count(*) AS c, sum(y) AS s FROM (SELECT node, 0 AS f, latitude AS v, y FROM {n} UNION ALL SELECT node, 1, longitude, y FROM {n}) GROUP BY 1,2,3"),
            (f"{n}_w", f"SELECT node, f, v, sum(c) OVER w AS cl, sum(s) OVER w AS sl, sum(c) OVER (PARTITION BY node, f) AS c, sum(s) OVER (PARTITION BY node, f) AS s FROM {n}_u WINDOW w AS (PARTITION BY node, f ORDER BY v)"),
            (f"{n}_b", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY sl*sl/cl+(s-sl)*(s-sl)/(c-cl) DESC, f, v) AS k FROM {n}_w WHERE cl>={least} AND c-cl>={least}) WHERE k=1"),
            (f"{name}_{k + 1}", f"SELECT r.date, r.latitude, r.longitude, r.y, CASE WHEN b.v IS NULL THEN 2*r.node+1 WHEN CASE WHEN b.f=0 THEN r.latitude ELSE r.longitude END <= b.v THEN 2*r.node+1 ELSE 2*r.node+2 END AS node"
             f" FROM {n} r LEFT JOIN {n}_b b ON r.node=b.node"),
        ]
    return [*steps, (name, f"SELECT *, avg(y) OVER (PARTITION BY node) AS p FROM {name}_{depth}")]


_LABELS = ("y0", "SELECT date, latitude, longitude, fwi AS y FROM grid_daily")
_BOOSTED = [_LABELS, *tree_steps("t0", "y0", 3, 1), ("f0", "SELECT date, latitude, longitude, p AS f FROM t0")]
for _k in (1, 2):
    # Squared error: the next tree learns twice the residual and counts a tenth.
    _BOOSTED += [(f"y{_k}", f"SELECT date, latitude, longitude, 2*(y0.y-f) AS y FROM y0 JOIN f{_k - 1} USING (date, latitude, longitude)"), *tree_steps(f"t{_k}", f"y{_k}", 3, 1),
                 (f"f{_k}", f"SELECT date, latitude, longitude, f+0.1*p AS f FROM f{_k - 1} JOIN t{_k} USING (date, latitude, longitude)")]


def _walked(spark, sf, fit, depth):
    """Predictions of a model on latitude and longitude by walking its node table."""
    rows = materialise(table(spark, sf, ["latitude", "longitude"]))
    return score_nodes(rows, node_table(fit(rows.select("features", "label")), spark), ["latitude", "longitude"], KEYS, depth)


@check("M09_fit_gbt", build("SELECT date, latitude, longitude, f AS prediction FROM f2", G, _BOOSTED), ["prediction"])
def _(spark, sf):
    """Three boosted trees over all rows; the SQL grows the same trees."""
    return _walked(spark, sf, lambda rows: N.fit_gbt(rows, trees=3, depth=3, subsample=1.0), 3)


@check("M10_fit_forest", build("SELECT date, latitude, longitude, p AS prediction FROM t0", G, [_LABELS, *tree_steps("t0", "y0", 4, 2)]), ["prediction"])
def _(spark, sf):
    """A forest whose trees all see every row; the SQL grows the same tree."""
    return _walked(spark, sf, lambda rows: N.fit_forest(rows, trees=3, depth=4, bootstrap=False), 4)


_SHIFTED = [
    ("pl", f"SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr({DIGEST}, 1, 15) AS BIGINT), date, latitude, longitude)-1 AS place, count(*) OVER () AS total FROM grid_daily"),
    ("tr", "SELECT feature, trial, 1+CAST('0x' || substr(md5(concat_ws('|', 'shift', feature, CAST(trial AS VARCHAR), '42')), 1, 15) AS BIGINT) % greatest(n-1, 1) AS shift FROM"
     " (SELECT unnest(['temperature_max', 'dewpoint']) AS feature), (SELECT unnest(range(1, 6)) AS trial), (SELECT count(*) AS n FROM grid_daily)"),
    ("mx", "SELECT feature, trial, a.fwi, CASE feature WHEN 'temperature_max' THEN b.temperature_max ELSE a.temperature_max END AS t, CASE feature WHEN 'dewpoint' THEN b.dewpoint ELSE a.dewpoint END AS d"
     " FROM tr JOIN pl b ON true JOIN pl a ON a.place=(b.place-shift+a.total)%a.total"),
]


@check("M19_permutation_importance", build(
    f"SELECT feature, any_value(base)-avg(r2) AS importance FROM (SELECT feature, trial, 1-sum(pow(fwi-my-b1*(t-mx)-b2*(d-mz), 2))/(var_pop(fwi)*count(*)) AS r2 FROM mx, ({_TWO}) GROUP BY feature, trial),"
    f" (SELECT 1-sum(pow(fwi-my-b1*(temperature_max-mx)-b2*(dewpoint-mz), 2))/(var_pop(fwi)*count(*)) AS base FROM grid_daily, ({_TWO})) GROUP BY feature", G, _SHIFTED), ["importance"])
def _(spark, sf):
    cols = ["temperature_max", "dewpoint"]
    rows = table(spark, sf, cols)
    return N.permutation_importance(N.fit_ridge(rows), rows, cols, KEYS)


@check("closure_align_inputs", build(
    "SELECT f.date, f.latitude, f.longitude, f.fwi, t.temperature_max, a.dewpoint, a.total_precipitation FROM fwi_daily f JOIN temp_daily t USING (date, latitude, longitude) JOIN atmos_daily a USING (date, latitude, longitude)"
    " WHERE latitude BETWEEN 36 AND 43 AND longitude BETWEEN -10 AND -6 AND total_precipitation IS NOT NULL", ["fwi_daily", "temp_daily", "atmos_daily"]), ["temperature_max", "dewpoint", "total_precipitation"])
def _(spark, sf):
    return closure.align_inputs(D.fwi_daily(spark, sf), {"temp": D.temp_daily(spark, sf), "atmos": D.atmos_daily(spark, sf)},
                                ["fwi", "temperature_max", "dewpoint", "total_precipitation"])
