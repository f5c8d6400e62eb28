"""Prediction scores, leaderboards and feature-importance tables."""

from pyspark.sql import functions as F

from checks.aggregates import MERGED_STEPS, RADIUS_SQL, merged
from checks.base import build, check
from checks.spatial import BOX_STEPS, _xy, boxes_sql
from emberlattice.operators import importance as I
from emberlattice.operators import metrics as M
from emberlattice.operators.aggregate import daily_cell_mean, radius_stats
from emberlattice.operators.joins import merge_daily, validate_merge
from emberlattice.plans import closure
from emberlattice.schema import FEATURE_CATEGORIES, SUMMARY_CATEGORIES
from emberlattice.session import materialise
from emberlattice.sources import derived as D

G, FP = ["grid_daily"], ["fine_pred"]
SCORES = ["correlation", "r_squared", "rmse", "mae", "bias", "truth_mean", "pred_mean"]
ALL_SCORES = [*SCORES, "p_value", "relative_rmse", "relative_mae"]


def scores_sql(t: str, p: str) -> str:
    return (f"count(*) AS n_points, corr({t},{p}) AS correlation, 1-sum(({p}-{t})*({p}-{t}))/(var_pop({t})*count(*)) AS r_squared,"
            f" sqrt(avg(({p}-{t})*({p}-{t}))) AS rmse, avg(abs({p}-{t})) AS mae, avg({p}-{t}) AS bias, avg({t}) AS truth_mean, avg({p}) AS pred_mean")


# Two-sided t test of r: Simpson sum of the Student density in the angle, normalised with lgamma.
_P = ("CASE WHEN asin(abs(r)) >= 12/sqrt(v) THEN 0.0::DOUBLE ELSE 2*exp(lgamma((v+1)/2)-lgamma(v/2))/sqrt(pi())*(SELECT sum("
      "(CASE WHEN k=0 OR k=2000 THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END) * pow(greatest(cos(asin(abs(r))+(least(pi()/2,14/sqrt(v))-asin(abs(r)))*k/2000.0),0), v-1)) FROM range(0,2001) t(k))"
      "*(least(pi()/2,14/sqrt(v))-asin(abs(r)))/2000/3 END")


def with_p(q: str, by: str = "") -> str:
    return (f"SELECT * EXCLUDE (r, v), {_P} AS p_value, rmse*100/truth_mean AS relative_rmse, mae*100/truth_mean AS relative_mae FROM ("
            f"SELECT *, correlation AS r, CAST(n_points-2 AS DOUBLE) AS v FROM ({q}))")


@check("A12_global_metrics", build(with_p(f"SELECT {scores_sql('fwi', 'p')} FROM m"), [*G, *FP], MERGED_STEPS), ALL_SCORES)
def _(spark, sf):
    return M.global_metrics(merged(spark, sf), "fwi", "fwi_aggregated")


@check("A12_metrics_per_date", build(with_p(f"SELECT date, {scores_sql('fwi', 'p')} FROM m GROUP BY date"), [*G, *FP], MERGED_STEPS), ALL_SCORES)
def _(spark, sf):
    return M.global_metrics(merged(spark, sf), "fwi", "fwi_aggregated", ["date"])


_POINT = ("SELECT latitude, longitude, n_points, correlation, r_squared AS r_squared_alt, rmse, mae, bias, truth_mean AS real_mean, pred_mean, correlation*correlation AS r_squared FROM ("
          f"SELECT latitude, longitude, {scores_sql('fwi', 'p')} FROM m GROUP BY 1,2 HAVING count(*)>=10)")
_POINT_COLS = ["correlation", "r_squared_alt", "rmse", "mae", "bias", "real_mean", "pred_mean", "r_squared"]


@check("A13_grid_point_metrics", build(_POINT, [*G, *FP], MERGED_STEPS), _POINT_COLS)
def _(spark, sf):
    return M.grid_point_metrics(merged(spark, sf), "fwi", "fwi_aggregated")


@check("A13_half_open_closure", build(
    _POINT.replace("FROM m GROUP", "FROM mh GROUP"), [*G, *FP],
    [*BOX_STEPS, ("mh", "SELECT b.latitude, b.longitude, b.p, q.fwi FROM (SELECT date, latitude, longitude, avg(fwi_predicted) AS p FROM (" + boxes_sql(1125, "<") + ") GROUP BY 1,2,3) b JOIN grid_daily q USING (date, latitude, longitude)")]), _POINT_COLS)
def _(spark, sf):
    """Daily means of half-open cells scored per point over the year."""
    g = D.grid_daily(spark, sf).select("date", "latitude", "longitude", "fwi")
    cells = daily_cell_mean(D.fine_pred(spark, sf), g, "fwi_predicted")
    return M.grid_point_metrics(validate_merge(cells, g, ("fwi_aggregated", "fwi")), "fwi", "fwi_aggregated")


@check("A14_metrics_by_method", build(
    with_p(" UNION ALL ".join(f"SELECT '{m}' AS method, {scores_sql('fwi', c)} FROM j" for m, c in
           (("Mean", "fwi_aggregated_mean"), ("Median", "fwi_aggregated_median"), ("Weighted", "fwi_aggregated_weighted")))),
    RADIUS_SQL[1], [*RADIUS_SQL[2], ("rs", RADIUS_SQL[0]), ("j", "SELECT rs.*, g2.fwi FROM rs JOIN grid_daily g2 USING (date, latitude, longitude)")]), ALL_SCORES)
def _(spark, sf):
    g = D.grid_daily(spark, sf).select("date", "latitude", "longitude", "fwi")
    stats = radius_stats(g, D.fine_pred(spark, sf), "fwi_predicted")
    return M.metrics_by_method(merge_daily(stats, g, "source"), "fwi", {
        "Mean": "fwi_aggregated_mean", "Median": "fwi_aggregated_median", "Weighted": "fwi_aggregated_weighted"})


def point_metrics(spark, sf):
    """Stored once: the summaries read it several times."""
    return materialise(M.grid_point_metrics(merged(spark, sf), "fwi", "fwi_aggregated"))


_COLS = ["rmse", "correlation", "r_squared", "mae", "bias"]


@check("A16_metric_summary", build(
    " UNION ALL ".join(f"SELECT '{c}' AS metric, avg({c}) AS mean, median({c}) AS median, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max FROM pm" for c in _COLS),
    [*G, *FP], [*MERGED_STEPS, ("pm", _POINT)]), ["mean", "median", "std", "min", "max"])
def _(spark, sf):
    return M.metric_summary(point_metrics(spark, sf), _COLS)


def _bands(col, cuts):
    a, b, c = cuts
    return [("Excellent", f"{col}>{a}"), ("Good", f"{col}>{b} AND {col}<={a}"), ("Fair", f"{col}>{c} AND {col}<={b}"), ("Poor", f"{col}<={c}")]


@check("A17_performance_bands", build(
    " UNION ALL ".join(
        [f"SELECT '{m}' AS measure, '{b}' AS band, count(*) FILTER ({w}) AS n, 100.0*count(*) FILTER ({w})/count(*) AS pct FROM pm"
         for m, cuts in (("correlation", (0.8, 0.6, 0.4)), ("r_squared", (0.64, 0.36, 0.16))) for b, w in _bands(m, cuts)]
        + ["SELECT 'combined', 'High performance', count(*) FILTER (r_squared>0.5 AND rmse<(SELECT median(rmse) FROM pm)), 100.0*count(*) FILTER (r_squared>0.5 AND rmse<(SELECT median(rmse) FROM pm))/count(*) FROM pm"]),
    [*G, *FP], [*MERGED_STEPS, ("pm", _POINT)]), ["pct"])
def _(spark, sf):
    return M.performance_bands(point_metrics(spark, sf))


_MODEL_STEPS = [("f", _xy("pred_models", "model, date, fwi_predicted")), BOX_STEPS[1],
                ("mm", "SELECT b.*, q.fwi FROM (SELECT f.model, f.date, g.latitude, g.longitude, avg(f.fwi_predicted) AS p, stddev_samp(f.fwi_predicted) AS s, count(*) AS c"
                 " FROM f JOIN g ON f.date=g.date AND abs(f.y-g.y)<=1250 AND abs(f.x-g.x)<=1250 GROUP BY 1,2,3,4) b JOIN grid_daily q USING (date, latitude, longitude)")]
_BOARD = with_p(f"SELECT model, {scores_sql('fwi', 'p')} FROM mm GROUP BY model")
_QUALITY = "CASE WHEN r_squared IS NULL THEN NULL WHEN r_squared>0.9 THEN 'Excellent' WHEN r_squared>0.8 THEN 'Good' WHEN r_squared>0.7 THEN 'Fair' ELSE 'Poor' END"


@check("A37_model_leaderboard", build(f"SELECT *, {_QUALITY} AS quality FROM ({_BOARD}) ORDER BY r_squared DESC, model", [*G, "pred_models"], _MODEL_STEPS), ALL_SCORES)
def _(spark, sf):
    return closure.leaderboard(closure.validate_models(D.pred_models(spark, sf), D.grid_daily(spark, sf)))


@check("A37_best_model", build(f"SELECT model, n_points, r_squared FROM ({_BOARD}) ORDER BY r_squared DESC, model LIMIT 1", [*G, "pred_models"], _MODEL_STEPS), ["r_squared"])
def _(spark, sf):
    board = closure.leaderboard(closure.validate_models(D.pred_models(spark, sf), D.grid_daily(spark, sf)))
    return M.best_row(board, "r_squared").select("model", "n_points", "r_squared")


@check("A38_quality_label", build(
    f"SELECT latitude, longitude, {_QUALITY.replace('r_squared', 'correlation')} AS quality FROM pm", [*G, *FP], [*MERGED_STEPS, ("pm", _POINT)]))
def _(spark, sf):
    from emberlattice.functions import quality_label
    pm = M.grid_point_metrics(merged(spark, sf), "fwi", "fwi_aggregated")
    return pm.select("latitude", "longitude", quality_label("correlation").alias("quality"))


@check("validation_merged_models", build(
    "SELECT model, date, latitude, longitude, p AS fwi_aggregated, s AS fwi_std, c AS count_1km_points, fwi FROM mm", [*G, "pred_models"], _MODEL_STEPS), ["fwi_aggregated", "fwi_std"])
def _(spark, sf):
    return closure.validate_models(D.pred_models(spark, sf), D.grid_daily(spark, sf))


@check("S09_validation_summary", build(
    "SELECT a.model, a.r_squared, a.rmse, b.data_size, b.unique_coordinates, b.lat_low, b.lon_high, b.original_p50, b.aggregated_p75, b.aggregated_std FROM ("
    f"SELECT model, {scores_sql('fwi', 'p')} FROM mm GROUP BY model) a JOIN (SELECT model, count(*) AS data_size, count(DISTINCT (latitude, longitude)) AS unique_coordinates, min(latitude) AS lat_low, max(longitude) AS lon_high,"
    " median(fwi) AS original_p50, quantile_cont(p, 0.75) AS aggregated_p75, stddev_samp(p) AS aggregated_std FROM mm GROUP BY model) b USING (model)", [*G, "pred_models"], _MODEL_STEPS),
    ["r_squared", "rmse", "original_p50", "aggregated_p75", "aggregated_std"])
def _(spark, sf):
    s = closure.validation_summary(closure.validate_models(D.pred_models(spark, sf), D.grid_daily(spark, sf)))
    return s.select(
        "model", "metrics.r_squared", "metrics.rmse", "data_size", "spatial_coverage.unique_coordinates",
        F.col("spatial_coverage.lat_range")[0].alias("lat_low"), F.col("spatial_coverage.lon_range")[1].alias("lon_high"),
        F.col("data_distribution")["fwi_original"]["p50"].alias("original_p50"),
        F.col("data_distribution")["fwi_aggregated"]["p75"].alias("aggregated_p75"),
        F.col("data_distribution")["fwi_aggregated"]["std"].alias("aggregated_std"))


FI = ["features_importance"]
_NORM = "SELECT model, feature, score, CASE WHEN max(score) OVER (PARTITION BY model)>0 THEN score/max(score) OVER (PARTITION BY model) ELSE 0 END AS normalised FROM features_importance"


@check("A39_importance_consensus", build("SELECT feature, avg(score) AS mean, stddev_pop(score) AS std, count(*) AS n_models FROM features_importance GROUP BY 1", FI), ["mean", "std"])
def _(spark, sf):
    return I.importance_consensus(D.features_importance(spark, sf))


@check("A39_consensus_normalised_top10", build(
    "SELECT feature, avg(normalised) AS mean, stddev_pop(normalised) AS std, count(*) AS n_models FROM n GROUP BY 1 ORDER BY mean DESC, feature LIMIT 10", FI, [("n", _NORM)]), ["mean", "std"])
def _(spark, sf):
    return I.importance_consensus(D.features_importance(spark, sf), normalised=True, k=10)


def _category_sql(src: str, by: str, value: str) -> str:
    parts = []
    for c, words in FEATURE_CATEGORIES.items():
        test = " OR ".join(f"contains(lower(feature), '{w}')" for w in words)
        parts.append(f"SELECT {by}'{c}' AS category, sum({value}) AS total, avg({value}) AS mean, count({value}) AS n_features FROM {src} WHERE {test} GROUP BY ALL HAVING count(*)>0")
    names = ", ".join(f"('{c}')" for c in FEATURE_CATEGORIES)
    on = " AND ".join(["b.category IS NOT DISTINCT FROM h.category", *(f"b.{k} IS NOT DISTINCT FROM h.{k}" for k in by.replace(",", " ").split())])
    groups = f"(SELECT DISTINCT {by}1 AS one FROM {src})"
    keys = "".join(f"b.{k}, " for k in by.replace(",", " ").split())
    return (f"SELECT {keys}b.category, coalesce(total, 0) AS total, coalesce(mean, 0) AS mean, coalesce(n_features, 0) AS n_features FROM"
            f" (SELECT * FROM {groups}, (VALUES {names}) c(category)) b LEFT JOIN ({' UNION ALL '.join(parts)}) h ON {on}")


@check("A40_importance_by_category", build(_category_sql("features_importance", "model, ", "score"), FI), ["total", "mean"])
def _(spark, sf):
    return I.importance_by_category(D.features_importance(spark, sf))


@check("A40_empty_category", build(_category_sql("rest", "model, ", "score"), FI, [
    ("rest", "SELECT * FROM features_importance WHERE NOT contains(lower(feature), 'temperature')")]), ["total", "mean"])
def _(spark, sf):
    """Without temperature features their category stays, with zeros."""
    return I.importance_by_category(D.features_importance(spark, sf).where("NOT contains(lower(feature), 'temperature')"))


@check("A40_consensus_by_category", build(_category_sql("c", "", "m"), FI, [("c", "SELECT feature, avg(score) AS m FROM features_importance GROUP BY 1")]), ["total", "mean"])
def _(spark, sf):
    c = I.importance_consensus(D.features_importance(spark, sf)).select("feature", F.col("mean").alias("m"))
    return I.importance_by_category(c, (), "m")


@check("A41_feature_type_counts", build(
    "SELECT CASE WHEN contains(feature,'feature_downscaled_') AND NOT contains(feature,'_variability') AND NOT contains(feature,'_spatial_range') THEN 'Downscaled Meteorological'"
    " WHEN contains(feature,'feature_spatial_') THEN 'Spatial Context' WHEN contains(feature,'feature_gradient_') THEN 'Gradient Features' ELSE 'Variability Features' END AS family, count(DISTINCT feature) AS n_features FROM features_importance GROUP BY 1", FI))
def _(spark, sf):
    return I.feature_type_counts(D.features_importance(spark, sf))


_FIRST = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(feature,'{w}')" for w in ws) + f" THEN '{c}'" for c, ws in SUMMARY_CATEGORIES.items()) + " WHEN contains(feature,'feature_downscaled_') THEN 'Temperature' END"


@check("A41_feature_summary_counts", build(f"SELECT {_FIRST} AS category, count(DISTINCT feature) AS n_features FROM features_importance GROUP BY 1 HAVING category IS NOT NULL", FI))
def _(spark, sf):
    return I.feature_summary_counts(D.features_importance(spark, sf))


_MODELS = D.IMPORTANCE_MODELS


@check("A42_importance_matrix", build(
    "SELECT feature, " + ", ".join(f"coalesce(max(normalised) FILTER (model='{m}'),0) AS {m}" for m in _MODELS)
    + ", (" + "+".join(f"coalesce(max(normalised) FILTER (model='{m}'),0)" for m in _MODELS) + ")/4 AS row_mean FROM n GROUP BY 1 ORDER BY row_mean DESC, feature LIMIT 25", FI, [("n", _NORM)]),
    [*_MODELS, "row_mean"])
def _(spark, sf):
    return I.importance_matrix(D.features_importance(spark, sf), _MODELS).drop("label")


@check("A44_importance_distribution", build("SELECT count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std, median(score) AS median FROM features_importance", FI), ["mean", "std", "median"])
def _(spark, sf):
    return I.importance_distribution(D.features_importance(spark, sf))


@check("W05_top_features", build(
    "SELECT model, feature, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, feature) AS rank FROM features_importance) WHERE rank<=8", FI), ["score"])
def _(spark, sf):
    return I.top_features(D.features_importance(spark, sf), 8)


@check("W07_group_max_normalise", build("SELECT model, feature, normalised FROM n", FI, [("n", _NORM)]), ["normalised"])
def _(spark, sf):
    return I.normalise_by_model(D.features_importance(spark, sf)).select("model", "feature", "normalised")


@check("U04_feature_union", build("SELECT DISTINCT feature FROM features_importance", FI))
def _(spark, sf):
    f = D.features_importance(spark, sf)
    return I.feature_union([f.where(F.col("model") == m) for m in _MODELS])
