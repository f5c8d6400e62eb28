"""Exposure matching and vulnerability."""

from pyspark.sql import functions as F

from checks.base import build, check
from checks.spatial import _xy
from emberlattice.operators import risk as R
from emberlattice.operators.aggregate import category_counts
from emberlattice.operators.metrics import correlations
from emberlattice.operators.order_stats import percent_rank_average
from emberlattice.plans.vulnerability import rank_vulnerability
from emberlattice.schema import MAINLAND_BOX
from emberlattice.session import materialise
from emberlattice.sources import derived as D

T = ["grid_daily", "exposure"]
_BOX = "latitude BETWEEN 36.5 AND 42.2 AND longitude BETWEEN -9.6 AND -6.0"


def match_steps(fwi: str, box: bool = True):
    w = f"WHERE {_BOX}" if box else ""
    return [("f", _xy(fwi, "fwi_value", w)), ("e", _xy("exposure", "point_id, latitude, longitude, value", w)),
            ("mt", "SELECT point_id, latitude, longitude, value AS exposure_value, fwi_value, sqrt(d2)/10000*111.32 AS match_distance_km, ry/10000.0::DOUBLE AS nearest_fwi_lat, rx/10000.0::DOUBLE AS nearest_fwi_lon FROM ("
             "SELECT e.*, f.fwi_value, f.y AS ry, f.x AS rx, (e.y-f.y)*(e.y-f.y)+(e.x-f.x)*(e.x-f.x) AS d2, row_number() OVER (PARTITION BY e.point_id ORDER BY (e.y-f.y)*(e.y-f.y)+(e.x-f.x)*(e.x-f.x), f.y, f.x, f.fwi_value) AS k FROM e, f) WHERE k=1")]


MEAN = "(SELECT latitude, longitude, avg(fwi) AS fwi_value FROM grid_daily GROUP BY 1,2)"
_MATCH_COLS = ["match_distance_km", "fwi_value"]
_COLS = ["point_id", "exposure_value", "fwi_value", "match_distance_km", "nearest_fwi_lat", "nearest_fwi_lon"]


@check("M22_exposure_match_mean", build(f"SELECT {', '.join(_COLS)} FROM mt", T, match_steps(MEAN, False)), _MATCH_COLS)
def _(spark, sf):
    return R.exposure_match(D.grid_daily(spark, sf), D.exposure(spark, sf)).select(*_COLS)


@check("M22_exposure_match_day", build(f"SELECT {', '.join(_COLS)} FROM mt", T, match_steps("(SELECT latitude, longitude, fwi AS fwi_value FROM grid_daily WHERE date=DATE '2017-06-17')", False)), _MATCH_COLS)
def _(spark, sf):
    return R.exposure_match(D.grid_daily(spark, sf), D.exposure(spark, sf), day="2017-06-17").select(*_COLS)


def scored(spark, sf, method):
    m = R.exposure_match(D.grid_daily(spark, sf).where(F.expr(_BOX)), D.exposure(spark, sf).where(F.expr(_BOX)))
    return R.risk_score(materialise(m), method)


_NORMED = "(fwi_value-a)/(b-a)*((exposure_value-c)/(d-c))"
_LIMITS = "(SELECT min(fwi_value) AS a, max(fwi_value) AS b, min(exposure_value) AS c, max(exposure_value) AS d FROM mt)"
STEPS = match_steps(MEAN)


@check("M20_risk_simple", build("SELECT point_id, fwi_value*exposure_value AS risk FROM mt", T, STEPS), {"risk": 4})
def _(spark, sf):
    return scored(spark, sf, "simple").select("point_id", "risk")


@check("M20_risk_normalized", build(f"SELECT point_id, {_NORMED} AS risk FROM mt, {_LIMITS}", T, STEPS), ["risk"])
def _(spark, sf):
    return scored(spark, sf, "normalized").select("point_id", "risk")


@check("M20_risk_weighted", build(f"SELECT point_id, 0.7*0.3*{_NORMED} AS risk FROM mt, {_LIMITS}", T, STEPS), ["risk"])
def _(spark, sf):
    return scored(spark, sf, "weighted").select("point_id", "risk")


_PCT = "(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x})-1)/2.0::DOUBLE)/count(*) OVER ()*100"
_CAT = "CASE WHEN risk_percentile>=90 THEN 'Very High' WHEN risk_percentile>=75 THEN 'High' WHEN risk_percentile>=50 THEN 'Moderate' WHEN risk_percentile>=25 THEN 'Low' ELSE 'Very Low' END"


@check("W01_risk_percentile", build(f"SELECT date, latitude, longitude, fwi, {_PCT.format(x='fwi')} AS risk_percentile FROM grid_daily", ["grid_daily"]), ["risk_percentile"])
def _(spark, sf):
    return percent_rank_average(D.grid_daily(spark, sf).select("date", "latitude", "longitude", "fwi"), "fwi")


_RANKED = ("rk", f"SELECT *, {_CAT} AS risk_category FROM (SELECT *, {_PCT.format(x='risk')} AS risk_percentile FROM (SELECT *, fwi_value*exposure_value AS risk FROM mt))")


@check("M21_risk_category", build("SELECT point_id, risk_percentile, risk_category FROM rk", T, [*STEPS, _RANKED]), ["risk_percentile"])
def _(spark, sf):
    ranked = rank_vulnerability(D.grid_daily(spark, sf), D.exposure(spark, sf), box=MAINLAND_BOX)
    return ranked.select("point_id", "risk_percentile", "risk_category")


@check("A31_category_counts", build("SELECT risk_category AS category, count(*) AS n, 100.0*count(*)/sum(count(*)) OVER () AS pct FROM rk GROUP BY 1", T, [*STEPS, _RANKED]), ["pct"])
def _(spark, sf):
    return category_counts(rank_vulnerability(D.grid_daily(spark, sf), D.exposure(spark, sf)), "risk_category")


@check("A29_correlations", build("SELECT corr(fwi_value, exposure_value) AS fwi_exposure, corr(fwi_value, risk) AS fwi_risk, corr(exposure_value, risk) AS exposure_risk FROM rk", T, [*STEPS, _RANKED]),
       ["fwi_exposure", "fwi_risk", "exposure_risk"])
def _(spark, sf):
    return correlations(scored(spark, sf, "simple"), [
        ("fwi_exposure", "fwi_value", "exposure_value"), ("fwi_risk", "fwi_value", "risk"), ("exposure_risk", "exposure_value", "risk")])


_BANDS = {"north": "latitude>41", "central": "latitude>39.5 AND latitude<=41", "south": "latitude<=39.5"}


@check("A30_high_risk_summary", build(
    "SELECT count(*) AS n_points, max(t) AS threshold, avg(fwi_value) AS mean_fwi, avg(exposure_value) AS mean_exposure, min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lon_min, max(longitude) AS lon_max, "
    + ", ".join(f"count(*) FILTER ({w}) AS n_{b}, 100.0*count(*) FILTER ({w})/count(*) AS pct_{b}" for b, w in _BANDS.items())
    + ", avg(latitude) AS centre_lat, avg(longitude) AS centre_lon FROM rk, (SELECT quantile_cont(risk, 0.9) AS t FROM rk) WHERE risk>=t", T, [*STEPS, _RANKED]),
    {"threshold": 4, "mean_fwi": 6, "mean_exposure": 4, "pct_north": 6, "pct_central": 6, "pct_south": 6, "centre_lat": 6, "centre_lon": 6})
def _(spark, sf):
    return R.high_risk_summary(scored(spark, sf, "simple"))


@check("T02_top_risk_points", build("SELECT point_id, latitude, longitude, risk FROM rk ORDER BY risk DESC, latitude, longitude LIMIT 10", T, [*STEPS, _RANKED]), {"risk": 4})
def _(spark, sf):
    return R.top_risk_points(scored(spark, sf, "simple").select("point_id", "latitude", "longitude", "risk"))


@check("P26_map_exposure", build(
    f"SELECT point_id, least(exposure_value, (SELECT quantile_cont(exposure_value,0.99) FROM rk WHERE exposure_value>0)) AS exposure_value_capped FROM rk WHERE exposure_value>0", T, [*STEPS, _RANKED]), {"exposure_value_capped": 4})
def _(spark, sf):
    return R.map_exposure(scored(spark, sf, "simple"), MAINLAND_BOX).select("point_id", "exposure_value_capped")
