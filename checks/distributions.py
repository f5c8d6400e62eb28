"""Ranks, quantiles, histograms and the comparison of coarse and fine distributions."""

from pyspark.sql import functions as F

from checks.base import build, check
from checks.spatial import _xy
from emberlattice.operators import distribution as X
from emberlattice.operators import order_stats as O
from emberlattice.operators.spatial import nearest_join
from emberlattice.sources import derived as D

G, FP, B = ["grid_daily"], ["fine_pred"], ["grid_daily", "fine_pred"]
SIDES = ("st", "SELECT 'coarse' AS source, fwi AS x FROM grid_daily UNION ALL SELECT 'fine', fwi_predicted FROM fine_pred")


def sides(spark, sf):
    return X.stack_sides(D.grid_daily(spark, sf), D.fine_pred(spark, sf), "fwi", "fwi_predicted")


def side_rows(stats: dict[str, str], src: str = "st", key: str = "statistic") -> str:
    """(key, coarse, fine, difference) with each statistic computed per side."""
    return " UNION ALL ".join(
        f"SELECT '{k}' AS {key}, c.v AS coarse, f.v AS fine, f.v-c.v AS difference FROM (SELECT CAST({e} AS DOUBLE) AS v FROM {src} WHERE source='coarse') c,"
        f" (SELECT CAST({e} AS DOUBLE) AS v FROM {src} WHERE source='fine') f" for k, e in stats.items())


_SKEW = "(avg(x*x*x)-3*avg(x)*avg(x*x)+2*pow(avg(x),3))/pow(var_pop(x),1.5)"
_CFD = ["coarse", "fine", "difference"]


@check("A18_distribution_stats", build(side_rows({
    "mean": "avg(x)", "std": "stddev_samp(x)", "median": "median(x)", "skewness": _SKEW, "kurtosis": "kurtosis_pop(x)", "min": "min(x)", "max": "max(x)"}), B, [SIDES]), _CFD)
def _(spark, sf):
    return X.distribution_stats(sides(spark, sf))


@check("A19_exceedance_share", build(
    " UNION ALL ".join(f"SELECT source, {t}.0::DOUBLE AS threshold, count(*) FILTER (x>{t}) AS n_above, 100.0*count(*) FILTER (x>{t})/count(*) AS pct_above FROM st GROUP BY source" for t in (24, 50)), B, [SIDES]), ["pct_above"])
def _(spark, sf):
    return X.exceedance_share(sides(spark, sf), "x", [24, 50], ["source"])


_TAIL = ("tail", "SELECT * FROM st WHERE x>=(SELECT quantile_cont(x,0.95) FROM st WHERE source='fine')")


@check("A20_tail_stats", build(
    "SELECT *, (SELECT quantile_cont(x,0.95) FROM st WHERE source='fine') AS threshold, CASE WHEN statistic IN ('mean','max') THEN (coarse-fine)*100/fine END AS relative_bias_pct FROM ("
    + side_rows({"count": "count(*)", "mean": "avg(x)", "std": "stddev_samp(x)", "min": "min(x)", "max": "max(x)", "median": "median(x)"}, "tail") + ")", B, [SIDES, _TAIL]),
    [*_CFD, "threshold", "relative_bias_pct"])
def _(spark, sf):
    return X.tail_stats(sides(spark, sf))


@check("A21_percentile_profile", build(
    " UNION ALL ".join(f"SELECT {p}::DOUBLE AS percentile, c AS coarse, f AS fine, f-c AS difference FROM (SELECT quantile_cont(x,{p / 100}) FILTER (source='coarse') AS c, quantile_cont(x,{p / 100}) FILTER (source='fine') AS f FROM st)"
                       for p in (90, 95, 99, 99.5, 99.9)), B, [SIDES]), _CFD)
def _(spark, sf):
    return X.percentile_profile(sides(spark, sf))


_CUTS = [30.0 + 50.0 * k / 19 for k in range(20)]


@check("A22_exceedance_curve", build(
    " UNION ALL ".join(f"SELECT {t!r}::DOUBLE AS threshold, count(*) FILTER (source='coarse' AND x>{t!r}::DOUBLE) AS coarse, count(*) FILTER (source='fine' AND x>{t!r}::DOUBLE) AS fine FROM st" for t in _CUTS), B, [SIDES]), ["threshold"])
def _(spark, sf):
    return X.exceedance_curve(sides(spark, sf))


_HIST = ("SELECT source, bin, n, n/(sum(n) OVER (PARTITION BY source)*w) AS density FROM (SELECT source, CAST(least(floor((x-0)/(hi/49)),48) AS INTEGER) AS bin, count(*) AS n, max(hi/49) AS w FROM st,"
         " (SELECT least(max(x) FILTER (source='coarse'), max(x) FILTER (source='fine')) AS hi FROM st) WHERE x>=0 AND x<=hi GROUP BY 1,2)")


@check("A23_histogram", build(_HIST, B, [SIDES]), ["density"])
def _(spark, sf):
    st = sides(spark, sf)
    peak = st.agg(F.least(F.max(F.when(F.col("source") == "coarse", F.col("x"))), F.max(F.when(F.col("source") == "fine", F.col("x")))).alias("m")).scalar()
    return X.histogram(st, "x", 49, 0.0, peak, ["source"])


@check("A24_box_stats", build(
    "SELECT s.source, q1, median, q3, min(x) FILTER (x>=q1-1.5*(q3-q1) AND x<=q3+1.5*(q3-q1)) AS whisker_low, max(x) FILTER (x>=q1-1.5*(q3-q1) AND x<=q3+1.5*(q3-q1)) AS whisker_high,"
    " count(*) FILTER (x<q1-1.5*(q3-q1) OR x>q3+1.5*(q3-q1)) AS n_outliers FROM st s JOIN (SELECT source, quantile_cont(x,0.25) AS q1, median(x) AS median, quantile_cont(x,0.75) AS q3 FROM st GROUP BY 1) q USING (source) GROUP BY 1,2,3,4",
    B, [SIDES]), ["q1", "median", "q3", "whisker_low", "whisker_high"])
def _(spark, sf):
    return X.box_stats(sides(spark, sf), "x", ["source"])


_QP = ("SELECT CAST(k AS INTEGER) AS k, k/999.0::DOUBLE AS q, max(v) FILTER (source='coarse') AS coarse, max(v) FILTER (source='fine') AS fine FROM ("
       "SELECT source, unnest(range(0,1000)) AS k, unnest(quantile_cont(x, [" + ",".join(f"{k / 999}" for k in range(1000)) + "])) AS v FROM st GROUP BY source) GROUP BY 1,2")


@check("A25_quantile_pairs", build(f"SELECT CAST(k AS BIGINT) AS k, q, coarse, fine FROM ({_QP})", B, [SIDES]), ["q", "coarse", "fine"])
def _(spark, sf):
    return X.quantile_pairs(sides(spark, sf))


@check("A25_quantile_correlation_tail", build(
    f"SELECT corr(coarse, fine) AS correlation, count(*) AS n FROM ({_QP.replace('FROM st GROUP', 'FROM tail GROUP')})", B, [SIDES, _TAIL]), ["correlation"])
def _(spark, sf):
    st = sides(spark, sf)
    cut = O.quantiles(st.where("source = 'fine'"), "x", [0.95], ["t"]).scalar()
    return X.quantile_correlation(X.quantile_pairs(st.where(F.col("x") >= cut)))


def _poly(cs, x):
    out = repr(cs[-1])
    for c in reversed(cs[:-1]):
        out = f"({out}*{x}+{c!r}::DOUBLE)"
    return out


def _ratio(name, x):
    top, bottom = X.AS241[name]
    return f"({_poly(top, x)}/{_poly(bottom, x)})"


_PROBIT = (f"CASE WHEN abs(p-0.5)<=0.425 THEN (p-0.5)*{_ratio('centre', '(0.180625-(p-0.5)*(p-0.5))')} ELSE sign(p-0.5)*CASE WHEN r<=5 THEN {_ratio('middle', '(r-1.6)')} ELSE {_ratio('tail', '(r-5)')} END END")
_PROB = ("SELECT k, {e} AS theoretical, ordered FROM (SELECT *, sqrt(-ln(least(p,1-p))) AS r FROM (SELECT k, x AS ordered, CAST(CASE WHEN k=n THEN pow(0.5,1.0/n) WHEN k=1 THEN 1-pow(0.5,1.0/n) ELSE (k-0.3175)/(n+0.365) END AS DOUBLE) AS p"
         " FROM (SELECT fwi AS x, row_number() OVER (ORDER BY fwi) AS k, count(*) OVER () AS n FROM grid_daily)))").format(e=_PROBIT)


@check("A26_normal_quantile_points", build(_PROB, G), ["theoretical", "ordered"])
def _(spark, sf):
    return X.normal_quantile_points(D.grid_daily(spark, sf), "fwi")


_MATCH = ("mt", "SELECT fwi, v FROM (SELECT g.fwi, f.v, row_number() OVER (PARTITION BY g.date, g.y, g.x ORDER BY (g.y-f.y)*(g.y-f.y)+(g.x-f.x)*(g.x-f.x), f.y, f.x, f.v) AS k FROM g JOIN f ON g.date=f.date AND (g.y-f.y)*(g.y-f.y)+(g.x-f.x)*(g.x-f.x)<1000*1000) WHERE k=1")
_MATCH_STEPS = [SIDES, ("g", _xy("grid_daily", "date, fwi")), ("f", _xy("fine_pred", "date, fwi_predicted AS v")), _MATCH]


@check("A45_extreme_match_bias", build(
    "SELECT count(*) AS n_points, corr(v,fwi) AS correlation, 1-sum((fwi-v)*(fwi-v))/(var_pop(v)*count(*)) AS r_squared, sqrt(avg((fwi-v)*(fwi-v))) AS rmse, avg(abs(fwi-v)) AS mae, avg(fwi-v) AS bias, avg(v) AS truth_mean, avg(fwi) AS pred_mean"
    " FROM mt, (SELECT quantile_cont(x,0.95) AS t FROM st WHERE source='fine') WHERE fwi>=t OR v>=t", B, _MATCH_STEPS),
    ["correlation", "r_squared", "rmse", "mae", "bias", "truth_mean", "pred_mean"])
def _(spark, sf):
    g = D.grid_daily(spark, sf).select("date", "latitude", "longitude", "fwi")
    near = nearest_join(g, D.fine_pred(spark, sf), ["fwi_predicted"], max_distance=0.1, inclusive=False)
    cut = O.quantiles(D.fine_pred(spark, sf), "fwi_predicted", [0.95], ["t"]).scalar()
    return X.extreme_match_bias(near, "fwi", "fwi_predicted", cut)


@check("W02_ecdf", build(
    "SELECT fwi AS value, row_number() OVER (ORDER BY fwi) AS k, row_number() OVER (ORDER BY fwi)/count(*) OVER () AS cumulative FROM grid_daily", G), ["cumulative", "value"])
def _(spark, sf):
    return O.ecdf(D.grid_daily(spark, sf), "fwi")


@check("W02_ecdf_by_source", build(
    "SELECT source, x AS value, row_number() OVER (PARTITION BY source ORDER BY x) AS k, row_number() OVER (PARTITION BY source ORDER BY x)/count(*) OVER (PARTITION BY source) AS cumulative FROM st", B, [SIDES]), ["cumulative", "value"])
def _(spark, sf):
    return O.ecdf(sides(spark, sf), "x", ["source"])


@check("W03_min_max_scale", build(
    "SELECT date, latitude, longitude, (fwi-a)/(b-a) AS fwi_normalized, (dewpoint-c)/(d-c) AS dewpoint_normalized FROM grid_daily, (SELECT min(fwi) AS a, max(fwi) AS b, min(dewpoint) AS c, max(dewpoint) AS d FROM grid_daily)", G),
    ["fwi_normalized", "dewpoint_normalized"])
def _(spark, sf):
    return O.min_max_scale(D.grid_daily(spark, sf), ["fwi", "dewpoint"]).select("date", "latitude", "longitude", "fwi_normalized", "dewpoint_normalized")
