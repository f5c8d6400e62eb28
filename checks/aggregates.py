"""Spatial, temporal and descriptive aggregates."""

from checks.base import build, check, tk
from checks.spatial import BOX_STEPS, _xy, boxes_sql, nodes_sql
from emberlattice.functions import round_to
from emberlattice.operators import aggregate as A
from emberlattice.operators import cases
from emberlattice.operators import clean as C
from emberlattice.operators.spatial import nearest_join
from emberlattice.operators.metrics import difference_stats
from emberlattice.schema import COARSE_BANDS, FINE_BANDS, MAP_LEVELS
from emberlattice.session import materialise
from emberlattice.sources import derived as D

G, FP = ["grid_daily"], ["fine_pred"]
M = ["fwi", "temperature_max", "total_precipitation", "dewpoint"]
# ---- Fixed values: fire-area box (south, north, west, east) and a wider one ----
FIRE_BOX = (39.72, 39.86, -9.05, -8.90)
CASE_BOX = (38.0, 41.0, -9.3, -7.5)


@check("A01_aggregate_to_reference", build(
    "SELECT date, latitude, longitude, avg(fwi_predicted) AS fwi_aggregated, stddev_samp(fwi_predicted) AS fwi_std, count(fwi_predicted) AS count_1km_points FROM ("
    + boxes_sql(1250, "<=") + ") GROUP BY 1,2,3", [*G, *FP], BOX_STEPS), ["fwi_aggregated", "fwi_std"])
def _(spark, sf):
    return A.aggregate_to_reference(D.fine_pred(spark, sf), D.grid_daily(spark, sf), "fwi_predicted")


@check("A01_aggregate_no_time", build(
    f"SELECT latitude, longitude, avg(v) AS fwi_aggregated, stddev_samp(v) AS fwi_std, count(v) AS count_1km_points FROM ("
    "SELECT g.latitude, g.longitude, f.v FROM f JOIN g ON abs(f.y-g.y)<=1250 AND abs(f.x-g.x)<=1250) GROUP BY 1,2", [*G, *FP],
    [("f", _xy("(SELECT latitude, longitude, avg(fwi_predicted) AS v FROM fine_pred GROUP BY 1,2)", "v")),
     ("g", _xy("(SELECT DISTINCT latitude, longitude FROM grid_daily)", "latitude, longitude"))]), ["fwi_aggregated", "fwi_std"])
def _(spark, sf):
    mean = A.temporal_mean(D.fine_pred(spark, sf), "fwi_predicted", out="v")
    return A.aggregate_to_reference(mean, D.grid_daily(spark, sf), "v", by=())


@check("A02_daily_cell_mean", build(
    "SELECT date, latitude, longitude, avg(fwi_predicted) AS fwi_aggregated FROM (" + boxes_sql(1125, "<") + ") GROUP BY 1,2,3", [*G, *FP], BOX_STEPS),
    ["fwi_aggregated"])
def _(spark, sf):
    return A.daily_cell_mean(D.fine_pred(spark, sf), D.grid_daily(spark, sf), "fwi_predicted")


_EXTENT = ("spec", f"SELECT date, min({tk('latitude')}) AS lat0, max({tk('latitude')}) AS lat1, min({tk('longitude')}) AS lon0, max({tk('longitude')}) AS lon1 FROM grid_daily GROUP BY date")
_EDGES = ("cells", "SELECT date, lat0-1125+2250*i AS s, lat0-1125+2250*(i+1) AS n, lon0-1125+2250*j AS w, lon0-1125+2250*(j+1) AS e FROM ("
          "SELECT *, unnest(range(0, CAST(ceil((lon1+2250-(lon0-1125))/2250.0) AS BIGINT)-1)) AS j FROM ("
          "SELECT *, unnest(range(0, CAST(ceil((lat1+2250-(lat0-1125))/2250.0) AS BIGINT)-1)) AS i FROM spec))")
_BINS = ("SELECT c.date, (c.s+c.n)/20000.0::DOUBLE AS latitude, (c.w+c.e)/20000.0::DOUBLE AS longitude, avg(fwi_predicted) AS fwi_mean, max(fwi_predicted) AS fwi_max, min(fwi_predicted) AS fwi_min,"
         " stddev_samp(fwi_predicted) AS fwi_std, count(*) AS point_count FROM cells c JOIN f ON f.date=c.date AND f.y>=c.s AND f.y<c.n AND f.x>=c.w AND f.x<c.e GROUP BY 1,2,3")
_BIN_STEPS = [_EXTENT, _EDGES, ("f", _xy("fine_pred", "date, fwi_predicted"))]


@check("A03_aggregate_bins", build(_BINS, [*G, *FP], _BIN_STEPS), ["latitude", "longitude", "fwi_mean", "fwi_max", "fwi_min", "fwi_std"])
def _(spark, sf):
    return A.aggregate_bins(D.fine_pred(spark, sf), D.grid_daily(spark, sf), "fwi_predicted")


@check("A04_downsample", build(
    "SELECT date, i, j, i*0.5::DOUBLE AS latitude, j*0.5::DOUBLE AS longitude, " + ", ".join(f"avg({m}) AS {m}" for m in M) + " FROM n GROUP BY date, i, j", G,
    [("n", nodes_sql("grid_daily", 5000))]), M)
def _(spark, sf):
    return A.downsample(D.grid_daily(spark, sf), M, 0.5)


@check("A05_downsample_with_spread", build(
    "SELECT date, i, j, i*0.75::DOUBLE AS latitude, j*0.75::DOUBLE AS longitude, " + ", ".join(
        f"avg({m}) AS {m}, CASE WHEN count({m})>1 THEN stddev_samp({m}) END AS {m}_std, CASE WHEN count({m})>1 THEN max({m})-min({m}) END AS {m}_range" for m in M)
    + " FROM n GROUP BY date, i, j", G, [("n", nodes_sql("grid_daily", 7500).replace("range(60, 100)", "range(40, 70)").replace("range(-30, -8)", "range(-20, -4)"))]),
    [f"{m}{s}" for m in M for s in ("", "_std", "_range")])
def _(spark, sf):
    return A.downsample_with_spread(D.grid_daily(spark, sf), M, 0.75)


@check("A06_temporal_mean", build("SELECT latitude, longitude, avg(fwi) AS fwi_mean FROM grid_daily GROUP BY 1,2", G), ["fwi_mean"])
def _(spark, sf):
    return A.temporal_mean(D.grid_daily(spark, sf), "fwi")


@check("A06_october_mean", build("SELECT latitude, longitude, avg(fwi) AS fwi_mean FROM grid_daily WHERE month(date)=10 GROUP BY 1,2", G), ["fwi_mean"])
def _(spark, sf):
    return A.temporal_mean(D.grid_daily(spark, sf), "fwi", 10)


def _in(box):
    return f"latitude BETWEEN {box[0]} AND {box[1]} AND longitude BETWEEN {box[2]} AND {box[3]}"


_DAYS = f"SELECT latitude, longitude, count(*) FILTER (fwi>40) AS high_fwi_days, count(*) AS total_days FROM grid_daily WHERE month(date)=10 AND {_in(CASE_BOX)} GROUP BY 1,2"


@check("A07_exceedance_days", build(_DAYS, G))
def _(spark, sf):
    return A.exceedance_days(D.grid_daily(spark, sf), "fwi", CASE_BOX)


@check("A07_exceedance_days_fire_area", build(
    f"SELECT latitude, longitude, count(*) FILTER (fwi_predicted>40) AS high_fwi_days, count(*) AS total_days FROM fine_pred WHERE month(date)=10 AND {_in(FIRE_BOX)} GROUP BY 1,2", FP))
def _(spark, sf):
    return A.exceedance_days(D.fine_pred(spark, sf), "fwi_predicted", FIRE_BOX)


@check("A07_exceedance_summary", build(
    f"SELECT count(*) AS n_points, count(*) FILTER (high_fwi_days>0) AS n_points_with_high, avg(high_fwi_days) AS mean_high_days, max(high_fwi_days) AS max_high_days, CAST(sum(total_days) AS BIGINT) AS n_days FROM ({_DAYS})", G),
    ["mean_high_days"])
def _(spark, sf):
    return A.exceedance_summary(A.exceedance_days(D.grid_daily(spark, sf), "fwi", CASE_BOX))


@check("J11_left_join_zero", build(_DAYS, G))
def _(spark, sf):
    return cases.high_days_with_zero(D.grid_daily(spark, sf), "fwi", CASE_BOX)


@check("case_event_day", build(f"SELECT date, latitude, longitude, fwi FROM grid_daily WHERE strftime(date,'%m-%d')='06-17' AND {_in(CASE_BOX)}", G))
def _(spark, sf):
    return cases.event_day(D.grid_daily(spark, sf), "06-17", CASE_BOX).select("date", "latitude", "longitude", "fwi")


@check("A08_location_stats", build(
    "SELECT latitude, longitude, round(avg(temperature_max),2) AS temp_mean, round(stddev_samp(temperature_max),2) AS temp_std, round(min(temperature_max),2) AS temp_min, round(max(temperature_max),2) AS temp_max, count(temperature_max) AS data_count FROM grid_daily GROUP BY 1,2", G))
def _(spark, sf):
    return A.location_stats(D.grid_daily(spark, sf), "temperature_max")


@check("A09_period_counts", build(
    "SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, count(*) AS n_rows, count(DISTINCT date) AS n_days, avg(dewpoint) AS dewpoint_mean, avg(fwi) AS fwi_mean FROM grid_daily GROUP BY 1,2", G),
    ["dewpoint_mean", "fwi_mean"])
def _(spark, sf):
    return A.period_counts(D.grid_daily(spark, sf), ["dewpoint", "fwi"])


def describe_sql(x: str) -> str:
    return (f"count({x}) AS count, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS min, max({x}) AS max,"
            f" quantile_cont({x},0.25) AS p25, quantile_cont({x},0.5) AS p50, quantile_cont({x},0.75) AS p75")


_DESC = ["mean", "std", "min", "max", "p25", "p50", "p75"]


@check("A10_describe_measure", build(f"SELECT {describe_sql('fwi_predicted')} FROM fine_pred", FP), _DESC)
def _(spark, sf):
    return A.describe_measure(D.fine_pred(spark, sf), "fwi_predicted")


@check("A10_describe_per_date", build(f"SELECT date, {describe_sql('temperature_max')} FROM grid_daily GROUP BY date", G), _DESC)
def _(spark, sf):
    return A.describe_measure(D.grid_daily(spark, sf), "temperature_max", ["date"])


@check("A10_describe_downsampled_node", build(
    f"SELECT i, j, {describe_sql('fwi')} FROM (SELECT date, i, j, avg(fwi) AS fwi FROM n GROUP BY 1,2,3) GROUP BY 1,2", G, [("n", nodes_sql("grid_daily", 5000))]), _DESC)
def flagship(spark, sf):
    """Daily 50 km means of the source grid, described per node."""
    rounded = C.round_coords(C.nan_to_null(D.grid_daily(spark, sf)))
    return A.describe_measure(A.downsample(rounded, ["fwi"], 0.5), "fwi", ["i", "j"])


@check("A11_hottest_common_day", build(
    "SELECT date, avg(fwi) AS fwi_mean, max(fwi) AS fwi_max FROM fwi_daily WHERE date IN (SELECT date FROM temp_daily) GROUP BY date ORDER BY avg(fwi) DESC, date LIMIT 1", ["fwi_daily", "temp_daily"]),
    ["fwi_mean", "fwi_max"])
def _(spark, sf):
    return A.hottest_common_day(D.fwi_daily(spark, sf), D.temp_daily(spark, sf), "fwi")


@check("A11_preferred_common_day", build(
    "SELECT date, avg(fwi) AS fwi_mean, max(fwi) AS fwi_max FROM fwi_daily WHERE date=DATE '2017-06-17' GROUP BY date", ["fwi_daily"]), ["fwi_mean", "fwi_max"])
def _(spark, sf):
    return A.hottest_common_day(D.fwi_daily(spark, sf), D.temp_daily(spark, sf), "fwi", "2017-06-17")


_RADIUS_PAIRS = ("pairs", "SELECT date, latitude, longitude, v, d2 FROM (SELECT *, min(d2) OVER (PARTITION BY date, latitude, longitude) AS m, row_number() OVER (PARTITION BY date, latitude, longitude ORDER BY d2, ry, rx, v) AS k FROM ("
                 "SELECT g.date, g.latitude, g.longitude, f.v, f.y AS ry, f.x AS rx, (f.y-g.y)*(f.y-g.y)+(f.x-g.x)*(f.x-g.x) AS d2 FROM g JOIN f ON f.date=g.date)) WHERE d2<=1500*1500 OR (m>1500*1500 AND k=1)")
_RADIUS_STEPS = [("f", _xy("fine_pred", "date, fwi_predicted AS v")), ("g", _xy("grid_daily", "date, latitude, longitude")), _RADIUS_PAIRS]
_RADIUS = ("SELECT date, latitude, longitude, avg(v) AS fwi_aggregated_mean, median(v) AS fwi_aggregated_median,"
           " CASE WHEN count(*)>1 THEN sum(v/(sqrt(d2)/10000+1e-10))/sum(1/(sqrt(d2)/10000+1e-10)) ELSE avg(v) END AS fwi_aggregated_weighted,"
           " stddev_pop(v) AS fwi_std, min(v) AS fwi_min, max(v) AS fwi_max, count(*) AS count_1km_points FROM pairs GROUP BY 1,2,3")
RADIUS_SQL = (_RADIUS, [*G, *FP], _RADIUS_STEPS)


@check("A15_radius_stats", build(*RADIUS_SQL),
       ["fwi_aggregated_mean", "fwi_aggregated_median", "fwi_aggregated_weighted", "fwi_std", "fwi_min", "fwi_max"])
def _(spark, sf):
    return A.radius_stats(D.grid_daily(spark, sf), D.fine_pred(spark, sf), "fwi_predicted")


def bands_sql(x: str, edges, closed: str, src: str) -> str:
    whens = []
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if closed == "left":
            whens.append(f"WHEN {x}>={a} AND {x}<{b} THEN '{a}-{b}'")
        else:
            whens.append(f"WHEN {x}{'>=' if k == 0 else '>'}{a} AND {x}<={b} THEN '{a}-{b}'")
    labels = [f"{a}-{b}" for a, b in zip(edges[:-1], edges[1:])] + ["out_of_range"]
    rows = ", ".join(f"('{lab}')" for lab in labels)
    return (f"SELECT l.band, count(t.b) AS n, 100.0*count(t.b)/(SELECT count(*) FROM {src}) AS pct FROM (VALUES {rows}) l(band) LEFT JOIN"
            f" (SELECT CASE {' '.join(whens)} ELSE 'out_of_range' END AS b FROM {src}) t ON t.b=l.band GROUP BY 1")


for _name, _edges, _closed in (("A27_risk_bands_fine", FINE_BANDS, "left"), ("A27_risk_bands_coarse", COARSE_BANDS, "right"),
                               ("A27_risk_bands_map", MAP_LEVELS, "left")):
    @check(_name, build(bands_sql("fwi_predicted", _edges, _closed, "fine_pred"), FP), ["pct"])
    def _(spark, sf, edges=_edges, closed=_closed):
        return A.risk_distribution(D.fine_pred(spark, sf), "fwi_predicted", edges, closed)


@check("A27_risk_bands_downsampled", build(bands_sql("fwi", FINE_BANDS, "left", "d"), G, [
    ("n", nodes_sql("grid_daily", 5000)), ("d", "SELECT date, i, j, round_even(avg(fwi)*1e9,0)/1e9 AS fwi FROM n GROUP BY 1,2,3")]), ["pct"])
def _(spark, sf):
    # Means on a band edge may differ in the last bit, so they are rounded to 9 decimals first.
    nodes = A.downsample(D.grid_daily(spark, sf), ["fwi"], 0.5).withColumn("fwi", round_to("fwi", 9))
    return A.risk_distribution(nodes, "fwi", FINE_BANDS)


_AGG = ("m", "SELECT b.date, b.latitude, b.longitude, b.p, g.fwi FROM (SELECT date, latitude, longitude, avg(fwi_predicted) AS p FROM (" + boxes_sql(1250, "<=")
        + ") GROUP BY 1,2,3) b JOIN grid_daily g USING (date, latitude, longitude)")


def merged(spark, sf):
    from emberlattice.operators.joins import validate_merge
    g = D.grid_daily(spark, sf).select("date", "latitude", "longitude", "fwi")
    return validate_merge(A.aggregate_to_reference(D.fine_pred(spark, sf), g, "fwi_predicted"), g, ("fwi_aggregated", "fwi"))


MERGED_STEPS = [*BOX_STEPS, _AGG]


@check("A28_daily_series", build("SELECT date, avg(fwi) AS observed_mean, avg(p) AS predicted_mean, count(*) AS n FROM m GROUP BY 1", [*G, *FP], MERGED_STEPS),
       ["observed_mean", "predicted_mean"])
def _(spark, sf):
    return A.daily_series(merged(spark, sf), "fwi", "fwi_aggregated")


@check("A28_spatial_mean", build("SELECT latitude, longitude, avg(fwi) AS observed_mean, avg(p) AS predicted_mean, count(*) AS n FROM m GROUP BY 1,2", [*G, *FP], MERGED_STEPS),
       ["observed_mean", "predicted_mean"])
def _(spark, sf):
    return A.daily_series(merged(spark, sf), "fwi", "fwi_aggregated", ["latitude", "longitude"])


@check("P39_residuals", build("SELECT date, latitude, longitude, p-fwi AS residual FROM m", [*G, *FP], MERGED_STEPS), ["residual"])
def _(spark, sf):
    return C.residuals(merged(spark, sf), "fwi_aggregated", "fwi").select("date", "latitude", "longitude", "residual")


@check("A34_coverage", build(
    "SELECT count(*) AS n_rows, count(DISTINCT (latitude, longitude)) AS n_points, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date,"
    " min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lon_min, max(longitude) AS lon_max FROM fine_pred", FP))
def _(spark, sf):
    return A.coverage(D.fine_pred(spark, sf))


@check("A34_points_per_cell", build(
    "SELECT avg(n) AS mean_points, min(n) AS min_points, max(n) AS max_points FROM (SELECT count(*) AS n FROM (" + boxes_sql(1250, "<=") + ") GROUP BY date, latitude, longitude)", [*G, *FP], BOX_STEPS), ["mean_points"])
def _(spark, sf):
    return A.points_per_cell(A.aggregate_to_reference(D.fine_pred(spark, sf), D.grid_daily(spark, sf), "fwi_predicted"), "count_1km_points")


@check("A35_difference_stats", build(
    "SELECT count(*) AS n_matched, avg(fwi-v) AS mean_difference, avg(abs(fwi-v)) AS mae, sqrt(avg((fwi-v)*(fwi-v))) AS rmse, corr(fwi, v) AS correlation FROM ("
    "SELECT g.fwi, b.v, row_number() OVER (PARTITION BY g.date, g.y, g.x ORDER BY (g.y-b.y)*(g.y-b.y)+(g.x-b.x)*(g.x-b.x), b.y, b.x) AS k, (g.y-b.y)*(g.y-b.y)+(g.x-b.x)*(g.x-b.x) AS d2"
    " FROM gg g JOIN bb b ON g.date=b.date) WHERE k=1 AND d2<5000*5000", [*G, *FP],
    [*_BIN_STEPS, ("bins", _BINS), ("bb", _xy("bins", "date, fwi_mean AS v")), ("gg", _xy("grid_daily", "date, fwi"))]),
    ["mean_difference", "mae", "rmse", "correlation"])
def _(spark, sf):
    g = D.grid_daily(spark, sf).select("date", "latitude", "longitude", "fwi")
    bins = A.aggregate_bins(D.fine_pred(spark, sf), g, "fwi_predicted")
    return difference_stats(nearest_join(g, bins, ["fwi_mean"], max_distance=0.5, inclusive=False), "fwi", "fwi_mean")


@check("A36_cell_uncertainty", build(
    "SELECT avg(fwi_std) AS mean_std, max(fwi_std) AS max_std, avg(point_count) AS mean_points, quantile_cont(fwi_std,0.95) AS p95_std FROM bins", [*G, *FP],
    [*_BIN_STEPS, ("bins", _BINS)]), ["mean_std", "max_std", "mean_points", "p95_std"])
def _(spark, sf):
    return A.cell_uncertainty(materialise(A.aggregate_bins(D.fine_pred(spark, sf), D.grid_daily(spark, sf), "fwi_predicted")))


@check("A43_enhancement_ratio", build(
    "SELECT f.n AS n_predicted, g.n AS n_source, f.n/g.n AS ratio FROM (SELECT count(*) AS n FROM fine_pred) f, (SELECT count(*) AS n FROM grid_daily) g", [*G, *FP]), ["ratio"])
def _(spark, sf):
    return A.enhancement_ratio(D.fine_pred(spark, sf), D.grid_daily(spark, sf))
