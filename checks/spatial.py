"""Lattices and spatial joins; the SQL compares every pair, the queries use integer cells."""

from pyspark.sql import functions as F

from checks.base import build, check, tk
from emberlattice.functions import degrees, ticks
from emberlattice.operators import lattice as L
from emberlattice.operators import spatial as S
from emberlattice.sources import derived as D

G, FP = ["grid_daily"], ["fine_pred"]
KEYS = ["date", "latitude", "longitude"]

# Lattice nodes next to each point, by scanning a fixed range of node numbers.
_NODES = """SELECT p.*, i.i, j.j FROM {src} p
 JOIN (SELECT unnest(range(60, 100)) AS i) i ON abs(""" + tk("p.latitude") + """ - i.i*{s}) * 2 <= {s}
 JOIN (SELECT unnest(range(-30, -8)) AS j) j ON abs(""" + tk("p.longitude") + """ - j.j*{s}) * 2 <= {s}"""


def nodes_sql(src: str, step: int) -> str:
    return _NODES.format(src=src, s=step)


@check("L01_coarse_lattice", build(
    "SELECT DISTINCT date, i, j, i*0.5::DOUBLE AS latitude, j*0.5::DOUBLE AS longitude FROM n", G, [("n", nodes_sql("grid_daily", 5000))]))
def _(spark, sf):
    return L.coarse_lattice(D.grid_daily(spark, sf), 0.5)


_SPEC = f"""SELECT date, min({tk('latitude')}) AS lat0, max({tk('latitude')}) AS lat1, min({tk('longitude')}) AS lon0, max({tk('longitude')}) AS lon1 FROM grid_daily GROUP BY date"""


@check("L02_fine_lattice_size", build(
    "SELECT date, count(*) AS n, CAST(sum(lat0+i*90) AS BIGINT) AS lat_sum, CAST(sum(lon0+j*120) AS BIGINT) AS lon_sum FROM ("
    "SELECT date, lat0, lon0, i, unnest(range(0, CAST(ceil((lon1-lon0)/120.0) AS BIGINT)+1)) AS j FROM ("
    "SELECT *, unnest(range(0, CAST(ceil((lat1-lat0)/90.0) AS BIGINT)+1)) AS i FROM spec)) GROUP BY date", G, [("spec", _SPEC)]))
def _(spark, sf):
    nodes = L.fine_lattice(D.grid_daily(spark, sf))
    return nodes.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(ticks("latitude")).alias("lat_sum"), F.sum(ticks("longitude")).alias("lon_sum"))


@check("L02_fine_lattice_capped", build(
    "SELECT date, i, j, (lat0+i*1800)/10000.0::DOUBLE AS latitude, (lon0+j*2400)/10000.0::DOUBLE AS longitude FROM ("
    "SELECT date, lat0, lon0, i, unnest(range(0, CAST(ceil((lon1-lon0)/2400.0) AS BIGINT)+1)) AS j FROM ("
    "SELECT *, unnest(range(0, CAST(ceil((lat1-lat0)/1800.0) AS BIGINT)+1)) AS i FROM spec))", G, [("spec", _SPEC)]),
    ["latitude", "longitude"])
def _(spark, sf):
    return L.fine_lattice(D.grid_daily(spark, sf), 0.09, 0.12, cap=1000)


@check("L03_global_lattice", build(
    "SELECT i, j, (lat0+i*90)/10000.0::DOUBLE AS latitude, (lon0+j*90)/10000.0::DOUBLE AS longitude FROM ("
    "SELECT lat0, lon0, i, unnest(range(0, CAST(ceil((lon1-lon0)/90.0) AS BIGINT)+1)) AS j FROM ("
    "SELECT *, unnest(range(0, CAST(ceil((lat1-lat0)/90.0) AS BIGINT)+1)) AS i FROM ("
    "SELECT min(lat0) AS lat0, max(lat1) AS lat1, min(lon0) AS lon0, max(lon1) AS lon1 FROM spec)))", G, [("spec", _SPEC)]),
    ["latitude", "longitude"])
def _(spark, sf):
    return L.global_lattice(D.grid_daily(spark, sf))


@check("L03_global_lattice_dates", build(
    "SELECT date, i, j, (lat0+i*1000)/10000.0::DOUBLE AS latitude, (lon0+j*1000)/10000.0::DOUBLE AS longitude FROM (SELECT DISTINCT date FROM grid_daily) d, ("
    "SELECT lat0, lon0, i, unnest(range(0, CAST(ceil((lon1-lon0)/1000.0) AS BIGINT)+1)) AS j FROM ("
    "SELECT *, unnest(range(0, CAST(ceil((lat1-lat0)/1000.0) AS BIGINT)+1)) AS i FROM ("
    "SELECT min(lat0) AS lat0, max(lat1) AS lat1, min(lon0) AS lon0, max(lon1) AS lon1 FROM spec)))", G, [("spec", _SPEC)]),
    ["latitude", "longitude"])
def _(spark, sf):
    g = D.grid_daily(spark, sf)
    return L.global_lattice(g, 0.1, g.select("date"))


@check("L04_edge_bins", build(
    f"SELECT date, i, j, count(*) AS n FROM (SELECT f.date, CAST(floor((2*{tk('f.latitude')} - (2*lat0-2250))/4500.0) AS BIGINT) AS i, CAST(floor((2*{tk('f.longitude')} - (2*lon0-2250))/4500.0) AS BIGINT) AS j,"
    " CAST(ceil((2*lat1+4500-(2*lat0-2250))/4500.0) AS BIGINT) AS ni, CAST(ceil((2*lon1+4500-(2*lon0-2250))/4500.0) AS BIGINT) AS nj"
    " FROM fine_pred f JOIN spec USING (date)) WHERE i BETWEEN 0 AND ni-2 AND j BETWEEN 0 AND nj-2 GROUP BY 1,2,3", [*G, *FP], [("spec", _SPEC)]))
def _(spark, sf):
    return L.edge_bins(D.fine_pred(spark, sf), D.grid_daily(spark, sf), 0.225).groupBy("date", "i", "j").agg(
        F.count(F.lit(1)).alias("n"))


@check("L05_grid_resolution_summary", build(
    "SELECT date, step_deg, step_deg*110.574 AS km_lat, step_deg*111.32*cos(radians((south+north)/2)) AS km_lon,"
    " CAST(floor(round((north-south)/step_deg,9))*floor(round((east-west)/step_deg,9)) AS BIGINT) AS n_cells,"
    " (floor(round((north-south)/step_deg,9))*floor(round((east-west)/step_deg,9)))/(floor(round((north-south)/0.5,9))*floor(round((east-west)/0.5,9))) AS ratio_to_coarsest"
    " FROM (SELECT date, min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east FROM grid_daily GROUP BY date), (SELECT unnest([0.5::DOUBLE, 0.25, 0.01]) AS step_deg)", G),
    ["km_lat", "km_lon", "ratio_to_coarsest"])
def _(spark, sf):
    box = D.grid_daily(spark, sf).groupBy("date").agg(
        F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east"))
    return L.grid_resolution_summary(box, [0.5, 0.25, 0.01], ["date"])


@check("J07_window_overlap", build("SELECT date, i, j, count(*) AS n, sum(fwi_predicted) AS s FROM n GROUP BY 1,2,3", FP, [("n", nodes_sql("fine_pred", 5000))]), ["s"])
def _(spark, sf):
    return L.window_overlap(D.fine_pred(spark, sf), 0.5).groupBy("date", "i", "j").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fwi_predicted").alias("s"))


@check("J07_window_half_open", build(
    f"SELECT date, CAST(floor((2*{tk('latitude')}+7500)/15000.0) AS BIGINT) AS i, CAST(floor((2*{tk('longitude')}+7500)/15000.0) AS BIGINT) AS j, count(*) AS n FROM fine_pred GROUP BY 1,2,3", FP))
def _(spark, sf):
    return L.window_overlap(D.fine_pred(spark, sf), 0.75, closed="left").groupBy("date", "i", "j").agg(F.count(F.lit(1)).alias("n"))


def _xy(src: str, cols: str, extra: str = "") -> str:
    return f"SELECT {cols}, {tk('latitude')} AS y, {tk('longitude')} AS x FROM {src} {extra}"


def nearest_sql(on: str, limit: str, left_cols: str, payload: str, partition: str) -> str:
    """Brute force: all pairs, first by distance, latitude, longitude, payload."""
    return (f"SELECT {left_cols}, sqrt(d2)/10000 AS distance, ry/10000.0::DOUBLE AS near_latitude, rx/10000.0::DOUBLE AS near_longitude, {payload} FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY d2, ry, rx, {payload}) AS k FROM ("
            f"SELECT l.*, r.y AS ry, r.x AS rx, r.{payload}, (l.y-r.y)*(l.y-r.y)+(l.x-r.x)*(l.x-r.x) AS d2 FROM l JOIN r ON {on}) {limit}) WHERE k=1")


_L = ("l", _xy("grid_daily", "date, latitude, longitude, fwi"))
_R = ("r", _xy("fine_pred", "date, fwi_predicted"))
_NEAR_OUT = ["distance", "near_latitude", "near_longitude", "fwi_predicted"]
_GK = "date, latitude, longitude, fwi"


@check("J06_nearest_join", build(nearest_sql("l.date=r.date", "WHERE d2<=1000*1000", _GK, "fwi_predicted", "date,latitude,longitude"),
                                 [*G, *FP], [_L, _R]), _NEAR_OUT)
def _(spark, sf):
    g = D.grid_daily(spark, sf).select(*KEYS, "fwi")
    return S.nearest_join(g, D.fine_pred(spark, sf), ["fwi_predicted"], max_distance=0.1)


@check("J06_nearest_join_strict", build(nearest_sql("l.date=r.date", "WHERE d2<500*500", _GK, "fwi_predicted", "date,latitude,longitude"),
                                        [*G, *FP], [_L, _R]), _NEAR_OUT)
def _(spark, sf):
    g = D.grid_daily(spark, sf).select(*KEYS, "fwi")
    return S.nearest_join(g, D.fine_pred(spark, sf), ["fwi_predicted"], max_distance=0.05, inclusive=False)


@check("J06_nearest_unbounded", build(nearest_sql("l.date=r.date", "", _GK, "hot", "date,latitude,longitude"), G,
    [_L, ("r", _xy("grid_daily", "date, fwi AS hot", "WHERE fwi = (SELECT max(o.fwi) FROM grid_daily o WHERE o.date = grid_daily.date)"))]), ["distance", "near_latitude", "near_longitude"])
def _(spark, sf):
    g = D.grid_daily(spark, sf).select(*KEYS, "fwi")
    hottest = g.groupBy("date").agg(F.max("fwi").alias("top"))
    hot = g.join(hottest, "date").where("fwi = top").drop("top").withColumnRenamed("fwi", "hot")
    return S.nearest_join(g, hot, ["hot"], expand="right")


@check("J06_nearest_fine_to_grid", build(
    "SELECT date, count(*) AS n, sum(distance) AS distance, sum(fwi) AS fwi FROM (" + nearest_sql("l.date=r.date", "", "date, latitude, longitude", "fwi", "date,latitude,longitude") + ") GROUP BY date", [*G, *FP],
    [("l", _xy("fine_pred", "DISTINCT date, latitude, longitude")), ("r", _xy("grid_daily", "date, fwi"))]), ["distance", "fwi"])
def _(spark, sf):
    f = D.fine_pred(spark, sf).select(*KEYS).distinct()
    near = S.nearest_join(f, D.grid_daily(spark, sf), ["fwi"], expand="right", first_radius=0.25)
    return near.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("distance"), F.sum("fwi").alias("fwi"))


@check("J05_nearest_within", build(nearest_sql("l.date=r.date", "WHERE d2<=500*500", _GK, "fwi_predicted", "date,latitude,longitude"),
                                   [*G, *FP], [_L, _R]), _NEAR_OUT)
def _(spark, sf):
    g = D.grid_daily(spark, sf).select(*KEYS, "fwi")
    return S.nearest_within(g, D.fine_pred(spark, sf), ["fwi_predicted"], 0.05)


@check("J13_rounded_join", build(
    "SELECT g.date, g.latitude, g.longitude, g.fwi, f.v FROM grid_daily g JOIN m f ON g.date=f.date AND g.latitude=f.latitude AND g.longitude=f.longitude",
    [*G, *FP], [("m", "SELECT date, latitude, longitude, avg(fwi_predicted) AS v FROM fine_pred GROUP BY 1,2,3")]), ["v"])
def _(spark, sf):
    g = D.grid_daily(spark, sf).select(*KEYS, "fwi")
    return S.rounded_join_or_nearest(g, D.fine_pred(spark, sf).groupBy(*KEYS).agg(F.avg("fwi_predicted").alias("v")), ["v"])


@check("J13_nearest_fallback", build(
    nearest_sql("l.date=r.date", "WHERE d2<500*500", _GK, "v", "date,latitude,longitude").replace(
        "SELECT " + _GK + ", sqrt(d2)/10000 AS distance, ry/10000.0::DOUBLE AS near_latitude, rx/10000.0::DOUBLE AS near_longitude, v", "SELECT " + _GK + ", v"),
    [*G, *FP], [_L, ("r", f"SELECT date, v, {tk('latitude+0.004')} AS y, {tk('longitude')} AS x FROM (SELECT date, latitude, longitude, avg(fwi_predicted) AS v FROM fine_pred GROUP BY 1,2,3)")]), ["v"])
def _(spark, sf):
    # Shifted by 0.004 degrees, so no rounded key can match and the nearest point is used.
    g = D.grid_daily(spark, sf).select(*KEYS, "fwi")
    m = D.fine_pred(spark, sf).groupBy(*KEYS).agg(F.avg("fwi_predicted").alias("v"))
    return S.rounded_join_or_nearest(g, m.withColumn("latitude", F.col("latitude") + 0.004), ["v"])


def boxes_sql(half: int, upper: str) -> str:
    return (f"SELECT f.date, g.latitude, g.longitude, f.fwi_predicted FROM f JOIN g ON f.date=g.date AND f.y-g.y>=-{half} AND f.x-g.x>=-{half}"
            f" AND f.y-g.y{upper}{half} AND f.x-g.x{upper}{half}")


BOX_STEPS = [("f", _xy("fine_pred", "date, fwi_predicted")), ("g", _xy("grid_daily", "date, latitude, longitude"))]


@check("J08_cells_around_closed", build(
    "SELECT date, latitude AS ref_latitude, longitude AS ref_longitude, count(*) AS n FROM (" + boxes_sql(1250, "<=") + ") GROUP BY 1,2,3", [*G, *FP], BOX_STEPS))
def _(spark, sf):
    return S.points_in_boxes(D.fine_pred(spark, sf), D.grid_daily(spark, sf), 0.125).groupBy(
        "date", "ref_latitude", "ref_longitude").agg(F.count(F.lit(1)).alias("n"))


@check("J09_cells_around_half_open", build(
    "SELECT date, latitude AS ref_latitude, longitude AS ref_longitude, count(*) AS n FROM (" + boxes_sql(1125, "<") + ") GROUP BY 1,2,3", [*G, *FP], BOX_STEPS))
def _(spark, sf):
    return S.points_in_boxes(D.fine_pred(spark, sf), D.grid_daily(spark, sf), 0.1125, "left").groupBy(
        "date", "ref_latitude", "ref_longitude").agg(F.count(F.lit(1)).alias("n"))


@check("J10_radius_join", build(
    "SELECT date, ly/10000.0::DOUBLE AS latitude, lx/10000.0::DOUBLE AS longitude, count(*) AS n, sum(fwi) AS s, bool_or(fallback) AS fallback FROM ("
    "SELECT *, d2>3000*3000 AS fallback FROM (SELECT *, min(d2) OVER (PARTITION BY date, ly, lx) AS m, row_number() OVER (PARTITION BY date, ly, lx ORDER BY d2, ry, rx) AS k FROM ("
    "SELECT l.date, l.y AS ly, l.x AS lx, r.y AS ry, r.x AS rx, r.fwi, (l.y-r.y)*(l.y-r.y)+(l.x-r.x)*(l.x-r.x) AS d2 FROM l JOIN r ON l.date=r.date))"
    " WHERE d2<=3000*3000 OR (m>3000*3000 AND k=1)) GROUP BY 1,2,3", G,
    [("l", _xy("grid_daily", "date")), ("r", _xy("grid_daily", "date, fwi", "WHERE fwi > 0.000001 + (SELECT avg(o.fwi) FROM grid_daily o WHERE o.date = grid_daily.date)"))]), ["s"])
def _(spark, sf):
    g = D.grid_daily(spark, sf)
    mean = g.groupBy("date").agg(F.avg("fwi").alias("mean"))
    sites = g.join(mean, "date").where("fwi > mean + 0.000001").select(*KEYS, "fwi")
    pairs = S.radius_join(g, sites, ["fwi"], 0.3)
    return pairs.groupBy("date", degrees("ly").alias("latitude"), degrees("lx").alias("longitude")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("fwi").alias("s"), F.bool_or("fallback").alias("fallback"))


_CORNER = "LEFT JOIN r AS {a} ON {a}.date=t.date AND {a}.y=t.sy+{dy} AND {a}.x=t.sx+{dx}"


@check("J15_lattice_interpolate", build(
    "SELECT t.date, t.latitude, t.longitude, coalesce(CASE WHEN t.u=0 AND t.w=0 THEN a.fwi WHEN t.u=0 THEN a.fwi+(b.fwi-a.fwi)*t.w WHEN t.w=0 THEN a.fwi+(c.fwi-a.fwi)*t.u"
    " WHEN t.u=t.w THEN a.fwi+(d.fwi-a.fwi)*t.u WHEN t.u>t.w THEN a.fwi+(c.fwi-a.fwi)*t.u+(d.fwi-c.fwi)*t.w ELSE a.fwi+(b.fwi-a.fwi)*t.w+(d.fwi-b.fwi)*t.u END, n.fwi) AS interpolated FROM t "
    + " ".join(_CORNER.format(a=a, dy=dy, dx=dx) for a, dy, dx in (("a", 0, 0), ("b", 0, 2500), ("c", 2500, 0), ("d", 2500, 2500)))
    + " JOIN n ON n.date=t.date AND n.y=t.y AND n.x=t.x", [*G, *FP],
    [("r", _xy("grid_daily", "date, fwi")),
     ("t", f"SELECT *, y-((y-367500)%2500+2500)%2500 AS sy, x-((x+95000)%2500+2500)%2500 AS sx, ((y-367500)%2500+2500)%2500/2500.0::DOUBLE AS u, ((x+95000)%2500+2500)%2500/2500.0::DOUBLE AS w FROM ({_xy('fine_pred', 'DISTINCT date, latitude, longitude')})"),
     ("n", "SELECT date, y, x, fwi FROM (SELECT t.date, t.y, t.x, r.fwi, row_number() OVER (PARTITION BY t.date, t.y, t.x ORDER BY (t.y-r.y)*(t.y-r.y)+(t.x-r.x)*(t.x-r.x), r.y, r.x) AS k FROM t JOIN r ON t.date=r.date) WHERE k=1")]),
    ["interpolated"])
def _(spark, sf):
    f = D.fine_pred(spark, sf).select(*KEYS).distinct()
    return S.lattice_interpolate(f, D.grid_daily(spark, sf), "fwi", 0.25, (36.75, -9.5))
