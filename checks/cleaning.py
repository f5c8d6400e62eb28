"""Scans, projections, filters, cleaning and key joins."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import DIGEST, build, check
from emberlattice.functions import clean_name, kelvin_to_celsius
from emberlattice.operators import clean as C
from emberlattice.operators import joins as J
from emberlattice.schema import MERGE_BOX, REGIONS, STUDY_BOX, WIDENED_BOX
from emberlattice.sources import cubes, tables
from emberlattice.sources import derived as D

G = ["grid_daily"]
LINE_SCHEMA = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_shipdate", T.TimestampNTZType()),
    T.StructField("l_quantity", T.DoubleType()),
])


@check("S01_read_daily_table", "SELECT l_orderkey, CAST(l_shipdate AS DATE) AS date, l_quantity FROM lineitem")
def _(spark, sf):
    df = tables.read_daily_table(spark, f"{sf}/lineitem.parquet", LINE_SCHEMA, "parquet", "l_shipdate")
    return df.select("l_orderkey", "date", "l_quantity")


@check("S04_scan_by_file_name",
       "SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1", ["q"])
def _(spark, sf):
    df = tables.scan_named(spark, sf, ["lineitem"], LINE_SCHEMA, "parquet")
    return df.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@check("S02_read_narrow", "SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS q FROM lineitem GROUP BY 1", ["q"])
def _(spark, sf):
    """Two of eleven columns are read; Spark splits the file by size."""
    df = tables.read_daily_table(spark, f"{sf}/lineitem.parquet", LINE_SCHEMA, "parquet", "l_shipdate")
    return df.groupBy("date").agg(F.sum("l_quantity").alias("q"))


@check("S05_union_all", build(
    "SELECT date, latitude, longitude, fwi, NULL::DOUBLE AS temperature_max FROM fwi_daily UNION ALL"
    " SELECT date, latitude, longitude, NULL, temperature_max FROM temp_daily", ["fwi_daily", "temp_daily"]),
    ["temperature_max"])
def _(spark, sf):
    return C.union_all([D.fwi_daily(spark, sf), D.temp_daily(spark, sf)])


@check("S06_flatten_grid", build("SELECT date, latitude, longitude, fwi AS value FROM grid_daily", G), ["value"])
def _(spark, sf):
    return cubes.flatten_grid(D.cube_daily(spark, sf))


@check("S06_flatten_curvilinear", build(
    "SELECT date, latitude, longitude, fwi AS value FROM grid_daily", G), ["value", "latitude", "longitude"])
def _(spark, sf):
    cube = D.cube_daily(spark, sf)
    lats = F.transform("lat_axis", lambda a: F.transform("lon_axis", lambda o: a))
    lons = F.transform("lat_axis", lambda a: F.col("lon_axis"))
    return cubes.flatten_curvilinear(cube.select("date", lats.alias("lats"), lons.alias("lons"), "values"))


_TILES = ("SELECT CAST(pix_row//10 AS BIGINT)*100+pix_col//20 AS tile, pix_row, pix_col, landcover,"
          " -9.6+(pix_col//20)*0.5 AS lft, 42.0-(pix_row//10)*0.25 AS top FROM landcover_pixels")


def _tiled(spark, sf):
    px = D.landcover_pixels(spark, sf)
    r, c = F.expr("pix_row div 10"), F.expr("pix_col div 20")
    return px.select((r * 100 + c).alias("tile"), "pix_row", "pix_col", "landcover",
                     (F.lit(-9.6) + c * 0.5).alias("left"), (F.lit(42.0) - r * 0.25).alias("top"))


@check("S11_scan_tiles_bbox", build(
    "SELECT tile, pix_row, pix_col, landcover FROM t WHERE lft<=-8.3 AND lft+0.5>=-9.2 AND top-0.25<=40.8 AND top>=39.6",
    ["landcover_pixels"], [("t", _TILES)]))
def _(spark, sf):
    px = _tiled(spark, sf)
    meta = px.groupBy("tile").agg(
        F.min("left").alias("left"), (F.min("left") + 0.5).alias("right"), F.max("top").alias("top"),
        (F.max("top") - 0.25).alias("bottom"))
    return tables.pixels_of_tiles(px.drop("left", "top"), meta, (39.6, 40.8, -9.2, -8.3))


@check("P01_resolve_columns", build("SELECT date, latitude, longitude, fwi FROM grid_daily", G))
def _(spark, sf):
    g = D.grid_daily(spark, sf).select("date", "latitude", "longitude", "fwi")
    return C.resolve_columns(g.withColumnsRenamed({"date": "valid_time", "latitude": "lat", "longitude": "Lon_deg"}))


@check("P02_resolve_exposure", build("SELECT point_id, value AS exposure_value FROM exposure", ["exposure"]))
def _(spark, sf):
    return C.resolve_exposure(D.exposure(spark, sf)).select("point_id", "exposure_value")


@check("P03_round_coords", build(
    "SELECT date, round_even((latitude+0.00049)*1000,0)/1000 AS latitude, round_even((longitude-0.00051)*1000,0)/1000 AS longitude, fwi_predicted FROM fine_pred",
    ["fine_pred"]), ["latitude", "longitude"])
def _(spark, sf):
    f = D.fine_pred(spark, sf)
    return C.round_coords(f.withColumns({"latitude": F.col("latitude") + 0.00049, "longitude": F.col("longitude") - 0.00051}))


@check("P04_wrap_longitude", build("SELECT date, latitude, longitude, fwi FROM grid_daily", G), ["longitude"])
def _(spark, sf):
    g = D.grid_daily(spark, sf).select("date", "latitude", "longitude", "fwi")
    return C.wrap_longitude(g.withColumn("longitude", F.col("longitude") + 360))


@check("P05_parse_date", "SELECT o_orderkey, CASE WHEN o_orderkey%9=0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders")
def _(spark, sf):
    text = F.when(F.col("o_orderkey") % 9 == 0, F.lit("not a date")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = D.table(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    return C.parse_date(rows, "t").select("o_orderkey", "date")


@check("P06_calendar_parts", build(
    "SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, count(*) AS n FROM grid_daily GROUP BY ALL", G))
def _(spark, sf):
    return C.calendar_parts(D.grid_daily(spark, sf)).groupBy("date", "year", "month", "day").agg(
        F.count(F.lit(1)).alias("n"))


@check("P07_kelvin_to_celsius", build(
    "SELECT date, latitude, longitude, temperature_max-273.15 AS temperature_max_celsius FROM grid_daily", G),
    ["temperature_max_celsius"])
def _(spark, sf):
    return D.grid_daily(spark, sf).select(
        "date", "latitude", "longitude", kelvin_to_celsius("temperature_max").alias("temperature_max_celsius"))


@check("P08_filter_bbox", build(
    "SELECT date, latitude, longitude, fwi FROM grid_daily WHERE latitude BETWEEN 36.8 AND 42.2 AND longitude BETWEEN -9.6 AND -6.2", G))
def _(spark, sf):
    return C.filter_bbox(D.grid_daily(spark, sf), STUDY_BOX).select("date", "latitude", "longitude", "fwi")


@check("P09_filter_bbox_or_widen", build(
    "SELECT date, latitude, longitude, fwi FROM grid_daily WHERE latitude BETWEEN 36 AND 43 AND longitude BETWEEN -10 AND -6 "
    "AND EXISTS (SELECT 1 FROM grid_daily) ", G))
def _(spark, sf):
    boxes = [(50.0, 60.0, 0.0, 9.0), MERGE_BOX, WIDENED_BOX]
    return C.filter_bbox_or_widen(D.grid_daily(spark, sf), boxes).select("date", "latitude", "longitude", "fwi")


_REGION_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS region, * FROM fine_pred WHERE latitude BETWEEN {s} AND {t} AND longitude BETWEEN {w} AND {e}"
    for n, s, t, w, e in REGIONS)


@check("P10_tag_regions", build(
    f"SELECT region, count(*) AS n_points, avg(fwi_predicted) AS mean_fwi, max(fwi_predicted) AS max_fwi, count(*) FILTER (fwi_predicted>50) AS n_extreme FROM ({_REGION_SQL}) GROUP BY region",
    ["fine_pred"]), ["mean_fwi", "max_fwi"])
def _(spark, sf):
    from emberlattice.operators.aggregate import region_stats
    return region_stats(C.tag_regions(D.fine_pred(spark, sf), REGIONS), "fwi_predicted")


@check("P11_latitude_band", build(
    "SELECT CASE WHEN latitude>41 THEN 'North' WHEN latitude>39.5 THEN 'Central' ELSE 'South' END AS band, count(*) AS n FROM grid_daily GROUP BY 1", G))
def _(spark, sf):
    from emberlattice.functions import latitude_band
    return D.grid_daily(spark, sf).groupBy(latitude_band("latitude").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@check("P12_nan_to_null_drop_missing", build(
    "SELECT date, latitude, longitude, fwi, total_precipitation FROM grid_daily WHERE fwi<>30 AND total_precipitation IS NOT NULL", G),
    ["total_precipitation"])
def _(spark, sf):
    g = D.grid_daily(spark, sf).select("date", "latitude", "longitude", "fwi", "total_precipitation")
    g = g.withColumn("fwi", F.when(F.col("fwi") == 30, F.lit(float("nan"))).otherwise(F.col("fwi")))
    return C.drop_missing(C.nan_to_null(g), ["fwi", "total_precipitation"])


@check("P13_dedupe_keys", build(
    "SELECT date, latitude, longitude, min(fwi_predicted) AS fwi_predicted FROM fine_pred GROUP BY 1,2,3", ["fine_pred"]),
    ["fwi_predicted"])
def _(spark, sf):
    return C.dedupe_keys(D.fine_pred(spark, sf), ["date", "latitude", "longitude"])


@check("P14_dedupe_mean", build(
    "SELECT date, latitude, longitude, avg(fwi_predicted) AS fwi_predicted FROM fine_pred GROUP BY 1,2,3", ["fine_pred"]),
    ["fwi_predicted"])
def _(spark, sf):
    return C.dedupe_mean(D.fine_pred(spark, sf), ["date", "latitude", "longitude"], ["fwi_predicted"])


_K = "date, latitude, longitude, fwi"


def _grid(spark, sf):
    return D.grid_daily(spark, sf).select("date", "latitude", "longitude", "fwi")


@check("P15_on_day", build(f"SELECT {_K} FROM grid_daily WHERE date=DATE '2017-06-17'", G))
def _(spark, sf):
    return C.on_day(_grid(spark, sf), "2017-06-17")


@check("P15_in_month", build(f"SELECT {_K} FROM grid_daily WHERE month(date)=10", G))
def _(spark, sf):
    return C.in_month(_grid(spark, sf), 10)


@check("P15_on_month_day", build(f"SELECT {_K} FROM grid_daily WHERE strftime(date,'%m-%d')='06-17'", G))
def _(spark, sf):
    return C.on_month_day(_grid(spark, sf), "06-17")


@check("P15_in_year", build(f"SELECT {_K} FROM grid_daily WHERE year(date)=2017", G))
def _(spark, sf):
    return C.in_year(_grid(spark, sf), 2017)


@check("P17_clip", build(
    "SELECT date, latitude, longitude, greatest(5.0::DOUBLE, least(40.0::DOUBLE, fwi_predicted)) AS fwi_predicted FROM fine_pred", ["fine_pred"]),
    ["fwi_predicted"])
def _(spark, sf):
    return C.clip_columns(D.fine_pred(spark, sf), ["fwi_predicted"], 5, 40)


@check("P18_winsorize", build(
    "SELECT date, latitude, longitude, greatest(q.a, least(q.b, fwi)) AS fwi, greatest(q.c, least(q.d, temperature_max)) AS temperature_max"
    " FROM grid_daily, (SELECT quantile_cont(fwi, 0.001) AS a, quantile_cont(fwi, 0.999) AS b, quantile_cont(temperature_max, 0.001) AS c,"
    " quantile_cont(temperature_max, 0.999) AS d FROM grid_daily) q", G), ["fwi", "temperature_max"])
def _(spark, sf):
    g = D.grid_daily(spark, sf).select("date", "latitude", "longitude", "fwi", "temperature_max")
    return C.winsorize(g, ["fwi", "temperature_max"])


@check("P19_finite_or_null", build(
    "SELECT date, latitude, longitude, CASE WHEN fwi>48 OR fwi<10 THEN NULL ELSE fwi END AS fwi FROM grid_daily", G))
def _(spark, sf):
    bad = F.when(F.col("fwi") > 48, F.lit(float("inf"))).when(F.col("fwi") < 10, F.lit(-1e11)).otherwise(F.col("fwi"))
    return C.finite_or_null(_grid(spark, sf).withColumn("fwi", bad), ["fwi"])


@check("P20_impute_median", build(
    "SELECT date, latitude, longitude, coalesce(total_precipitation, (SELECT median(total_precipitation) FROM grid_daily)) AS total_precipitation, 10.0::DOUBLE AS empty FROM grid_daily", G),
    ["total_precipitation"])
def _(spark, sf):
    g = D.grid_daily(spark, sf).select("date", "latitude", "longitude", "total_precipitation",
                                       F.lit(None).cast("double").alias("empty"))
    return C.impute_median(g, ["total_precipitation", "empty"], 10.0)


@check("P21_constant_features", build(
    "SELECT 'fwi' AS feature, min(fwi)=max(fwi) AS is_constant FROM grid_daily UNION ALL SELECT 'flat', true UNION ALL"
    " SELECT 'dewpoint', min(dewpoint)=max(dewpoint) FROM grid_daily", G))
def _(spark, sf):
    g = D.grid_daily(spark, sf).withColumn("flat", F.lit(3.0))
    return C.constant_features(g, ["fwi", "flat", "dewpoint"])


@check("P22_select_features", build("SELECT date, latitude, longitude, fwi AS fine_fwi, dewpoint AS fine_dew FROM grid_daily", G), ["fine_dew"])
def _(spark, sf):
    g = D.grid_daily(spark, sf).select(
        "date", "latitude", "longitude", F.col("fwi").alias("fine_fwi"), F.col("dewpoint").alias("fine_dew"),
        F.lit(None).cast("double").alias("fine_empty"), F.lit("x").alias("fine_text"))
    return g.select("date", "latitude", "longitude", *C.select_features(g, "fine_"))


@check("P23_completeness", build(
    "SELECT 'fwi' AS \"column\", 100.0*count(fwi)/count(*) AS pct_complete FROM grid_daily UNION ALL"
    " SELECT 'total_precipitation', 100.0*count(total_precipitation)/count(*) FROM grid_daily", G), ["pct_complete"])
def _(spark, sf):
    return C.completeness(D.grid_daily(spark, sf), ["fwi", "total_precipitation"])


@check("P24_quality_counts", build(
    "SELECT count(*) FILTER (x<0) AS n_negative, count(*) FILTER (x>40) AS n_above, count(*) FILTER (x IS NULL) AS n_missing"
    " FROM (SELECT CASE WHEN total_precipitation IS NULL THEN NULL ELSE fwi-20 END AS x FROM grid_daily)", G))
def _(spark, sf):
    x = F.when(F.col("total_precipitation").isNotNull(), F.col("fwi") - 20)
    return C.quality_counts(D.grid_daily(spark, sf).withColumn("x", x), "x", 40.0)


@check("P25_with_lineage", build(
    "SELECT date, count(*) AS n, prediction_method, source_resolution, target_resolution, model_cv_score, prediction_timestamp FROM ("
    "SELECT date, 'ridge' AS prediction_method, '25km' AS source_resolution, '1km' AS target_resolution, 0.5::DOUBLE AS model_cv_score, '2017-12-31T00:00:00' AS prediction_timestamp FROM fine_pred) GROUP BY ALL",
    ["fine_pred"]))
def _(spark, sf):
    f = C.with_lineage(D.fine_pred(spark, sf), "ridge", "25km", "1km", 0.5, "2017-12-31T00:00:00")
    return f.groupBy("date", "prediction_method", "source_resolution", "target_resolution", "model_cv_score",
                     "prediction_timestamp").agg(F.count(F.lit(1)).alias("n"))


@check("P26_cap_at_quantile", build(
    "SELECT point_id, value, least(value, (SELECT quantile_cont(value, 0.99) FROM exposure WHERE value>0)) AS value_capped FROM exposure WHERE value>0", ["exposure"]),
    ["value_capped"])
def _(spark, sf):
    return C.cap_at_quantile(D.exposure(spark, sf), "value").select("point_id", "value", "value_capped")


@check("P27_log10_if_wide", build(
    "SELECT point_id, CASE WHEN (SELECT min(value)>0 AND max(value)/min(value)>1000 FROM exposure WHERE value>0) THEN log10(value) ELSE value END AS value_scaled FROM exposure WHERE value>0", ["exposure"]),
    ["value_scaled"])
def _(spark, sf):
    return C.log10_if_wide(D.exposure(spark, sf).where("value > 0"), "value").select("point_id", "value_scaled")


@check("P28_sample_n", build(
    f"SELECT * FROM fine_pred ORDER BY {DIGEST}, date, latitude, longitude, fwi_predicted LIMIT 500", ["fine_pred"]), ["fwi_predicted"])
def _(spark, sf):
    return C.sample_n(D.fine_pred(spark, sf), 500, ["date", "latitude", "longitude"], 42)


@check("P36_clean_names", build(
    "SELECT DISTINCT feature, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace("
    "feature,'feature_downscaled_',''),'feature_gradient_','grad_'),'feature_spatial_','spatial_'),'_variability','_var'),'_spatial_range','_s_range'),"
    "'temperature','temp'),'humidity','humid'),'precipitation','precip'),'u_component','u_comp'),'v_component','v_comp'),'distance_to_50km','dist_50km'),"
    "'num_50km_points','n_50km_pts'),'surface_pressure','surf_press') AS label FROM features_importance", ["features_importance"],
    ).replace("AS label FROM", "AS label0 FROM").join(
    ["SELECT feature, replace(replace(replace(label0,'surface_net_solar_radiation','net_solar'),'lat_50km','lat_50k'),'lon_50km','lon_50k') AS label FROM (", ")"]))
def _(spark, sf):
    return D.features_importance(spark, sf).select("feature", clean_name("feature").alias("label")).distinct()


@check("P38_drop_bounds_vars", build("SELECT date, latitude, longitude, fwi FROM grid_daily", G))
def _(spark, sf):
    g = _grid(spark, sf).withColumns({"lat_bnds": F.array("latitude"), "time_bnds": F.array("date")})
    return cubes.drop_bounds_vars(g)


@check("P40_filter_above", build(f"SELECT {_K} FROM grid_daily WHERE fwi>40", G))
def _(spark, sf):
    return C.filter_above(_grid(spark, sf), "fwi", 40)


@check("J01_merge_daily", build(
    "SELECT f.date, f.latitude, f.longitude, f.fwi, t.temperature_max, a.dewpoint, a.total_precipitation FROM fwi_daily f"
    " JOIN temp_daily t USING (date, latitude, longitude) JOIN atmos_daily a USING (date, latitude, longitude)",
    ["fwi_daily", "temp_daily", "atmos_daily"]), ["temperature_max", "dewpoint", "total_precipitation"])
def _(spark, sf):
    m = J.merge_daily(D.fwi_daily(spark, sf), D.temp_daily(spark, sf), "temp")
    return J.merge_daily(m, D.atmos_daily(spark, sf), "atmos")


@check("J02_retention_share", build(
    "SELECT count(*) AS n_base, CAST(count(t.temperature_max) AS BIGINT) AS n_joined, count(t.temperature_max)/count(*) AS share FROM fwi_daily f LEFT JOIN temp_daily t USING (date, latitude, longitude)",
    ["fwi_daily", "temp_daily"]), ["share"])
def _(spark, sf):
    return J.retention_share(D.fwi_daily(spark, sf), D.temp_daily(spark, sf))


@check("J02_retention_gated_merge", build(
    "SELECT f.date, f.latitude, f.longitude, f.fwi, t.temperature_max FROM fwi_daily f JOIN temp_daily t USING (date, latitude, longitude)",
    ["fwi_daily", "temp_daily"]), ["temperature_max"])
def _(spark, sf):
    return J.retention_gated_merge(D.fwi_daily(spark, sf), D.temp_daily(spark, sf), "temp", ["temperature_max"])


def _moved(spark, sf, by):
    shift = {c: F.col(c) + by for c in ("latitude", "longitude")}
    return J.retention_gated_merge(D.fwi_daily(spark, sf), D.temp_daily(spark, sf).withColumns(shift), "temp", ["temperature_max"])


@check("J02_falls_to_nearest", build(
    "SELECT f.date, f.latitude, f.longitude, f.fwi, t.temperature_max FROM fwi_daily f JOIN temp_daily t USING (date, latitude, longitude)",
    ["fwi_daily", "temp_daily"]), ["temperature_max"])
def _(spark, sf):
    """No key of the moved table is met, but nearly every point has a neighbour within the tolerance."""
    return _moved(spark, sf, 0.05)


@check("J02_falls_to_base", build("SELECT date, latitude, longitude, fwi FROM fwi_daily", ["fwi_daily"]))
def _(spark, sf):
    return _moved(spark, sf, 0.12)


@check("J03_merge_variables", build(
    "SELECT date, latitude, longitude, fwi, temperature_max, dewpoint, total_precipitation FROM fwi_daily FULL JOIN temp_daily USING (date, latitude, longitude)"
    " FULL JOIN atmos_daily USING (date, latitude, longitude)", ["fwi_daily", "temp_daily", "atmos_daily"]),
    ["temperature_max", "dewpoint", "total_precipitation"])
def _(spark, sf):
    return J.merge_variables([D.fwi_daily(spark, sf), D.temp_daily(spark, sf), D.atmos_daily(spark, sf)])


@check("J04_overlay_last_wins", build(
    "SELECT date, latitude, longitude, coalesce(b.dewpoint, a.dewpoint) AS dewpoint, coalesce(b.total_precipitation, a.total_precipitation) AS total_precipitation, c.fwi"
    " FROM atmos_daily a FULL JOIN b USING (date, latitude, longitude) FULL JOIN fwi_daily c USING (date, latitude, longitude)",
    ["atmos_daily", "fwi_daily"],
    [("b", "SELECT date, latitude, longitude, dewpoint+1 AS dewpoint, total_precipitation+2 AS total_precipitation FROM atmos_daily WHERE fmod(dewpoint*2,3)<1")]),
    ["dewpoint", "total_precipitation"])
def _(spark, sf):
    a = D.atmos_daily(spark, sf)
    b = a.where(F.col("dewpoint") * 2 % 3 < 1).withColumns(
        {"dewpoint": F.col("dewpoint") + 1, "total_precipitation": F.col("total_precipitation") + 2})
    return J.overlay_last_wins([a, b, D.fwi_daily(spark, sf)])


@check("J12_validate_merge", build(
    "SELECT f.date, f.latitude, f.longitude, f.fwi, a.total_precipitation FROM fwi_daily f JOIN atmos_daily a USING (date, latitude, longitude) WHERE a.total_precipitation IS NOT NULL",
    ["fwi_daily", "atmos_daily"]), ["total_precipitation"])
def _(spark, sf):
    return J.validate_merge(D.fwi_daily(spark, sf), D.atmos_daily(spark, sf).drop("dewpoint"), ("fwi", "total_precipitation"))


@check("J14_common_dates", build(
    "SELECT date FROM fwi_daily INTERSECT SELECT date FROM temp_daily", ["fwi_daily", "temp_daily"]))
def _(spark, sf):
    return J.common_dates(D.fwi_daily(spark, sf), D.temp_daily(spark, sf))


@check("U01_union_by_name", build(
    "SELECT date, latitude, longitude, fwi AS v FROM fwi_daily UNION ALL SELECT date, latitude, longitude, temperature_max FROM temp_daily", ["fwi_daily", "temp_daily"]), ["v"])
def _(spark, sf):
    a = D.fwi_daily(spark, sf).withColumnRenamed("fwi", "v")
    return C.union_all([a, D.temp_daily(spark, sf).withColumnRenamed("temperature_max", "v")])


@check("U02_intersect_dates", build(
    "SELECT date FROM fine_pred INTERSECT SELECT date FROM grid_daily", ["fine_pred", "grid_daily"]))
def _(spark, sf):
    return J.common_dates(D.fine_pred(spark, sf), D.grid_daily(spark, sf))


@check("U05_distinct_coordinates", build("SELECT DISTINCT latitude, longitude FROM fine_pred", ["fine_pred"]))
def _(spark, sf):
    return C.distinct_coordinates(D.fine_pred(spark, sf))


@check("T01_sort_daily", build(f"SELECT {_K} FROM grid_daily ORDER BY 1,2,3", G))
def _(spark, sf):
    return C.sort_daily(_grid(spark, sf))


@check("T03_head", build(f"SELECT {_K} FROM grid_daily ORDER BY 1,2,3 LIMIT 10", G))
def _(spark, sf):
    return C.sort_daily(_grid(spark, sf)).limit(10)


@check("T04_first_dates", build(
    f"SELECT {_K} FROM grid_daily WHERE date IN (SELECT DISTINCT date FROM grid_daily ORDER BY date LIMIT 30)", G))
def _(spark, sf):
    return C.first_dates(_grid(spark, sf), 30)


@check("T05_min_group_size", build(
    f"SELECT {_K} FROM grid_daily WHERE date IN (SELECT date FROM grid_daily GROUP BY date HAVING count(*)>=286)", G))
def _(spark, sf):
    return C.min_group_size(_grid(spark, sf), ["date"], 286)
