"""Writers: each query stores a table in the shared folder and reads it back."""

import datetime as dt
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import DIGEST, build, check
from emberlattice.operators import counted as K
from emberlattice.plans import closure
from emberlattice.schema import FWI_DAILY
from emberlattice.session import shared_folder
from emberlattice.sources import derived as D
from emberlattice.sources import tables, zones
from emberlattice.streaming import slices

G = ["grid_daily"]
_ALL = "SELECT date, latitude, longitude, fwi FROM grid_daily"


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _grid(spark, sf):
    return D.grid_daily(spark, sf).select("date", "latitude", "longitude", "fwi")


@check("S07_write_table", build(_ALL, G))
def _(spark, sf):
    path = folder(spark, "table")
    tables.write_table(_grid(spark, sf), path, files_per_slice=2)
    return spark.read.parquet(path).select("date", "latitude", "longitude", "fwi")


@check("S07_write_table_csv", build(_ALL, G))
def _(spark, sf):
    path = folder(spark, "csv")
    tables.write_table(_grid(spark, sf), path, "csv", partition_by=())
    schema = "date date, latitude double, longitude double, fwi double"
    return spark.read.schema(schema).option("header", True).csv(path)


@check("S01_read_csv", build(_ALL, G))
def _(spark, sf):
    """The daily rows as delimited text, read with the declared schema."""
    path = folder(spark, "delimited")
    time = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("time")
    _grid(spark, sf).select(time, "latitude", "longitude", "fwi").write.option("header", True).csv(path)
    return tables.read_daily_table(spark, path, FWI_DAILY).select("date", "latitude", "longitude", "fwi")


@check("S08_append_slices", build(_ALL, G))
def _(spark, sf):
    path, g = folder(spark, "slices"), _grid(spark, sf)
    tables.append_slices(g.where("month(date) <= 6"), path)
    tables.append_slices(g.where("month(date) > 6"), path)
    return spark.read.parquet(path).select("date", "latitude", "longitude", "fwi")


@check("S08_append_slices_stream", build(_ALL, G))
def _(spark, sf):
    """The incoming folder holds the daily rows; the stream files them by date and stops."""
    src, out, state = (folder(spark, n) for n in ("incoming", "filed", "state"))
    rows = _grid(spark, sf).select(F.col("date").cast("timestamp_ntz").alias("time"), "latitude", "longitude", "fwi")
    rows.write.parquet(src)
    slices.append_slices_stream(slices.read_slices(spark, src, FWI_DAILY), out, state).awaitTermination()
    return spark.read.parquet(out).select("date", "latitude", "longitude", "fwi")


_RERUN = "SELECT date, latitude, longitude, CASE WHEN month(date) = 6 THEN fwi + 1 ELSE fwi END AS fwi FROM grid_daily"


@check("S08_replace_slices", build(_RERUN, G), ["fwi"])
def _(spark, sf):
    """All dates are filed twice, then June is delivered again with other values."""
    path, g = folder(spark, "refiled"), _grid(spark, sf)
    for part in (g, g, g.where("month(date) = 6").withColumn("fwi", F.col("fwi") + 1)):
        tables.replace_slices(part, path)
    return spark.read.parquet(path).select("date", "latitude", "longitude", "fwi")


@check("S08_replace_slices_stream", build(_RERUN, G), ["fwi"])
def _(spark, sf):
    """Two runs of the stream: the daily rows, then June again with other values."""
    src, out, state = (folder(spark, n) for n in ("arriving", "refiled", "state"))
    time = F.col("date").cast("timestamp_ntz").alias("time")
    g = _grid(spark, sf)
    for part in (g, g.where("month(date) = 6").withColumn("fwi", F.col("fwi") + 1)):
        part.select(time, "latitude", "longitude", "fwi").write.mode("append").parquet(src)
        slices.replace_slices_stream(slices.read_slices(spark, src, FWI_DAILY), out, state).awaitTermination()
    return spark.read.parquet(out).select("date", "latitude", "longitude", "fwi")


def _counted(spark, sf, measures):
    """The counts of all days: two half years, then June again with the same rows."""
    path, g = folder(spark, "counts"), D.grid_daily(spark, sf)
    for part in (g.where("month(date) <= 6"), g.where("month(date) > 6"), g.where("month(date) = 6")):
        K.update_counts(part, path, measures)
    return spark.read.parquet(path)


_STATS = ("SELECT '{0}' AS measure, count({0}) AS count, avg({0}) AS mean, stddev_samp({0}) AS std, median({0}) AS median,"
          " sqrt(count({0}))*sum(({0}-m)**3)/sum(({0}-m)**2)**1.5 AS skewness, kurtosis_pop({0}) AS kurtosis,"
          " min({0}) AS min, max({0}) AS max FROM grid_daily, (SELECT avg({0}) AS m FROM grid_daily)")


@check("A18_stats_of_counts", build(" UNION ALL ".join(_STATS.format(c) for c in ("fwi", "total_precipitation")), G),
       ["mean", "std", "median", "skewness", "kurtosis", "min", "max"])
def _(spark, sf):
    return K.counted_stats(_counted(spark, sf, ["fwi", "total_precipitation"]))


@check("W02_ecdf_of_counts", build(
    "SELECT fwi AS value, row_number() OVER (ORDER BY fwi) AS k, row_number() OVER (ORDER BY fwi)/count(*) OVER () AS cumulative FROM grid_daily", G), ["cumulative", "value"])
def _(spark, sf):
    return K.counted_ecdf(_counted(spark, sf, ["fwi"])).drop("measure")


@check("P20_impute_from_counts", build(
    "SELECT date, latitude, longitude, coalesce(total_precipitation, (SELECT median(total_precipitation) FROM grid_daily)) AS total_precipitation"
    " FROM grid_daily WHERE date = (SELECT max(date) FROM grid_daily)", G), ["total_precipitation"])
def _(spark, sf):
    """The last day, filled with the median of all days."""
    g = D.grid_daily(spark, sf).select("date", "latitude", "longitude", "total_precipitation")
    last = g.where(F.col("date") == g.agg(F.max("date")).scalar())
    return K.impute_from_counts(last, _counted(spark, sf, ["total_precipitation"]), ["total_precipitation"])


@check("S04_zone_scan", build(
    "SELECT date, latitude, longitude, fwi FROM grid_daily WHERE latitude BETWEEN 39 AND 40 AND date BETWEEN DATE '2017-05-01' AND DATE '2017-07-31'", G), ["fwi"])
def _(spark, sf):
    """Two half years stored by ranges of latitude, the second one after the map was begun."""
    path, state, g = folder(spark, "zoned"), folder(spark, "zones"), _grid(spark, sf)
    for part in (g.where("month(date) <= 6"), g.where("month(date) > 6")):
        part.repartitionByRange(8, "latitude").write.mode("append").parquet(path)
        zones.extend_zones(spark, path, state, ["latitude", "longitude", "date"])
    ranges = {"latitude": (39.0, 40.0), "date": (dt.date(2017, 5, 1), dt.date(2017, 7, 31))}
    return zones.scan_zones(spark, path, spark.read.parquet(state), ranges)


@check("S10_write_sample", build(
    f"SELECT * FROM fine_pred ORDER BY {DIGEST}, date, latitude, longitude, fwi_predicted LIMIT 1000", ["fine_pred"]), ["fwi_predicted"])
def _(spark, sf):
    path = folder(spark, "sample")
    tables.write_sample(D.fine_pred(spark, sf), path, 1000)
    return spark.read.parquet(path)


@check("S09_write_summary_json", build(
    "SELECT model, count(*) AS data_size FROM (SELECT DISTINCT f.model, g.date, g.latitude, g.longitude FROM f JOIN g ON f.date=g.date AND abs(f.y-g.y)<=1250 AND abs(f.x-g.x)<=1250) GROUP BY model",
    [*G, "pred_models"], [
        ("f", "SELECT model, date, CAST(round_even(latitude*10000,0) AS BIGINT) AS y, CAST(round_even(longitude*10000,0) AS BIGINT) AS x FROM pred_models"),
        ("g", "SELECT date, latitude, longitude, CAST(round_even(latitude*10000,0) AS BIGINT) AS y, CAST(round_even(longitude*10000,0) AS BIGINT) AS x FROM grid_daily")]))
def _(spark, sf):
    path = folder(spark, "summary")
    merged = closure.validate_models(D.pred_models(spark, sf), D.grid_daily(spark, sf))
    tables.write_summary_json(closure.validation_summary(merged), path)
    schema = T.StructType([T.StructField("model", T.StringType()), T.StructField("data_size", T.LongType())])
    return spark.read.schema(schema).json(path)
