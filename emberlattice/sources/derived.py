"""Weather-shaped tables derived by Spark from the given order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str, scale: int):
    """Exact integer sum of a price-like column."""
    return F.sum(F.round(F.col(c) * scale).cast("long")).cast("double")


def _date():
    return F.date_add(F.lit("2017-01-03").cast("date"), (5 * (F.col("l_orderkey") % 73)).cast("int"))


def _row():
    return F.floor(F.col("l_partkey") / 14) % 22


def grid_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 km-like daily source grid."""
    n = F.count(F.lit(1))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            _date().alias("date"),
            ((36750 + 250 * _row()).cast("double") / 1000).alias("latitude"),
            ((-9500 + 250 * (F.col("l_partkey") % 14)).cast("double") / 1000).alias("longitude"),
        )
        .agg(
            (F.sum("l_quantity") / n).cast("double").alias("fwi"),
            (F.lit(273.0) + _cents("l_extendedprice", 100) / n / 300000).alias("temperature_max"),
            F.when(F.sum("l_linenumber") % 7 == 0, F.lit(None).cast("double"))
            .otherwise(_cents("l_tax", 100) / n / 10)
            .alias("total_precipitation"),
            (F.lit(260.0) + _cents("l_discount", 100) / n * 2).alias("dewpoint"),
        )
    )


def fine_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 km-like predictions scattered within 0.12 degrees of each grid point."""
    key, line, supp = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        _date().alias("date"),
        ((36750 + 250 * _row() + 10 * ((key * 7 + line * 3) % 25 - 12)).cast("double") / 1000)
        .alias("latitude"),
        ((-9500 + 250 * (F.col("l_partkey") % 14) + 10 * ((key * 5 + supp * 11) % 25 - 12))
         .cast("double") / 1000).alias("longitude"),
        (F.col("l_quantity") * 9 / 10 + supp % 7).cast("double").alias("fwi_predicted"),
    )


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("point_id"),
        ((36850 + 13 * (F.col("p_partkey") % 400)).cast("double") / 1000).alias("latitude"),
        ((-9400 + 17 * ((F.col("p_partkey") * 7) % 190)).cast("double") / 1000).alias("longitude"),
        ((F.round(F.col("p_retailprice") * 100 - 89000).cast("long") * F.col("p_size"))
         .cast("double") / 100).alias("value"),
    )


def landcover_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120-column raster as rows; code 0 is nodata."""
    code = F.col("o_custkey") % 12
    return table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / 120).cast("int").alias("pix_row"),
        (F.col("o_orderkey") % 120).cast("int").alias("pix_col"),
        F.when(code == 11, 0).when(code == 10, 95).otherwise(10 * (1 + code)).cast("int")
        .alias("landcover"),
    )


def _residue():
    """Small integer made of the key. Each daily table lacks the rows of one residue, so inner, outer
    and overlay joins give different results; about 10/11 of all rows stay in each table."""
    day = F.datediff(F.col("date"), F.lit("2017-01-01").cast("date"))
    lat = F.round(F.col("latitude") * 1000).cast("long")
    lon = F.round(F.col("longitude") * 1000).cast("long") + 200000
    return (day * 31 + lat * 7 + lon * 13) % 11


def fwi_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_daily(spark, sf_dir).withColumn("r", _residue())
    return g.where("r <> 0").select("date", "latitude", "longitude", "fwi")


def temp_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_daily(spark, sf_dir).withColumn("r", _residue())
    return g.where("r <> 1").select("date", "latitude", "longitude", "temperature_max")


def atmos_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_daily(spark, sf_dir).withColumn("r", _residue())
    return g.where("r <> 2").select(
        "date", "latitude", "longitude", "dewpoint", "total_precipitation"
    )


# Model name -> offset added to the fine predictions.
MODEL_OFFSETS = {"boosting": 0, "forest": 2, "linear": -3, "ridge": 5}


def pred_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fine predictions of four models, one row per model."""
    models = F.explode(
        F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(o)).alias("offset"))
                  for m, o in MODEL_OFFSETS.items()])
    )
    return fine_pred(spark, sf_dir).select("*", models.alias("m")).select(
        F.col("m.model").alias("model"),
        "date",
        "latitude",
        "longitude",
        (F.col("fwi_predicted") + F.col("m.offset")).alias("fwi_predicted"),
    )


def cube_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid_daily folded to one row per date: axis arrays and a 2-d value array with gaps as null.

    A slice has at most 22 x 14 cells by construction, whatever the table size.
    """
    cells = grid_daily(spark, sf_dir).groupBy("date").agg(
        F.sort_array(F.collect_set("latitude")).alias("lat_axis"),
        F.sort_array(F.collect_set("longitude")).alias("lon_axis"),
        F.map_from_entries(
            F.collect_list(
                F.struct(F.struct("latitude", "longitude"), F.col("fwi"))
            )
        ).alias("m"),
    )
    rows = F.transform(
        "lat_axis",
        lambda a: F.transform(
            "lon_axis",
            lambda o: F.try_element_at(
                F.col("m"), F.struct(a.alias("latitude"), o.alias("longitude"))
            ),
        ),
    )
    return cells.select("date", "lat_axis", "lon_axis", rows.alias("values"))


# Feature names of the importance table.
IMPORTANCE_FEATURES = [
    "feature_downscaled_2m_temperature",
    "feature_downscaled_2m_temperature_variability",
    "feature_downscaled_2m_temperature_spatial_range",
    "feature_downscaled_relative_humidity",
    "feature_downscaled_10m_u_component_of_wind",
    "feature_downscaled_10m_v_component_of_wind",
    "feature_downscaled_10m_v_component_of_wind_variability",
    "feature_downscaled_total_precipitation",
    "feature_downscaled_surface_pressure",
    "feature_downscaled_surface_net_solar_radiation",
    "feature_spatial_distance_to_50km",
    "feature_spatial_num_50km_points",
    "feature_spatial_lat_50km",
    "feature_spatial_lon_50km",
    "feature_gradient_2m_temperature_lat",
    "feature_gradient_2m_temperature_lon",
    "feature_gradient_total_precipitation_lat",
    "feature_gradient_fwi_lon",
]
IMPORTANCE_MODELS = ["boosting", "forest", "linear", "ridge"]


def features_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, feature, score) rows: a share of the order quantity per model and feature."""

    def pick(names, index):
        return F.element_at(F.array(*[F.lit(x) for x in names]), (index + 1).cast("int"))

    per = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            (F.col("l_suppkey") % len(IMPORTANCE_MODELS)).alias("mi"),
            ((F.col("l_partkey") * 5 + F.col("l_suppkey")) % len(IMPORTANCE_FEATURES)).alias("fi"),
        )
        .agg(
            F.sum(F.col("l_quantity") * (F.col("l_linenumber") - 1)).cast("double").alias("a"),
            F.sum(F.col("l_quantity") * 7).cast("double").alias("b"),
        )
        # Some (model, feature) pairs are left out, so that models differ in their feature names.
        .where("(mi * 3 + fi) % 7 <> 0")
    )
    return per.select(
        pick(IMPORTANCE_MODELS, F.col("mi")).alias("model"),
        pick(IMPORTANCE_FEATURES, F.col("fi")).alias("feature"),
        (F.col("a") / F.col("b")).alias("score"),
    )
