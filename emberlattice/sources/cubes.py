"""Decoded climate cubes: one row per time slice with axis arrays and a 2-d value array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_grid(
    cubes: DataFrame, values: str = "values", lat_axis: str = "lat_axis", lon_axis: str = "lon_axis",
    out: str = "value", keep_null: bool = False,
) -> DataFrame:
    """Long rows (other columns..., latitude, longitude, value) of cubes with 1-d axes."""
    others = [c for c in cubes.columns if c not in (values, lat_axis, lon_axis)]
    rows = cubes.select(
        *others, F.col(lon_axis).alias("_lon"),
        F.explode(F.arrays_zip(F.col(lat_axis).alias("y"), F.col(values).alias("v"))).alias("_r"),
    ).select(*others, "_lon", F.col("_r.y").alias("latitude"), F.col("_r.v").alias("_v"))
    cells = rows.select(*others, "latitude", F.explode(F.arrays_zip("_lon", "_v")).alias("_c"))
    flat = cells.select(
        *others, "latitude", F.col("_c._lon").alias("longitude"), F.col("_c._v").alias(out)
    )
    return flat if keep_null else flat.where(F.col(out).isNotNull())


def flatten_curvilinear(
    cubes: DataFrame, values: str = "values", lats: str = "lats", lons: str = "lons", out: str = "value",
    keep_null: bool = False,
) -> DataFrame:
    """Long rows of cubes whose latitude and longitude are 2-d arrays of the value shape."""
    others = [c for c in cubes.columns if c not in (values, lats, lons)]
    rows = cubes.select(*others, F.explode(F.arrays_zip(lats, lons, values)).alias("_r")).select(
        *others, F.col("_r")[lats].alias("_y"), F.col("_r")[lons].alias("_x"),
        F.col("_r")[values].alias("_v"),
    )
    flat = rows.select(*others, F.explode(F.arrays_zip("_y", "_x", "_v")).alias("_c")).select(
        *others, F.col("_c._y").alias("latitude"), F.col("_c._x").alias("longitude"),
        F.col("_c._v").alias(out),
    )
    return flat if keep_null else flat.where(F.col(out).isNotNull())


def drop_bounds_vars(df: DataFrame, suffix: str = "_bnds") -> DataFrame:
    """Leave out the cell-bounds variables of a cube."""
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])
