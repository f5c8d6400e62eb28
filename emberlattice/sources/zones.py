"""Zone maps: the range of coordinates and dates in every file, looked up before a scan.

Spark prunes partitions by their folder and row groups by their statistics, but it opens every file of the
folder for the latter. With a map kept beside the table, files outside a box are not opened at all.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Ranges = Mapping[str, tuple[object, object]]


def zone_map(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(file, n_rows, <column>_min, <column>_max...) of every file of a table read from files; nulls are left out.

    Only ``columns`` are read. Files are combined map-side: a task sends one row for each file it reads.
    """
    low = [F.min(c).alias(f"{c}_min") for c in columns]
    high = [F.max(c).alias(f"{c}_max") for c in columns]
    return table.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"), *low, *high)


def _key(file: str) -> str:
    """A file's name in one form: listings and scans write the slashes after the scheme differently."""
    return re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", file)


def _read(spark: SparkSession, path: str, files: Sequence[str]) -> DataFrame:
    """Files as ``inputFiles`` names them, which is encoded, while a reader takes plain paths."""
    return spark.read.schema(spark.read.parquet(path).schema).option("basePath", path).parquet(*map(unquote, files))


def extend_zones(spark: SparkSession, path: str, zones_path: str, columns: Sequence[str]) -> int:
    """Add the files of a table that its stored map does not hold; returns how many were read.

    File names are unique, as Spark's writers make them: a name that is known is not read again. Entries of files that
    are gone stay; scans ignore them. The first call passes a path without a map.
    """
    listed = spark.read.parquet(path).inputFiles()
    where = spark._jvm.org.apache.hadoop.fs.Path(zones_path)
    begun = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    known = {_key(r.file) for r in spark.read.parquet(zones_path).select("file").toLocalIterator()} if begun else set()
    fresh = [f for f in listed if _key(f) not in known]
    if fresh:
        zone_map(_read(spark, path, fresh), columns).write.mode("append").parquet(zones_path)
    return len(fresh)


def _inside(ranges: Ranges) -> Column:
    return reduce(and_, [F.col(f"`{c}`").between(F.lit(lo), F.lit(hi)) for c, (lo, hi) in ranges.items()], F.lit(True))


def _touches(ranges: Ranges) -> Column:
    parts = [(F.col(f"`{c}_min`") <= F.lit(hi)) & (F.col(f"`{c}_max`") >= F.lit(lo)) for c, (lo, hi) in ranges.items()]
    return F.coalesce(reduce(and_, parts, F.lit(True)), F.lit(False))


def scan_zones(spark: SparkSession, path: str, zones: DataFrame, ranges: Ranges) -> DataFrame:
    """Rows of a table inside closed ranges of its columns; files that the map shows to lie outside are not opened.

    A file that the map does not hold is read, so an old map costs time and no rows. Null in a ranged column lies in
    no range. The names of the files left out travel through the driver, like Spark's own listing of the folder.
    """
    whole = spark.read.parquet(path)
    away = {_key(r.file) for r in zones.where(~_touches(ranges)).select("file").toLocalIterator()}
    files = [f for f in whole.inputFiles() if _key(f) not in away]
    table = _read(spark, path, files) if files else whole.where(F.lit(False))
    return table.where(_inside(ranges))
