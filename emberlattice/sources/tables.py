"""Daily tables, cubes and summaries: reading and writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlattice.operators.clean import nan_to_null, sample_n
from emberlattice.schema import KEYS


# Columns whose filters must reach the scan.
COORDINATES = ("latitude", "longitude", "lat", "lon", "x", "y")


def read_daily_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", time: str | None = "time"
) -> DataFrame:
    """Read a delimited or columnar daily table with a declared schema.

    Large files are split by Spark (spark.sql.files.maxPartitionBytes). NaN measures become null and a
    ``date`` column is derived from ``time``. Coordinates stay as read, so that box filters reach the
    scan; a NaN coordinate lies in no box.
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    df = nan_to_null(reader.format(fmt).load(path), COORDINATES)
    if time and time in df.columns and "date" not in df.columns:
        df = df.withColumn("date", F.col(time).cast("date"))
    return df


def scan_named(
    spark: SparkSession, path: str, tokens: Sequence[str], schema: T.StructType, fmt: str = "csv"
) -> DataFrame:
    """All files of a folder whose name holds one of the tokens; other files are not opened."""
    pattern = "*{" + ",".join(tokens) + "}*"
    reader = spark.read.schema(schema).option("pathGlobFilter", pattern)
    if fmt == "csv":
        reader = reader.option("header", True)
    return nan_to_null(reader.format(fmt).load(path), COORDINATES)


def scan_years(
    spark: SparkSession, path: str, years: Sequence[int], schema: T.StructType, fmt: str = "csv"
) -> DataFrame:
    """All files of a folder whose name holds one of the years."""
    return scan_named(spark, path, [str(y) for y in years], schema, fmt)


def scan_tiles_bbox(tiles: DataFrame, box: Sequence[float]) -> DataFrame:
    """Tile rows (left, bottom, right, top) whose bounds touch the box."""
    south, north, west, east = box
    return tiles.where(
        (F.col("left") <= east) & (F.col("right") >= west)
        & (F.col("bottom") <= north) & (F.col("top") >= south)
    )


def pixels_of_tiles(pixels: DataFrame, tiles: DataFrame, box: Sequence[float], key: str = "tile") -> DataFrame:
    """Pixels of the tiles touching the box. With pixels stored by tile the semi join prunes files."""
    return pixels.join(scan_tiles_bbox(tiles, box).select(key), key, "left_semi")


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ("date",),
    mode: str = "overwrite", sort: Sequence[str] = KEYS, files_per_slice: int | None = None, replace: str = "static",
) -> None:
    """Save a table partitioned by date, sorted inside each file.

    Rows are gathered per slice first, so tasks do not each write a small file for every date. Spark
    rebalances the slices by size: large dates are split over tasks, small ones share one. With
    ``files_per_slice`` a date is cut in that many files by a hash of its keys instead. ``replace`` tells what
    an overwrite removes: the whole table ("static") or the slices written ("dynamic").
    """
    inner = [c for c in sort if c in df.columns and c not in partition_by]
    out = df
    if partition_by and files_per_slice is None:
        out = out.hint("rebalance", *[F.col(c) for c in partition_by])
    elif partition_by:
        slot = F.pmod(F.xxhash64(*(inner or df.columns)), F.lit(files_per_slice))
        out = out.repartition(*partition_by, slot)
    if inner or partition_by:
        out = out.sortWithinPartitions(*partition_by, *inner)
    writer = out.write.mode(mode).format(fmt).option("partitionOverwriteMode", replace)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def append_slices(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ("date",),
    files_per_slice: int | None = None,
) -> None:
    """Append the time slices of ``df`` in one job."""
    write_table(df, path, fmt, partition_by, "append", files_per_slice=files_per_slice)


def replace_slices(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ("date",)) -> None:
    """Write the time slices of ``df`` in place of the stored ones with the same dates; other dates stay.

    Writing a slice twice equals writing it once, so a job that failed, or a date that was delivered again, is simply run
    again. Only the slices in ``df`` are rewritten, whatever the table's size. ``df`` may be made from the table
    itself: a slice changes when the job commits, after its rows were read. A null date is a slice like any
    other. An empty ``df`` changes nothing.
    """
    if not partition_by:
        raise ValueError("slices need a column")
    write_table(df, path, fmt, partition_by, "overwrite", replace="dynamic")


def write_sample(df: DataFrame, path: str, n: int, keys: Sequence[str] = KEYS, seed: int = 42) -> None:
    """Save at most n rows, chosen by a seeded hash of the keys."""
    write_table(sample_n(df, n, keys, seed), path, partition_by=())


def write_summary_json(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)
