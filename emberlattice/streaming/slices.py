"""Incremental form of the slice-by-slice append: new daily files are picked up as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlattice.operators.clean import nan_to_null, round_coords
from emberlattice.sources.tables import replace_slices


def read_slices(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Stream of daily rows from a folder, cleaned like the batch reader."""
    reader = spark.readStream.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    rows = round_coords(nan_to_null(reader.format(fmt).load(folder)))
    return rows.withColumn("date", F.col("time").cast("date"))


def append_slices_stream(rows: DataFrame, out: str, checkpoint: str):
    """Append to a date-partitioned table, each input file exactly once; stops when all are read."""
    return (
        rows.writeStream.format("parquet")
        .partitionBy("date")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def replace_slices_stream(rows: DataFrame, out: str, checkpoint: str):
    """File each batch of arriving rows by date, in place of the stored slices of its dates; stops when all are read.

    A date delivered again in a later batch replaces the earlier rows of that date only; all rows of one date must
    arrive in one batch, as whole daily files do. A batch repeated after a failure writes the same slices again, so the table holds each
    date once without a commit log of its own.
    """
    return (
        rows.writeStream.foreachBatch(lambda batch, _: replace_slices(batch, out))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
