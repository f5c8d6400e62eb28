"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlattice.session import shared_folder

# Separators of words everywhere in this package: space and the five ASCII control spaces.
GAPS = " \t\n\x0b\f\r"
GAP_CLASS = "[\\x20\\x09-\\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    This cuts the lineage like a checkpoint, runs the work once, and gives Spark the true size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(stored: DataFrame) -> None:
    """Delete a stored table once everything made from it is stored itself."""
    spark = stored.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words between separators, none for a blank text."""
    return F.array_remove(F.split(text, f"{GAP_CLASS}+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def fraction_of(seed: str, *keys: Column) -> Column:
    """A stable draw in [0, 1) from the keys' text: 32 bits of an MD5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where lambdas inside ``body`` use it."""
    return F.transform(F.array(value), body)[0]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that what a task makes of one stays small."""
    for batch in batches:
        for start in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(start, rows)
