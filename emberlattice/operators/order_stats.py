"""Exact quantiles, ranks and cumulative distributions without a single-task sort.

Equal values are first collapsed to (value, count), so a hot value costs one row. The distinct
values are then cut into ranges at a small deterministic sample of split points and each range is
ranked on its own; range offsets are added back. No task sees more than about 1/buckets of the
distinct values, also when one group holds most of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_BUCKETS = 512


def _bucket_count(df: DataFrame, buckets: int | None) -> int:
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(4, min(MAX_BUCKETS, buckets))


def ranked_counts(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    buckets: int | None = None,
    weight: Column | None = None,
    keep_bucket: bool = False,
) -> DataFrame:
    """(by..., value, n, before, total): counts per distinct value with cumulative position.

    ``before`` is the number of rows of the group with a smaller value, ``total`` the group size.
    ``weight`` replaces the row count when rows already carry one. ``keep_bucket`` adds the value's
    range as ``bucket``, so that a group's statistics can go back to its values range by range.
    """
    by = list(by)
    size = _bucket_count(df, buckets)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("value"))
        .agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("n"))
    )
    # Bottom-k by hash: a bounded sample of the distinct values that is the same on every run.
    splits = (
        counted.where("n > 0")
        .orderBy(F.xxhash64(*by, "value"), "value", *by)
        .limit(size - 1)
        .agg(F.sort_array(F.collect_list("value")).alias("s"))
        .scalar()
    )
    position = F.array_position(F.sort_array(F.array_append(splits, F.col("value"))), F.col("value"))
    ranged = counted.where("n > 0").withColumn("bucket", F.coalesce(position, F.lit(0).cast("long")))
    inside = W.partitionBy(*by, "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    ranked = ranged.withColumn("upto", F.sum("n").over(inside))
    # At most `size` rows per group from here on.
    offsets = (
        ranged.groupBy(*by, "bucket")
        .agg(F.sum("n").alias("bucket_n"))
        .withColumn(
            "offset",
            F.sum("bucket_n").over(
                W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
            )
            - F.col("bucket_n"),
        )
        .withColumn("total", F.sum("bucket_n").over(W.partitionBy(*by)))
        .drop("bucket_n")
    )
    if not by:
        offsets = F.broadcast(offsets)  # no more than MAX_BUCKETS rows
    return ranked.join(offsets, [*by, "bucket"]).select(
        *by, "value", "n", (F.col("offset") + F.col("upto") - F.col("n")).alias("before"), "total",
        *(["bucket"] if keep_bucket else []),
    )


def _at(position: Column) -> Column:
    hit = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
    return F.max(F.when(hit, F.col("value")))


def quantile_columns(probs: Sequence[float], names: Sequence[str]) -> list[Column]:
    """Aggregates over ``ranked_counts`` rows giving linearly interpolated quantiles."""
    out = []
    for p, name in zip(probs, names):
        place = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.floor(place), F.ceil(place)
        part = F.max(place - low)
        out.append((_at(low) + (_at(high) - _at(low)) * part).alias(name))
    return out


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles, one row per group (nulls skipped)."""
    ranked = ranked_counts(df, value, by, buckets)
    return ranked.groupBy(*by).agg(*quantile_columns(probs, names))


def unpivot_columns(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, x): the listed columns stacked into rows."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x"))
                  for c in cols])
    )
    return df.select(*keep, pairs.alias("p")).select(*keep, "p.column", "p.x")


def column_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """(column, names...): quantiles of several columns from one pass over the data."""
    return quantiles(unpivot_columns(df, cols), "x", probs, names, by=["column"])


def column_lookup(stats: DataFrame, names: Sequence[str], key: str = "column") -> Column:
    """Per-column statistics (one row per column) as a scalar map column -> struct."""
    entry = F.struct(F.col(key), F.struct(*[F.col(n) for n in names]))
    return stats.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()


def percent_rank_average(
    df: DataFrame, value: str, out: str = "risk_percentile", by: Sequence[str] = ()
) -> DataFrame:
    """Percentile rank 0..100 with tied rows sharing their average rank; null for null values."""
    by = list(by)
    ranked = ranked_counts(df, value, by).select(
        *by,
        F.col("value").alias(value),
        ((F.col("before") + (F.col("n") + 1) / 2) / F.col("total") * 100).alias(out),
    )
    return df.join(ranked, [*by, value], "left").select(*df.columns, out)


def ecdf(
    df: DataFrame, value: str, by: Sequence[str] = (), chunk: int = 100_000, weight: Column | None = None
) -> DataFrame:
    """(by..., value, k, cumulative): one step k/n per row, ties get consecutive steps.

    ``weight`` tells how many rows a row stands for.
    """
    by = list(by)
    ranked = ranked_counts(df, value, by, weight=weight)
    # A value with many copies is cut in chunks that can be spread before they are expanded.
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long")))
    chunks = ranked.withColumn("start", starts)
    spread = chunks.repartition(F.col("value"), F.col("start"))
    step = F.explode(
        F.sequence(F.col("start") + 1, F.least(F.col("start") + F.lit(chunk), F.col("n")))
    )
    return spread.withColumn("step", step).select(
        *by,
        F.col("value"),
        (F.col("before") + F.col("step")).alias("k"),
        ((F.col("before") + F.col("step")) / F.col("total")).alias("cumulative"),
    )


def min_max_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_normalized") -> DataFrame:
    """(x-min)/(max-min) of each column over the whole table, from a one-row aggregate."""
    bounds = df.agg(
        F.struct(
            *[F.min(c).alias(f"{c}_lo") for c in cols], *[F.max(c).alias(f"{c}_hi") for c in cols]
        ).alias("b")
    ).scalar()
    scaled = {
        f"{c}{suffix}": F.try_divide(
            F.col(c) - bounds[f"{c}_lo"], bounds[f"{c}_hi"] - bounds[f"{c}_lo"]
        )
        for c in cols
    }
    return df.withColumns(scaled)


def top_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """First k rows of each group. Spark keeps k rows per group map-side (WindowGroupLimit)."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
