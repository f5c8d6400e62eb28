"""Order statistics of tables that grow by days, from counts that are kept and merged.

The state is (date, measure, value, n): how often each value of a measure occurs on a date. It is stored by date
beside the table's slices. A new or repeated day adds or replaces its own slice of the state, and statistics
over all days are made from the counts, so stored rows are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlattice.operators.order_stats import column_lookup, ecdf, quantile_columns, ranked_counts, unpivot_columns
from emberlattice.sources.tables import replace_slices


def value_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("date",)) -> DataFrame:
    """(by..., measure, value, n): nulls are left out; a date without any value has no row.

    Zeros of both signs are one value, and NaN is a value above all others.
    """
    rows = unpivot_columns(df, cols, by).withColumnsRenamed({"column": "measure", "x": "value"})
    return rows.where("value IS NOT NULL").groupBy(*by, "measure", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(states: Sequence[DataFrame], by: Sequence[str] = ("date",)) -> DataFrame:
    """One state from several over different rows, in any order and grouping."""
    rows = states[0]
    for state in states[1:]:
        rows = rows.unionByName(state)
    return rows.groupBy(*by, "measure", "value").agg(F.sum("n").alias("n"))


def update_counts(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    """Put the counts of the dates in ``df`` in place of the stored ones; other dates are not touched.

    ``df`` holds whole days. Running it twice equals running it once. The first run makes the table.
    """
    replace_slices(value_counts(df, cols), path)


def counted_quantiles(
    state: DataFrame, probs: Sequence[float], names: Sequence[str], by: Sequence[str] = ("measure",)
) -> DataFrame:
    """(by..., names...): exact interpolated quantiles over all counted rows."""
    ranked = ranked_counts(state, "value", by, weight=F.col("n"))
    return ranked.groupBy(*by).agg(*quantile_columns(probs, names))


def counted_stats(state: DataFrame, by: Sequence[str] = ("measure",)) -> DataFrame:
    """(by..., count, mean, std, median, skewness, kurtosis, min, max) over all counted rows.

    std is that of a sample (null for one row); skewness and excess kurtosis are those of the population, null
    where all values are equal. Deviations are taken from the mean in a second aggregate.
    """
    by = list(by)
    v, n = F.col("value"), F.col("n")
    level = state.groupBy(*by, "value").agg(F.sum("n").alias("n"))
    first = level.groupBy(*by).agg(
        F.sum("n").alias("count"), (F.sum(v * n) / F.sum("n")).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    away = v - F.col("mean")
    sums = level.join(first, by).groupBy(*by).agg(*[F.sum(n * F.pow(away, F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)])
    total, m2 = F.col("count"), F.col("m2")
    shaped = first.join(sums, by).select(
        *by, "count", "mean", F.sqrt(F.try_divide(m2, total - 1)).alias("std"),
        F.try_divide(F.sqrt(total) * F.col("m3"), F.pow(m2, F.lit(1.5))).alias("skewness"),
        (F.try_divide(total * F.col("m4"), m2 * m2) - 3).alias("kurtosis"), "min", "max")
    return shaped.join(counted_quantiles(state, [0.5], ["median"], by), by).select(
        *by, "count", "mean", "std", "median", "skewness", "kurtosis", "min", "max")


def counted_ecdf(state: DataFrame, by: Sequence[str] = ("measure",)) -> DataFrame:
    """(by..., value, k, cumulative): one step for every counted row, as ``ecdf`` gives it from the rows."""
    return ecdf(state, "value", by, weight=F.col("n"))


def impute_from_counts(df: DataFrame, state: DataFrame, cols: Sequence[str], default: float = 0.0) -> DataFrame:
    """Fill nulls with the median over all counted days, and with ``default`` for a measure without values.

    ``df`` may be one new day; it is not counted here.
    """
    lookup = column_lookup(counted_quantiles(state.where(F.col("measure").isin(list(cols))), [0.5], ["median"]), ["median"], "measure")
    fill = {c: F.coalesce(F.col(c), F.try_element_at("_medians", F.lit(c))["median"], F.lit(float(default))) for c in cols}
    return df.withColumn("_medians", lookup).withColumns(fill).drop("_medians")
