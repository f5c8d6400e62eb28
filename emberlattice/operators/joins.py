"""Key joins between daily tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlattice.functions import degrees, ticks
from emberlattice.operators.spatial import nearest_within
from emberlattice.schema import KEYS
from emberlattice.session import written


def _common_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[str]:
    common = [k for k in keys if k in left.columns and k in right.columns]
    if len(common) < 2:
        raise ValueError(f"need two common keys of {list(keys)}, found {common}")
    return common


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coordinates replaced by integer milli-degrees, the join keys of daily tables."""
    swap = {k: ticks(k, 1000) for k in keys if k in ("latitude", "longitude")}
    return df.withColumns(swap) if swap else df


def _unkeyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumns({k: degrees(k, 1000) for k in keys if k in ("latitude", "longitude")})


def merge_daily(
    base: DataFrame, other: DataFrame, name: str, keys: Sequence[str] = KEYS, how: str = "inner"
) -> DataFrame:
    """Join on the available keys; clashing measures of ``other`` get the suffix ``_name``."""
    on = _common_keys(base, other, keys)
    clash = [c for c in other.columns if c in base.columns and c not in on]
    renamed = other.withColumnsRenamed({c: f"{c}_{name}" for c in clash})
    return _unkeyed(_keyed(base, on).join(_keyed(renamed, on), on, how), on)


def retention_share(base: DataFrame, other: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(n_base, n_joined, share): how much of the base an inner merge keeps."""
    on = _common_keys(base, other, keys)
    hits = _keyed(other, on).groupBy(*on).agg(F.count(F.lit(1)).alias("copies"))
    return (
        _keyed(base, on).select(*on).join(hits, on, "left")
        .agg(
            F.count(F.lit(1)).alias("n_base"),
            F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("n_joined"),
        )
        .withColumn("share", F.try_divide(F.col("n_joined"), F.col("n_base")))
    )


def retention_gated_merge(
    base: DataFrame,
    other: DataFrame,
    name: str,
    measures: Sequence[str],
    keys: Sequence[str] = KEYS,
    minimum: float = 0.1,
    nearest_minimum: float = 0.8,
    tolerance: float = 0.1,
) -> DataFrame:
    """Inner merge if it keeps more than ``minimum`` of the base; else the nearest-point merge if
    that keeps more than ``nearest_minimum``; else the base unchanged.

    The branch depends on two counts, which are read here; the nearest matches are stored for the second.
    """
    counts = retention_share(base, other, keys).first()
    if counts["share"] is not None and counts["share"] > minimum:
        return merge_daily(base, other, name, keys)
    by = [k for k in keys if k not in ("latitude", "longitude") and k in base.columns]
    near = written(nearest_within(base, other, measures, tolerance, by=by).drop(
        "distance", "near_latitude", "near_longitude"
    ))
    if counts["n_base"] and near.count() / counts["n_base"] > nearest_minimum:
        return near
    return base


def merge_variables(frames: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Chain of full outer joins on the keys, one variable column per frame.

    Coordinates meet as integer milli-degrees, so float noise does not part equal points.
    """
    on = list(keys)
    joined = reduce(lambda a, b: a.join(b, on, "full_outer"), [_keyed(f, on) for f in frames])
    return _unkeyed(joined, on)


def overlay_last_wins(frames: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key, coordinates in milli-degrees; each variable is the last frame's that has one."""
    tagged = [_keyed(f, keys).withColumn("_file", F.lit(k)) for k, f in enumerate(frames)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    variables = [c for c in stacked.columns if c not in (*keys, "_file")]
    # max of (file, value) over rows that have a value; equal files keep the largest value.
    last = [
        F.max(F.when(F.col(v).isNotNull(), F.struct("_file", v)))[v].alias(v) for v in variables
    ]
    return _unkeyed(stacked.groupBy(*keys).agg(*last), keys)


def left_join_zero(left: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join; numeric columns of the right side become 0 where absent."""
    added = [c for c in counts.columns if c not in keys]
    return left.join(counts, list(keys), "left").fillna(0, subset=added)


def validate_merge(
    aggregated: DataFrame, reference: DataFrame, pair: tuple[str, str],
    keys: Sequence[str] = KEYS, name: str = "reference",
) -> DataFrame:
    """Inner merge of aggregated and reference values; rows missing either are dropped."""
    return merge_daily(aggregated, reference, name, keys).dropna(subset=list(pair))


def common_dates(left: DataFrame, right: DataFrame, date: str = "date") -> DataFrame:
    return left.select(date).intersect(right.select(date))
