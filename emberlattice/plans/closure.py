"""Predict fine, aggregate back, compare with the source grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlattice.operators.clean import drop_missing, filter_bbox_or_widen, round_coords
from emberlattice.operators.joins import merge_daily, validate_merge
from emberlattice.operators.metrics import global_metrics, model_leaderboard
from emberlattice.operators.order_stats import quantile_columns, ranked_counts
from emberlattice.operators.spatial import points_in_boxes
from emberlattice.schema import KEYS, MERGE_BOX, WIDENED_BOX
from emberlattice.session import materialise


def align_inputs(
    base: DataFrame, others: Mapping[str, DataFrame], required: Sequence[str],
    boxes=(MERGE_BOX, WIDENED_BOX),
) -> DataFrame:
    """Round coordinates, keep the study box, inner-merge all tables, drop incomplete rows."""
    start = filter_bbox_or_widen(round_coords(base), boxes)
    merged = reduce(
        lambda acc, item: merge_daily(acc, round_coords(item[1]), item[0], KEYS), others.items(), start
    )
    return drop_missing(merged, required)


def validate_models(predictions: DataFrame, reference: DataFrame, value: str = "fwi_predicted") -> DataFrame:
    """(model, date, latitude, longitude, fwi_aggregated, fwi_std, count, fwi) of all models at once."""
    cells = aggregate_by_model(predictions, reference, value)
    return validate_merge(cells, reference.select(*KEYS, "fwi"), ("fwi_aggregated", "fwi"))


def aggregate_by_model(predictions: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    """The reference grid is matched per date; the model is one more grouping key."""
    return (
        points_in_boxes(predictions, reference, 0.125, "both", ["date"])
        .groupBy("model", "date", "ref_latitude", "ref_longitude")
        .agg(
            F.avg(value).alias("fwi_aggregated"), F.stddev_samp(value).alias("fwi_std"),
            F.count(value).alias("count_1km_points"),
        )
        .withColumnsRenamed({"ref_latitude": "latitude", "ref_longitude": "longitude"})
    )


def leaderboard(merged: DataFrame) -> DataFrame:
    return model_leaderboard(global_metrics(merged, "fwi", "fwi_aggregated", ["model"]))


def validation_summary(merged: DataFrame) -> DataFrame:
    """One nested row per model: metrics, spatial coverage and value distributions."""
    merged = materialise(merged)  # read once per part of the summary
    metrics = global_metrics(merged, "fwi", "fwi_aggregated", ["model"])
    names = [c for c in metrics.columns if c != "model"]
    cover = merged.groupBy("model").agg(
        F.count(F.lit(1)).alias("data_size"),
        F.struct(
            F.count_distinct("latitude", "longitude").alias("unique_coordinates"),
            F.array(F.min("latitude"), F.max("latitude")).alias("lat_range"),
            F.array(F.min("longitude"), F.max("longitude")).alias("lon_range"),
        ).alias("spatial_coverage"),
    )
    sides = F.explode(
        F.array(
            F.struct(F.lit("fwi_original").alias("side"), F.col("fwi").alias("x")),
            F.struct(F.lit("fwi_aggregated").alias("side"), F.col("fwi_aggregated").alias("x")),
        )
    )
    long = merged.select("model", sides.alias("s")).select("model", "s.side", "s.x")
    keys = ["model", "side"]
    basic = long.groupBy(*keys).agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    )
    q = ranked_counts(long, "x", keys).groupBy(*keys).agg(
        *quantile_columns([0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    )
    described = basic.join(q, keys).groupBy("model").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct("side", F.struct("count", "mean", "std", "min", "p25", "p50", "p75", "max"))
            )
        ).alias("data_distribution")
    )
    return (
        metrics.select("model", F.struct(*names).alias("metrics"))
        .join(cover, "model").join(described, "model")
    )
