"""Neighbourhood features and training pairs, one plan for all days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlattice.functions import degrees, finite, planar_distance, ticks
from emberlattice.operators.aggregate import downsample, downsample_with_spread
from emberlattice.operators.clean import min_group_size
from emberlattice.operators.order_stats import quantiles
from emberlattice.operators.spatial import (
    nearest_if_lonely, nearest_join, radius_pairs, target_keys,
)

WEIGHT_OFFSET = 0.001
# ---- Fixed values: last-resort features ---------------------------------------------------------
DEFAULT_FWI = 10.0
DEFAULT_DISTANCE = 0.1
# -------------------------------------------------------------------------------------------------


def _names(df: DataFrame) -> DataFrame:
    """Tick keys back to target coordinates."""
    return df.withColumns({"target_lat": degrees("ly"), "target_lon": degrees("lx")}).drop("ly", "lx")


def _neighbourhoods(targets, source, payload, radius, by, summarise) -> DataFrame:
    """``summarise`` applied to the pairs within the radius and to the nearest pairs of the rest.

    The two parts are summarised apart, so the first keeps the partitioning of its join.
    """
    inside = summarise(radius_pairs(targets, source, payload, radius, by, "right"))
    alone = summarise(nearest_if_lonely(targets, source, payload, radius, by, "right"))
    return _names(inside.unionByName(alone).drop("cy", "cx"))


def coarse_features(
    fine: DataFrame, coarse: DataFrame, measures: Sequence[str], radius: float,
    pick: str = "nearest", by: Sequence[str] = ("date",),
) -> DataFrame:
    """Per distinct fine point: values of the chosen coarse node, distance to the nearest node, and
    neighbourhood mean / sample deviation of each measure when several nodes are in the radius.

    ``pick='nearest'`` chooses the nearest node, ``pick='first'`` the southernmost, then westernmost.
    """
    by = list(by)
    keys = target_keys(by, "right")
    node = F.struct("ry", "rx", *measures)
    rank = F.struct("d2", "ry", "rx") if pick == "nearest" else F.struct("ry", "rx")
    aggs = [F.min_by(node, rank).alias("node"), F.min("d2").alias("d2"), F.count(F.lit(1)).alias("n")]
    for m in measures:
        several = F.count(F.lit(1)) > 1
        aggs += [
            F.when(several, F.avg(m)).alias(f"coarse_{m}_mean"),
            F.when(several & (F.count(m) > 1), F.stddev_samp(m)).alias(f"coarse_{m}_std"),
        ]
    extra = [f"coarse_{m}_{s}" for m in measures for s in ("mean", "std")]
    out = _neighbourhoods(
        fine, coarse, list(measures), radius, by, lambda pairs: pairs.groupBy(*keys).agg(*aggs)
    )
    return out.select(
        *by, "target_lat", "target_lon",
        *[F.col("node")[m].alias(f"coarse_{m}") for m in measures],
        planar_distance("d2").alias("coarse_distance"),
        degrees("node.ry").alias("coarse_lat"), degrees("node.rx").alias("coarse_lon"),
        F.col("n").alias("coarse_n"), *extra,
    )


def training_pairs(
    daily: DataFrame, measures: Sequence[str], step: float = 0.5, target: str = "fwi",
    include_target: bool = False, pick: str = "nearest", minimum: int | None = None,
) -> DataFrame:
    """Fine rows joined with features of their own downsampled day.

    Days with fewer than ``minimum`` points are left out if asked. The target leaks into its own coarse mean;
    ``include_target=True`` keeps that feature, the default leaves it out.
    """
    used = daily if minimum is None else min_group_size(daily, ["date"], minimum)
    inputs = [m for m in measures if include_target or m != target]
    nodes = downsample(used, inputs, step)
    features = coarse_features(used, nodes, inputs, 1.5 * step, pick)
    fine = used.select(
        "date", F.col("latitude").alias("fine_lat"), F.col("longitude").alias("fine_lon"),
        *[F.col(m).alias(f"fine_{m}") for m in measures],
        ticks("latitude").alias("_y"), ticks("longitude").alias("_x"),
    )
    keyed = features.withColumns({"_y": ticks("target_lat"), "_x": ticks("target_lon")})
    return fine.join(keyed, ["date", "_y", "_x"]).drop("_y", "_x")


def slope(here: tuple[Column, Column], before: Column, after: Column, at) -> Column:
    """Second-order difference on uneven spacing, one-sided at the ends, null on zero spacing.

    ``here`` is (value, place); ``at`` gives the same of a neighbour, which is null at the ends.
    """
    f, x = here
    (fb, xb), (fa, xa) = at(before), at(after)
    hs, hd = x - xb, xa - x
    central = F.try_divide(hs * hs * fa + (hd * hd - hs * hs) * f - hd * hd * fb, hs * hd * (hd + hs))
    backward = F.try_divide(f - fb, hs)
    forward = F.try_divide(fa - f, hd)
    return (
        F.when(before.isNotNull() & after.isNotNull(), central)
        .when(before.isNotNull(), backward)
        .when(after.isNotNull(), forward)
    )


def with_gradients(
    pairs: DataFrame, keys: Sequence[str], measures: Sequence[str], per_degree: float
) -> DataFrame:
    """Add ``_g_<m>_lat`` and ``_g_<m>_lon``: slope of each valid neighbour in (lat, lon) order.

    Windows hold the neighbours of one target only, which the radius bounds.
    """
    frame = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY ry, rx)"
    points = {
        f"_p_{m}": F.when(
            F.col(m).isNotNull(),
            F.struct(F.col(m).alias("f"), F.col("ry").cast("double").alias("ry"), F.col("rx").cast("double").alias("rx")),
        )
        for m in measures
    }
    beside = {}
    for p in points:
        beside[f"{p}_b"] = F.expr(f"lag({p}) IGNORE NULLS {frame}")
        beside[f"{p}_a"] = F.expr(f"lead({p}) IGNORE NULLS {frame}")
    slopes = {}
    for m in measures:
        for name, axis in (("lat", "ry"), ("lon", "rx")):
            before, after = F.col(f"_p_{m}_b"), F.col(f"_p_{m}_a")
            slopes[f"_g_{m}_{name}"] = F.when(
                F.col(m).isNotNull(), slope((F.col(m), F.col(axis).cast("double")), before, after,
                                            lambda p, axis=axis: (p["f"], p[axis])) * F.lit(per_degree)
            )
    return pairs.withColumns(points).withColumns(beside).withColumns(slopes).drop(*points, *beside)


def neighbour_gradient(
    targets: DataFrame, source: DataFrame, value: str, radius: float = 0.3,
    by: Sequence[str] = ("date",),
) -> DataFrame:
    """Mean slope of the neighbours within the radius along latitude and longitude (>= 3 needed)."""
    by = list(by)
    keys = target_keys(by, "right")
    enough = F.count(F.lit(1)) >= 3

    def summarise(pairs):
        graded = with_gradients(pairs, keys, [value], 10_000.0)
        return graded.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.when(enough, F.avg(f"_g_{value}_lat")).alias("lat_gradient"),
            F.when(enough, F.avg(f"_g_{value}_lon")).alias("lon_gradient"),
        )

    return _neighbourhoods(targets, source, [value], radius, by, summarise)


def idw_features(
    targets: DataFrame, source: DataFrame, measures: Sequence[str], radius: float = 0.3,
    gradient_of: str | None = "fwi", by: Sequence[str] = ("date",),
) -> DataFrame:
    """Inverse-distance features of each distinct target point from the source grid.

    ``coarse_<v>`` is weighted with 1/(d + 0.001), normalised over all neighbours; statistics need
    more than 2 neighbours and gradients at least 3. Targets without a neighbour use the nearest.
    The source is the small side: it is copied into the cells it reaches, targets are not. It holds
    one row per key (``dedupe_keys`` or ``dedupe_mean`` first), which bounds a neighbourhood.
    """
    by = list(by)
    keys = target_keys(by, "right")
    n = F.count(F.lit(1))
    aggs = []
    for m in measures:
        known = F.count(m)
        aggs += [
            (F.sum(F.col(m) * F.col("w")) / F.sum("w")).alias(f"coarse_{m}"),
            F.when(n > 2, F.avg(m)).alias(f"coarse_{m}_mean"),
            F.when(n > 2, F.min(m)).alias(f"coarse_{m}_min"),
            F.when(n > 2, F.max(m)).alias(f"coarse_{m}_max"),
            F.when((n > 2) & (known > 1), F.stddev_samp(m)).alias(f"coarse_{m}_std"),
            F.when((n > 2) & (known > 1), F.max(m) - F.min(m)).alias(f"coarse_{m}_range"),
        ]
    if gradient_of:
        aggs += [
            F.when(n >= 3, F.avg(f"_g_{gradient_of}_{a}")).alias(f"coarse_{gradient_of}_{a}_gradient")
            for a in ("lat", "lon")
        ]
    aggs += [
        planar_distance(F.min("d2")).alias("coarse_distance"),
        (F.avg("ry") / 10_000.0).alias("coarse_lat"),
        (F.avg("rx") / 10_000.0).alias("coarse_lon"),
        n.alias("coarse_n"),
    ]

    def summarise(pairs):
        weighted = pairs.withColumn("w", 1 / (planar_distance("d2") + F.lit(WEIGHT_OFFSET)))
        if gradient_of:
            weighted = with_gradients(weighted, keys, [gradient_of], 10_000.0)
        return weighted.groupBy(*keys).agg(*aggs)

    return _neighbourhoods(targets, source, list(measures), radius, by, summarise)


def default_features(
    targets: DataFrame, source: DataFrame, measures: Sequence[str], by: Sequence[str] = ("date",)
) -> DataFrame:
    """Nearest point's values; constants when a target has no source point at all."""
    near = nearest_join(targets, source, list(measures), by=by, how="left", expand="right")
    named = near.withColumnsRenamed({m: f"coarse_{m}" for m in measures})
    defaults = {
        "coarse_distance": F.coalesce("distance", F.lit(DEFAULT_DISTANCE)),
        "coarse_lat": F.coalesce("near_latitude", "latitude"),
        "coarse_lon": F.coalesce("near_longitude", "longitude"),
        "target_lat": F.col("latitude"),
        "target_lon": F.col("longitude"),
    }
    if "fwi" in measures:
        defaults["coarse_fwi"] = F.coalesce(
            "coarse_fwi", F.when(F.col("distance").isNull(), F.lit(DEFAULT_FWI))
        )
    return named.withColumns(defaults).drop("distance", "near_latitude", "near_longitude")


def fill_missing_features(
    features: DataFrame, names: Sequence[str], source: DataFrame, fwi: str = "fwi"
) -> DataFrame:
    """Add absent feature columns (daily median FWI, mean target position, else 0); nulls become 0."""
    absent = [n for n in names if n not in features.columns]
    out = features
    kinds = {
        n: "fwi" if "fwi" in n.lower() else "lat" if "lat" in n.lower()
        else "lon" if "lon" in n.lower() else "zero"
        for n in absent
    }
    if "fwi" in kinds.values():
        out = out.join(quantiles(source, fwi, [0.5], ["_fwi"], ["date"]), "date", "left")
    if {"lat", "lon"} & set(kinds.values()):
        means = features.groupBy("date").agg(
            F.avg("target_lat").alias("_lat"), F.avg("target_lon").alias("_lon")
        )
        out = out.join(means, "date", "left")
    value = {"fwi": lambda: F.col("_fwi"), "lat": lambda: F.col("_lat"), "lon": lambda: F.col("_lon"),
             "zero": lambda: F.lit(0.0)}
    out = out.withColumns({n: value[k]() for n, k in kinds.items()}) if kinds else out
    return out.drop("_fwi", "_lat", "_lon").fillna(0.0, subset=list(names))


def downscaled_features(
    points: DataFrame, daily: DataFrame, measures: Sequence[str], step: float = 0.5,
    radius: float = 0.75, by: Sequence[str] = ("date",),
) -> DataFrame:
    """Features of each point from the 50 km means of its day.

    Values and within-node deviations are weighted with 1/(d + 0.001) over the nodes that have a
    usable value. A point with one node in reach also gets that node's range.
    """
    by = list(by)
    keys = target_keys(by, "right")
    stats = [f"{m}{s}" for m in measures for s in ("", "_std", "_range")]
    nodes = downsample_with_spread(daily, measures, step, by)
    nodes = nodes.withColumns({c: finite(c) for c in stats})
    n = F.count(F.lit(1))

    def weighted(c):
        return F.sum(F.col(c) * F.col("w")) / F.sum(F.when(F.col(c).isNotNull(), F.col("w")))

    aggs = []
    for m in measures:
        enough = F.count(m) >= 3
        aggs += [
            weighted(m).alias(f"feature_downscaled_{m}"),
            weighted(f"{m}_std").alias(f"feature_downscaled_{m}_variability"),
            F.when(n == 1, F.max(f"{m}_range")).alias(f"feature_downscaled_{m}_spatial_range"),
            F.when(enough, F.avg(f"_g_{m}_lat")).alias(f"feature_gradient_{m}_lat"),
            F.when(enough, F.avg(f"_g_{m}_lon")).alias(f"feature_gradient_{m}_lon"),
        ]
    aggs += [
        planar_distance(F.min("d2")).alias("feature_spatial_distance_to_50km"),
        n.alias("feature_spatial_num_50km_points"),
        (F.avg("ry") / 10_000.0).alias("feature_spatial_lat_50km"),
        (F.avg("rx") / 10_000.0).alias("feature_spatial_lon_50km"),
    ]

    def summarise(pairs):
        weighted_pairs = pairs.withColumn("w", 1 / (planar_distance("d2") + F.lit(WEIGHT_OFFSET)))
        return with_gradients(weighted_pairs, keys, list(measures), 10_000.0).groupBy(*keys).agg(*aggs)

    return _neighbourhoods(points, nodes, stats, radius, by, summarise)
