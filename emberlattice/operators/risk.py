"""Exposure matching and vulnerability ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlattice.functions import latitude_band, risk_category
from emberlattice.operators.aggregate import temporal_mean
from emberlattice.operators.clean import in_box, on_day, resolve_exposure
from emberlattice.operators.order_stats import min_max_scale, percent_rank_average, quantiles
from emberlattice.operators.spatial import nearest_join
from emberlattice.schema import KM_PER_DEGREE

# ---- Fixed values: weights of the weighted method ----------------------------------------------
FWI_WEIGHT, EXPOSURE_WEIGHT = 0.7, 0.3
# -------------------------------------------------------------------------------------------------


def exposure_match(
    fwi: DataFrame, exposure: DataFrame, value: str = "fwi", day: str | None = None
) -> DataFrame:
    """Each exposure point with its nearest FWI value: of one day, or the mean over all days.

    Adds fwi_value, match_distance_km, nearest_fwi_lat/lon, match_date and exposure_value.
    """
    if day is None:
        points = temporal_mean(fwi, value, out="fwi_value")
    else:
        points = on_day(fwi, day).select("latitude", "longitude", F.col(value).alias("fwi_value"))
    matched = nearest_join(exposure, points, ["fwi_value"], by=(), expand="right")
    return (
        resolve_exposure(matched)
        .withColumn("match_distance_km", F.col("distance") * F.lit(KM_PER_DEGREE))
        .withColumn("match_date", F.lit(day if day is not None else "mean"))
        .withColumnsRenamed({"near_latitude": "nearest_fwi_lat", "near_longitude": "nearest_fwi_lon"})
        .drop("distance")
    )


def risk_score(matched: DataFrame, method: str = "simple") -> DataFrame:
    """Add ``risk``: FWI x exposure, the product of both scaled to 0..1, or that product weighted.

    The weighted form is a product too, so its weights only rescale the result.
    """
    if method == "simple":
        return matched.withColumn("risk", F.col("fwi_value") * F.col("exposure_value"))
    scaled = min_max_scale(matched, ["fwi_value", "exposure_value"], "_normalized")
    f, e = F.col("fwi_value_normalized"), F.col("exposure_value_normalized")
    if method == "normalized":
        return scaled.withColumn("risk", f * e)
    if method == "weighted":
        return scaled.withColumn("risk", (F.lit(FWI_WEIGHT) * f) * (F.lit(EXPOSURE_WEIGHT) * e))
    raise ValueError(f"unknown risk method {method!r}")


def classify_risk(scored: DataFrame, risk: str = "risk") -> DataFrame:
    """Add the average-rank percentile and its category."""
    ranked = percent_rank_average(scored, risk, "risk_percentile")
    return ranked.withColumn("risk_category", risk_category("risk_percentile"))


def high_risk_summary(scored: DataFrame, risk: str = "risk", q: float = 0.9) -> DataFrame:
    """One row about the points at or above the q quantile of risk."""
    threshold = quantiles(scored, risk, [q], ["t"]).scalar()
    rows = scored.withColumn("threshold", threshold).where(F.col(risk) >= F.col("threshold"))
    band = latitude_band("latitude")
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("n_points"), F.max("threshold").alias("threshold"),
        F.avg("fwi_value").alias("mean_fwi"), F.avg("exposure_value").alias("mean_exposure"),
        F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
        F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"),
        *[
            expr for name in ("North", "Central", "South")
            for expr in (
                F.count_if(band == name).alias(f"n_{name.lower()}"),
                F.try_divide(F.count_if(band == name) * 100.0, n).alias(f"pct_{name.lower()}"),
            )
        ],
        F.avg("latitude").alias("centre_lat"), F.avg("longitude").alias("centre_lon"),
    )


def top_risk_points(scored: DataFrame, risk: str = "risk", k: int = 10) -> DataFrame:
    return scored.orderBy(F.desc(risk), "latitude", "longitude", *[
        c for c in scored.columns if c not in (risk, "latitude", "longitude")
    ]).limit(k)


def map_exposure(scored: DataFrame, box: Sequence[float]) -> DataFrame:
    """Rows of the box with positive exposure, exposure capped at its 99 % quantile."""
    from emberlattice.operators.clean import cap_at_quantile

    return cap_at_quantile(scored.where(in_box(box)), "exposure_value", 0.99)
