"""Spatial, temporal and descriptive aggregates.

Everything here is an algebraic aggregate, so Spark combines map-side and a hot group costs one
partial row per task. Medians and percentiles go through ``order_stats`` for the same reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlattice.functions import TICKS, band, band_labels, degrees, planar_distance, ticks
from emberlattice.functions.bands import OUT_OF_RANGE
from emberlattice.operators.clean import in_box, in_month
from emberlattice.operators.lattice import edge_bins, window_overlap
from emberlattice.operators.order_stats import quantiles
from emberlattice.operators.spatial import nearest_if_lonely, points_in_boxes, radius_pairs
from emberlattice.session import materialise



def _rows(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def downsample(
    points: DataFrame, measures: Sequence[str], step: float, by: Sequence[str] = ("date",),
    closed: str = "both",
) -> DataFrame:
    """Mean of the measures per lattice window and day (by..., i, j, latitude, longitude, ...)."""
    s = round(step * TICKS)
    return (
        window_overlap(points, step, closed)
        .groupBy(*by, "i", "j")
        .agg(*[F.avg(m).alias(m) for m in measures])
        .select(
            *by, "i", "j", degrees(F.col("i") * s).alias("latitude"),
            degrees(F.col("j") * s).alias("longitude"), *measures,
        )
    )


def downsample_with_spread(
    points: DataFrame, measures: Sequence[str], step: float, by: Sequence[str] = ("date",),
    closed: str = "both",
) -> DataFrame:
    """Mean, sample deviation and range of each measure per window; spread needs two values."""
    s = round(step * TICKS)
    aggs = []
    for m in measures:
        several = F.count(m) > 1
        aggs += [
            F.avg(m).alias(m),
            F.when(several, F.stddev_samp(m)).alias(f"{m}_std"),
            F.when(several, F.max(m) - F.min(m)).alias(f"{m}_range"),
        ]
    out = window_overlap(points, step, closed).groupBy(*by, "i", "j").agg(*aggs)
    return out.withColumns(
        {"latitude": degrees(F.col("i") * s), "longitude": degrees(F.col("j") * s)}
    )


def aggregate_to_reference(
    points: DataFrame, reference: DataFrame, value: str, half: float = 0.125,
    closed: str = "both", by: Sequence[str] = ("date",),
) -> DataFrame:
    """Mean, sample deviation and non-null count of the points in each reference cell."""
    return (
        points_in_boxes(points, reference, half, closed, by)
        .groupBy(*by, "ref_latitude", "ref_longitude")
        .agg(
            F.avg(value).alias("fwi_aggregated"),
            F.stddev_samp(value).alias("fwi_std"),
            F.count(value).alias("count_1km_points"),
        )
        .withColumnsRenamed({"ref_latitude": "latitude", "ref_longitude": "longitude"})
    )


def daily_cell_mean(
    points: DataFrame, reference: DataFrame, value: str, half: float = 0.1125,
    by: Sequence[str] = ("date",),
) -> DataFrame:
    """Daily mean per half-open reference cell."""
    return (
        points_in_boxes(points, reference, half, "left", by)
        .groupBy(*by, "ref_latitude", "ref_longitude")
        .agg(F.avg(value).alias("fwi_aggregated"))
        .withColumnsRenamed({"ref_latitude": "latitude", "ref_longitude": "longitude"})
    )


def aggregate_bins(
    points: DataFrame, extent: DataFrame, value: str, step: float = 0.225,
    by: Sequence[str] = ("date",),
) -> DataFrame:
    """Mean, max, min, sample deviation and count per fixed bin."""
    return (
        edge_bins(points, extent, step, by)
        .groupBy(*by, F.col("bin_latitude").alias("latitude"), F.col("bin_longitude").alias("longitude"))
        .agg(
            F.avg(value).alias("fwi_mean"), F.max(value).alias("fwi_max"),
            F.min(value).alias("fwi_min"), F.stddev_samp(value).alias("fwi_std"),
            _rows("point_count"),
        )
    )


def temporal_mean(df: DataFrame, value: str, month: int | None = None, out: str = "fwi_mean") -> DataFrame:
    """Mean per coordinate over the table or one calendar month."""
    rows = df if month is None else in_month(df, month)
    return rows.groupBy("latitude", "longitude").agg(F.avg(value).alias(out))


def exceedance_days(
    df: DataFrame, value: str, box: Sequence[float] | None, month: int = 10, threshold: float = 40.0
) -> DataFrame:
    """Per point of the box and month: days above the threshold and days in total."""
    rows = in_month(df, month)
    if box is not None:
        rows = rows.where(in_box(box))
    return rows.groupBy("latitude", "longitude").agg(
        F.count_if(F.col(value) > threshold).alias("high_fwi_days"), _rows("total_days")
    )


def exceedance_summary(days: DataFrame) -> DataFrame:
    """Summary of ``exceedance_days``: points, points with any, mean and max of the day count."""
    return days.agg(
        _rows("n_points"),
        F.count_if(F.col("high_fwi_days") > 0).alias("n_points_with_high"),
        F.avg("high_fwi_days").alias("mean_high_days"),
        F.max("high_fwi_days").alias("max_high_days"),
        F.sum("total_days").alias("n_days"),
    )


def location_stats(df: DataFrame, value: str, prefix: str = "temp", digits: int = 2) -> DataFrame:
    def r(c):
        return F.round(c, digits)

    return df.groupBy("latitude", "longitude").agg(
        r(F.avg(value)).alias(f"{prefix}_mean"), r(F.stddev_samp(value)).alias(f"{prefix}_std"),
        r(F.min(value)).alias(f"{prefix}_min"), r(F.max(value)).alias(f"{prefix}_max"),
        F.count(value).alias("data_count"),
    )


def period_counts(df: DataFrame, measures: Sequence[str] = ()) -> DataFrame:
    """Rows, days and measure means per (year, month)."""
    return df.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        _rows("n_rows"), F.count_distinct("date").alias("n_days"),
        *[F.avg(m).alias(f"{m}_mean") for m in measures],
    )


def describe_measure(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, 25/50/75 % and max, from one ranked pass over distinct values."""
    basic = df.groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
    )
    q = quantiles(df, value, [0.25, 0.5, 0.75], ["p25", "p50", "p75"], by)
    if by:
        return basic.join(q, list(by), "left")
    one = q.select(F.struct("p25", "p50", "p75").alias("q")).scalar()
    return basic.withColumn("q", one).select("count", "mean", "std", "min", "max", "q.*")


def hottest_common_day(
    left: DataFrame, right: DataFrame, value: str, preferred: str | None = None
) -> DataFrame:
    """The common date with the highest mean of ``value`` in ``left`` (or ``preferred`` if common)."""
    days = left.join(right.select("date").distinct(), "date", "left_semi")
    per = days.groupBy("date").agg(F.avg(value).alias("fwi_mean"), F.max(value).alias("fwi_max"))
    first = F.lit(False) if preferred is None else F.col("date") == F.lit(preferred).cast("date")
    return per.orderBy(first.desc(), F.desc("fwi_mean"), "date").limit(1)


def radius_stats(
    targets: DataFrame, points: DataFrame, value: str, radius: float = 0.15,
    by: Sequence[str] = ("date",), expand: str = "left",
) -> DataFrame:
    """Mean, median, inverse-distance mean, deviation, min, max and count of the points within the
    radius of each target; the nearest point's value with count 1 when there is none."""
    by = list(by)
    sites = (
        points.where(F.col(value).isNotNull())
        .groupBy(
            *by, ticks("latitude").alias("_y"), ticks("longitude").alias("_x"),
            F.col(value).alias("value"),
        )
        .agg(_rows("copies"))
        .select(*by, degrees("_y").alias("latitude"), degrees("_x").alias("longitude"), "value", "copies")
    )
    # Stored once: the statistics, the ranking for the median and the search for lonely targets
    # read the pairs five times.
    pairs = materialise(radius_pairs(targets, sites, ["value", "copies"], radius, by, expand))
    n, v = F.col("copies"), F.col("value")
    weight = n / (planar_distance("d2") + F.lit(1e-10))
    keys = [*by, "ly", "lx"]
    total = F.sum(n)
    mean = F.sum(n * v) / total
    stats = pairs.groupBy(*keys).agg(
        mean.alias("fwi_aggregated_mean"),
        F.when(total > 1, F.sum(weight * v) / F.sum(weight)).otherwise(mean)
        .alias("fwi_aggregated_weighted"),
        F.min(v).alias("fwi_min"),
        F.max(v).alias("fwi_max"),
        total.alias("count_1km_points"),
    )
    # Squares of deviations from the stored mean: nothing cancels, whatever the values' offset.
    gap = v - F.col("_m")
    centred = pairs.join(stats.select(*keys, F.col("fwi_aggregated_mean").alias("_m")), keys)
    spread = centred.groupBy(*keys).agg(
        F.sqrt(F.sum(n * gap * gap) / total).alias("fwi_std"),
        F.percentile(v, F.lit(0.5), n).alias("fwi_aggregated_median"))
    inside = stats.join(spread, keys)
    alone = nearest_if_lonely(targets, sites, ["value"], radius, by, found=pairs).select(
        *keys,
        *[v.alias(c) for c in ("fwi_aggregated_mean", "fwi_aggregated_median",
                               "fwi_aggregated_weighted", "fwi_min", "fwi_max")],
        F.lit(0.0).alias("fwi_std"),
        F.lit(1).cast("long").alias("count_1km_points"),
    )
    return (
        inside.unionByName(alone)
        .withColumns({"latitude": degrees("ly"), "longitude": degrees("lx")})
        .drop("ly", "lx")
    )


def risk_distribution(
    df: DataFrame, value: str, edges: Sequence[float], closed: str = "left"
) -> DataFrame:
    """(band, n, pct) for each band, empty ones and ``out_of_range`` included; pct of all rows."""
    labels = [*band_labels(list(edges)), OUT_OF_RANGE]
    tagged = df.select(band(value, list(edges), closed).alias("b"))
    row = tagged.agg(
        _rows("total"), *[F.count_if(F.col("b") == lab).alias(f"c{k}") for k, lab in enumerate(labels)]
    )
    stacked = F.explode(
        F.array(*[F.struct(F.lit(lab).alias("band"), F.col(f"c{k}").alias("n"))
                  for k, lab in enumerate(labels)])
    )
    return row.select("total", stacked.alias("s")).select(
        "s.band", "s.n", F.try_divide(F.col("s.n") * 100.0, F.col("total")).alias("pct")
    )


def daily_series(merged: DataFrame, observed: str, predicted: str, by: Sequence[str] = ("date",)) -> DataFrame:
    """Mean observed and predicted per date (or per coordinate with other keys)."""
    return merged.groupBy(*by).agg(
        F.avg(observed).alias("observed_mean"), F.avg(predicted).alias("predicted_mean"), _rows("n")
    )


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts and percentages per category."""
    counts = df.groupBy(F.col(col).alias("category")).agg(_rows("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))


def mode_per_cell(df: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """Most frequent code per cell, the smallest code on a tie. Two combinable aggregations."""
    counts = df.groupBy(*keys, code).agg(_rows("n"))
    top = F.max(F.struct(F.col("n"), (-F.col(code)).alias("neg")))
    return counts.groupBy(*keys).agg((-top["neg"]).alias(code))


def class_area(df: DataFrame, code: str = "landcover", label: str = "landcover_class") -> DataFrame:
    """Pixels, share and area in km2 (10 m pixels) per class."""
    counts = df.groupBy(code, label).agg(_rows("pixel_count"))
    return counts.withColumns(
        {
            "percentage": F.col("pixel_count") * 100.0 / F.sum("pixel_count").over(W.partitionBy()),
            "area_km2": F.col("pixel_count") * 100 / 1e6,
        }
    )


def coverage(df: DataFrame, date: str = "date") -> DataFrame:
    """Distinct points and dates, and the date and coordinate ranges."""
    return df.agg(
        _rows("n_rows"), F.count_distinct("latitude", "longitude").alias("n_points"),
        F.count_distinct(date).alias("n_dates"), F.min(date).alias("first_date"),
        F.max(date).alias("last_date"), F.min("latitude").alias("lat_min"),
        F.max("latitude").alias("lat_max"), F.min("longitude").alias("lon_min"),
        F.max("longitude").alias("lon_max"),
    )


def points_per_cell(cells: DataFrame, count: str) -> DataFrame:
    return cells.agg(
        F.avg(count).alias("mean_points"), F.min(count).alias("min_points"),
        F.max(count).alias("max_points"),
    )


def cell_uncertainty(cells: DataFrame, std: str = "fwi_std", count: str = "point_count") -> DataFrame:
    """Mean, max and 95 % quantile of the within-cell deviation, and mean points per cell."""
    q = quantiles(cells, std, [0.95], ["q"]).scalar()
    return cells.agg(
        F.avg(std).alias("mean_std"), F.max(std).alias("max_std"), F.avg(count).alias("mean_points")
    ).withColumn("p95_std", q)


def region_stats(tagged: DataFrame, value: str, extreme: float = 50.0) -> DataFrame:
    return tagged.groupBy("region").agg(
        _rows("n_points"), F.avg(value).alias("mean_fwi"), F.max(value).alias("max_fwi"),
        F.count_if(F.col(value) > extreme).alias("n_extreme"),
    )


def enhancement_ratio(predicted: DataFrame, source: DataFrame) -> DataFrame:
    """Predicted rows per source row."""
    n = source.agg(_rows("n_source")).scalar()
    return predicted.agg(_rows("n_predicted")).select(
        "n_predicted", n.alias("n_source"),
    ).withColumn("ratio", F.try_divide(F.col("n_predicted"), F.col("n_source")))
