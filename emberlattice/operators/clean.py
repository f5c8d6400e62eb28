"""Projection, filtering and cleaning of daily tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlattice.functions import clip, finite, not_nan, round_coord, row_digest, wrap
from emberlattice.operators.order_stats import column_lookup, column_quantiles, unpivot_columns
from emberlattice.schema import KEYS

# ---- Fixed values: name fragments of each role, in order of preference ------------------------
ALIASES = {
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon"],
    "date": ["date", "time"],
    "10m_u_component_of_wind": ["10m_u_component_of_wind", "u10"],
    "10m_v_component_of_wind": ["10m_v_component_of_wind", "v10"],
    "2m_dewpoint_temperature": ["2m_dewpoint_temperature", "d2m"],
    "total_precipitation": ["total_precipitation", "tp"],
}
EXPOSURE_FIRST = ["value", "exposure"]
EXPOSURE_SECOND = ["pop", "asset", "gdp", "income"]
# ------------------------------------------------------------------------------------------------


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Rename columns to their roles: exact alias first, then first column containing one."""
    renames, free = {}, list(df.columns)
    for role, names in aliases.items():
        if role in free:
            free.remove(role)
            continue
        exact = [c for n in names for c in free if c.lower() == n.lower()]
        partial = [c for n in names for c in free if n.lower() in c.lower()]
        if exact or partial:
            chosen = (exact or partial)[0]
            free.remove(chosen)
            renames[chosen] = role
    return df.withColumnsRenamed(renames)


def resolve_exposure(df: DataFrame, out: str = "exposure_value") -> DataFrame:
    """Copy the exposure measure to ``out``; 1.0 when no column looks like one."""
    for words in (EXPOSURE_FIRST, EXPOSURE_SECOND):
        for c in df.columns:
            if any(w in c.lower() for w in words):
                return df.withColumn(out, F.col(c).cast("double"))
    return df.withColumn(out, F.lit(1.0))


def round_coords(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.withColumns({lat: round_coord(lat), lon: round_coord(lon)})


def wrap_longitude(df: DataFrame, lon: str = "longitude") -> DataFrame:
    """Wrap to -180..180 when any longitude of the table exceeds 180; otherwise unchanged."""
    over = df.agg((F.max(lon) > 180).alias("o")).scalar()
    return df.withColumn(lon, F.when(over, wrap(lon)).otherwise(F.col(lon)))


def parse_date(df: DataFrame, source: str, out: str = "date") -> DataFrame:
    """Text or timestamp to date; text that is no date becomes null."""
    return df.withColumn(out, F.to_date(F.try_to_timestamp(F.col(source).cast("string"))))


def calendar_parts(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(
        {"year": F.year(date), "month": F.month(date), "day": F.dayofmonth(date)}
    )


def in_box(box: Sequence[float], lat: str = "latitude", lon: str = "longitude") -> Column:
    south, north, west, east = box
    return F.col(lat).between(south, north) & F.col(lon).between(west, east)


def filter_bbox(df: DataFrame, box: Sequence[float], lat: str = "latitude", lon: str = "longitude"):
    """Closed box filter, pushed to the scan."""
    return df.where(in_box(box, lat, lon))


def filter_bbox_or_widen(df: DataFrame, boxes: Sequence[Sequence[float]]) -> DataFrame:
    """Rows of the first box that holds any row; all rows when none does."""
    tier = F.coalesce(
        *[F.when(in_box(b), F.lit(k)) for k, b in enumerate(boxes)], F.lit(len(boxes))
    )
    best = df.agg(F.min(tier).alias("t")).scalar()
    return df.where(tier <= best)


def tag_regions(
    df: DataFrame, regions: Sequence[tuple], lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """One row per (row, named box holding it); boxes may overlap.

    The few boxes are an array of the matching names, so no join is planned.
    """
    names = F.array(*[F.when(in_box(box, lat, lon), F.lit(name)) for name, *box in regions])
    return df.withColumn("region", F.explode(F.array_compact(names)))


def nan_to_null(df: DataFrame, leave: Sequence[str] = ()) -> DataFrame:
    """NaN as null in every floating column but those left as they are."""
    floats = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in leave]
    return df.withColumns({c: not_nan(f"`{c}`") for c in floats}) if floats else df


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows where any of the columns is null or NaN."""
    return df.dropna(subset=list(cols))


def dedupe_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Keep the first row of each key in the order of the remaining columns.

    A min over structs, so copies of a hot key collapse before the shuffle.
    """
    rest = list(order or [c for c in df.columns if c not in keys])
    rest += [c for c in df.columns if c not in keys and c not in rest]
    if not rest:
        return df.select(*keys).distinct()
    first = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r"))
    return first.select(*keys, "r.*").select(*df.columns)


def dedupe_mean(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures])


def on_day(df: DataFrame, day: str, date: str = "date") -> DataFrame:
    return df.where(F.col(date) == F.lit(day).cast("date"))


def in_month(df: DataFrame, month: int, date: str = "date") -> DataFrame:
    return df.where(F.month(date) == month)


def on_month_day(df: DataFrame, month_day: str, date: str = "date") -> DataFrame:
    return df.where(F.date_format(date, "MM-dd") == month_day)


def in_year(df: DataFrame, year: int, date: str = "date") -> DataFrame:
    """A range predicate, so the scan can prune by partition or row-group statistics."""
    low, high = F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year + 1}-01-01").cast("date")
    return df.where((F.col(date) >= low) & (F.col(date) < high))


def clip_columns(df: DataFrame, cols: Sequence[str], low: float, high: float) -> DataFrame:
    return df.withColumns({c: clip(c, low, high) for c in cols})


def winsorize(
    df: DataFrame, cols: Sequence[str], low: float = 0.001, high: float = 0.999
) -> DataFrame:
    """Clip each column to its own quantiles of finite values."""
    usable = df.select(*[finite(c).alias(c) for c in cols])
    stats = column_quantiles(usable, cols, [low, high], ["lo", "hi"])
    lookup = column_lookup(stats, ["lo", "hi"])
    out = df.withColumn("_q", lookup)
    return out.withColumns(
        {
            c: F.when(
                F.col(c).isNotNull(),
                F.greatest(F.col("_q")[c]["lo"], F.least(F.col("_q")[c]["hi"], F.col(c))),
            )
            for c in cols
        }
    ).drop("_q")


def finite_or_null(df: DataFrame, cols: Sequence[str], limit: float = 1e10) -> DataFrame:
    return df.withColumns({c: finite(c, limit) for c in cols})


def impute_median(df: DataFrame, cols: Sequence[str], default: float = 0.0) -> DataFrame:
    """Fill nulls with the column median, and with ``default`` when the column has no value."""
    stats = column_quantiles(df.select(*cols), cols, [0.5], ["median"])
    lookup = column_lookup(stats, ["median"])
    return df.withColumn("_q", lookup).withColumns(
        {
            c: F.coalesce(F.col(c), F.try_element_at("_q", F.lit(c))["median"], F.lit(float(default)))
            for c in cols
        }
    ).drop("_q")


def constant_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, is_constant) for each column: zero or undefined variance."""
    return (
        unpivot_columns(df, cols)
        .groupBy(F.col("column").alias("feature"))
        .agg((F.coalesce(F.max("x") == F.min("x"), F.lit(True))).alias("is_constant"))
    )


def drop_constant_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the constant columns. Reads one row of flags to fix the schema."""
    flags = df.agg(
        *[F.coalesce(F.max(c) == F.min(c), F.lit(True)).alias(c) for c in cols]
    ).first()
    return df.drop(*[c for c in cols if flags[c]])


def numeric_columns(df: DataFrame, prefix: str = "") -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name.startswith(prefix)
    ]


def select_features(df: DataFrame, prefix: str, exclude: Sequence[str] = ()) -> list[str]:
    """Names of numeric columns with the prefix that are not entirely null."""
    names = [c for c in numeric_columns(df, prefix) if c not in exclude]
    counts = df.agg(*[F.count(f"`{c}`").alias(c) for c in names]).first()
    return [c for c in names if counts[c] > 0]


def completeness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, pct_complete): percentage of non-null values."""
    cols = list(cols or df.columns)
    row = df.agg(*[(F.avg(F.col(c).isNotNull().cast("double")) * 100).alias(c) for c in cols])
    return unpivot_columns(row, cols).withColumnRenamed("x", "pct_complete")


def quality_counts(df: DataFrame, value: str, high: float = 100.0) -> DataFrame:
    return df.agg(
        F.count_if(F.col(value) < 0).alias("n_negative"),
        F.count_if(F.col(value) > high).alias("n_above"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
    )


def with_lineage(
    df: DataFrame, method: str, source: str, target: str, score: float, run_time: str
) -> DataFrame:
    return df.withColumns(
        {
            "prediction_method": F.lit(method),
            "source_resolution": F.lit(source),
            "target_resolution": F.lit(target),
            "model_cv_score": F.lit(float(score)),
            "prediction_timestamp": F.lit(run_time),
        }
    )


def cap_at_quantile(df: DataFrame, col: str, q: float = 0.99) -> DataFrame:
    """Drop non-positive values, then add ``<col>_capped``: values limited to their quantile."""
    from emberlattice.operators.order_stats import quantiles

    positive = df.where(F.col(col) > 0)
    top = quantiles(positive, col, [q], ["q"]).scalar()
    return positive.withColumn(f"{col}_capped", F.least(F.col(col), top))


def log10_if_wide(df: DataFrame, col: str, ratio: float = 1000.0) -> DataFrame:
    """Add ``<col>_scaled``: log10 when all values are positive and span more than ``ratio``."""
    wide = df.agg(
        F.coalesce((F.min(col) > 0) & (F.try_divide(F.max(col), F.min(col)) > ratio), F.lit(False))
        .alias("w")
    ).scalar()
    return df.withColumn(f"{col}_scaled", F.when(wide, F.log10(col)).otherwise(F.col(col)))


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash of the keys: same rows for any partitioning."""
    rest = [c for c in df.columns if c not in keys]
    return df.orderBy(row_digest(keys, seed), *keys, *rest).limit(n)


def residuals(df: DataFrame, predicted: str, truth: str, out: str = "residual") -> DataFrame:
    return df.withColumn(out, F.col(predicted) - F.col(truth))


def filter_above(df: DataFrame, value: str, threshold: float) -> DataFrame:
    return df.where(F.col(value) > threshold)


def first_dates(df: DataFrame, k: int | None = None, date: str = "date") -> DataFrame:
    """Rows of the k earliest dates; all rows when k is None."""
    if k is None:
        return df
    wanted = df.select(date).distinct().orderBy(date).limit(k)
    return df.join(wanted, date, "left_semi")


def min_group_size(df: DataFrame, keys: Sequence[str], minimum: int) -> DataFrame:
    """Rows of groups with at least ``minimum`` rows."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum)
    return df.join(big.select(*keys), list(keys), "left_semi")


def distinct_coordinates(df: DataFrame, keys: Sequence[str] = ("latitude", "longitude")) -> DataFrame:
    return df.select(*keys).distinct()


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing from a frame are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sort_daily(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.orderBy(*keys)
