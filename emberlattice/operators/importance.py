"""Feature-importance tables (model, feature, score)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlattice.functions import clean_name
from emberlattice.operators.order_stats import quantiles, top_k_per_group
from emberlattice.schema import FEATURE_CATEGORIES, SUMMARY_CATEGORIES


def normalise_by_model(scores: DataFrame, out: str = "normalised") -> DataFrame:
    """score / highest score of the model; 0 when that is not positive."""
    top = F.max("score").over(W.partitionBy("model"))
    return scores.withColumn(out, F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0)))


def top_features(scores: DataFrame, k: int) -> DataFrame:
    return top_k_per_group(scores, ["model"], [F.desc("score"), F.col("feature")], k)


def importance_consensus(scores: DataFrame, normalised: bool = False, k: int | None = None) -> DataFrame:
    """Mean, population deviation and number of models per feature; the k best if asked."""
    rows = normalise_by_model(scores, "s") if normalised else scores.withColumn("s", F.col("score"))
    out = rows.groupBy("feature").agg(
        F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.count("s").alias("n_models")
    )
    return out if k is None else out.orderBy(F.desc("mean"), "feature").limit(k)


def _categories(df: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per (row, category with a keyword inside the feature name)."""
    name = F.lower("feature")
    hits = []
    for category, words in categories.items():
        match = F.lit(False)
        for w in words:
            match = match | F.contains(name, F.lit(w))
        hits.append(F.when(match, F.lit(category)))
    return df.withColumn("category", F.explode(F.array_compact(F.array(*hits))))


def importance_by_category(
    scores: DataFrame, by: Sequence[str] = ("model",), value: str = "score",
    categories: Mapping[str, Sequence[str]] = FEATURE_CATEGORIES,
) -> DataFrame:
    """Total, mean and count of the scores per category; a feature may count in several.

    Every category is listed for each group; without a feature in it total, mean and count are 0.
    """
    names = F.explode(F.array(*[F.lit(c) for c in categories]))
    blank = scores.select(*by).distinct().select(*by, names.alias("category"), F.lit(None).cast("double").alias(value))
    found = _categories(scores, categories).select(*by, "category", F.col(value).cast("double").alias(value))
    return found.unionByName(blank).groupBy(*by, "category").agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
        F.count(value).alias("n_features")
    )


def feature_type_counts(features: DataFrame) -> DataFrame:
    """Features per family, decided by name."""
    name = F.col("feature")
    spread = name.contains("_variability") | name.contains("_spatial_range")
    family = (
        F.when(name.contains("feature_downscaled_") & ~spread, "Downscaled Meteorological")
        .when(name.contains("feature_spatial_"), "Spatial Context")
        .when(name.contains("feature_gradient_"), "Gradient Features")
        .when(spread, "Variability Features")
    )
    return (
        features.select("feature").distinct()
        .groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n_features"))
        .where("family IS NOT NULL")
    )


def feature_summary_counts(features: DataFrame) -> DataFrame:
    """Features per summary category, each counted once; other downscaled ones as Temperature."""
    name = F.lower("feature")
    label = F.when(F.lit(False), F.lit(""))
    for category, words in SUMMARY_CATEGORIES.items():
        match = F.lit(False)
        for w in words:
            match = match | F.contains(name, F.lit(w))
        label = label.when(match, F.lit(category))
    label = label.when(F.contains(name, F.lit("feature_downscaled_")), F.lit("Temperature"))
    return (
        features.select("feature").distinct().withColumn("category", label)
        .where("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n_features"))
    )


def importance_matrix(scores: DataFrame, models: Sequence[str], k: int | None = None) -> DataFrame:
    """Feature x model matrix, absent 0, each model scaled by its maximum; the k best rows by mean if asked."""
    wide = normalise_by_model(scores).groupBy("feature").pivot("model", list(models)).agg(
        F.max("normalised")
    ).fillna(0.0)
    total = sum((F.col(m) for m in models), F.lit(0.0))
    ranked = wide.withColumn("row_mean", total / len(models))
    best = ranked if k is None else ranked.orderBy(F.desc("row_mean"), "feature").limit(k)
    return best.withColumn("label", clean_name("feature"))


def importance_distribution(scores: DataFrame) -> DataFrame:
    """Mean, deviation and median of all scores."""
    median = quantiles(scores, "score", [0.5], ["m"]).scalar()
    return scores.agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")
    ).withColumn("median", median)


def feature_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Distinct feature names over several models."""
    out = frames[0].select("feature")
    for f in frames[1:]:
        out = out.union(f.select("feature"))
    return out.distinct()
