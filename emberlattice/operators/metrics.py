"""Scores of predictions against reference values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlattice.functions import finite, pearson, quality_label
from emberlattice.operators.order_stats import quantiles, unpivot_columns

SIMPSON_STEPS = 600


def _cosine_integral(power: Column, start: Column, end: Column) -> Column:
    """Simpson integral of cos(t)^power over [start, end]; runs once per result row."""
    width = (end - start) / F.lit(SIMPSON_STEPS)

    def term(total, k):
        weight = (
            F.when((k == 0) | (k == SIMPSON_STEPS), 1.0).when(F.pmod(k, F.lit(2)) == 1, 4.0)
            .otherwise(2.0)
        )
        return total + weight * F.pow(F.greatest(F.cos(start + width * k), F.lit(0.0)), power)

    steps = F.sequence(F.lit(0), F.lit(SIMPSON_STEPS))
    return F.aggregate(steps, F.lit(0.0), term) * width / F.lit(3.0)


def pearson_p_value(r: Column, n: Column) -> Column:
    """Two-sided p value of a Pearson correlation.

    With t = tan(a) * sqrt(df) the Student tail is a ratio of integrals of cos(a)^(df-1), which
    needs no gamma function. The integrand is negligible beyond 12 / sqrt(df).
    """
    df = (n - F.lit(2)).cast("double")
    end = F.least(F.lit(1.5707963267948966), F.lit(12.0) / F.sqrt(df))
    start = F.asin(F.least(F.abs(r), F.lit(1.0)))
    tail = _cosine_integral(df - 1, F.least(start, end), end)
    whole = _cosine_integral(df - 1, F.lit(0.0), end)
    return F.when(n > 2, F.when(start >= end, F.lit(0.0)).otherwise(tail / whole))


def score_columns(truth: str, pred: str) -> list[Column]:
    """Algebraic aggregates of one scoring pass; both columns must be non-null."""
    t, p = F.col(truth), F.col(pred)
    err = p - t
    n = F.count(F.lit(1))
    sse = F.sum(err * err)
    sst = F.var_pop(truth) * n
    varied = (F.min(t) < F.max(t)) & (F.min(p) < F.max(p))
    return [
        n.alias("n_points"),
        F.when(varied, F.try_divide(F.covar_pop(t, p), F.stddev_pop(t) * F.stddev_pop(p)))
        .alias("correlation"),
        F.when(F.min(t) < F.max(t), 1 - F.try_divide(sse, sst)).alias("r_squared"),
        F.sqrt(sse / n).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err).alias("bias"),
        F.avg(t).alias("truth_mean"),
        F.avg(p).alias("pred_mean"),
    ]


def finite_pairs(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.where(
        finite(truth, float("inf")).isNotNull() & finite(pred, float("inf")).isNotNull()
    )


def global_metrics(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """r, p value, R2, RMSE, MAE, both relative errors in %, bias and n over finite pairs."""
    scored = finite_pairs(df, truth, pred).groupBy(*by).agg(*score_columns(truth, pred))
    return scored.withColumns(
        {
            "p_value": pearson_p_value(F.col("correlation"), F.col("n_points")),
            "relative_rmse": F.try_divide(F.col("rmse") * 100, F.col("truth_mean")),
            "relative_mae": F.try_divide(F.col("mae") * 100, F.col("truth_mean")),
        }
    )


def grid_point_metrics(
    merged: DataFrame, truth: str, pred: str, minimum: int = 10,
    keys: Sequence[str] = ("latitude", "longitude"),
) -> DataFrame:
    """Scores per point with at least ``minimum`` pairs: both R2 definitions, no null rows needed."""
    scored = merged.dropna(subset=[truth, pred]).groupBy(*keys).agg(*score_columns(truth, pred))
    return (
        scored.where(F.col("n_points") >= minimum)
        .withColumnRenamed("r_squared", "r_squared_alt")
        .withColumn("r_squared", F.col("correlation") * F.col("correlation"))
        .withColumnsRenamed({"truth_mean": "real_mean"})
    )


def metrics_by_method(df: DataFrame, truth: str, methods: dict[str, str]) -> DataFrame:
    """One row of scores per method column."""
    rows = F.explode(
        F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("pred"))
                  for m, c in methods.items()])
    )
    long = df.select(F.col(truth).alias("truth"), rows.alias("s")).select("truth", "s.method", "s.pred")
    return global_metrics(long, "truth", "pred", ["method"])


def metric_summary(metrics: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(metric, mean, median, std, min, max): one row per metric column."""
    long = unpivot_columns(metrics, cols).withColumnRenamed("column", "metric")
    basic = long.groupBy("metric").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    return basic.join(quantiles(long, "x", [0.5], ["median"], ["metric"]), "metric", "left")


def performance_bands(metrics: DataFrame) -> DataFrame:
    """(measure, band, n, pct): points per correlation and R2 band, and high performers."""
    from emberlattice.functions import correlation_band, r2_band

    median = quantiles(metrics, "rmse", [0.5], ["m"]).scalar()
    groups = [
        ("correlation", correlation_band("correlation")), ("r_squared", r2_band("r_squared")),
    ]
    names = ["Excellent", "Good", "Fair", "Poor"]
    tagged = metrics.select(
        *[label.alias(name) for name, label in groups],
        ((F.col("r_squared") > 0.5) & (F.col("rmse") < median)).alias("high"),
    )
    cells = [(g, b, F.count_if(F.col(g) == b)) for g, _ in groups for b in names]
    cells.append(("combined", "High performance", F.count_if(F.col("high"))))
    row = tagged.agg(
        F.count(F.lit(1)).alias("total"), *[c.alias(f"c{k}") for k, (_, _, c) in enumerate(cells)]
    )
    stacked = F.explode(
        F.array(*[
            F.struct(F.lit(g).alias("measure"), F.lit(b).alias("band"), F.col(f"c{k}").alias("n"))
            for k, (g, b, _) in enumerate(cells)
        ])
    )
    return row.select("total", stacked.alias("s")).select(
        "s.*", F.try_divide(F.col("s.n") * 100.0, F.col("total")).alias("pct")
    )


def model_leaderboard(scores: DataFrame, model: str = "model") -> DataFrame:
    """Scores sorted by R2, best first, with a quality label. One row per model."""
    return scores.withColumn("quality", quality_label("r_squared")).orderBy(
        F.desc_nulls_last("r_squared"), model
    )


def best_row(scores: DataFrame, metric: str, name: str = "model") -> DataFrame:
    """The row with the highest metric; the first name on a tie."""
    return scores.orderBy(F.desc_nulls_last(metric), name).limit(1)


def difference_stats(matched: DataFrame, observed: str, predicted: str, minimum: int = 5) -> DataFrame:
    """Mean, MAE and RMSE of observed - predicted; correlation with more than ``minimum`` pairs."""
    diff = F.col(observed) - F.col(predicted)
    n = F.count(diff)
    return matched.agg(
        n.alias("n_matched"), F.avg(diff).alias("mean_difference"), F.avg(F.abs(diff)).alias("mae"),
        F.sqrt(F.avg(diff * diff)).alias("rmse"),
        F.when(n > minimum, pearson(observed, predicted)).alias("correlation"),
    )


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row with a Pearson correlation per (name, left, right)."""
    return df.agg(*[pearson(a, b).alias(name) for name, a, b in pairs])
