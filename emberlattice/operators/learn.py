"""Model fitting, scoring and prediction with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlattice.functions import clip, row_digest, ticks
from emberlattice.operators.clean import min_group_size, sample_n
from emberlattice.operators.features import fill_missing_features, idw_features
from emberlattice.operators.lattice import expand_lattice, lattice_spec
from emberlattice.operators.metrics import global_metrics
from emberlattice.operators.order_stats import (
    column_lookup, column_quantiles, ranked_counts,
)
from emberlattice.operators.stencil import is_regular, stencil_features
from emberlattice.session import written

FEATURES, LABEL, PREDICTION = "features", "label", "prediction"


def scale_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, median, iqr) with exact interpolated quantiles; iqr of a constant column is 1."""
    q = column_quantiles(df, cols, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.select("column", "median", F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("iqr"))


def robust_scale(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """(x - median) / IQR of each column, with the statistics of ``stats`` or of the table itself."""
    lookup = column_lookup(stats if stats is not None else scale_stats(df, cols), ["median", "iqr"])
    return df.withColumn("_q", lookup).withColumns(
        {c: (F.col(c) - F.col("_q")[c]["median"]) / F.col("_q")[c]["iqr"] for c in cols}
    ).drop("_q")


def split_flag(keys: Sequence[str], test_share: float = 0.2, seed: int = 42) -> Column:
    """True for test rows: a hash of the row key, so the split does not depend on partitioning."""
    slot = F.conv(F.substring(row_digest(keys, seed), 1, 8), 16, 10).cast("long") % 10_000
    return slot < round(test_share * 10_000)


def split_rows(df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seed: int = 42):
    flagged = df.withColumn("_test", split_flag(keys, test_share, seed))
    return flagged.where("NOT _test").drop("_test"), flagged.where("_test").drop("_test")


def assemble(df: DataFrame, cols: Sequence[str], label: str | None = None) -> DataFrame:
    out = VectorAssembler(inputCols=list(cols), outputCol=FEATURES, handleInvalid="keep").transform(df)
    return out if label is None else out.withColumn(LABEL, F.col(label).cast("double"))


def _params(features: str = FEATURES):
    return {"featuresCol": features, "labelCol": LABEL, "predictionCol": PREDICTION}


def fit_gbt(train: DataFrame, trees: int = 100, depth: int = 6, rate: float = 0.1,
            subsample: float = 0.8, seed: int = 42):
    return GBTRegressor(
        maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed, **_params()
    ).fit(train)


def fit_forest(train: DataFrame, trees: int = 100, depth: int = 15, min_leaf: int = 2, seed: int = 42, bootstrap: bool = True):
    return RandomForestRegressor(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy="all",
        seed=seed, bootstrap=bootstrap, **_params()
    ).fit(train)


def fit_ridge(train: DataFrame, alpha: float = 1.0):
    """Ridge with penalty alpha * |w|^2 on the residual sum of squares.

    Spark divides the loss by 2n and the normal solver rescales by the label deviation, so the
    parameter is alpha * stddev_pop(label) / n.
    """
    row = train.agg(F.stddev_pop(LABEL).alias("s"), F.count(F.lit(1)).alias("n")).first()
    penalty = alpha * (row["s"] or 0.0) / max(row["n"], 1)
    return LinearRegression(
        solver="normal", elasticNetParam=0.0, regParam=penalty, standardization=False, **_params()
    ).fit(train)


def fit_constant(train: DataFrame):
    """The labels' mean, whatever the features: a ridge whose penalty leaves no slope."""
    return fit_ridge(train, NO_SLOPE)


NO_SLOPE = 1e18
FITTERS = {"gradient_boosting": fit_gbt, "random_forest": fit_forest, "ridge": fit_ridge, "constant": fit_constant}


def row_order(date: str = "date", lat: str = "latitude", lon: str = "longitude") -> Column:
    """One sortable integer per (date, latitude, longitude)."""
    day = F.datediff(F.col(date), F.lit("1900-01-01").cast("date")).cast("long")
    return (day * 10_000_000 + ticks(lat) + 1_000_000) * 10_000_000 + ticks(lon) + 2_000_000


def fold_column(df: DataFrame, order: Column, folds: int = 5, name: str = "fold") -> DataFrame:
    """Contiguous unshuffled folds of the rows in the given order; the first n % k folds get one
    row more. Rows that share an order value share a fold."""
    keyed = df.withColumn("_o", order)
    ranked = ranked_counts(keyed, "_o")
    q = F.call_function("div", F.col("total"), F.lit(folds).cast("long"))
    extra = F.col("total") % folds
    cut = extra * (q + 1)
    fold = F.when(F.col("before") < cut, F.call_function("div", F.col("before"), q + 1)).otherwise(
        extra + F.call_function("div", F.col("before") - cut, F.greatest(q, F.lit(1)))
    )
    places = ranked.select(F.col("value").alias("_o"), fold.cast("int").alias(name))
    return keyed.join(places, "_o").drop("_o")


def evaluate(model, df: DataFrame) -> DataFrame:
    """One row of scores of the model on the rows."""
    return global_metrics(model.transform(df), LABEL, PREDICTION)


def evaluate_model(model, train: DataFrame, test: DataFrame) -> DataFrame:
    """Scores on both parts in one pass: train_r2, test_r2, rmse and mae of the test part."""
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    scores = global_metrics(model.transform(both), LABEL, PREDICTION, ["part"])

    def of(part, c):
        return F.max(F.when(F.col("part") == part, F.col(c)))

    return scores.agg(
        of("train", "r_squared").alias("train_r2"), of("test", "r_squared").alias("test_r2"),
        of("test", "rmse").alias("rmse"), of("test", "mae").alias("mae"),
        of("train", "n_points").alias("n_train"), of("test", "n_points").alias("n_test"),
    )


def cv_r2(df: DataFrame, fit, fold: str = "fold", folds: int = 5) -> DataFrame:
    """(cv_r2, cv_std, n_folds): mean and population deviation of the held-out R2."""
    held = None
    for k in range(folds):
        model = fit(df.where(F.col(fold) != k))
        scored = model.transform(df.where(F.col(fold) == k)).select(fold, LABEL, PREDICTION)
        held = scored if held is None else held.unionByName(scored)
    per = global_metrics(held, LABEL, PREDICTION, [fold])
    return per.agg(
        F.avg("r_squared").alias("cv_r2"), F.stddev_pop("r_squared").alias("cv_std"),
        F.count("r_squared").alias("n_folds"),
    )


def fold_moments(df: DataFrame, size: int, fold: str = "fold") -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(rows, means, co-moments) of features and label for each fold, in one aggregate over the rows.

    Spark's covariances are merged around their means, so large offsets cancel nothing. One row of at most
    (size + 1) * (size + 4) / 2 numbers comes back for each fold.
    """
    columns = [F.coalesce(F.get(vector_to_array(F.col(FEATURES)), F.lit(i)), F.lit(float("nan"))).alias(f"_{i}") for i in range(size)]
    rows = df.select(fold, *columns, F.col(LABEL).alias(f"_{size}"))
    pairs = [(i, j) for i in range(size + 1) for j in range(i, size + 1)]
    per = rows.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"_{i}").alias(f"m{i}") for i in range(size + 1)],
        *[F.covar_pop(f"_{i}", f"_{j}").alias(f"c{i}_{j}") for i, j in pairs]).orderBy(fold).collect()
    out = []
    for row in per:
        moments = np.zeros((size + 1, size + 1))
        for i, j in pairs:
            moments[i, j] = moments[j, i] = row[f"c{i}_{j}"] * row["n"]
        out.append((float(row["n"]), np.array([row[f"m{i}"] for i in range(size + 1)]), moments))
    return out


def _merged(a, b):
    """Moments of two disjoint sets of rows together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def cv_r2_ridge(df: DataFrame, size: int, alpha: float = 1.0, fold: str = "fold") -> DataFrame:
    """``cv_r2`` of ``fit_ridge`` over ``size`` features without a refit: one pass over the rows.

    The moments of the other folds, merged, give each fold's coefficients; its own moments give the held-out
    error. A fold whose labels are all equal has no R2, as there; NaN and null features make the scores NaN.
    """
    parts = fold_moments(df, size, fold)
    scores = []
    for k, (n, mean, own) in enumerate(parts):
        others = [p for j, p in enumerate(parts) if j != k]
        if not others or own[size, size] == 0:
            continue
        _, centre, rest = reduce(_merged, others)
        slope = np.linalg.solve(rest[:size, :size] + alpha * np.eye(size), rest[:size, size])
        weights = np.append(-slope, 1.0)  # the residual as a combination of features and label
        bias = float(weights @ (mean - centre))
        scores.append(1.0 - (float(weights @ own @ weights) + n * bias * bias) / own[size, size])
    found = [(float(np.mean(scores)), float(np.std(scores)), len(scores))] if scores else [(None, None, 0)]
    return df.sparkSession.createDataFrame(found, "cv_r2 double, cv_std double, n_folds bigint")


def feature_importance(model, names: Sequence[str], spark) -> DataFrame:
    """(feature, importance): tree importances, else absolute coefficients. One row per feature."""
    vector = getattr(model, "featureImportances", None)
    scores = vector.toArray() if vector is not None else abs(model.coefficients.toArray())
    rows = [(n, float(s)) for n, s in zip(names, scores)]
    return spark.createDataFrame(rows, "feature string, importance double")


def _number(digest: Column, digits: int = 15) -> Column:
    """The first hex digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def hash_places(df: DataFrame, keys: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Add _place (0.. in the order of a digest of the keys) and _total; ties are told apart by the row.

    Any engine can repeat the order: it goes by the MD5 of the keys as text (without ``keys`` of all columns).
    """
    cols = df.columns
    keyed = df.withColumn("_h", _number(row_digest(cols if keys is None else keys, seed)))
    tie = F.row_number().over(W.partitionBy("_h").orderBy(*cols)) - 1
    places = ranked_counts(keyed, "_h").select(F.col("value").alias("_h"), "before", F.col("total").alias("_total"))
    joined = keyed.withColumn("_tie", tie).join(places, "_h")
    return joined.select(*cols, (F.col("before") + F.col("_tie")).alias("_place"), "_total")


def permutation_importance(
    model, df: DataFrame, names: Sequence[str], keys: Sequence[str], rows: int | None = None,
    repeats: int = 5, seed: int = 42,
) -> DataFrame:
    """(feature, importance): mean drop of R2 when the feature is shuffled, over ``repeats``.

    All rows take part unless a sample of ``rows`` is asked for. The rows are put in one hash order;
    every (feature, repeat) takes the feature's value from the row a hashed distance further on, all in
    one prediction pass. No window or join holds more than one place of the order in a group.
    """
    used = df.select(*keys, *names, LABEL)
    sample = written(hash_places(used if rows is None else sample_n(used, rows, keys, seed), keys, seed))
    base = evaluate(model, assemble(sample, names)).select(F.col("r_squared").alias("base"))
    trials = sample.withColumn("feature", F.explode(F.array(*[F.lit(n) for n in names]))).withColumn(
        "trial", F.explode(F.sequence(F.lit(1), F.lit(repeats)))
    )
    draw = _number(F.md5(F.concat_ws("|", F.lit("shift"), "feature", F.col("trial").cast("string"), F.lit(str(seed)))))
    trials = trials.withColumn("_shift", F.lit(1) + draw % F.greatest(F.col("_total") - 1, F.lit(1)))
    chosen = F.coalesce(*[F.when(F.col("feature") == n, F.col(n).cast("double")) for n in names])
    left = trials.withColumn("_k", F.col("_place"))
    right = trials.select(
        "feature", "trial", F.pmod(F.col("_place") - F.col("_shift"), F.col("_total")).alias("_k"), chosen.alias("_v"))
    mixed = left.join(right, ["feature", "trial", "_k"]).withColumns(
        {n: F.when(F.col("feature") == n, F.col("_v")).otherwise(F.col(n)) for n in names}
    )
    scored = model.transform(assemble(mixed, names))
    drop = global_metrics(scored, LABEL, PREDICTION, ["feature", "trial"])
    one = base.scalar()
    return drop.groupBy("feature").agg(F.avg("r_squared").alias("m")).select(
        "feature", (one - F.col("m")).alias("importance")
    )


def prediction_uncertainty(predicted: DataFrame, source: DataFrame, value: str = "fwi_predicted") -> DataFrame:
    """(date, prediction_uncertainty): population deviation of the day's predictions over sqrt(n)."""
    n = source.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return predicted.groupBy("date").agg(F.stddev_pop(value).alias("s")).join(n, "date").select(
        "date", (F.col("s") / F.sqrt("n")).alias("prediction_uncertainty")
    )


def quality_score(distance) -> Column:
    """max(0.3, 1 - distance / 0.5)."""
    return F.greatest(F.lit(0.3), F.lit(1.0) - F.col(distance) / F.lit(0.5))


def predict_fine(
    source: DataFrame, model, names: Sequence[str], measures: Sequence[str],
    dlat: float = 0.009, dlon: float = 0.012, cap: int | None = None,
    stats: DataFrame | None = None, minimum: int | None = None, radius: float = 0.3,
    source_step: float | None = None,
) -> DataFrame:
    """Predict every node of each day's fine lattice, with uncertainty and quality score.

    With ``source_step`` the source is a regular grid of that step, and features come from stencil kernels
    instead of a radius join; a source that is not regular raises an error.

    Days with fewer than ``minimum`` source points are left out if asked. All days run in one job. The
    predictions are stored once; a day's deviation is a partial aggregate over them, joined back.
    """
    days = source if minimum is None else min_group_size(source, ["date"], minimum)
    spec = lattice_spec(days, dlat, dlon, ["date"], cap)
    if source_step is None:
        features = idw_features(expand_lattice(spec, ["date"]), days, measures, radius)
    elif is_regular(days, source_step):
        features = stencil_features(spec, days, measures, radius, source_step, "fwi" if "fwi" in measures else None)
    else:
        raise ValueError(f"the source is no regular grid of {source_step} degrees")
    ready = fill_missing_features(features, names, days).withColumn(
        "quality_score", quality_score("coarse_distance")
    )
    scaled = robust_scale(ready, names, stats) if stats is not None else ready
    predicted = model.transform(assemble(scaled, names)).select(
        "date", F.col("target_lat").alias("latitude"), F.col("target_lon").alias("longitude"),
        clip(PREDICTION, 0, 100).alias("fwi_predicted"), "quality_score",
    )
    predicted = written(predicted)
    return predicted.join(prediction_uncertainty(predicted, days), "date")
