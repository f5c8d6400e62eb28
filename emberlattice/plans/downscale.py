"""Train on downsampled days, predict the fine lattice."""

from __future__ import annotations

import datetime
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from emberlattice.operators.clean import impute_median, with_lineage
from emberlattice.operators.features import training_pairs
from emberlattice.operators.learn import (
    FEATURES, FITTERS, NO_SLOPE, assemble, cv_r2, cv_r2_ridge, evaluate_model, fold_column, predict_fine, robust_scale,
    row_order, scale_stats, split_rows,
)
from emberlattice.session import materialise, written

MODELS = ("gradient_boosting", "random_forest", "ridge")
KEYS = ["date", "fine_lat", "fine_lon"]


def feature_names(measures: Sequence[str]) -> list[str]:
    parts = [f"coarse_{m}{s}" for m in measures for s in ("", "_mean", "_std")]
    return [*parts, "coarse_distance", "coarse_lat", "coarse_lon", "target_lat", "target_lon"]


def prepare_training(
    daily: DataFrame, measures: Sequence[str], step: float = 0.5, target: str = "fwi",
    include_target: bool = False,
):
    """(scaled training table with label and vector, feature names, scaling statistics).

    The pairs are checkpointed once: medians, quartiles and every model read them.
    """
    pairs = materialise(training_pairs(daily, measures, step, target, include_target))
    inputs = [m for m in measures if include_target or m != target]
    names = feature_names(inputs)
    filled = impute_median(pairs, [*names, f"fine_{target}"])
    stats = materialise(scale_stats(filled, names))
    return assemble(robust_scale(filled, names, stats), names, f"fine_{target}"), names, stats


def train(table: DataFrame, name: str = "ridge", **params):
    """(model, scores) of one regressor on the 80/20 split."""
    fit_rows, test_rows = split_rows(table, KEYS)
    model = FITTERS[name](fit_rows, **params)
    return model, evaluate_model(model, fit_rows, test_rows)


def select_model(table: DataFrame, names: Sequence[str] = MODELS, params: Mapping[str, dict] | None = None, folds: int = 5):
    """(name, model, scores by name): every regressor is trained on the 80 % part and cross-validated
    there on contiguous folds; the highest mean R2 wins, then the first name. Linear models are cross-validated
    from the folds' moments, without refits."""
    fit_rows, test_rows = split_rows(table, KEYS)
    folded = written(fold_column(fit_rows, row_order("date", "fine_lat", "fine_lon"), folds))
    models, scores = {}, {}
    for name in names:
        options = (params or {}).get(name, {})
        models[name] = FITTERS[name](folded, **options)
        if name in ("ridge", "constant"):
            size = len(folded.select(FEATURES).first()[0]) if folded.head(1) else 0
            held = cv_r2_ridge(folded, size, NO_SLOPE if name == "constant" else options.get("alpha", 1.0)).first()
        else:
            held = cv_r2(folded, lambda rows, n=name, o=options: FITTERS[n](rows, **o), folds=folds).first()
        scores[name] = {**held.asDict(), **evaluate_model(models[name], folded.drop("fold"), test_rows).first().asDict()}
    best = max(sorted(names), key=lambda n: -math.inf if scores[n]["cv_r2"] is None else scores[n]["cv_r2"])
    return best, models[best], scores


def downscale_best(
    daily: DataFrame, measures: Sequence[str], step: float = 0.5, dlat: float = 0.009, dlon: float = 0.012,
    target: str = "fwi", names: Sequence[str] = MODELS, params: Mapping[str, dict] | None = None,
    source_step: float | None = None,
) -> DataFrame:
    """Predict the fine lattice with the best of several regressors; adds method, resolutions and score."""
    table, features, stats = prepare_training(daily, measures, step, target, include_target=True)
    name, model, scores = select_model(written(table), names, params)
    fine = predict_fine(daily, model, features, list(measures), dlat, dlon, stats=stats, source_step=source_step)
    now = datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")
    return with_lineage(fine, name, f"{step} degrees", f"{dlat} degrees", scores[name]["cv_r2"], now)


def downscale(
    daily: DataFrame, measures: Sequence[str], model_name: str = "ridge", step: float = 0.5,
    dlat: float = 0.009, dlon: float = 0.012, cap: int | None = None, target: str = "fwi",
    include_target: bool = True, source_step: float | None = None, **params,
) -> DataFrame:
    """Fit one regressor on all training pairs and predict every day's fine lattice.

    The neighbourhood features of the lattice hold the target's own coarse mean, so it is a feature
    here unless left out; medians and quartiles come from all pairs.
    """
    table, names, stats = prepare_training(daily, measures, step, target, include_target)
    model = FITTERS[model_name](table, **params)
    inputs = [m for m in measures if include_target or m != target]
    return predict_fine(daily, model, names, inputs, dlat, dlon, cap, stats, source_step=source_step)
