"""Exposure overlay: match, score, rank, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame

from emberlattice.operators.clean import filter_bbox
from emberlattice.operators.risk import classify_risk, exposure_match, risk_score
from emberlattice.schema import MAINLAND_BOX
from emberlattice.session import materialise


def rank_vulnerability(
    fwi: DataFrame, exposure: DataFrame, value: str = "fwi", method: str = "simple",
    day: str | None = None, box=MAINLAND_BOX,
) -> DataFrame:
    """Exposure points of the box with risk, percentile rank and category.

    The matched table is stored once: scaling, ranking and the final join all read it.
    """
    matched = exposure_match(filter_bbox(fwi, box), filter_bbox(exposure, box), value, day)
    return classify_risk(risk_score(materialise(matched), method))
