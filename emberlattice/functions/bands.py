"""Classification columns: risk bands, latitude bands, quality and performance labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlattice.functions.columns import as_col

__all__ = [
    "band_labels", "band", "latitude_band", "quality_label", "correlation_band", "r2_band",
    "risk_category", "OUT_OF_RANGE",
]

OUT_OF_RANGE = "out_of_range"


def band_labels(edges: list[float]) -> list[str]:
    return [f"{lo:g}-{hi:g}" for lo, hi in zip(edges[:-1], edges[1:])]


def band(c, edges: list[float], closed: str = "left") -> Column:
    """Label of the interval holding ``c``.

    ``closed='left'``: [lo, hi). ``closed='right'``: (lo, hi] with the lowest edge included.
    Values outside every interval get ``out_of_range``; nulls stay null.
    """
    c = as_col(c)
    out = F.when(c.isNull() | F.isnan(c), F.lit(None).cast("string"))
    for k, label in enumerate(band_labels(edges)):
        lo, hi = F.lit(float(edges[k])), F.lit(float(edges[k + 1]))
        if closed == "left":
            inside = (c >= lo) & (c < hi)
        else:
            inside = ((c >= lo) if k == 0 else (c > lo)) & (c <= hi)
        out = out.when(inside, F.lit(label))
    return out.otherwise(F.lit(OUT_OF_RANGE))


def _steps(c, cuts, strict: bool) -> Column:
    c = as_col(c)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for cut, label in cuts[:-1]:
        limit = F.lit(float(cut))
        out = out.when((c > limit) if strict else (c >= limit), F.lit(label))
    return out.otherwise(F.lit(cuts[-1][1]))


# ---- Fixed values: cut points and labels -----------------------------------------------------
_LATITUDE = [(41.0, "North"), (39.5, "Central"), (None, "South")]
_QUALITY = [(0.9, "Excellent"), (0.8, "Good"), (0.7, "Fair"), (None, "Poor")]
_CORRELATION = [(0.8, "Excellent"), (0.6, "Good"), (0.4, "Fair"), (None, "Poor")]
_R2 = [(0.64, "Excellent"), (0.36, "Good"), (0.16, "Fair"), (None, "Poor")]
_RISK = [(90, "Very High"), (75, "High"), (50, "Moderate"), (25, "Low"), (None, "Very Low")]
# ----------------------------------------------------------------------------------------------


def latitude_band(lat) -> Column:
    """North above 41, Central above 39.5 up to 41, South at or below 39.5."""
    return _steps(lat, _LATITUDE, strict=True)


def quality_label(r2) -> Column:
    return _steps(r2, _QUALITY, strict=True)


def correlation_band(r) -> Column:
    return _steps(r, _CORRELATION, strict=True)


def r2_band(r2) -> Column:
    return _steps(r2, _R2, strict=True)


def risk_category(percentile) -> Column:
    """Band of a 0..100 percentile rank; a missing rank falls to the default 'Low'."""
    return F.coalesce(_steps(percentile, _RISK, strict=False), F.lit("Low"))
