"""Scalar column helpers. All are built-in expressions and stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlattice.schema import KELVIN_OFFSET, KM_PER_DEGREE_LON, NAME_REPLACEMENTS

__all__ = [
    "TICKS", "as_col", "ticks", "degrees", "round_to", "round_coord", "wrap", "kelvin_to_celsius",
    "clip", "finite", "not_nan", "planar_distance", "distance2", "pearson",
    "km_per_degree_lon", "clean_name", "row_digest", "month_day", "floor_div", "ceil_div",
]

TICKS = 10_000  # ticks per degree: coordinates are compared as integers, never as doubles


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ticks(c, per_degree: int = TICKS) -> Column:
    """Degrees -> integer ticks (1e-4 degree by default)."""
    if isinstance(c, str):  # one parsed expression is much cheaper to build than four calls
        return F.expr(f"CAST(rint({c} * {per_degree}D) AS BIGINT)")
    return F.rint(as_col(c) * F.lit(float(per_degree))).cast("long")


def row_digest(keys, seed: int) -> Column:
    """MD5 of a row's keys as text, coordinates in ticks: one order for every engine and partitioning."""
    parts = [ticks(k) if k.endswith(("latitude", "longitude", "_lat", "_lon")) else F.col(k) for k in keys]
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.lit(str(seed))))


def degrees(c, per_degree: int = TICKS) -> Column:
    if isinstance(c, str):
        return F.expr(f"CAST({c} AS DOUBLE) / {per_degree}D")
    return as_col(c).cast("double") / F.lit(float(per_degree))


def round_to(c, digits: int) -> Column:
    """Multiply, round half to even, divide: the rounding rule of the coordinate keys."""
    scale = float(10**digits)
    return F.rint(as_col(c) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def round_coord(c) -> Column:
    return round_to(c, 3)


def wrap(c) -> Column:
    """0..360 longitudes to -180..180."""
    c = as_col(c)
    return F.pmod(c + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def kelvin_to_celsius(c) -> Column:
    return as_col(c) - F.lit(KELVIN_OFFSET)


def clip(c, low: float, high: float) -> Column:
    c = as_col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def not_nan(c) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def finite(c, limit: float = 1e10) -> Column:
    """Null for NaN, infinities and magnitudes of ``limit`` or more."""
    c = as_col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(limit)), c)


def distance2(lat1, lon1, lat2, lon2) -> Column:
    """Squared planar distance of integer tick coordinates (exact)."""
    dy, dx = as_col(lat1) - as_col(lat2), as_col(lon1) - as_col(lon2)
    return dy * dy + dx * dx


def planar_distance(d2, per_degree: int = TICKS) -> Column:
    if isinstance(d2, str):
        return F.expr(f"sqrt(CAST({d2} AS DOUBLE)) / {per_degree}D")
    return F.sqrt(as_col(d2).cast("double")) / F.lit(float(per_degree))


def pearson(a, b) -> Column:
    """Aggregate: Pearson correlation over rows with both values; null when either is constant.

    The built-in ``corr`` raises on a constant column in ANSI mode.
    """
    a, b = as_col(a), as_col(b)
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def km_per_degree_lon(lat) -> Column:
    return F.lit(KM_PER_DEGREE_LON) * F.cos(F.radians(as_col(lat)))


def clean_name(c) -> Column:
    out = as_col(c)
    for old, new in NAME_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def month_day(c) -> Column:
    return F.date_format(as_col(c), "MM-dd")


def floor_div(a: Column, b: int) -> Column:
    """Integer floor division that also holds for negative numerators."""
    return ((a - F.pmod(a, F.lit(b).cast("long"))) / F.lit(b)).cast("long")


def ceil_div(a: Column, b: int) -> Column:
    return -floor_div(-a, b)
