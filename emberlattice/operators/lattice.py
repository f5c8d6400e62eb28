"""Regular lattices: integer node indices, never float keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlattice.functions import TICKS, ceil_div, degrees, floor_div, km_per_degree_lon, ticks
from emberlattice.schema import KM_PER_DEGREE_LAT


def _node_span(x, step: int, half2: int, closed: str):
    """First and last node index whose window holds x; half2 is twice the half width (ticks)."""
    low = ceil_div(2 * x - half2, 2 * step)
    high = floor_div(2 * x + half2, 2 * step)
    if closed == "left":  # window [node-h, node+h): the far edge is excluded
        low = floor_div(2 * x - half2, 2 * step) + 1
    return low, high


def window_overlap(
    points: DataFrame, step: float, closed: str = "both", lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """Add node indices (i, j): one output row per lattice window that holds the point.

    Windows are step wide and centred on multiples of step. With ``closed='both'`` a point on an
    edge belongs to 2 windows (4 on a corner); ``closed='left'`` gives exactly one.
    """
    s = round(step * TICKS)
    out = points
    for name, c in (("i", lat), ("j", lon)):
        low, high = _node_span(ticks(c), s, s, closed)
        if closed == "left":
            out = out.withColumn(name, high)
        else:
            nodes = F.when(low == high, F.array(high)).otherwise(F.array(low, high))
            out = out.withColumn(name, F.explode(nodes))
    return out


def coarse_lattice(points: DataFrame, step: float, by: Sequence[str] = ("date",)) -> DataFrame:
    """Occupied nodes (by..., i, j, latitude, longitude) of the step lattice."""
    s = round(step * TICKS)
    nodes = window_overlap(points, step).select(*by, "i", "j").distinct()
    return nodes.withColumn("latitude", degrees(F.col("i") * s)).withColumn(
        "longitude", degrees(F.col("j") * s)
    )


def lattice_spec(
    points: DataFrame,
    dlat: float,
    dlon: float,
    by: Sequence[str] = (),
    cap: int | None = None,
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """(by..., lat0, lon0, dlat, dlon, n_lat, n_lon) in ticks: min..max+step by step per group.

    Both steps double when the lattice would hold more than ``cap`` points.
    """
    box = points.groupBy(*by).agg(
        F.min(ticks(lat)).alias("lat0"), F.max(ticks(lat)).alias("lat1"),
        F.min(ticks(lon)).alias("lon0"), F.max(ticks(lon)).alias("lon1"),
    )
    a, b = round(dlat * TICKS), round(dlon * TICKS)

    def count(lo: str, hi: str, step: int):
        return ceil_div(F.col(hi) - F.col(lo), step) + 1

    n_lat, n_lon = count("lat0", "lat1", a), count("lon0", "lon1", b)
    dense = F.lit(False) if cap is None else n_lat * n_lon > cap
    return box.select(
        *by,
        "lat0",
        "lon0",
        F.when(dense, 2 * a).otherwise(a).cast("long").alias("dlat"),
        F.when(dense, 2 * b).otherwise(b).cast("long").alias("dlon"),
        F.when(dense, count("lat0", "lat1", 2 * a)).otherwise(n_lat).alias("n_lat"),
        F.when(dense, count("lon0", "lon1", 2 * b)).otherwise(n_lon).alias("n_lon"),
    )


def expand_lattice(spec: DataFrame, by: Sequence[str] = (), spread: bool = True) -> DataFrame:
    """(by..., i, j, latitude, longitude): every node of each lattice of ``lattice_spec``.

    Rows of the lattice (index i) are spread over the cluster before the columns are expanded,
    so one large lattice is not generated by one task.
    """
    rows = spec.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_lat") - 1)))
    if spread:
        rows = rows.repartition(*by, "i")
    nodes = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_lon") - 1)))
    return nodes.select(
        *by,
        "i",
        "j",
        degrees(F.col("lat0") + F.col("i") * F.col("dlat")).alias("latitude"),
        degrees(F.col("lon0") + F.col("j") * F.col("dlon")).alias("longitude"),
    )


def fine_lattice(
    points: DataFrame,
    dlat: float = 0.009,
    dlon: float = 0.012,
    cap: int | None = None,
    by: Sequence[str] = ("date",),
) -> DataFrame:
    """The ~1 km target lattice over each day's extent; ``cap`` only where a coarser one is asked for."""
    return expand_lattice(lattice_spec(points, dlat, dlon, by, cap), by)


def global_lattice(points: DataFrame, step: float = 0.009, dates: DataFrame | None = None) -> DataFrame:
    """One lattice over the full extent of ``points``; repeated for each row of ``dates`` if given."""
    spec = lattice_spec(points, step, step)
    if dates is None:
        return expand_lattice(spec)
    one = spec.agg(F.first(F.struct(*spec.columns)).alias("s")).scalar()
    per_date = dates.distinct().select("date", one.alias("s")).select("date", "s.*")
    return expand_lattice(per_date, ["date"])


def edge_bins(
    points: DataFrame,
    extent: DataFrame,
    step: float,
    by: Sequence[str] = ("date",),
    closed: str = "left",
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """Bin indices (i, j) and bin centres of edges min-step/2 ... max+step of ``extent``.

    Points outside the outermost edges are dropped. The extent is one row per group; it is joined
    on the group key (Spark broadcasts it only under its own size limit).
    """
    s = round(step * TICKS)
    box = extent.groupBy(*by).agg(
        F.min(ticks(lat)).alias("_y0"), F.max(ticks(lat)).alias("_y1"),
        F.min(ticks(lon)).alias("_x0"), F.max(ticks(lon)).alias("_x1"),
    )
    if by:
        joined = points.join(box, list(by))
    else:
        one = box.agg(F.first(F.struct("_y0", "_y1", "_x0", "_x1")).alias("s")).scalar()
        joined = points.select("*", one.alias("_s")).select(*points.columns, "_s.*")
    out = joined
    for idx, c, lo, hi in (("i", lat, "_y0", "_y1"), ("j", lon, "_x0", "_x1")):
        # Twice the ticks keeps the half step exact. Edges: 2*lo - s + 2*s*k while < 2*hi + 2*s.
        edges = ceil_div(2 * F.col(hi) + 2 * s - (2 * F.col(lo) - s), 2 * s)
        out = out.withColumn(idx, floor_div(2 * ticks(c) - (2 * F.col(lo) - s), 2 * s))
        out = out.where((F.col(idx) >= 0) & (F.col(idx) < edges - 1))
    return out.withColumns(
        {
            "bin_latitude": degrees(F.col("_y0") + F.col("i") * s),
            "bin_longitude": degrees(F.col("_x0") + F.col("j") * s),
        }
    ).drop("_y0", "_y1", "_x0", "_x1")


def grid_resolution_summary(
    boxes: DataFrame, steps: Sequence[float], keys: Sequence[str] = ("box",)
) -> DataFrame:
    """Per box and step: spacing in km, whole cells per box, and the ratio to the coarsest step.

    ``boxes`` has columns keys..., south, north, west, east.
    """
    keys = list(keys)
    widest = max(steps)
    mid = (F.col("south") + F.col("north")) / 2

    def cells(step):
        return F.floor(F.round((F.col("north") - F.col("south")) / step, 9)) * F.floor(
            F.round((F.col("east") - F.col("west")) / step, 9)
        )

    s = F.col("step_deg")
    return (
        boxes.withColumn("step_deg", F.explode(F.array(*[F.lit(float(x)) for x in steps])))
        .select(
            *keys,
            "step_deg",
            (s * F.lit(KM_PER_DEGREE_LAT)).alias("km_lat"),
            (s * km_per_degree_lon(mid)).alias("km_lon"),
            cells(s).cast("long").alias("n_cells"),
            F.try_divide(cells(s).cast("double"), cells(F.lit(float(widest))).cast("double"))
            .alias("ratio_to_coarsest"),
        )
    )
