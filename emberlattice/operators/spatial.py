"""Point-to-point and point-to-box joins as equi joins on integer cells.

Rules shared by all operators here
- Coordinates are integer ticks, so distances compare exactly and ties break on (lat, lon).
- Rows are first collapsed to distinct coordinates per key. A coordinate that holds a third of
  the table is one row in the candidate join, and results are attached back by an equi join whose
  right side is unique (AQE splits the hot left partition).
- After collapsing, a cell holds at most (cell side / coordinate step)^2 rows, whatever the table
  size: 10 000 for a 0.1 degree cell of 3-decimal coordinates.
- No inequality-only joins: each candidate join has the cell and the ``by`` keys as equi keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlattice.functions import TICKS, floor_div, planar_distance, ticks

PYRAMID_FACTOR = 8
WORLD_TICKS = 720 * TICKS


def _coordinates(df: DataFrame, by: Sequence[str], lat: str, lon: str) -> DataFrame:
    """Distinct (by..., ly, lx)."""
    return df.select(*by, ticks(lat).alias("ly"), ticks(lon).alias("lx")).where(
        "ly IS NOT NULL AND lx IS NOT NULL"
    ).distinct()


def _sites(
    df: DataFrame, by: Sequence[str], lat: str, lon: str, payload: Sequence[str]
) -> DataFrame:
    """One row per distinct coordinate (by..., ry, rx, p); the smallest payload wins."""
    return (
        df.select(*by, ticks(lat).alias("ry"), ticks(lon).alias("rx"), F.struct(*payload).alias("p"))
        .where("ry IS NOT NULL AND rx IS NOT NULL")
        .groupBy(*by, "ry", "rx")
        .agg(F.min("p").alias("p"))
    )


def _with_cells(df: DataFrame, y: str, x: str, size: int) -> DataFrame:
    """Add the cell (cy, cx) of the row."""
    return df.withColumns({"cy": F.expr(f"floor({y} / {size}D)"), "cx": F.expr(f"floor({x} / {size}D)")})


def _near_cells(df: DataFrame, y: str, x: str, size: int, r: int) -> DataFrame:
    """Add (cy, cx) for exactly the cells a square of half side r (ticks) around the row touches."""

    def span(c):
        return F.expr(f"explode(sequence(floor(({c} - {r}) / {size}D), floor(({c} + {r}) / {size}D)))")

    return df.withColumn("cy", span(y)).withColumn("cx", span(x))


_D2 = "(ly - ry) * (ly - ry) + (lx - rx) * (lx - rx)"


def _d2() -> Column:
    return F.expr(_D2)


def candidate_pairs(
    coords: DataFrame, sites: DataFrame, r: int, by: Sequence[str], expand: str = "left",
    size: int | None = None,
) -> DataFrame:
    """All (coordinate, site) pairs with distance <= r ticks, from one cell equi join.

    ``expand`` names the side that is copied into the cells it reaches; choose the smaller one.
    """
    size = max(1, size or r)
    keys = [*by, "cy", "cx"]
    if expand == "left":
        left = _near_cells(coords, "ly", "lx", size, r)
        right = _with_cells(sites, "ry", "rx", size)
    else:
        left = _with_cells(coords, "ly", "lx", size)
        right = _near_cells(sites, "ry", "rx", size, r)
    return (
        left.join(right, keys)
        .withColumn("d2", _d2())
        .where(f"d2 <= {r * r}L")
    )


def target_keys(by: Sequence[str], expand: str) -> list[str]:
    """Grouping keys of a left coordinate in pair tables.

    A left coordinate that was not copied lies in one cell. With the cell among the keys, grouping
    reuses the partitioning of the join on (by..., cy, cx) and needs no further shuffle.
    """
    return [*by, "cy", "cx", "ly", "lx"] if expand == "right" else [*by, "ly", "lx"]


def _best(pairs: DataFrame, by: Sequence[str], expand: str = "left") -> DataFrame:
    """(by..., ly, lx, best) with best = struct(d2, ry, rx, p): the nearest pair per coordinate."""
    best = pairs.groupBy(*target_keys(by, expand)).agg(
        F.min(F.struct("d2", "ry", "rx", "p")).alias("best")
    )
    return best.select(*by, "ly", "lx", "best")


def _without_neighbour(
    coords: DataFrame, sites: DataFrame, r: int, by: Sequence[str], expand: str
) -> DataFrame:
    """Coordinates with no site within r ticks."""
    if expand == "right":  # one anti join with the distance test as residual, no copies of coords
        near = _near_cells(sites.select(*by, "ry", "rx"), "ry", "rx", r, r)
        a, b = _with_cells(coords, "ly", "lx", r).alias("a"), near.alias("b")
        same = " AND ".join(f"a.{c} = b.{c}" for c in (*by, "cy", "cx"))
        match = F.expr(f"{same} AND {_D2} <= {r * r}L")
        return a.join(b, match, "left_anti").select(*by, "ly", "lx")
    found = candidate_pairs(coords, sites, r, by, expand).select(*by, "ly", "lx").distinct()
    return coords.join(found, [*by, "ly", "lx"], "left_anti")


def _search_beyond(missing: DataFrame, sites: DataFrame, r0: int, by: Sequence[str]) -> DataFrame:
    """Exact nearest site for coordinates with none within r0, without pairing whole groups.

    The levels are searched once for all coordinates of a base cell, by the box around them:
    1. Find the smallest cell size r0 * FACTOR^k whose 3x3 block holds a site; the box corner farthest
       from any site in it bounds the distance. 2. From the block that covers the bound go down level
       by level: a cell's occupied children are opened only if the cell can hold a nearer site than the
       best representative seen so far. 3. Each coordinate keeps those of its box's base cells that can
       hold its nearest site and compares their sites.
    A box keeps few cells on every level, however many sites lie in its far block, and the coordinates
    are neither copied nor sorted for the levels.
    """
    levels, side = [], r0
    while True:
        levels.append(side)
        if side >= WORLD_TICKS:
            break
        side *= PYRAMID_FACTOR
    base = _with_cells(sites, "ry", "rx", r0).groupBy(*by, "cy", "cx").agg(
        F.min(F.struct("ry", "rx")).alias("rep")
    )

    def parents(df, cy, cx):
        """Cell of size r0*FACTOR^k holding base cell (cy, cx), for k in column k."""
        scale = f"power({PYRAMID_FACTOR}, k)"
        return df.withColumns(
            {"py": F.expr(f"floor({cy} / {scale})"), "px": F.expr(f"floor({cx} / {scale})")}
        )

    def blocks(df):
        """One row per parent cell of the 3x3 block."""
        return df.withColumn("py", F.expr("explode(sequence(py - 1, py + 1))")).withColumn(
            "px", F.expr("explode(sequence(px - 1, px + 1))")
        )

    def gap2(side, y0, y1, x0, x1):
        """Least squared distance of a cell (py, px) and a box."""
        dy, dx = [f"greatest({c} * {side} - {hi}, {lo} - {c} * {side} - {side - 1}, 0)"
                  for c, lo, hi in (("py", y0, y1), ("px", x0, x1))]
        return f"{dy} * {dy} + {dx} * {dx}"

    # The distance every coordinate of the box keeps to a representative at most.
    far = F.expr("power(greatest(abs(y0 - ry), abs(y1 - ry)), 2) + power(greatest(abs(x0 - rx), abs(x1 - rx)), 2)").cast("long")
    home = [*by, "hy", "hx"]
    box = ["y0", "y1", "x0", "x1"]
    all_levels = F.expr(f"explode(sequence(0, {len(levels) - 1}))")
    pyramid = (
        parents(base.withColumn("k", all_levels), "cy", "cx")
        .groupBy(*by, "k", "py", "px")
        .agg(F.min("rep").alias("rep"))
    )
    reps = pyramid.select(*by, "k", "py", "px", F.col("rep.ry").alias("ry"), F.col("rep.rx").alias("rx"))
    placed = _with_cells(missing, "ly", "lx", r0).withColumnsRenamed({"cy": "hy", "cx": "hx"})
    homes = placed.groupBy(*home).agg(
        F.min("ly").alias("y0"), F.max("ly").alias("y1"), F.min("lx").alias("x0"), F.max("lx").alias("x1")
    )
    around = blocks(parents(homes.withColumn("k", all_levels), "hy", "hx"))
    cover = "CASE " + " ".join(f"WHEN ub <= {s * s}L THEN {k}" for k, s in enumerate(levels)) + f" ELSE {len(levels) - 1} END"
    # Smallest level first, then the nearest representative on that level; then the level whose cells
    # are at least as wide as the bound, so that one 3x3 block covers the circles.
    bound = (
        around.join(reps, [*by, "k", "py", "px"])
        .withColumn("d2", far)
        .groupBy(*home, *box)
        .agg(F.min(F.struct("k", "d2")).alias("m"))
        .select(*home, *box, F.col("m.d2").alias("ub"))
        .withColumn("k", F.expr(cover))
    )
    starts = blocks(parents(bound, "hy", "hx")).join(reps, [*by, "k", "py", "px"]).select(
        *home, *box, "ub", "k", "py", "px", "ry", "rx"
    )
    own = W.partitionBy(*home)
    kept = None
    for k in reversed(range(len(levels))):
        cells = starts.where(F.col("k") == k)
        if kept is not None:
            children = reps.where(F.col("k") == k).withColumns(
                {"qy": F.expr(f"floor(py / {PYRAMID_FACTOR})"), "qx": F.expr(f"floor(px / {PYRAMID_FACTOR})")}
            )
            opened = kept.select(*home, *box, "ub", F.col("py").alias("qy"), F.col("px").alias("qx"))
            cells = cells.unionByName(opened.join(children, [*by, "qy", "qx"]).drop("qy", "qx"))
        near = cells.withColumn("ub", F.least("ub", F.min(far).over(own)))
        kept = near.where(F.expr(f"{gap2(levels[k], *box)} <= ub"))
    # One row per home, so a coordinate meets its cells as a list and keeps its own few.
    lists = kept.groupBy(*home).agg(F.collect_list(F.struct("py", "px", "ry", "rx")).alias("cells"))
    ub = F.expr("array_min(transform(cells, c -> (ly - c.ry) * (ly - c.ry) + (lx - c.rx) * (lx - c.rx)))")
    reached = gap2(levels[0], "ly", "ly", "lx", "lx").replace("py", "c.py").replace("px", "c.px")
    mine = placed.join(lists, home).withColumn("ub", ub).select(
        *by, "ly", "lx", F.explode(F.expr(f"filter(cells, c -> {reached} <= ub)")).alias("c")
    )
    base_cells = mine.select(*by, "ly", "lx", F.col("c.py").alias("cy"), F.col("c.px").alias("cx"))
    pairs = base_cells.join(_with_cells(sites, "ry", "rx", r0), [*by, "cy", "cx"]).withColumn("d2", _d2())
    return _best(pairs, by)


def nearest_sites(
    coords: DataFrame,
    sites: DataFrame,
    by: Sequence[str],
    radius: float | None,
    first_radius: float = 0.3,
    inclusive: bool = True,
    expand: str = "left",
) -> DataFrame:
    """(by..., ly, lx, best) for the coordinates that have a nearest site."""
    r = round((radius if radius is not None else first_radius) * TICKS)
    hit = _best(candidate_pairs(coords, sites, r, by, expand), by, expand)
    if radius is not None:
        if not inclusive:
            hit = hit.where(F.col("best.d2") < F.lit(r * r).cast("long"))
        return hit
    missing = _without_neighbour(coords, sites, r, by, expand)
    return hit.unionByName(_search_beyond(missing, sites, r, by))


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    payload: Sequence[str],
    by: Sequence[str] = ("date",),
    max_distance: float | None = None,
    inclusive: bool = True,
    how: str = "inner",
    lat: str = "latitude",
    lon: str = "longitude",
    right_lat: str = "latitude",
    right_lon: str = "longitude",
    first_radius: float = 0.3,
    expand: str = "left",
) -> DataFrame:
    """Left rows with the payload of their nearest right point (planar degrees).

    Adds ``distance``, ``near_latitude``, ``near_longitude`` and the payload columns. Without
    ``max_distance`` the search is unbounded. Equal distances: lowest latitude, then longitude,
    then smallest payload. ``by`` keys must match exactly; pass ``by=()`` to ignore dates.
    ``expand`` names the smaller side, which is copied into the cells it reaches.
    """
    by = list(by)
    coords = _coordinates(left, by, lat, lon)
    sites = _sites(right, by, right_lat, right_lon, payload)
    best = nearest_sites(coords, sites, by, max_distance, first_radius, inclusive, expand)
    found = best.select(
        *by,
        "ly",
        "lx",
        planar_distance("best.d2").alias("distance"),
        (F.col("best.ry") / F.lit(float(TICKS))).alias("near_latitude"),
        (F.col("best.rx") / F.lit(float(TICKS))).alias("near_longitude"),
        *[F.col("best.p")[c].alias(c) for c in payload],
    )
    keyed = left.withColumns({"ly": ticks(lat), "lx": ticks(lon)})
    return keyed.join(found, [*by, "ly", "lx"], how).drop("ly", "lx")


def nearest_within(
    left: DataFrame, right: DataFrame, payload: Sequence[str], tolerance: float,
    by: Sequence[str] = ("date",),
) -> DataFrame:
    """Inner nearest join that keeps only matches within the tolerance."""
    return nearest_join(left, right, payload, by=by, max_distance=tolerance)


def rounded_join_or_nearest(
    left: DataFrame, right: DataFrame, payload: Sequence[str], by: Sequence[str] = ("date",),
    tolerance: float = 0.05,
) -> DataFrame:
    """Join on 3-decimal coordinates; if nothing at all matches, nearest point under the tolerance."""
    by = list(by)
    key_l = left.withColumns({"_y": ticks("latitude", 1000), "_x": ticks("longitude", 1000)})
    key_r = right.select(
        *by, ticks("latitude", 1000).alias("_y"), ticks("longitude", 1000).alias("_x"), *payload
    )
    exact = key_l.join(key_r, [*by, "_y", "_x"]).select(*left.columns, *payload)
    any_exact = exact.agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
    near = nearest_join(
        left, right, payload, by=by, max_distance=tolerance, inclusive=False
    ).select(*left.columns, *payload)
    return exact.unionByName(near.where(~any_exact))


def points_in_boxes(
    points: DataFrame,
    reference: DataFrame,
    half: float,
    closed: str = "both",
    by: Sequence[str] = ("date",),
) -> DataFrame:
    """Points with the reference cells whose box (half width ``half``) holds them.

    Output: the point columns plus ``ref_latitude`` and ``ref_longitude``. ``closed='left'`` is
    [lo, hi). Overlapping boxes give one row each.
    """
    by = list(by)
    h = round(half * TICKS)
    size = max(1, 2 * h)
    boxes = (
        reference.select(*by, ticks("latitude").alias("ry"), ticks("longitude").alias("rx"))
        .distinct()
        .transform(lambda d: _near_cells(d, "ry", "rx", size, h))
    )
    keyed = _with_cells(
        points.withColumns({"ly": ticks("latitude"), "lx": ticks("longitude")}), "ly", "lx", size
    )
    dy, dx = F.col("ly") - F.col("ry"), F.col("lx") - F.col("rx")
    upper = (dy <= h) & (dx <= h) if closed == "both" else (dy < h) & (dx < h)
    return (
        keyed.join(boxes, [*by, "cy", "cx"])
        .where((dy >= -h) & (dx >= -h) & upper)
        .withColumns(
            {
                "ref_latitude": F.col("ry") / F.lit(float(TICKS)),
                "ref_longitude": F.col("rx") / F.lit(float(TICKS)),
            }
        )
        .drop("ly", "lx", "ry", "rx", "cy", "cx")
    )


def radius_join(
    left: DataFrame,
    right: DataFrame,
    payload: Sequence[str],
    radius: float,
    by: Sequence[str] = ("date",),
    fallback: bool = True,
    expand: str = "left",
    first_radius: float | None = None,
) -> DataFrame:
    """(target keys..., ry, rx, d2, payload..., fallback): each distinct left coordinate with every
    right point within the radius, or with its nearest one when there is none.

    ``right`` must hold one row per coordinate (aggregate first); copies are kept as they are.
    """
    inside = radius_pairs(left, right, payload, radius, by, expand).withColumn(
        "fallback", F.lit(False)
    )
    if not fallback:
        return inside
    outside = nearest_if_lonely(left, right, payload, radius, by, expand, first_radius)
    return inside.unionByName(outside.withColumn("fallback", F.lit(True)))


def _radius_sides(left, right, payload, by):
    coords = _coordinates(left, by, "latitude", "longitude")
    sites = right.select(
        *by, ticks("latitude").alias("ry"), ticks("longitude").alias("rx"),
        F.struct(*payload).alias("p"),
    )
    return coords, sites


def radius_pairs(
    left: DataFrame, right: DataFrame, payload: Sequence[str], radius: float,
    by: Sequence[str] = ("date",), expand: str = "left",
) -> DataFrame:
    """The pairs of ``radius_join`` within the radius only, keyed by ``target_keys``."""
    by = list(by)
    coords, sites = _radius_sides(left, right, payload, by)
    pairs = candidate_pairs(coords, sites, round(radius * TICKS), by, expand)
    return pairs.select(
        *target_keys(by, expand), "ry", "rx", "d2", *[F.col("p")[c].alias(c) for c in payload]
    )


def nearest_if_lonely(
    left: DataFrame, right: DataFrame, payload: Sequence[str], radius: float,
    by: Sequence[str] = ("date",), expand: str = "left", first_radius: float | None = None,
    found: DataFrame | None = None,
) -> DataFrame:
    """One pair with the nearest right point for each left coordinate with none in the radius.

    ``found`` may pass pairs that are already stored, to tell the lonely coordinates from.
    """
    by = list(by)
    coords, sites = _radius_sides(left, right, payload, by)
    if found is None:
        lonely = _without_neighbour(coords, sites, round(radius * TICKS), by, expand)
    else:
        keys = [*by, "ly", "lx"]
        lonely = coords.join(found.select(*keys).distinct(), keys, "left_anti")
    unique = sites.groupBy(*by, "ry", "rx").agg(F.min("p").alias("p"))
    nearest = _search_beyond(lonely, unique, round((first_radius or radius) * TICKS), by)
    if expand == "right":
        nearest = _with_cells(nearest, "ly", "lx", round(radius * TICKS))
    return nearest.select(
        *target_keys(by, expand), F.col("best.ry").alias("ry"), F.col("best.rx").alias("rx"),
        F.col("best.d2").alias("d2"), *[F.col("best.p")[c].alias(c) for c in payload],
    )


def lattice_interpolate(
    targets: DataFrame,
    source: DataFrame,
    value: str,
    step: float,
    origin: tuple[float, float] = (0.0, 0.0),
    by: Sequence[str] = ("date",),
    out: str = "interpolated",
) -> DataFrame:
    """Piecewise-linear interpolation from a regular source lattice; nearest point elsewhere.

    Each lattice square is split on its SW-NE diagonal. A target inside a triangle with all three
    corners present gets the plane through them; any other target gets its nearest source value. Only
    source points on the lattice are corners; all others serve the nearest value alone.
    """
    by = list(by)
    s = round(step * TICKS)
    y0, x0 = round(origin[0] * TICKS), round(origin[1] * TICKS)
    on_lattice = (F.pmod(ticks("latitude") - y0, F.lit(s)) == 0) & (F.pmod(ticks("longitude") - x0, F.lit(s)) == 0)
    unique = source.where(on_lattice).groupBy(
        *by,
        floor_div(ticks("latitude") - y0, s).alias("i"),
        floor_div(ticks("longitude") - x0, s).alias("j"),
    ).agg(F.avg(value).alias("v"))
    # A source point is a corner of four squares; send its value to each and gather by square.
    corner = F.explode(
        F.array(*[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)
        ])
    )
    squares = (
        unique.withColumn("c", corner)
        .groupBy(*by, (F.col("i") - F.col("c.a")).alias("i"), (F.col("j") - F.col("c.b")).alias("j"))
        .agg(*[
            F.max(F.when((F.col("c.a") == a) & (F.col("c.b") == b), F.col("v"))).alias(f"v{a}{b}")
            for a in (0, 1) for b in (0, 1)
        ])
    )
    coords = _coordinates(targets, by, "latitude", "longitude").withColumns(
        {
            "i": floor_div(F.col("ly") - y0, s), "j": floor_div(F.col("lx") - x0, s),
            "u": F.pmod(F.col("ly") - y0, F.lit(s)) / F.lit(float(s)),
            "w": F.pmod(F.col("lx") - x0, F.lit(s)) / F.lit(float(s)),
        }
    )
    u, w, v00, v11 = F.col("u"), F.col("w"), F.col("v00"), F.col("v11")
    upper = v00 + (F.col("v10") - v00) * u + (v11 - F.col("v10")) * w  # u > w: SW, NW, NE
    lower = v00 + (F.col("v01") - v00) * w + (v11 - F.col("v01")) * u  # u < w: SW, SE, NE
    diagonal = v00 + (v11 - v00) * u
    # On an edge only the corners of that edge carry weight.
    plane = (
        F.when((u == 0) & (w == 0), v00)
        .when(u == 0, v00 + (F.col("v01") - v00) * w)
        .when(w == 0, v00 + (F.col("v10") - v00) * u)
        .when(u == w, diagonal)
        .when(u > w, upper)
        .otherwise(lower)
    )
    placed = coords.join(squares, [*by, "i", "j"], "left").select(*by, "ly", "lx", plane.alias("x"))
    inside = placed.where("x IS NOT NULL")
    outside = placed.where("x IS NULL").select(*by, "ly", "lx")
    sites = _sites(source.where(F.col(value).isNotNull()), by, "latitude", "longitude", [value])
    near = nearest_sites(outside, sites, by, None, first_radius=step).select(
        *by, "ly", "lx", F.col("best.p")[value].alias("x")
    )
    both = inside.unionByName(near).withColumnRenamed("x", out)
    keyed = targets.withColumns({"ly": ticks("latitude"), "lx": ticks("longitude")})
    return keyed.join(both, [*by, "ly", "lx"], "left").drop("ly", "lx")
