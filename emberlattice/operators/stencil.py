"""Neighbourhood features on regular grids by stencil kernels.

Where source and target are both regular, the neighbours of a target, their distances and weights depend only on
where the target lies inside its source cell. The places that occur are few: one for each remainder of the two
steps. One small kernel table holds each place's neighbours; a target reads them from the block of source points around
its cell. No candidate pairs are made, and no row is sorted or grouped for each target.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlattice.functions import TICKS, ceil_div, degrees, floor_div, planar_distance, ticks
from emberlattice.operators.features import WEIGHT_OFFSET, slope
from emberlattice.operators.spatial import nearest_join

BROADCAST_PLACES = 100_000


def is_regular(source: DataFrame, step: float) -> bool:
    """Whether all coordinates lie on one grid of the step: a single aggregate over the table."""
    s = round(step * TICKS)
    y, x = ticks("latitude"), ticks("longitude")
    row = source.agg(F.min(F.pmod(y, F.lit(s))), F.max(F.pmod(y, F.lit(s))), F.min(F.pmod(x, F.lit(s))), F.max(F.pmod(x, F.lit(s)))).first()
    return row[0] == row[1] and row[2] == row[3]


def _reach(radius: int, step: int) -> tuple[int, int]:
    """First and last source row, counted from a target's cell, that the radius can reach."""
    return -(radius // step), (step - 1 + radius) // step


def kernel_table(spark: SparkSession, step: int, radius: int, unit_y: int, unit_x: int) -> DataFrame:
    """(fy, fx, kernel): for each place inside a source cell the neighbours within the radius.

    kernel is an array of (slot, d2, w) in (latitude, longitude) order; slots number the block's points row by row.
    All in ticks. The table has step/unit_y * step/unit_x rows and is made by Spark.
    """
    low, high = _reach(radius, step)
    across = high - low + 1
    rows, cols = step // unit_y, step // unit_x
    places = spark.range(rows * cols).select((F.call_function("div", F.col("id"), F.lit(cols)) * unit_y).alias("fy"),
                                             (F.col("id") % cols * unit_x).alias("fx"))

    def neighbour(slot: Column) -> Column:
        dy = (F.call_function("div", slot, F.lit(across)) + low) * step - F.col("fy")
        dx = (slot % across + low) * step - F.col("fx")
        d2 = dy * dy + dx * dx
        return F.struct(slot.cast("int").alias("slot"), d2.alias("d2"), (1 / (planar_distance(d2) + F.lit(WEIGHT_OFFSET))).alias("w"))

    slots = F.transform(F.sequence(F.lit(0), F.lit(across * across - 1)).cast("array<bigint>"), neighbour)
    return places.select("fy", "fx", F.filter(slots, lambda k: k["d2"] <= radius * radius).alias("kernel"))


def neighbour_sets(kernels: DataFrame) -> list[list[int]]:
    """The distinct sets of slots that places have: a few dozen, for a radius of a step or so."""
    found = kernels.select(F.transform("kernel", lambda k: k["slot"]).alias("slots")).distinct().collect()
    return sorted(list(r["slots"]) for r in found)


def source_blocks(source: DataFrame, measures: Sequence[str], step: int, radius: int) -> DataFrame:
    """(date, cy, cx, block): for each cell in reach of a source point its block, null where a point is missing.

    A point is copied into the cells whose blocks hold it; the smallest payload wins where rows share a point.
    """
    low, high = _reach(radius, step)
    across = high - low + 1
    y, x = ticks("latitude"), ticks("longitude")
    points = source.select("date", y.alias("y"), x.alias("x"), F.struct(*measures).alias("p")).where("y IS NOT NULL AND x IS NOT NULL")
    points = points.groupBy("date", "y", "x").agg(F.min("p").alias("p"))
    points = points.withColumns({"gy": floor_div(F.col("y"), step), "gx": floor_div(F.col("x"), step)})
    for name, at in (("cy", "gy"), ("cx", "gx")):
        points = points.withColumn(name, F.explode(F.sequence(F.col(at) - high, F.col(at) - low)))
    slot = (F.col("gy") - F.col("cy") - low) * across + (F.col("gx") - F.col("cx") - low)
    found = points.groupBy("date", "cy", "cx").agg(F.map_from_entries(F.collect_list(
        F.struct(slot.cast("int"), F.struct("y", "x", F.col("p"))))).alias("m"))
    return found.select("date", "cy", "cx", F.transform(
        F.sequence(F.lit(0), F.lit(across * across - 1)), lambda i: F.try_element_at("m", i)).alias("block"))


def _cells(spec: DataFrame, origin: tuple[int, int], step: int) -> DataFrame:
    """Cells of the source grid that hold targets of a day's lattice, with the lattice's columns; rows are spread over tasks."""
    cells = spec
    for name, start, size, count, o in (("cy", "lat0", "dlat", "n_lat", origin[0]), ("cx", "lon0", "dlon", "n_lon", origin[1])):
        first = floor_div(F.col(start) - o, step)
        last = floor_div(F.col(start) + F.col(size) * (F.col(count) - 1) - o, step)
        cells = cells.withColumn(name, F.explode(F.sequence(first, last)))
        if name == "cy":
            cells = cells.repartition("date", "cy")
    return cells


def _inside(name: str, start: str, size: str, count: str, origin: int, step: int) -> Column:
    """Indices of the lattice rows (or columns) inside a cell."""
    low = F.greatest(ceil_div(F.col(name) * step + origin - F.col(start), F.col(size)), F.lit(0))
    high = F.least(ceil_div((F.col(name) + 1) * step + origin - F.col(start), F.col(size)), F.col(count)) - 1
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def _values(m: str) -> Column:
    return F.filter(F.transform("near", lambda x: x["p"][m]), lambda v: v.isNotNull())


def _statistics(m: str) -> dict[str, Column]:
    """Of one set of neighbours ``near`` (y, x, p): what does not depend on distances."""
    known, many = F.size(f"v_{m}"), F.size("near") > 2
    mean = F.try_divide(F.aggregate(f"v_{m}", F.lit(0.0), lambda a, v: a + v), known)
    low, high = F.array_min(f"v_{m}"), F.array_max(f"v_{m}")

    def spread(mean: Column) -> Column:
        return F.sqrt(F.aggregate(f"v_{m}", F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / (known - 1))

    return {
        f"coarse_{m}_mean": F.when(many, mean), f"coarse_{m}_min": F.when(many, low), f"coarse_{m}_max": F.when(many, high),
        f"coarse_{m}_std": F.when(many & (known > 1), F.transform(F.array(mean), spread)[0]),
        f"coarse_{m}_range": F.when(many & (known > 1), high - low),
    }


def _gradients(m: str) -> dict[str, Column]:
    """Mean slope of the neighbours that have a value, in (latitude, longitude) order."""
    points = F.filter("near", lambda x: x["p"][m].isNotNull())

    def mean_slope(axis: str) -> Column:
        def at(x: Column) -> tuple[Column, Column]:
            return x["p"][m], x[axis].cast("double")

        def one(points: Column) -> Column:
            slopes = F.filter(F.transform(points, lambda x, i: slope(
                at(x), F.get(points, i - 1), F.get(points, i + 1), at) * F.lit(float(TICKS))), lambda s: s.isNotNull())
            return F.try_divide(F.aggregate(slopes, F.lit(0.0), lambda a, s: a + s), F.size(slopes))

        return F.transform(F.array(points), one)[0]

    return {f"coarse_{m}_{name}_gradient": F.when(F.size("near") >= 3, mean_slope(axis)) for name, axis in (("lat", "y"), ("lon", "x"))}


def stencil_features(
    spec: DataFrame, source: DataFrame, measures: Sequence[str], radius: float = 0.3, step: float = 0.25,
    gradient_of: str | None = "fwi",
) -> DataFrame:
    """The features of ``idw_features`` for every node of each day's lattice (``lattice_spec`` by date).

    The source grid is regular with ``step`` degrees and one origin for all days (``is_regular``), with any points
    missing; each day's lattice begins on it. A node without a point in the radius takes the nearest one, found by
    the general search for these nodes only. Rows that share a point: the smallest payload wins.
    """
    spark = source.sparkSession
    s, r = round(step * TICKS), round(radius * TICKS)
    first = source.where("latitude IS NOT NULL AND longitude IS NOT NULL").agg(
        F.min(F.pmod(ticks("latitude"), F.lit(s))), F.min(F.pmod(ticks("longitude"), F.lit(s)))).first()
    origin = (first[0] or 0, first[1] or 0)
    shifted = source.withColumns({"latitude": degrees(ticks("latitude") - origin[0]), "longitude": degrees(ticks("longitude") - origin[1])})
    blocks = source_blocks(shifted, measures, s, r)
    # Every node lies a multiple of these units from the grid, whatever a day's steps: doubled ones are multiples too.
    units = spec.agg(F.min("dlat"), F.min("dlon")).first()
    unit_y, unit_x = (math.gcd(u or s, s) for u in units)
    kernels = kernel_table(spark, s, r, unit_y, unit_x)
    sets = neighbour_sets(kernels)
    numbered = F.array(*[F.array(*[F.lit(k) for k in slots]).cast("array<int>") for slots in sets])
    kernels = kernels.select("fy", "fx", "kernel", (F.array_position(numbered, F.transform("kernel", lambda k: k["slot"])) - 1).cast("int").alias("set"))
    if (s // unit_y) * (s // unit_x) <= BROADCAST_PLACES:
        kernels = F.broadcast(kernels)
    cells = _cells(spec, origin, s).join(blocks, ["date", "cy", "cx"], "left")

    def centre(axis: str, o: int) -> Column:
        return (F.try_divide(F.aggregate("near", F.lit(0).cast("long"), lambda a, x: a + x[axis]), F.size("near")) + o) / float(TICKS)

    # Once for each cell and set of neighbours, not for each node.
    shared: dict[str, Column] = {"coarse_lat": centre("y", origin[0]), "coarse_lon": centre("x", origin[1]), "coarse_n": F.size("near").cast("long")}
    for m in measures:
        shared |= _statistics(m)
    if gradient_of:
        shared |= _gradients(gradient_of)
    per_set = cells.where("block IS NOT NULL").select(
        "date", "cy", "cx", "block", F.posexplode(numbered).alias("set", "slots"))
    per_set = per_set.select("date", "cy", "cx", "set", F.filter(
        F.transform("slots", lambda k: F.get("block", k)), lambda x: x.isNotNull()).alias("near"))
    per_set = per_set.select("*", *[_values(m).alias(f"v_{m}") for m in measures])
    per_set = per_set.select("date", "cy", "cx", "set", F.struct(*[c.alias(n) for n, c in shared.items()]).alias("s"))
    stats = per_set.groupBy("date", "cy", "cx").agg(F.map_from_entries(F.collect_list(F.struct("set", "s"))).alias("stats"))

    def nodes(cells: DataFrame, *more: str) -> DataFrame:
        rows = cells.withColumn("i", F.explode(_inside("cy", "lat0", "dlat", "n_lat", origin[0], s)))
        rows = rows.withColumn("j", F.explode(_inside("cx", "lon0", "dlon", "n_lon", origin[1], s)))
        rows = rows.withColumns({"ly": F.col("lat0") + F.col("i") * F.col("dlat"), "lx": F.col("lon0") + F.col("j") * F.col("dlon")})
        rows = rows.withColumns({"fy": F.col("ly") - origin[0] - F.col("cy") * s, "fx": F.col("lx") - origin[1] - F.col("cx") * s})
        return rows.join(kernels, ["fy", "fx"]).select("date", "ly", "lx", "kernel", "block", *more)

    def present(k: Column) -> Column:
        return F.get("block", k["slot"]).isNotNull()

    def weighted(m: str) -> Column:
        """Sum of weighted values over the weights of all neighbours, null where no neighbour has a value."""
        total = F.aggregate("kernel", F.lit(None).cast("double"), lambda a, k: F.when(
            F.get("block", k["slot"])["p"][m].isNotNull(), F.coalesce(a, F.lit(0.0)) + F.get("block", k["slot"])["p"][m] * k["w"]).otherwise(a))
        return total / F.col("weight")

    found = nodes(cells.where("block IS NOT NULL").join(stats, ["date", "cy", "cx"]), F.try_element_at("stats", F.col("set")).alias("s"))
    found = found.where("s.coarse_n > 0").withColumns({
        "weight": F.aggregate("kernel", F.lit(0.0), lambda a, k: a + F.when(present(k), k["w"]).otherwise(0.0)),
        "d2": F.aggregate("kernel", F.lit(None).cast("bigint"), lambda a, k: F.when(present(k), F.least(a, k["d2"])).otherwise(a))})
    order = [n for m in measures for n in (f"coarse_{m}", *_statistics(m))] + (list(_gradients(gradient_of)) if gradient_of else [])
    columns = {n: F.col(f"s.{n}") for n in order} | {f"coarse_{m}": weighted(m) for m in measures}
    inside = found.select(
        "date", degrees("ly").alias("target_lat"), degrees("lx").alias("target_lon"), *[columns[n].alias(n) for n in order],
        planar_distance("d2").alias("coarse_distance"), "s.coarse_lat", "s.coarse_lon", "s.coarse_n")
    # Where the radius reaches a corner from any place, only cells with a gap in their block can hold a node without a neighbour.
    gaps = cells.where(F.col("block").isNull() | F.exists("block", lambda p: p.isNull())) if 2 * r * r >= s * s else cells
    none = F.col("block").isNull() | ~F.exists("kernel", present)
    lonely = nodes(gaps).where(none).select("date", degrees("ly").alias("latitude"), degrees("lx").alias("longitude"))
    alone = nearest_join(lonely, source, list(measures), by=("date",), expand="right")
    types = dict(inside.dtypes)
    known = {"target_lat": F.col("latitude"), "target_lon": F.col("longitude"), "coarse_distance": F.col("distance"),
             "coarse_lat": F.col("near_latitude"), "coarse_lon": F.col("near_longitude"), "coarse_n": F.lit(1),
             **{f"coarse_{m}": F.col(m) for m in measures}, "date": F.col("date")}
    return inside.unionByName(alone.select(*[known.get(n, F.lit(None)).cast(types[n]).alias(n) for n in inside.columns]))
