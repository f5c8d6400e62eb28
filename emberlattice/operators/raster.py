"""Land-cover rasters as rows (pix_row, pix_col, landcover)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlattice.functions import round_coord
from emberlattice.operators.clean import dedupe_keys, union_all
from emberlattice.schema import LANDCOVER_CLASSES

# Transform of a north-up raster: (west edge, north edge, pixel width, pixel height) in degrees.
Transform = tuple[float, float, float, float]


def with_pixel_coordinates(pixels: DataFrame, transform: Transform) -> DataFrame:
    """Add pixel-centre longitude and latitude, rounded to 3 decimals."""
    west, north, dx, dy = transform
    return pixels.withColumns(
        {
            "longitude": round_coord(F.lit(west) + (F.col("pix_col") + 0.5) * F.lit(dx)),
            "latitude": round_coord(F.lit(north) - (F.col("pix_row") + 0.5) * F.lit(dy)),
        }
    )


def drop_nodata(pixels: DataFrame, nodata: int = 0, code: str = "landcover") -> DataFrame:
    return pixels.where(F.col(code) != nodata)


def label_codes(
    pixels: DataFrame, classes: Mapping[int, str] = LANDCOVER_CLASSES, code: str = "landcover"
) -> DataFrame:
    """Class name per code from a literal map; unknown codes become ``Unknown_<code>``."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(classes.items())])
    label = F.coalesce(
        F.try_element_at(names, F.col(code)), F.concat(F.lit("Unknown_"), F.col(code).cast("string"))
    )
    return pixels.withColumn("landcover_class", label)


def clip_raster(pixels: DataFrame, transform: Transform, box: Sequence[float]) -> DataFrame:
    """Pixels whose centre lies in the box, as an index range that the scan can prune."""
    west, north, dx, dy = transform
    south_edge, north_edge, west_edge, east_edge = box
    lat = F.lit(north) - (F.col("pix_row") + 0.5) * F.lit(dy)
    lon = F.lit(west) + (F.col("pix_col") + 0.5) * F.lit(dx)
    row0, row1 = int((north - north_edge) / dy) - 1, int((north - south_edge) / dy) + 1
    col0, col1 = int((west_edge - west) / dx) - 1, int((east_edge - west) / dx) + 1
    return pixels.where(
        F.col("pix_row").between(row0, row1) & F.col("pix_col").between(col0, col1)
    ).where(lat.between(south_edge, north_edge) & lon.between(west_edge, east_edge))


def mosaic(tiles: Sequence[DataFrame], nodata: int = 0, code: str = "landcover") -> DataFrame:
    """Merge tiles on a common pixel index; the first tile with data wins."""
    tagged = union_all([t.withColumn("_tile", F.lit(k)) for k, t in enumerate(tiles)])
    return (
        drop_nodata(tagged, nodata, code)
        .groupBy("pix_row", "pix_col")
        .agg(F.min(F.struct("_tile", code))[code].alias(code))
    )


def _size(pixels: DataFrame) -> Column:
    """(h, w) of the raster as a scalar struct."""
    return pixels.agg(
        F.struct(
            (F.max("pix_row") + 1).cast("long").alias("h"), (F.max("pix_col") + 1).cast("long").alias("w")
        ).alias("s")
    ).scalar()


def thin_raster(pixels: DataFrame, factor: int) -> DataFrame:
    """Nearest-neighbour reduction to floor(size / factor) rows and columns.

    Output cell r reads source row floor((r + 1/2) * height / new height); tested in integers.
    """
    sized = pixels.withColumn("_s", _size(pixels))
    for name, side in (("pix_row", "h"), ("pix_col", "w")):
        full = F.col("_s")[side]
        small = F.call_function("div", full, F.lit(factor).cast("long"))
        x = F.col(name).cast("long")
        # Smallest r with (2r + 1) * full >= 2 * x * small; it reads x if it stays below x + 1.
        r = F.call_function("div", 2 * x * small - full + 2 * full - 1, 2 * full)
        r = F.greatest(r, F.lit(0).cast("long"))
        reads = ((2 * r + 1) * full < 2 * (x + 1) * small) & ((2 * r + 1) * full >= 2 * x * small)
        sized = sized.where(reads & (r < small)).withColumn(name, r)
    return sized.drop("_s")


def sample_every_nth(
    pixels: DataFrame, step: int, nodata: int = 0, transform: Transform | None = None
) -> DataFrame:
    """Valid pixels whose row and column are multiples of the step; the step is halved until any
    pixel is valid. All candidate steps are tested in one aggregate."""
    steps, k = [], step
    while k >= 1:
        steps.append(k)
        k //= 2
    valid = F.col("landcover") != nodata

    def on(k):
        return (F.pmod("pix_row", k) == 0) & (F.pmod("pix_col", k) == 0)

    best = pixels.agg(
        F.coalesce(*[F.when(F.bool_or(valid & on(F.lit(s))), F.lit(s)) for s in steps]).alias("k")
    ).scalar()
    chosen = pixels.withColumn("step", best).where(valid & on(F.col("step")))
    if transform is None:
        return chosen
    placed = with_pixel_coordinates(chosen, transform)
    unique = dedupe_keys(placed, ["longitude", "latitude"], ["pix_row", "pix_col"])
    return label_codes(unique)


def lattice_axis(low: float, high: float, resolution: float) -> int:
    return int(round((high - low) / resolution, 9)) + 1


def sample_lattice(
    pixels: DataFrame, transform: Transform, height: int, width: int, resolution: float = 0.001,
    max_samples: int | None = None, nodata: int = 0,
) -> DataFrame:
    """Values under an evenly spaced lattice over the raster bounds.

    If ``max_samples`` is given, a larger lattice is thinned on both axes, to 10 at the least. Lattice
    coordinates are rounded to 3 decimals and looked up by an equi join on the pixel index.
    """
    west, north, dx, dy = transform
    east, south = west + width * dx, north - height * dy
    n_lon, n_lat = lattice_axis(west, east, resolution), lattice_axis(south, north, resolution)
    if max_samples is not None and n_lon * n_lat > max_samples:
        shrink = (n_lon * n_lat / max_samples) ** 0.5
        n_lon, n_lat = max(10, int(n_lon / shrink)), max(10, int(n_lat / shrink))
    spark = pixels.sparkSession

    def axis(name, low, high, n):
        at = F.lit(low) + F.col("id") * F.lit((high - low) / (n - 1))
        return round_coord(at).alias(name)

    lattice = spark.range(n_lat).select(axis("latitude", south, north, n_lat)).withColumn(
        "id", F.explode(F.sequence(F.lit(0), F.lit(n_lon - 1)))
    ).select("latitude", axis("longitude", west, east, n_lon))
    placed = lattice.select(
        "latitude", "longitude",
        F.floor((F.lit(north) - F.col("latitude")) / F.lit(dy)).cast("int").alias("pix_row"),
        F.floor((F.col("longitude") - F.lit(west)) / F.lit(dx)).cast("int").alias("pix_col"),
    )
    hit = placed.join(drop_nodata(pixels, nodata), ["pix_row", "pix_col"])
    unique = dedupe_keys(hit.select("longitude", "latitude", "landcover"), ["longitude", "latitude"])
    return label_codes(unique)
