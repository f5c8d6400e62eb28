"""Land-cover rasters as rows."""

from pyspark.sql import functions as F

from checks.base import build, check
from emberlattice.operators import raster as Z
from emberlattice.operators.aggregate import class_area, mode_per_cell
from emberlattice.schema import LANDCOVER_CLASSES
from emberlattice.sources import derived as D

P = ["landcover_pixels"]
TRANSFORM = (-9.6, 42.2, 0.025, 0.025)
_LABEL = "CASE landcover " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LANDCOVER_CLASSES.items()) + " ELSE 'Unknown_' || landcover END"
_LON, _LAT = "-9.6::DOUBLE+(pix_col+0.5)*0.025::DOUBLE", "42.2::DOUBLE-(pix_row+0.5)*0.025::DOUBLE"
_R3 = "(round_even(({})*1000,0)/1000+0.0)"


@check("P34_label_codes", build(f"SELECT pix_row, pix_col, landcover, {_LABEL} AS landcover_class FROM landcover_pixels", P))
def _(spark, sf):
    return Z.label_codes(D.landcover_pixels(spark, sf))


@check("P35_drop_nodata", build("SELECT * FROM landcover_pixels WHERE landcover<>0", P))
def _(spark, sf):
    return Z.drop_nodata(D.landcover_pixels(spark, sf))


@check("raster_pixel_coordinates", build(f"SELECT *, {_R3.format(_LON)} AS longitude, {_R3.format(_LAT)} AS latitude FROM landcover_pixels", P), ["longitude", "latitude"])
def _(spark, sf):
    return Z.with_pixel_coordinates(D.landcover_pixels(spark, sf), TRANSFORM)


@check("P33_clip_raster", build(f"SELECT * FROM landcover_pixels WHERE {_LAT} BETWEEN 39.01 AND 41.02 AND {_LON} BETWEEN -9.01 AND -7.52", P))
def _(spark, sf):
    return Z.clip_raster(D.landcover_pixels(spark, sf), TRANSFORM, (39.01, 41.02, -9.01, -7.52))


@check("P32_mosaic", build(
    "SELECT pix_row, pix_col, first(landcover ORDER BY tile) AS landcover FROM (SELECT 0 AS tile, * FROM landcover_pixels WHERE pix_col<70 UNION ALL"
    " SELECT 1, pix_row, pix_col, CASE WHEN landcover=95 THEN 0 ELSE 100 END FROM landcover_pixels WHERE pix_col>=40) WHERE landcover<>0 GROUP BY 1,2", P))
def _(spark, sf):
    px = D.landcover_pixels(spark, sf)
    second = px.where("pix_col >= 40").withColumn("landcover", F.when(F.col("landcover") == 95, 0).otherwise(100))
    return Z.mosaic([px.where("pix_col < 70"), second])


@check("P31_thin_raster", build(
    "SELECT CAST(a.r AS BIGINT) AS pix_row, CAST(b.r AS BIGINT) AS pix_col, p.landcover FROM landcover_pixels p"
    " JOIN (SELECT r, CAST((2*r+1)*h//(2*(h//7)) AS BIGINT) AS src FROM (SELECT h, unnest(range(0, h//7)) AS r FROM s)) a ON a.src=p.pix_row"
    " JOIN (SELECT r, CAST((2*r+1)*w//(2*(w//7)) AS BIGINT) AS src FROM (SELECT w, unnest(range(0, w//7)) AS r FROM s)) b ON b.src=p.pix_col", P,
    [("s", "SELECT CAST(max(pix_row)+1 AS BIGINT) AS h, CAST(max(pix_col)+1 AS BIGINT) AS w FROM landcover_pixels")]))
def _(spark, sf):
    return Z.thin_raster(D.landcover_pixels(spark, sf), 7)


@check("P29_sample_every_nth", build(
    f"SELECT pix_row, pix_col, landcover, 10 AS step, {_R3.format(_LON)} AS longitude, {_R3.format(_LAT)} AS latitude, {_LABEL} AS landcover_class FROM landcover_pixels WHERE landcover<>0 AND pix_row%10=0 AND pix_col%10=0", P), ["longitude", "latitude"])
def _(spark, sf):
    return Z.sample_every_nth(D.landcover_pixels(spark, sf), 10, transform=TRANSFORM)


@check("P29_sample_halved_step", build(
    "SELECT pix_row, pix_col, landcover, 16 AS step FROM px WHERE landcover<>0 AND pix_row%16=0 AND pix_col%16=0", P,
    [("px", "SELECT pix_row, pix_col, CASE WHEN pix_row%32=0 AND pix_col%32=0 THEN 0 ELSE landcover END AS landcover FROM landcover_pixels")]))
def _(spark, sf):
    # All cells on multiples of 32 are nodata, so 64 and 32 find nothing and 16 is used.
    hole = (F.col("pix_row") % 32 == 0) & (F.col("pix_col") % 32 == 0)
    px = D.landcover_pixels(spark, sf).withColumn("landcover", F.when(hole, 0).otherwise(F.col("landcover")))
    return Z.sample_every_nth(px, 64)


_AX = "(round_even((({lo})::DOUBLE+k*(({hi})::DOUBLE-({lo})::DOUBLE)/({n}-1))*1000,0)/1000+0.0)"


@check("P30_sample_lattice", build(
    f"SELECT o.v AS longitude, a.v AS latitude, p.landcover, {_LABEL} AS landcover_class FROM (SELECT {_AX.format(lo=39.075, hi=42.2, n=51)} AS v FROM range(0,51) t(k)) a,"
    f" (SELECT {_AX.format(lo=-9.6, hi=-6.6, n=48)} AS v FROM range(0,48) t(k)) o, landcover_pixels p WHERE p.landcover<>0 AND p.pix_row=CAST(floor((42.2::DOUBLE-a.v)/0.025::DOUBLE) AS INTEGER) AND p.pix_col=CAST(floor((o.v+9.6::DOUBLE)/0.025::DOUBLE) AS INTEGER)", P),
    ["longitude", "latitude"])
def _(spark, sf):
    # Bounds of the first 125 rows; 0.0125 degree lattice of 251 x 241 points thinned to 51 x 48.
    return Z.sample_lattice(D.landcover_pixels(spark, sf), TRANSFORM, 125, 120, 0.0125, 2500)


@check("A32_mode_per_cell", build(
    "SELECT cell_row, cell_col, landcover FROM (SELECT pix_row//9 AS cell_row, pix_col//9 AS cell_col, landcover, row_number() OVER (PARTITION BY pix_row//9, pix_col//9 ORDER BY count(*) DESC, landcover) AS k FROM landcover_pixels WHERE landcover<>0 GROUP BY 1,2,3) WHERE k=1", P))
def _(spark, sf):
    px = Z.drop_nodata(D.landcover_pixels(spark, sf)).withColumns(
        {"cell_row": F.expr("cast(pix_row div 9 as int)"), "cell_col": F.expr("cast(pix_col div 9 as int)")})
    return mode_per_cell(px, ["cell_row", "cell_col"], "landcover")


@check("A33_class_area", build(
    f"SELECT landcover, landcover_class, count(*) AS pixel_count, 100.0*count(*)/sum(count(*)) OVER () AS percentage, count(*)*100/1e6 AS area_km2 FROM (SELECT landcover, {_LABEL} AS landcover_class FROM landcover_pixels WHERE landcover<>0) GROUP BY 1,2", P), ["percentage", "area_km2"])
def _(spark, sf):
    return class_area(Z.label_codes(Z.drop_nodata(D.landcover_pixels(spark, sf))))
