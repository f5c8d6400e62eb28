import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlattice.functions import band, km_per_degree_lon, latitude_band, quality_label, risk_category, wrap
from emberlattice.operators import aggregate as A
from emberlattice.operators import clean as C
from emberlattice.operators import joins as J
from emberlattice.operators import metrics as M
from emberlattice.operators import raster as Z
from emberlattice.schema import COARSE_BANDS, FINE_BANDS, FWI_DAILY
from emberlattice.sources import tables
from emberlattice.streaming import slices

NAN, INF = float("nan"), float("inf")


def one(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_nan_null_inf(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,), (INF,)], "x double")
    assert A.describe_measure(C.nan_to_null(df).where("x < 1e300"), "x").first()["count"] == 1
    assert C.finite_or_null(df, ["x"]).where("x IS NOT NULL").count() == 1
    assert C.drop_missing(df, ["x"]).count() == 2


def test_wrap_only_when_needed(spark):
    df = spark.createDataFrame([(350.4,), (180.0,), (-9.6,)], "longitude double")
    assert [round(v, 6) for v in one(df, wrap("longitude"))] == [-9.6, -180.0, -9.6]
    small = df.where("longitude < 0")
    assert one(C.wrap_longitude(small), "longitude") == [-9.6]


def test_bad_dates(spark):
    df = spark.createDataFrame([("2017-06-17",), ("17/06/nope",), ("2017-06-17 12:30:00",), (None,)], "t string")
    got = one(C.parse_date(df, "t"), "date")
    assert got == [dt.date(2017, 6, 17), None, dt.date(2017, 6, 17), None]


def test_bands(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (100.0,), (100.5,), (-1.0,)], "x double")
    assert one(df, band("x", FINE_BANDS)) == ["0-5", "5-12", "out_of_range", "out_of_range", "out_of_range"]
    assert one(df, band("x", COARSE_BANDS, "right")) == ["0-5", "0-5", "50-100", "out_of_range", "out_of_range"]
    lat = spark.createDataFrame([(41.0,), (41.1,), (39.5,)], "x double")
    assert one(lat, latitude_band("x")) == ["Central", "North", "South"]
    p = spark.createDataFrame([(90.0,), (89.9,), (24.9,), (None,)], "x double")
    assert one(p, risk_category("x")) == ["Very High", "High", "Very Low", "Low"]
    assert one(spark.createDataFrame([(0.9,), (0.91,)], "x double"), quality_label("x")) == ["Good", "Excellent"]


def test_bbox_tiers(spark):
    inner, outer = (36.0, 43.0, -10.0, -6.0), (35.0, 44.0, -11.0, -5.0)
    far = spark.createDataFrame([(35.5, -8.0), (60.0, 0.0)], "latitude double, longitude double")
    assert C.filter_bbox_or_widen(far, [inner, outer]).count() == 1
    assert C.filter_bbox_or_widen(far.where("latitude > 50"), [inner, outer]).count() == 1
    assert C.filter_bbox_or_widen(far.limit(0), [inner, outer]).count() == 0


def test_resolve_columns_and_exposure(spark):
    df = spark.createDataFrame([(1.0, 2.0, "2017-01-01", "x", 3.0)], "LAT double, lon_0 double, valid_time string, date string, u10 double")
    assert C.resolve_columns(df).columns == ["latitude", "longitude", "valid_time", "date", "10m_u_component_of_wind"]
    assert C.resolve_exposure(spark.createDataFrame([(5.0,)], "gdp_2020 double")).first()["exposure_value"] == 5.0
    assert C.resolve_exposure(spark.createDataFrame([(5.0,)], "thing double")).first()["exposure_value"] == 1.0


def test_dedupe_and_overlay(spark):
    s = "k int, a double, b double"
    df = spark.createDataFrame([(1, 3.0, 1.0), (1, 2.0, 9.0), (2, 5.0, None)], s)
    assert sorted(map(tuple, C.dedupe_keys(df, ["k"]).collect())) == [(1, 2.0, 9.0), (2, 5.0, None)]
    f0 = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, a double")
    f1 = spark.createDataFrame([(1, None, 7.0), (3, 4.0, 8.0)], "k int, a double, b double")
    got = sorted(map(tuple, J.overlay_last_wins([f0, f1], ["k"]).collect()))
    assert got == [(1, 1.0, 7.0), (2, 2.0, None), (3, 4.0, 8.0)]


def test_merge_needs_two_keys_and_suffixes(spark):
    a = spark.createDataFrame([("d", 40.0, -8.0, 1.0)], "date string, latitude double, longitude double, v double")
    assert "v_other" in J.merge_daily(a, a, "other").columns
    with pytest.raises(ValueError):
        J.merge_daily(a, a.select("date", "v"), "other")


def test_retention_gate(spark):
    s = "date string, latitude double, longitude double"
    base = spark.createDataFrame([("d", 40.0 + i / 4, -8.0) for i in range(20)], s)
    shifted = base.withColumn("latitude", F.col("latitude") + 0.02).withColumn("w", F.lit(1.0))
    far = base.withColumn("latitude", F.col("latitude") + 0.12).withColumn("w", F.lit(1.0))
    assert "w" in J.retention_gated_merge(base, shifted, "o", ["w"]).columns  # nearest path
    assert "w" not in J.retention_gated_merge(base, far, "o", ["w"]).columns  # base unchanged


def test_sample_is_stable_over_partitioning(spark):
    df = spark.range(5000).withColumn("v", F.col("id") * 2)
    a = C.sample_n(df.repartition(3), 50, ["id"]).collect()
    b = C.sample_n(df.repartition(11), 50, ["id"]).collect()
    assert a == b and len(a) == 50
    assert C.sample_n(df, 50, ["id"], 7).collect() != a


def test_group_metrics_minimum_and_constant(spark):
    rows = [("p", float(i), 2.0) for i in range(10)] + [("q", 1.0, 2.0)] * 9
    m = M.grid_point_metrics(spark.createDataFrame(rows, "k string, t double, p double"), "t", "p", keys=["k"]).collect()
    assert len(m) == 1 and m[0]["correlation"] is None and m[0]["r_squared_alt"] is not None


def test_mode_tie_and_raster(spark):
    px = spark.createDataFrame([(0, 30), (0, 10), (1, 20), (1, 20), (1, 5)], "cell int, landcover int")
    assert sorted(map(tuple, A.mode_per_cell(px, ["cell"], "landcover").collect())) == [(0, 10), (1, 20)]
    labels = one(Z.label_codes(spark.createDataFrame([(10,), (77,)], "landcover int")), "landcover_class")
    assert labels == ["Tree cover", "Unknown_77"]
    grid = spark.createDataFrame([(r, c, 0 if r % 4 == 0 and c % 4 == 0 else 10) for r in range(9) for c in range(9)],
                                 "pix_row int, pix_col int, landcover int")
    assert {r["step"] for r in Z.sample_every_nth(grid, 8).collect()} == {2}
    assert Z.thin_raster(grid, 3).select("pix_row").distinct().count() == 3
    empty = grid.withColumn("landcover", F.lit(0))
    assert Z.sample_every_nth(empty, 8).count() == 0


def test_thin_raster_uneven_size(spark):
    grid = spark.createDataFrame([(r, c, r * 100 + c) for r in range(11) for c in range(7)], "pix_row int, pix_col int, landcover int")
    got = sorted(tuple(x) for x in Z.thin_raster(grid, 2).collect())
    rows, cols = [int((r + 0.5) * 11 / 5) for r in range(5)], [int((c + 0.5) * 7 / 3) for c in range(3)]
    assert got == sorted((i, j, r * 100 + c) for i, r in enumerate(rows) for j, c in enumerate(cols))


def test_readers_writers(spark, tmp_path):
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    for year in (2016, 2017):
        with open(f"{folder}/fwi_{year}_daily.csv", "w") as f:
            f.write("time,latitude,longitude,fwi\n" + "".join(f"{year}-06-{d:02d} 12:00:00,40.0,-8.0,{'NaN' if d == 2 else d}\n" for d in range(1, 5)))
    df = tables.read_daily_table(spark, f"{folder}/fwi_2017_daily.csv", FWI_DAILY)
    assert df.count() == 4 and df.where("fwi IS NULL").count() == 1
    assert df.select("date").first()[0] == dt.date(2017, 6, 1)
    assert tables.scan_years(spark, folder, [2017], FWI_DAILY).count() == 4
    assert tables.scan_years(spark, folder, [2016, 2017], FWI_DAILY).count() == 8
    out = str(tmp_path / "out")
    tables.write_table(df, out)
    tables.append_slices(df.withColumn("date", F.date_add("date", 30)), out)
    back = spark.read.parquet(out)
    assert back.count() == 8 and len([d for d in os.listdir(out) if d.startswith("date=")]) == 8
    tables.write_sample(df, str(tmp_path / "sample"), 3, ["date"])
    assert spark.read.parquet(str(tmp_path / "sample")).count() == 3
    tables.write_summary_json(df.groupBy().agg(F.struct(F.count("fwi").alias("n")).alias("metrics")), str(tmp_path / "j"))
    part = [f for f in os.listdir(tmp_path / "j") if f.endswith(".json")][0]
    assert json.loads(open(tmp_path / "j" / part).readline())["metrics"]["n"] == 3


def test_stream_append(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    rows = spark.createDataFrame([(dt.datetime(2017, 6, 1 + i), 40.0, -8.0, float(i)) for i in range(6)],
                                 T.StructType(FWI_DAILY.fields))
    rows.where("fwi < 3").write.parquet(src)
    for expected in (3, 6):
        slices.append_slices_stream(slices.read_slices(spark, src, FWI_DAILY), out, cp).awaitTermination()
        assert spark.read.parquet(out).count() == expected
        rows.where("fwi >= 3").write.mode("append").parquet(src)


def daily(spark, days, shift=0.0):
    rows = [(dt.datetime(2017, 6, d), 40.0 + i, -8.0, float(d) + shift) for d in days for i in range(2)]
    return spark.createDataFrame(rows, T.StructType(FWI_DAILY.fields))


def slices_of(spark, path):
    return sorted((str(r["date"]), r["n"], r["x"]) for r in spark.read.parquet(path).groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.max("fwi").alias("x")).collect())


def test_replace_slices_twice_equals_once(spark, tmp_path):
    out, dated = str(tmp_path / "out"), F.col("time").cast("date")
    rows = daily(spark, [1, 2, 3]).withColumn("date", dated)
    tables.replace_slices(rows, out)
    once = slices_of(spark, out)
    tables.replace_slices(rows, out)
    tables.replace_slices(rows.limit(0), out)
    assert slices_of(spark, out) == once == [(f"2017-06-0{d}", 2, float(d)) for d in (1, 2, 3)]
    kept = sorted(os.listdir(f"{out}/date=2017-06-01"))
    tables.replace_slices(daily(spark, [3, 4], 0.5).withColumn("date", dated), out)
    assert slices_of(spark, out) == [("2017-06-01", 2, 1.0), ("2017-06-02", 2, 2.0), ("2017-06-03", 2, 3.5), ("2017-06-04", 2, 4.5)]
    assert sorted(os.listdir(f"{out}/date=2017-06-01")) == kept
    with pytest.raises(ValueError):
        tables.replace_slices(rows, out, partition_by=())


def test_replace_slices_null_date_and_own_table(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = daily(spark, [1, 2]).withColumn("date", F.when(F.col("fwi") < 2, F.col("time").cast("date")))
    for _ in range(2):
        tables.replace_slices(rows, out)
    assert slices_of(spark, out) == [("2017-06-01", 2, 1.0), ("None", 2, 2.0)]
    tables.replace_slices(spark.read.parquet(out).where("date IS NULL").withColumn("fwi", F.col("fwi") * 2), out)
    assert slices_of(spark, out) == [("2017-06-01", 2, 1.0), ("None", 2, 4.0)]


def test_stream_replaces_redelivered_dates(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    daily(spark, [1, 2, 3]).write.parquet(src)
    for expected in (2.0, 2.5, 2.5):
        slices.replace_slices_stream(slices.read_slices(spark, src, FWI_DAILY), out, cp).awaitTermination()
        assert slices_of(spark, out) == [("2017-06-01", 2, 1.0), ("2017-06-02", 2, expected), ("2017-06-03", 2, 3.0)]
        if expected == 2.0:
            daily(spark, [2], 0.5).write.mode("append").parquet(src)


def test_km_per_degree(spark):
    v = spark.range(1).select(km_per_degree_lon(F.lit(39.5))).first()[0]
    assert abs(v - 85.8974) < 1e-3


def test_risk_distribution_sums_to_rows(spark):
    df = spark.range(200).select((F.col("id") * 0.7).alias("x"))
    assert A.risk_distribution(df, "x", FINE_BANDS).agg(F.sum("n")).first()[0] == 200
