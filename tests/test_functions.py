import datetime as dt
import math

from pyspark.sql import functions as F

from caliper.functions import columns as C


def test_hour_parse_defaults_and_rejections(spark):
    rows = [("9:05",), ("09:5",), ("08:30:00",), ("24:00",), (" 9:10",), ("23:59",), (None,), ("junk",)]
    df = spark.createDataFrame(rows, "time string")
    got = [r[0] for r in df.select(C.parse_hour("time")).collect()]
    assert got == [9, 9, 12, 12, 12, 23, 12, 12]


def test_temporal_features_rules(spark):
    df = spark.createDataFrame([("2024-01-06", "17:30"), ("2024-03-04", None), (None, "07:00"), ("bad", "08:00")],
                               "date string, time string")
    out = C.temporal_features(df).orderBy(F.col("date").asc_nulls_last(), "time").collect()
    by_date = {str(r["date"]): r for r in out}
    sat = by_date["2024-01-06"]
    assert (sat.day_of_week, sat.month, sat.is_weekend, sat.season, sat.hour, sat.hour_peak) == (5, 1, 1, 0, 17, 1)
    mon = by_date["2024-03-04"]
    assert (mon.day_of_week, mon.is_weekend, mon.season, mon.hour, mon.hour_peak) == (0, 0, 1, 12, 0)
    nulls = [r for r in out if r["date"] is None]
    assert len(nulls) == 2
    assert all(r.is_weekend == 0 and r.day_of_week is None and r.season is None for r in nulls)


def test_temporal_defaults_without_columns(spark):
    df = spark.createDataFrame([(1,)], "x int")
    r = C.temporal_features(df).first()
    assert (r.day_of_week, r.month, r.is_weekend, r.season, r.hour, r.hour_peak) == (0, 1, 0, 0, 12, 0)


def test_season_every_month(spark):
    df = spark.createDataFrame([(dt.date(2021, m, 1),) for m in range(1, 13)], "d date")
    got = [r[0] for r in df.select(C.season(F.col("d"))).collect()]
    assert got == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 0]


def test_interaction_features_null_as_zero(spark):
    df = spark.createDataFrame([(2.0, 1, 8.0, None), (None, 1, 6.0, 0.0), (1.5, 0, 7.0, 2.0)],
                               "precipitation double, hour_peak int, cloud_cover double, sunshine double")
    out = C.interaction_features(df).collect()
    assert [r.precipitation_peak_interaction for r in out] == [2.0, 0.0, 0.0]
    assert [r.low_visibility_proxy for r in out] == [1, 0, 0]


def test_interaction_features_absent_columns(spark):
    r = C.interaction_features(spark.createDataFrame([(1,)], "x int")).first()
    assert r.precipitation_peak_interaction == 0.0 and r.low_visibility_proxy == 0


def test_spatial_key_grid_rules(spark):
    df = spark.createDataFrame([("530123.7", "180999"), ("-1500.7", "999"), ("abc", None), ("-0.5", "1000")],
                               "location_easting_osgr string, location_northing_osgr string")
    got = [r.spatial_key for r in C.spatial_key(df).collect()]
    assert got == ["530_180", "-2_0", "-1_-1", "0_1"]


def test_spatial_key_area_and_unknown(spark):
    df = spark.createDataFrame([("E01000001",), (None,)], "lsoa_of_accident_location string")
    assert [r.spatial_key for r in C.spatial_key(df).collect()] == ["E01000001", "unknown"]
    assert C.spatial_key(spark.createDataFrame([(1,)], "x int")).first().spatial_key == "unknown"


def test_snow_flag_variants(spark):
    df = spark.createDataFrame([("0",), ("2.5",), (None,), ("x",)], "snow_depth string")
    assert [r.snow for r in C.snow_flag(df).collect()] == [0, 1, 0, 0]
    assert C.snow_flag(spark.createDataFrame([(1,)], "x int")).first().snow == 0


def test_category_string_and_missing(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (None, None, None)], "i int, d double, s string")
    r = df.select(C.category_string("i").alias("i"), C.category_string("d").alias("d"),
                  C.category_string("s").alias("s")).collect()
    assert (r[0].i, r[0].d, r[0].s) == ("1", "1.0", "a")
    assert (r[1].i, r[1].d, r[1].s) == ("missing", "missing", "missing")


def test_nan_is_missing_and_inf_to_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "x double")
    miss = [r[0] for r in df.select(C.is_missing(df, "x")).collect()]
    assert miss == [True, False, False, True]
    cleaned = [r[0] for r in df.select(C.non_finite_to_null(F.col("x"))).collect()]
    assert cleaned[0] is None and cleaned[1] is None and cleaned[2] == 1.0


def test_date_parse_formats(spark):
    df = spark.createDataFrame([("2020-01-02",), ("15/03/2020",), ("20200316",), ("nope",)], "d string")
    got = [r[0] for r in df.select(C.parse_date(df, "d")).collect()]
    assert got == [dt.date(2020, 1, 2), dt.date(2020, 3, 15), dt.date(2020, 3, 16), None]


def test_md5_order_matches_python(spark):
    import hashlib
    df = spark.createDataFrame([(7,), (123456789,)], "k long")
    got = [r[0] for r in df.select(C.md5_order(F.col("k"), 42)).collect()]
    exp = [int(hashlib.md5(f"42:{k}".encode()).hexdigest()[:8], 16) for k in (7, 123456789)]
    assert got == exp and all(0 <= g < 2 ** 32 for g in got) and not any(math.isnan(g) for g in got)
