import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from caliper.operators import enrich as EN
from caliper.plans.master import build_master, merge_daily_inner
from caliper.sources import tables as TB


def _inputs(spark):
    collision = spark.createDataFrame(
        [("A1", 1, "02/01/2020", "08:30", None, 500123.0, 180456.0),
         ("A2", 2, "2020-01-03", "24:00", 3, -1500.0, 999.0),
         (None, 3, None, None, None, None, None),
         ("A4", 9, "2020-12-25", " 9:10", None, 1000.0, 2000.0)],
        "collision_index string, collision_severity int, date string, time string, number_of_casualties int, "
        "location_easting_osgr double, location_northing_osgr double")
    vehicle = spark.createDataFrame([("A1", 2), ("A1", 3), (None, 1), ("A2", None)],
                                    "accident_index string, number_of_vehicles int")
    casualty = spark.createDataFrame([("A1",), ("A1",), (None,)], "collision_index string")
    weather = spark.createDataFrame(
        [("2020-01-02", 5.0, 0.5, 10.0), ("2020-01-03", 8.0, 1.0, None), ("2020-01-03", 1.0, 9.0, 12.0),
         (None, 0.0, 0.0, 1.0)],
        "date string, cloud_cover double, sunshine double, mean_temp double")
    holidays = spark.createDataFrame([(dt.date(2020, 12, 25), 1, "Christmas Day")],
                                     "date date, is_bank_holiday int, bank_holiday_title string")
    return collision, vehicle, casualty, weather, holidays


def test_build_master_rules(spark):
    master, stats = build_master(*_inputs(spark))
    rows = master.orderBy(F.col("accident_index").asc_nulls_last(), "cloud_cover").collect()
    # duplicate weather date multiplies the A2 row (same join semantics as a plain left join)
    assert len(rows) == 5
    a1 = rows[0]
    assert a1.accident_index == "A1" and a1.accident_severity == 1
    assert a1.date == dt.date(2020, 1, 2)                       # day-first text parsed
    assert a1.vehicle_record_count == 2 and a1.number_of_vehicles == 3.0   # max of vehicle rows
    assert a1.casualty_record_count == 2 and a1.number_of_casualties == 2.0
    assert a1.hour == 8 and a1.spatial_key == "500_180"
    assert a1.is_bank_holiday == 0 and a1.bank_holiday_title == "none"
    a2 = [r for r in rows if r.accident_index == "A2"]
    assert len(a2) == 2 and all(r.number_of_vehicles == 1.0 for r in a2)   # max NULL -> record count
    assert all(r.number_of_casualties == 3.0 for r in a2)                   # own value wins
    assert all(r.spatial_key == "-2_0" for r in a2) and all(r.hour == 12 for r in a2)
    a4 = [r for r in rows if r.accident_index == "A4"][0]
    assert a4.is_bank_holiday == 1 and a4.bank_holiday_title == "Christmas Day"
    assert a4.number_of_vehicles == 0.0 and a4.number_of_casualties == 0.0  # no child -> 0
    nul = [r for r in rows if r.accident_index is None][0]
    # NULL key matches the NULL-keyed child records; NULL date matches the NULL-dated weather row
    assert nul.vehicle_record_count == 1 and nul.casualty_record_count == 1
    assert nul.mean_temp == 1.0 and nul.is_weekend == 0 and nul.day_of_week is None
    assert set(EN.PLACEHOLDER_COLUMNS) <= set(master.columns)
    s = stats.first()
    assert s.vehicle_match_rate == pytest.approx(4 / 5)
    assert s.casualty_match_rate == pytest.approx(2 / 5)
    assert s.weather_match_rate == pytest.approx(3 / 5)   # matched day without mean_temp counts as unmatched


def test_child_counts_keeps_null_key_and_max(spark):
    _, vehicle, _, _, _ = _inputs(spark)
    out = {r.accident_index: r for r in EN.child_counts(vehicle, "accident_index", "n", ["number_of_vehicles"]).collect()}
    assert out["A1"].n == 2 and out["A1"].number_of_vehicles == 3.0
    assert out[None].n == 1 and out["A2"].number_of_vehicles is None


def test_match_rates_absent_column(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    r = EN.match_rates(df, {"x": "b", "y": "zzz"}).first()
    assert r.x == 0.5 and r.y == 0.0


def test_calendar_json(spark, tmp_dir):
    p = os.path.join(tmp_dir, "hol.json")
    with open(p, "w") as f:
        json.dump({"england-and-wales": {"events": [{"title": "New Year", "date": "2020-01-01"},
                                                    {"title": None, "date": "2020-12-25"},
                                                    {"title": "bad", "date": "not-a-date"}]}}, f)
    rows = TB.read_calendar(spark, p).orderBy(F.col("date").asc_nulls_last()).collect()
    assert [r.date for r in rows] == [dt.date(2020, 1, 1), dt.date(2020, 12, 25), None]
    assert [r.bank_holiday_title for r in rows] == ["New Year", "unknown", "bad"]
    assert all(r.is_bank_holiday == 1 for r in rows)
    p2 = os.path.join(tmp_dir, "empty.json")
    with open(p2, "w") as f:
        json.dump({"scotland": {"events": []}}, f)
    empty = TB.read_calendar(spark, p2)
    assert empty.count() == 0 and empty.columns == ["date", "is_bank_holiday", "bank_holiday_title"]


def test_merge_daily_inner_year_filter(spark):
    fact = spark.createDataFrame([("2009-12-31", 1), ("2010-01-02", 2), ("2011-05-05", 3)], "date string, k int")
    daily = spark.createDataFrame([("20091231", 1.0), ("20100102", 2.0), ("20110505", 3.0)], "date string, w double")
    out = merge_daily_inner(fact, daily, start_year=2010).orderBy("k").collect()
    assert [(r.k, r.w) for r in out] == [(2, 2.0), (3, 3.0)]


def test_read_table_guards(spark, tmp_dir):
    with pytest.raises(FileNotFoundError, match="Master dataset not found"):
        TB.read_table(spark, os.path.join(tmp_dir, "missing.parquet"))
    with pytest.raises(ValueError, match="Unsupported"):
        TB.read_table(spark, os.path.join(tmp_dir, "x.xlsx"))
    with pytest.raises(RuntimeError, match="Master dataset was not loaded correctly"):
        TB.require_rows(spark.range(36), 100000)
    with pytest.raises(FileNotFoundError, match="a=.*b="):
        TB.require_inputs(spark, {"a": os.path.join(tmp_dir, "a.csv"), "b": os.path.join(tmp_dir, "b.csv")})


def test_csv_scan_and_landing(spark, tmp_dir):
    src = os.path.join(tmp_dir, "c.csv")
    with open(src, "w") as f:
        f.write("date,v\n2020-01-01,1\n2020-02-01,2\nbad,3\n2020-03-01,4\n")
    df = TB.read_table(spark, src)
    manifest = TB.land(df, os.path.join(tmp_dir, "landed"), "date", "2020-01-15", "2020-03-01").first()
    assert manifest.rows == 2 and manifest.min_date == dt.date(2020, 2, 1) and manifest.max_date == dt.date(2020, 3, 1)
