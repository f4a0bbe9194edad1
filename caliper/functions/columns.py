"""Scalar column builders.

All builders return native Catalyst expressions (no Python UDFs) so they stay inside
whole-stage codegen.  Spark 4 runs with ANSI mode on, where a plain ``cast`` of a bad
string raises; every coercion here uses the ``try_*`` family so bad values become NULL.
NaN and NULL differ in Spark: ``is_missing`` treats both as missing.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, StringType, TimestampNTZType, TimestampType

# fixed values: peak hours and weekend day numbers (Monday = 0)
PEAK_HOURS = (7, 8, 9, 16, 17, 18)
WEEKEND_DAYS = (5, 6)
# fixed values: date text formats tried in order when a date arrives as a string
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd")
DEFAULT_HOUR = 12


def col_type(df: DataFrame, name: str):
    return df.schema[name].dataType


def to_double(c: Column | str) -> Column:
    """Numeric coercion (F9): bad text -> NULL, numbers pass through as double."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("double")


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating columns (the pandas notion of missing)."""
    c = F.col(f"`{name}`")
    t = col_type(df, name)
    if isinstance(t, (DoubleType, FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def is_missing_numeric(df: DataFrame, name: str) -> Column:
    """Missing after numeric coercion: NULL, NaN or non-numeric text."""
    d = F.col(f"`{name}`").try_cast("double")
    return d.isNull() | F.isnan(d)


def non_finite_to_null(c: Column | str) -> Column:
    """+/-Inf (and NaN) become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def parse_date(df: DataFrame, name: str, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """date column from date / timestamp / text; unparseable text -> NULL."""
    t = col_type(df, name)
    c = F.col(name)
    if isinstance(t, DateType):
        return c
    if isinstance(t, (TimestampType, TimestampNTZType)):
        return F.to_date(c)
    if isinstance(t, StringType):
        return F.coalesce(*[F.try_to_date(c, f) for f in formats])
    return F.lit(None).cast("date")


def parse_hour(c: Column | str, default: int = DEFAULT_HOUR) -> Column:
    """hour from an ``H:m`` text; NULL / unparseable -> ``default``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.hour(F.try_to_timestamp(c, F.lit("H:m"))), F.lit(default)).cast("int")


def day_of_week(d: Column) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(d)


def is_weekend(d: Column) -> Column:
    """weekend flag; NULL date -> 0."""
    return F.coalesce(F.weekday(d).isin(*WEEKEND_DAYS), F.lit(False)).cast("int")


def season(d: Column) -> Column:
    """0 = Dec–Feb, 1 = Mar–May, 2 = Jun–Aug, 3 = Sep–Nov (NULL date -> NULL)."""
    return F.floor((F.month(d) % 12) / 3).cast("int")


def hour_peak(h: Column) -> Column:
    """F7."""
    return h.isin(*PEAK_HOURS).cast("int")


def year_month(d: Column) -> Column:
    """F8."""
    return F.date_format(d, "yyyy-MM")


def zero_if_absent(df: DataFrame, name: str) -> Column:
    return F.coalesce(to_double(F.col(name)), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def category_string(c: Column | str, missing: str = "missing") -> Column:
    """category as text, NULL -> ``missing``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(missing))


def label_of(index: Column, labels: list[str]) -> Column:
    """class index (0-based) -> label text."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), index.cast("int") + 1)



def md5_order(key: Column, seed: int) -> Column:
    """Deterministic 32-bit order value from a key and a seed (same in any SQL engine:
    first 8 hex digits of md5('<seed>:<key>') read as an unsigned integer)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


# ---------------------------------------------------------------- bundles

def snow_flag(df: DataFrame, snow: str = "snow", depth: str = "snow_depth") -> DataFrame:
    """Keep ``snow`` if present, else ``depth > 0`` (NULL/bad -> 0), else 0."""
    if snow in df.columns:
        return df
    if depth in df.columns:
        return df.withColumn(snow, (F.coalesce(to_double(depth), F.lit(0.0)) > 0).cast("int"))
    return df.withColumn(snow, F.lit(0))


def temporal_features(df: DataFrame, date: str = "date", time: str = "time",
                      date_formats: Iterable[str] = DATE_FORMATS) -> DataFrame:
    """day_of_week, month, is_weekend, season, hour, hour_peak in one projection.

    Missing columns get the documented defaults (no date -> 0,1,0,0; no time -> hour 12)."""
    cols = {}
    if date in df.columns:
        d = parse_date(df, date, date_formats)
        cols[date] = d
        cols["day_of_week"] = day_of_week(d)
        cols["month"] = F.month(d)
        cols["is_weekend"] = is_weekend(d)
        cols["season"] = season(d)
    else:
        cols.update(day_of_week=F.lit(0), month=F.lit(1), is_weekend=F.lit(0), season=F.lit(0))
    h = parse_hour(F.col(time)) if time in df.columns else F.lit(DEFAULT_HOUR)
    cols["hour"] = h
    cols["hour_peak"] = hour_peak(h)
    return df.withColumns(cols)


def interaction_features(df: DataFrame) -> DataFrame:
    """precipitation × peak (NULL -> 0) and the low-visibility proxy."""
    precip = zero_if_absent(df, "precipitation")
    peak = zero_if_absent(df, "hour_peak")
    cloud = zero_if_absent(df, "cloud_cover")
    sun = zero_if_absent(df, "sunshine")
    return df.withColumns({
        "precipitation_peak_interaction": precip * peak,
        "low_visibility_proxy": F.when((cloud >= 7) & (sun <= 1), 1).otherwise(0),
    })


def spatial_key(df: DataFrame, area: str = "lsoa_of_accident_location",
                easting: str = "location_easting_osgr", northing: str = "location_northing_osgr",
                out: str = "spatial_key", unknown: str = "unknown") -> DataFrame:
    """area code if present; else 1-km grid cell ``floor(e/1000)_floor(n/1000)``
    (bad coordinates -> -1 before the division); else ``unknown``.  A NULL area code
    becomes ``unknown``."""
    if area in df.columns:
        return df.withColumn(out, F.coalesce(F.col(area).cast("string"), F.lit(unknown)))
    if easting in df.columns and northing in df.columns:
        def cell(c: str) -> Column:
            v = to_double(c)
            v = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(-1.0)).otherwise(v)
            return F.floor(v.cast("bigint") / F.lit(1000)).cast("bigint").cast("string")
        return df.withColumn(out, F.concat_ws("_", cell(easting), cell(northing)))
    return df.withColumn(out, F.lit(unknown))
