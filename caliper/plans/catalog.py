"""Registered queries (one per operator group of the inventory) and their DuckDB oracles.

Each query takes ``(spark, sf_dir)``, reads the driver's tables through the role
binding, runs the operator over the whole tables and returns a DataFrame.  ``EXACT`` has
the queries as they are; ``QUERIES`` rounds double columns to 6 places, as ``ORACLE`` does,
because the two engines add doubles in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from caliper.plans import roles as R
from caliper.plans import roles_sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXACT: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, doubles: list[str] | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name], EXACT[name] = run, fn
        if sql is not None:
            ORACLE[name] = S.rnd(sql, doubles or [])
        return run
    return deco


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    cols = {f.name: F.round(F.col(f"`{f.name}`"), places) for f in df.schema.fields
            if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.withColumns(cols) if cols else df


# ------------------------------------------------------------------ enrichment

from caliper.operators import enrich as EN  # noqa: E402
from caliper.plans import master as MA  # noqa: E402

MASTER_DOUBLES = ["location_easting_osgr", "cloud_cover", "sunshine", "global_radiation", "max_temp", "mean_temp",
                  "min_temp", "precipitation", "pressure", "snow_depth", "number_of_vehicles",
                  "number_of_casualties", "precipitation_peak_interaction", "road_class", "maxspeed",
                  "junction_density", "no2", "pm25", "imd_decile"]
WEATHER_COLS = ["cloud_cover", "sunshine", "global_radiation", "max_temp", "mean_temp", "min_temp",
                "precipitation", "pressure", "snow_depth"]


@register("child_max", S.with_(S.VEHICLE) + """
SELECT accident_index, count(*) AS vehicle_record_count, max(CAST(number_of_vehicles AS DOUBLE)) AS number_of_vehicles
FROM vehicle GROUP BY accident_index""", ["number_of_vehicles"])
def q_child_max(spark, d):
    """A1 + A2 + J6: records and max per key in one aggregate."""
    return EN.child_counts(R.vehicle(spark, d), "accident_index", "vehicle_record_count", ["number_of_vehicles"])


@register("child_counts", S.with_(S.CASUALTY) + """
SELECT accident_index, count(*) AS casualty_record_count FROM casualty GROUP BY accident_index""")
def q_child_counts(spark, d):
    """A3: records per key."""
    return EN.child_counts(R.casualty(spark, d), "accident_index", "casualty_record_count")


@register("enriched_fact", S.with_(S.ALL_MASTER) + "SELECT * FROM master", MASTER_DOUBLES)
def q_enriched_fact(spark, d):
    """The full master table."""
    return R.master(spark, d)[0]


@register("match_rates", S.with_(S.ALL_MASTER) + """
SELECT avg(CAST(vehicle_record_count IS NOT NULL AS DOUBLE)) AS vehicle_match_rate,
       avg(CAST(casualty_record_count IS NOT NULL AS DOUBLE)) AS casualty_match_rate,
       avg(CAST(mean_temp IS NOT NULL AS DOUBLE)) AS weather_match_rate
FROM master""", ["vehicle_match_rate", "casualty_match_rate", "weather_match_rate"])
def q_match_rates(spark, d):
    """A4: join match rates in one pass over the master."""
    return R.master(spark, d)[1]


@register("count_coalesce", S.with_(S.ALL_MASTER) + """
SELECT accident_index, number_of_vehicles, number_of_casualties, vehicle_record_count, casualty_record_count
FROM master""", ["number_of_vehicles", "number_of_casualties"])
def q_count_coalesce(spark, d):
    """Own value -> child count -> 0."""
    return R.master(spark, d)[0].select("accident_index", "number_of_vehicles", "number_of_casualties",
                                        "vehicle_record_count", "casualty_record_count")


@register("calendar_join", S.with_(S.COLLISION, S.CALENDAR) + """
SELECT f.accident_index, f.date, CAST(coalesce(h.is_bank_holiday, 0) AS INTEGER) AS is_bank_holiday,
       coalesce(h.bank_holiday_title, 'none') AS bank_holiday_title
FROM collision f LEFT JOIN holidays h ON f.date IS NOT DISTINCT FROM h.date""")
def q_calendar_join(spark, d):
    """J4 + P13: fact ⟕ calendar with defaults."""
    fact = EN.normalise_dates(R.collision(spark, d).select("accident_index", "date"), "date")
    return EN.holiday_defaults(EN.daily_left_join(fact, R.calendar(spark, d), "date"))


@register("daily_inner_join", S.with_(S.COLLISION, S.WEATHER) + """
SELECT f.*, w.cloud_cover, w.sunshine, w.global_radiation, w.max_temp, w.mean_temp, w.min_temp,
       w.precipitation, w.pressure, w.snow_depth
FROM collision f JOIN weather w ON f.date = w.date
WHERE f.date >= DATE '1997-01-01' AND w.date >= DATE '1997-01-01'""",
          ["location_easting_osgr"] + WEATHER_COLS)
def q_daily_inner_join(spark, d):
    """C5 (J5 + P10): fact ⋈ daily from a start year on."""
    return MA.merge_daily_inner(R.collision(spark, d), R.weather(spark, d), "date", start_year=1997)


@register("placeholder_columns", S.with_(S.ALL_MASTER) + """
SELECT accident_index, road_class, maxspeed, junction_density, no2, pm25, imd_decile FROM master""",
          ["road_class", "maxspeed", "junction_density", "no2", "pm25", "imd_decile"])
def q_placeholder_columns(spark, d):
    """Typed NULL placeholder columns."""
    return R.master(spark, d)[0].select("accident_index", *EN.PLACEHOLDER_COLUMNS)


@register("date_window", S.with_(S.COLLISION) + """
SELECT accident_index, date FROM collision
WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-02-28'""")
def q_date_window(spark, d):
    """Inclusive date window (pushed to the scan as a range)."""
    fact = EN.date_window(R.collision(spark, d).select("accident_index", "date"), "date", "1996-03-01", "1998-02-28")
    return EN.normalise_dates(fact, "date")


# ------------------------------------------------------------------ scalar features

from caliper.functions import columns as C  # noqa: E402
from caliper.operators import prepare as PR  # noqa: E402
from caliper.operators import quality as QU  # noqa: E402


@register("temporal_features", S.with_(S.TIMED_EVENTS) + f"""
SELECT event_id, date, time, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month,
       CAST(coalesce(isodow(date) IN (6, 7), false) AS INTEGER) AS is_weekend,
       CAST(floor((month(date) % 12) / 3) AS INTEGER) AS season,
       {S.HOUR_SQL} AS hour, CAST({S.HOUR_SQL} IN (7, 8, 9, 16, 17, 18) AS INTEGER) AS hour_peak
FROM timed""")
def q_temporal_features(spark, d):
    """F2–F7, F20 on timestamped events."""
    return C.temporal_features(R.timed_events(spark, d))


@register("date_parse", S.with_(S.TEXT_DATES) + """
SELECT accident_index, date_text,
       CAST(coalesce(try_strptime(date_text, '%Y-%m-%d'), try_strptime(date_text, '%d/%m/%Y'),
                     try_strptime(date_text, '%Y%m%d')) AS DATE) AS date
FROM text_dates""")
def q_date_parse(spark, d):
    """text dates in several formats; unparseable -> NULL."""
    df = R.text_dates(spark, d)
    return df.withColumn("date", C.parse_date(df, "date_text"))


@register("interaction_features", S.with_(S.ALL_MASTER) + """
SELECT accident_index, precipitation, hour_peak, cloud_cover, sunshine,
       precipitation_peak_interaction, low_visibility_proxy FROM master""",
          ["precipitation", "cloud_cover", "sunshine", "precipitation_peak_interaction"])
def q_interaction_features(spark, d):
    """F10, F11, F21."""
    return R.master(spark, d)[0].select("accident_index", "precipitation", "hour_peak", "cloud_cover", "sunshine",
                                        "precipitation_peak_interaction", "low_visibility_proxy")


@register("spatial_key", S.with_(S.ALL_MASTER) + """
SELECT m.accident_index, m.spatial_key AS grid_key,
       coalesce('E' || lpad(CAST(c.c_nationkey AS VARCHAR), 8, '0'), 'unknown') AS area_key
FROM master m JOIN orders o ON m.accident_index = o.o_orderkey
LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_spatial_key(spark, d):
    """grid cell from coordinates and area code (customer nation) forms."""
    grid = R.master(spark, d)[0].select("accident_index", F.col("spatial_key").alias("grid_key"))
    o = R.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = R.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    area = (o.join(c, o.o_custkey == c.c_custkey, "left")
            .select(F.col("o_orderkey").alias("accident_index"),
                    F.concat(F.lit("E"), F.lpad(F.col("c_nationkey").cast("string"), 8, "0"))
                    .alias("lsoa_of_accident_location")))
    area = C.spatial_key(area, area="lsoa_of_accident_location", out="area_key")
    return grid.join(area.select("accident_index", "area_key"), "accident_index")


@register("snow_flag", S.with_(S.ALL_MASTER) + """
SELECT accident_index, snow_depth, CAST(coalesce(TRY_CAST(snow_depth AS DOUBLE), 0) > 0 AS INTEGER) AS snow
FROM master""", ["snow_depth"])
def q_snow_flag(spark, d):
    """Snow flag from depth (NULL -> 0)."""
    return C.snow_flag(R.master(spark, d)[0].select("accident_index", "snow_depth"))


@register("category_string", S.with_(S.ALL_MASTER) + """
SELECT accident_index, coalesce(CAST(order_status AS VARCHAR), 'missing') AS order_status_cat,
       coalesce(CAST(pressure AS VARCHAR), 'missing') AS pressure_cat,
       coalesce(CAST(accident_severity AS VARCHAR), 'missing') AS severity_cat
FROM master""")
def q_category_string(spark, d):
    """categories as text, NULL -> 'missing'."""
    m = R.master(spark, d)[0]
    return m.select("accident_index", C.category_string("order_status").alias("order_status_cat"),
                    C.category_string("pressure").alias("pressure_cat"),
                    C.category_string("accident_severity").alias("severity_cat"))


# ------------------------------------------------------------------ prepare

PREP_DOUBLES = ["number_of_vehicles", "cloud_cover", "sunshine", "global_radiation", "max_temp", "mean_temp",
                "min_temp", "precipitation", "pressure", "precipitation_peak_interaction"]


@register("target_filter", S.with_(S.ALL_MASTER) + """
SELECT accident_index, TRY_CAST(accident_severity AS DOUBLE) AS target_code FROM master
WHERE TRY_CAST(accident_severity AS DOUBLE) IN (1, 2, 3)""", ["target_code"])
def q_target_filter(spark, d):
    """Numeric target within the valid codes."""
    m = R.master(spark, d)[0]
    return m.filter(PR.valid_target("accident_severity")).select(
        "accident_index", PR.target_code("accident_severity").alias("target_code"))


@register("target_recode", S.with_(S.ALL_PREPARED) + "SELECT row_id, label FROM prepared")
def q_target_recode(spark, d):
    """Code -> class through the code map."""
    return R.prepared(spark, d).select("row_id", "label")


@register("prepared_dataset", S.with_(S.ALL_PREPARED) + "SELECT * FROM prepared", PREP_DOUBLES)
def q_prepared_dataset(spark, d):
    """row_id, features, label, date, spatial_key."""
    return R.prepared(spark, d)


def _missing_expr(c: str, is_double: bool) -> str:
    return f"avg(CAST(({c} IS NULL{f' OR isnan({c})' if is_double else ''}) AS DOUBLE))"


@register("feature_missing", S.with_(S.ALL_MASTER) + f"""
SELECT feature, missing_rate FROM (
  SELECT {", ".join(_missing_expr(c, c in PREP_DOUBLES) + f" AS {c}" for c in R.FEATURES if c != "snow")},
         CAST(0 AS DOUBLE) AS snow
  FROM master WHERE TRY_CAST(accident_severity AS DOUBLE) IN (1, 2, 3))
UNPIVOT (missing_rate FOR feature IN ({", ".join(R.FEATURES)}))""", ["missing_rate"])
def q_feature_missing(spark, d):
    """Missing rate per feature over valid-target rows."""
    return PR.feature_missing_rates(R.master(spark, d)[0], R.FEATURES)


# ------------------------------------------------------------------ quality

MASTER_COLUMNS = ["accident_index", "accident_severity", "date", "number_of_casualties", "location_easting_osgr",
                  "location_northing_osgr", "order_status", "time", "vehicle_record_count", "casualty_record_count",
                  "cloud_cover", "sunshine", "global_radiation", "max_temp", "mean_temp", "min_temp", "precipitation",
                  "pressure", "snow_depth", "is_bank_holiday", "bank_holiday_title", "number_of_vehicles",
                  "spatial_key", "day_of_week", "month", "is_weekend", "season", "hour", "hour_peak",
                  "precipitation_peak_interaction", "low_visibility_proxy", "road_class", "maxspeed",
                  "junction_density", "no2", "pm25", "imd_decile"]

MISSING_RATES_SQL = S.with_(S.ALL_MASTER) + f"""
SELECT column_name, missing_rate FROM (
  SELECT {", ".join(_missing_expr(c, c in MASTER_DOUBLES) + f' AS "{c}"' for c in MASTER_COLUMNS)} FROM master)
UNPIVOT (missing_rate FOR column_name IN ({", ".join(f'"{c}"' for c in MASTER_COLUMNS)}))"""


@register("missing_rates", MISSING_RATES_SQL, ["missing_rate"])
def q_missing_rates(spark, d):
    """A5: missing rate of every master column, highest first."""
    return QU.missing_rates(R.master(spark, d)[0]).withColumnRenamed("column", "column_name")


@register("top_missing", f"SELECT * FROM ({MISSING_RATES_SQL}) ORDER BY missing_rate DESC, column_name LIMIT 12",
          ["missing_rate"])
def q_top_missing(spark, d):
    """The 12 most-missing columns (ties by name)."""
    return QU.top_missing(R.master(spark, d)[0], 12).withColumnRenamed("column", "column_name")


@register("missing_by_month", S.with_(S.ALL_MASTER) + f"""
SELECT year_month, feature, missing_rate, rows FROM (
  SELECT strftime(date, '%Y-%m') AS year_month, count(*) AS rows,
         {", ".join(f"avg(CAST((TRY_CAST({c} AS DOUBLE) IS NULL OR isnan(TRY_CAST({c} AS DOUBLE))) AS DOUBLE)) AS {c}" for c in R.WEATHER_FEATURES)}
  FROM master WHERE date IS NOT NULL GROUP BY 1)
UNPIVOT (missing_rate FOR feature IN ({", ".join(R.WEATHER_FEATURES)}))""", ["missing_rate"])
def q_missing_by_month(spark, d):
    """A7 + T10: month × feature missingness of the daily measurements."""
    return QU.missing_by_month(R.master(spark, d)[0], R.WEATHER_FEATURES)


@register("class_distribution", S.with_(S.ALL_PREPARED) + """
SELECT label, count(*) AS rows FROM prepared GROUP BY label""")
def q_class_distribution(spark, d):
    """Rows per class after the target filter."""
    return QU.class_distribution(R.prepared(spark, d))


@register("target_validity", S.with_(S.ALL_MASTER) + """
SELECT count(*) AS rows_raw,
       count(*) FILTER (WHERE TRY_CAST(accident_severity AS DOUBLE) IN (1, 2, 3)) AS rows_valid_target,
       count(*) FILTER (WHERE NOT coalesce(TRY_CAST(accident_severity AS DOUBLE) IN (1, 2, 3), false)) AS rows_invalid_target,
       avg(CAST(coalesce(TRY_CAST(accident_severity AS DOUBLE) IN (1, 2, 3), false) AS DOUBLE)) AS target_valid_ratio
FROM master""", ["target_valid_ratio"])
def q_target_validity(spark, d):
    """A9."""
    return QU.target_validity(R.master(spark, d)[0])


@register("date_coverage", S.with_(S.ALL_MASTER) + """
SELECT min(date) AS date_min, max(date) AS date_max, count(DISTINCT date) AS unique_days FROM master""")
def q_date_coverage(spark, d):
    """A10."""
    return QU.date_coverage(R.master(spark, d)[0])


@register("spatial_coverage", S.with_(S.ALL_PREPARED) + """
SELECT count(DISTINCT coalesce(spatial_key, 'unknown')) AS unique_spatial_keys,
       avg(CAST(coalesce(spatial_key, 'unknown') = 'unknown' AS DOUBLE)) AS unknown_spatial_key_ratio
FROM prepared""", ["unknown_spatial_key_ratio"])
def q_spatial_coverage(spark, d):
    """A11."""
    return QU.spatial_coverage(R.prepared(spark, d))


@register("quality_report", S.with_(S.ALL_PREPARED) + """
SELECT r.*, s.* FROM
 (SELECT count(*) AS rows_raw,
         count(*) FILTER (WHERE TRY_CAST(accident_severity AS DOUBLE) IN (1, 2, 3)) AS rows_valid_target,
         count(*) FILTER (WHERE NOT coalesce(TRY_CAST(accident_severity AS DOUBLE) IN (1, 2, 3), false)) AS rows_invalid_target,
         min(date) AS date_min, max(date) AS date_max, count(DISTINCT date) AS unique_days FROM master) r,
 (SELECT count(DISTINCT coalesce(spatial_key, 'unknown')) AS unique_spatial_keys,
         avg(CAST(coalesce(spatial_key, 'unknown') = 'unknown' AS DOUBLE)) AS unknown_spatial_key_ratio
  FROM prepared) s""", ["unknown_spatial_key_ratio"])
def q_quality_report(spark, d):
    """Raw + prepared coverage in one row."""
    m, _ = R.master(spark, d)
    return QU.quality_report(m, R.prepared(spark, d))


@register("master_metadata", S.with_(S.ALL_MASTER) + f"""
SELECT count(*) AS row_count, {len(MASTER_COLUMNS)} AS column_count,
       avg(CAST(coalesce(TRY_CAST(accident_severity AS DOUBLE) IN (1, 2, 3), false) AS DOUBLE)) AS target_valid_ratio,
       count(*) FILTER (WHERE NOT coalesce(TRY_CAST(accident_severity AS DOUBLE) IN (1, 2, 3), false)) AS target_invalid_count,
       avg(CAST(vehicle_record_count IS NOT NULL AS DOUBLE)) AS vehicle_match_rate,
       avg(CAST(casualty_record_count IS NOT NULL AS DOUBLE)) AS casualty_match_rate,
       avg(CAST(mean_temp IS NOT NULL AS DOUBLE)) AS weather_match_rate
FROM master""", ["target_valid_ratio", "vehicle_match_rate", "casualty_match_rate", "weather_match_rate"])
def q_master_metadata(spark, d):
    """A13."""
    m, stats = R.master(spark, d)
    return QU.master_metadata(m, stats)


# ------------------------------------------------------------------ metrics

from caliper.operators import metrics as ME  # noqa: E402


def _pc_sql(src: str, by: list[str]) -> str:
    """Per-class CTEs (cm, tr, pr, pc) over a scored source, optionally per group."""
    b = "".join(f"{c}, " for c in by)
    on = " AND ".join(["tr.cls = pr.cls"] + [f"tr.{c} = pr.{c}" for c in by])
    bsel = "".join(f"coalesce(tr.{c}, pr.{c}) AS {c}, " for c in by)
    return f"""cm AS (SELECT {b}label, prediction, count(*) AS n FROM {src} GROUP BY ALL),
tr AS (SELECT {b}label AS cls, CAST(sum(n) AS BIGINT) AS support,
              CAST(sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS BIGINT) AS tp FROM cm GROUP BY ALL),
pr AS (SELECT {b}prediction AS cls, CAST(sum(n) AS BIGINT) AS predicted FROM cm GROUP BY ALL),
pc0 AS (SELECT {bsel}coalesce(tr.cls, pr.cls) AS cls, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support,
               coalesce(predicted, 0) AS predicted FROM tr FULL OUTER JOIN pr ON {on}),
pc AS (SELECT *, CASE WHEN predicted = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / predicted END AS precision,
              CASE WHEN support = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / support END AS recall,
              CASE WHEN support + predicted = 0 THEN CAST(0 AS DOUBLE)
                   ELSE CAST(2 * tp AS DOUBLE) / (support + predicted) END AS f1 FROM pc0)"""


def _overall_sql(by: list[str]) -> str:
    b = "".join(f"{c}, " for c in by)
    return f"""ov AS (SELECT {b}CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy,
       avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy, avg(f1) AS f1_macro FROM pc GROUP BY ALL)"""


def _ovr_sql(src: str, by: list[str], pos: int = 0) -> str:
    b = "".join(f"{c}, " for c in by)
    return f"""ovr0 AS (SELECT {b}count(*) FILTER (WHERE label = {pos} AND prediction = {pos}) AS tp,
                  count(*) FILTER (WHERE label = {pos}) AS support,
                  count(*) FILTER (WHERE prediction = {pos}) AS predicted FROM {src} GROUP BY ALL),
ovr AS (SELECT {b}CASE WHEN predicted = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / predicted END AS fatal_precision,
               CASE WHEN support = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / support END AS fatal_recall,
               CASE WHEN support + predicted = 0 THEN CAST(0 AS DOUBLE)
                    ELSE CAST(2 * tp AS DOUBLE) / (support + predicted) END AS fatal_f1 FROM ovr0)"""


def _ap_sql(src: str, by: list[str], pos: int = 0) -> str:
    b = "".join(f"{c}, " for c in by)
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    return f"""ps AS (SELECT {b}score, count(*) FILTER (WHERE label = {pos}) AS tp, count(*) AS n FROM {src} GROUP BY ALL),
cu AS (SELECT {b}tp, sum(tp) OVER ({part}ORDER BY score DESC) AS ctp, sum(n) OVER ({part}ORDER BY score DESC) AS cn,
              sum(tp) OVER ({part.strip()}) AS pos FROM ps),
ap AS (SELECT {b}CASE WHEN max(pos) > 0 THEN sum((CAST(tp AS DOUBLE) / pos) * (CAST(ctp AS DOUBLE) / cn))
                      ELSE CAST(0 AS DOUBLE) END AS fatal_pr_auc FROM cu GROUP BY ALL)"""


def _lit(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


THRESHOLDS_SQL = "th AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_lit(t)})" for i, t in enumerate(ME.default_thresholds())) + ") AS v(k, t))"

SWEEP_SQL = S.with_(S.SCORED, THRESHOLDS_SQL, """sw0 AS (
  SELECT th.k, th.t, count(*) FILTER (WHERE label = 0) AS P, count(*) AS N,
         count(*) FILTER (WHERE label = 0 AND score >= th.t) AS tp, count(*) FILTER (WHERE score >= th.t) AS pp
  FROM scored, th GROUP BY th.k, th.t),
sw AS (SELECT round(t, 2) AS threshold,
         CASE WHEN pp = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / pp END AS precision,
         CASE WHEN P = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / P END AS recall,
         CASE WHEN P + pp = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(2 * tp AS DOUBLE) / (P + pp) END AS f1,
         CAST(pp - tp AS DOUBLE) / greatest(1, (pp - tp) + (N - P - (pp - tp))) AS false_positive_rate,
         CASE WHEN N = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(pp AS DOUBLE) / N END AS predicted_positive_rate,
         tp, pp - tp AS fp, P - tp AS fn, N - P - (pp - tp) AS tn FROM sw0)""")

SWEEP_DOUBLES = ["threshold", "precision", "recall", "f1", "false_positive_rate", "predicted_positive_rate"]


@register("confusion_matrix", S.with_(S.SCORED) + "SELECT label, prediction, count(*) AS n FROM scored GROUP BY ALL")
def q_confusion_matrix(spark, d):
    """A14."""
    return ME.confusion(R.scored(spark, d))


@register("class_report", S.with_(S.SCORED, _pc_sql("scored", [])) + """
SELECT CAST(cls AS VARCHAR) AS class, precision, recall, f1, support FROM pc
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pc""",
          ["precision", "recall", "f1"])
def q_class_report(spark, d):
    """A15."""
    return ME.class_report(ME.confusion(R.scored(spark, d)))


@register("overall_metrics", S.with_(S.SCORED, _pc_sql("scored", []), _overall_sql([])) + "SELECT * FROM ov",
          ["accuracy", "balanced_accuracy", "f1_macro"])
def q_overall_metrics(spark, d):
    """A16."""
    return ME.overall(ME.confusion(R.scored(spark, d)))


@register("critical_class_metrics", S.with_(S.SCORED, _ovr_sql("scored", [])) + "SELECT * FROM ovr",
          ["fatal_precision", "fatal_recall", "fatal_f1"])
def q_critical_class_metrics(spark, d):
    """A17."""
    return ME.one_vs_rest(ME.confusion(R.scored(spark, d)), R.CRITICAL)


@register("average_precision", S.with_(S.SCORED, _ap_sql("scored", [])) + "SELECT * FROM ap", ["fatal_pr_auc"])
def q_average_precision(spark, d):
    """A18 (bucketed prefix sum)."""
    return ME.average_precision(R.scored(spark, d), R.CRITICAL)


@register("threshold_sweep", SWEEP_SQL + "SELECT * FROM sw", SWEEP_DOUBLES)
def q_threshold_sweep(spark, d):
    """A19."""
    return ME.threshold_sweep(R.scored(spark, d), R.CRITICAL)


@register("safety_threshold", SWEEP_SQL + """
SELECT *, 'max recall with false_positive_rate <= 0.2' AS selection_rule FROM sw
ORDER BY (false_positive_rate <= CAST(0.2 AS DOUBLE)) DESC, recall DESC, precision DESC, threshold ASC LIMIT 1""",
          SWEEP_DOUBLES)
def q_safety_threshold(spark, d):
    """T4."""
    return ME.pick_threshold(ME.threshold_sweep(R.scored(spark, d), R.CRITICAL), 0.2)


def _calib_sql(src: str) -> str:
    fr = sorted({f for q in range(1, 11) for f in ME._fractions(q)})
    idx = {f: i + 1 for i, f in enumerate(fr)}
    cases = " ".join(f"WHEN {q} THEN [{', '.join(f'pv[{idx[f]}]' for f in ME._fractions(q))}]" for q in range(1, 11))
    return f"""st AS (SELECT quantile_cont(score, [{', '.join(_lit(f) for f in fr)}]) AS pv,
                   count(DISTINCT score) AS nd FROM {src}),
ed AS (SELECT list_sort(list_distinct(CASE least(10, nd) {cases} END)) AS edges, nd FROM st),
bn AS (SELECT s.score, CAST(s.label = 0 AS DOUBLE) AS y, ed.edges, ed.nd,
              CASE WHEN ed.nd <= 1 THEN 1 ELSE greatest(1, len(list_filter(ed.edges, lambda e: e < s.score))) END AS bin
       FROM {src} s, ed),
cb AS (SELECT CAST(bin AS INTEGER) AS bin,
              CASE WHEN max(nd) <= 1 THEN min(score) ELSE first(edges)[bin] END AS lo,
              CASE WHEN max(nd) <= 1 THEN max(score) ELSE first(edges)[bin + 1] END AS hi,
              count(*) AS count, avg(score) AS mean_predicted_probability, avg(y) AS observed_rate,
              abs(avg(score) - avg(y)) AS abs_gap FROM bn GROUP BY bin)"""


@register("calibration_bins", S.with_(S.SCORED, _calib_sql("scored")) + "SELECT * FROM cb",
          ["lo", "hi", "mean_predicted_probability", "observed_rate", "abs_gap"])
def q_calibration_bins(spark, d):
    """A20."""
    return ME.calibration_bins(R.scored(spark, d), R.CRITICAL)


@register("ece_brier", S.with_(S.SCORED, _calib_sql("scored")) + """
SELECT b.sample_count, b.brier_score, e.expected_calibration_error FROM
 (SELECT count(*) AS sample_count, avg(pow(score - CAST(label = 0 AS DOUBLE), 2)) AS brier_score FROM scored) b,
 (SELECT sum(abs_gap * count) / sum(count) AS expected_calibration_error FROM cb) e""",
          ["brier_score", "expected_calibration_error"])
def q_ece_brier(spark, d):
    """A21 + A22."""
    return ME.ece_brier(R.scored(spark, d), R.CRITICAL)


MODEL_METRICS_SQL = S.with_(S.SCORED_MODELS, _pc_sql("scored_models", ["model_name", "train_order"]),
                            _overall_sql(["model_name", "train_order"]),
                            _ovr_sql("scored_models", ["model_name", "train_order"]),
                            _ap_sql("scored_models", ["model_name", "train_order"]), """mm AS (
  SELECT ov.model_name, ov.train_order, accuracy, f1_macro, balanced_accuracy, fatal_precision, fatal_recall,
         fatal_pr_auc
  FROM ov JOIN ovr USING (model_name, train_order) JOIN ap USING (model_name, train_order))""")

MODEL_DOUBLES = ["accuracy", "f1_macro", "balanced_accuracy", "fatal_precision", "fatal_recall", "fatal_pr_auc"]


def _model_metrics(spark, d):
    m = ME.evaluate(R.scored_models(spark, d), R.CRITICAL, by=["model_name", "train_order"])
    return m


@register("model_comparison", MODEL_METRICS_SQL + """
SELECT model_name, accuracy, f1_macro, balanced_accuracy, fatal_precision, fatal_recall, fatal_pr_auc FROM mm""",
          MODEL_DOUBLES)
def q_model_comparison(spark, d):
    """A29 + T1: all models evaluated in one job (grouped by model)."""
    return ME.compare_models(_model_metrics(spark, d))


@register("best_model", MODEL_METRICS_SQL + """
SELECT model_name, f1_macro FROM mm ORDER BY f1_macro DESC, train_order ASC LIMIT 1""", ["f1_macro"])
def q_best_model(spark, d):
    """T2."""
    return ME.best_model(_model_metrics(spark, d))


@register("screening_model", MODEL_METRICS_SQL + """
SELECT model_name, fatal_recall, fatal_precision, fatal_pr_auc, f1_macro,
       'highest fatal_recall, then fatal_pr_auc, then macro_f1' AS selection_rule
FROM mm ORDER BY fatal_recall DESC, fatal_pr_auc DESC, f1_macro DESC, train_order ASC LIMIT 1""",
          ["fatal_recall", "fatal_precision", "fatal_pr_auc", "f1_macro"])
def q_screening_model(spark, d):
    """T3."""
    return ME.screening_model(_model_metrics(spark, d))


@register("error_cases", S.with_(S.SCORED) + """
SELECT *, label AS actual_class_index, prediction AS predicted_class_index,
       ['Fatal', 'Serious', 'Slight'][label + 1] AS actual_class_label,
       ['Fatal', 'Serious', 'Slight'][prediction + 1] AS predicted_class_label
FROM scored WHERE label <> prediction""", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "score"])
def q_error_cases(spark, d):
    """P15."""
    return ME.error_cases(R.scored(spark, d), R.CLASS_LABELS)


@register("error_dispersion", S.with_(S.SCORED) + """
SELECT feature, std FROM (
  SELECT stddev_samp(l_quantity) AS l_quantity, stddev_samp(l_extendedprice) AS l_extendedprice,
         stddev_samp(l_discount) AS l_discount, stddev_samp(l_tax) AS l_tax
  FROM scored WHERE label <> prediction)
UNPIVOT (std FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax))
ORDER BY std DESC, feature LIMIT 3""", ["std"])
def q_error_dispersion(spark, d):
    """A25 + T8: top-3 dispersive features among error rows."""
    err = ME.error_cases(R.scored(spark, d), R.CLASS_LABELS)
    return QU.error_dispersion(err, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], top=3)


# ------------------------------------------------------------------ splits and leakage

from caliper.operators import splits as SP  # noqa: E402

_H = "CAST(('0x' || substr(md5('42:' || CAST({} AS VARCHAR)), 1, 8)) AS BIGINT)"

SPLIT_BASE = f"""base AS (SELECT *, {_H.format('row_id')} AS h FROM prepared),
cc AS (SELECT label, count(*) AS nc FROM base GROUP BY label)"""


def _alloc_sql(total: str) -> str:
    return f"""al0 AS (SELECT label, nc, sum(nc) OVER () AS n FROM cc),
al1 AS (SELECT label, nc, n, CAST({total} AS BIGINT) AS t FROM al0),
al2 AS (SELECT label, t, (nc * t) // n AS b, (nc * t) % n AS rem FROM al1),
al AS (SELECT label, b + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= t - sum(b) OVER () THEN 1 ELSE 0 END
              AS alloc FROM al2),
rk AS (SELECT base.*, row_number() OVER (PARTITION BY base.label ORDER BY h, row_id) AS rn, al.alloc
       FROM base JOIN al USING (label))"""


STRAT_SQL = S.with_(S.ALL_PREPARED, SPLIT_BASE, _alloc_sql("ceil(n * CAST(0.2 AS DOUBLE))"))


def _prepared_split(spark, d):
    return SP.stratified_split(R.prepared_checkpointed(spark, d), "label", "row_id", 0.2, seed=42)


@register("stratified_split", STRAT_SQL + """
SELECT row_id, label, CASE WHEN rn <= alloc THEN 'test' ELSE 'train' END AS side FROM rk""")
def q_stratified_split(spark, d):
    """Exact stratified 80/20 split in seeded hash order."""
    return _prepared_split(spark, d).select("row_id", "label", "side")


@register("row_cap", S.with_(S.ALL_PREPARED, SPLIT_BASE, _alloc_sql("least(n, 5000)")) + """
SELECT row_id, label FROM rk WHERE rn <= alloc""")
def q_row_cap(spark, d):
    """Stratified cap at 5 000 rows."""
    return SP.stratified_cap(R.prepared_checkpointed(spark, d), 5000).select("row_id", "label")


@register("stratified_folds", S.with_(S.ALL_PREPARED, SPLIT_BASE) + """
SELECT row_id, label,
       CAST((row_number() OVER (PARTITION BY label ORDER BY h, row_id) - 1)
            % (SELECT greatest(2, least(5, min(nc))) FROM cc) AS INTEGER) AS fold
FROM base""")
def q_stratified_folds(spark, d):
    """X3 + W3 + A28: exact per-class folds."""
    return SP.stratified_folds(R.prepared_checkpointed(spark, d)).select("row_id", "label", "fold")


@register("fold_count", S.with_(S.ALL_PREPARED) + """
SELECT min(nc) AS min_class_count, CAST(greatest(2, least(5, min(nc))) AS INTEGER) AS n_splits,
       min(nc) >= 2 AS stratify FROM (SELECT label, count(*) AS nc FROM prepared GROUP BY label)""")
def q_fold_count(spark, d):
    """A28."""
    return SP.min_class_count(R.prepared(spark, d))


GROUP_SQL = S.with_(S.ALL_PREPARED, f"""gs AS (SELECT DISTINCT coalesce(spatial_key, 'unknown') AS g FROM prepared),
gh AS (SELECT g, {_H.format('g')} AS h FROM gs),
gt AS (SELECT g, CASE WHEN row_number() OVER (ORDER BY h, g) <= ceil(count(*) OVER () * CAST(0.2 AS DOUBLE))
                      THEN 'test' ELSE 'train' END AS side FROM gh),
gsplit AS (SELECT p.*, gt.side FROM prepared p JOIN gt ON coalesce(p.spatial_key, 'unknown') = gt.g)""")


@register("group_split", GROUP_SQL + "SELECT row_id, spatial_key, side FROM gsplit")
def q_group_split(spark, d):
    """Group shuffle split (whole spatial groups per side)."""
    return SP.group_split(R.prepared_checkpointed(spark, d), "spatial_key", 0.2).select("row_id", "spatial_key", "side")


@register("holdout_sizes", GROUP_SQL + """
SELECT side, count(*) AS rows, count(DISTINCT coalesce(spatial_key, 'unknown')) AS groups FROM gsplit GROUP BY side""")
def q_holdout_sizes(spark, d):
    """Rows and groups per side of the group holdout."""
    return SP.holdout_sizes(SP.group_split(R.prepared_checkpointed(spark, d), "spatial_key", 0.2))


@register("time_split", S.with_(S.ALL_PREPARED) + """
SELECT row_id, date, CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS side
FROM (SELECT row_id, date, row_number() OVER (ORDER BY date, row_id) AS rn, count(*) OVER () AS n
      FROM prepared WHERE date IS NOT NULL)""")
def q_time_split(spark, d):
    """X5 + W1: ordered 80/20 cut by date (two-level bucketed prefix sum)."""
    return SP.time_split(R.prepared_checkpointed(spark, d)).select("row_id", "date", "side")


_FEAT_EQ = " AND ".join(f"tr.{c} IS NOT DISTINCT FROM te.{c}" for c in R.FEATURES)
LEAK_SQL = STRAT_SQL + f""", sides AS (SELECT *, CASE WHEN rn <= alloc THEN 'test' ELSE 'train' END AS side FROM rk),
tr AS (SELECT * FROM sides WHERE side = 'train'), te AS (SELECT * FROM sides WHERE side = 'test'),
dup AS (SELECT count(*) AS duplicate_row_overlap_count FROM te
        WHERE EXISTS (SELECT 1 FROM tr WHERE {_FEAT_EQ}))
"""


@register("leakage_overlap", LEAK_SQL + "SELECT * FROM dup")
def q_leakage_overlap(spark, d):
    """Test rows whose full feature row occurs in train."""
    sp = _prepared_split(spark, d)
    tr, te = sp.filter("side = 'train'"), sp.filter("side = 'test'")
    return QU.duplicate_overlap(tr, te, R.FEATURES).agg(F.count(F.lit(1)).alias("duplicate_row_overlap_count"))


@register("leakage_report", LEAK_SQL + """
SELECT CASE WHEN duplicate_row_overlap_count > 0 THEN 'medium' ELSE 'low' END AS risk_level,
       false AS suspicious_feature_present, '' AS suspicious_features_present,
       duplicate_row_overlap_count > 0 AS row_overlap_train_test, duplicate_row_overlap_count,
       (SELECT max(date) FROM tr) >= (SELECT min(date) FROM te) AS temporal_overlap_possible
FROM dup""")
def q_leakage_report(spark, d):
    """A26."""
    sp = _prepared_split(spark, d)
    return QU.leakage_report(sp.filter("side = 'train'"), sp.filter("side = 'test'"), R.FEATURES)


# ------------------------------------------------------------------ feature preprocessing

from caliper.operators import features as FE  # noqa: E402
from pyspark.ml.functions import vector_to_array  # noqa: E402

NUM_WITH_MISSING = R.WEATHER_FEATURES  # the daily measurements are the only numeric features with gaps


@register("class_weights", S.with_(S.ALL_PREPARED) + """
SELECT label, CAST(sum(nc) OVER () AS DOUBLE) / (count(*) OVER () * nc) AS weight
FROM (SELECT label, count(*) AS nc FROM prepared GROUP BY label)""", ["weight"])
def q_class_weights(spark, d):
    """Balanced class weights n / (K · n_c)."""
    return FE.class_weights(R.prepared_checkpointed(spark, d))


@register("feature_defaults", S.with_(S.ALL_PREPARED) + " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, 'numeric' AS kind, coalesce(median(TRY_CAST({c} AS DOUBLE)), CAST(0 AS DOUBLE)) "
     f"AS numeric_default, CAST(NULL AS VARCHAR) AS categorical_default FROM prepared" for c in R.NUMERIC_FEATURES]
    + [f"SELECT '{c}', 'categorical', CAST(NULL AS DOUBLE), coalesce((SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v, "
       f"count(*) AS n FROM prepared WHERE {c} IS NOT NULL GROUP BY v) ORDER BY n DESC, v LIMIT 1), 'missing')"
       for c in R.CATEGORICAL_FEATURES]), ["numeric_default"])
def q_feature_defaults(spark, d):
    """Median / mode defaults used to fill absent inputs."""
    return FE.feature_defaults(R.prepared_checkpointed(spark, d), R.NUMERIC_FEATURES, R.CATEGORICAL_FEATURES)


def _imputed_sql() -> str:
    cols = ", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in R.NUMERIC_FEATURES)
    ind = ", ".join(f"CAST({c} IS NULL AS DOUBLE) AS missingindicator_{c}" for c in NUM_WITH_MISSING)
    return f"imp AS (SELECT row_id, {cols}, {ind} FROM prepared)"


IMPUTED_COLS = R.NUMERIC_FEATURES + [f"missingindicator_{c}" for c in NUM_WITH_MISSING]


@register("imputed_features", S.with_(S.ALL_PREPARED, _imputed_sql()) + "SELECT * FROM imp",
          [c for c in IMPUTED_COLS])
def q_imputed_features(spark, d):
    """M1: exact-median imputation + missing indicators (only for columns with gaps)."""
    p = R.prepared_checkpointed(spark, d)
    m = FE.ExactMedianImputer(inputCols=R.NUMERIC_FEATURES).fit(p)
    out = m.transform(p)
    return out.select("row_id", *[c for c in out.columns if c in IMPUTED_COLS])


@register("scaled_features", S.with_(S.ALL_PREPARED, _imputed_sql()) + "SELECT row_id, " + ", ".join(
    f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / coalesce(nullif(stddev_pop(CAST({c} AS DOUBLE)) OVER (), 0), 1) AS {c}"
    for c in IMPUTED_COLS) + " FROM imp", IMPUTED_COLS)
def q_scaled_features(spark, d):
    """M2: imputed (incl. indicators) and standardised with the population std."""
    p = R.prepared_checkpointed(spark, d)
    m = FE.ScalerAfterImputer(inputCols=R.NUMERIC_FEATURES).fit(p)
    out = m.transform(p)
    return out.select("row_id", *[c for c in out.columns if c in IMPUTED_COLS])


OHE_COLS = {"order_status": ["F", "O", "P"], "is_bank_holiday": ["0", "1"]}


@register("onehot_features", S.with_(S.ALL_PREPARED) + "SELECT row_id, " + ", ".join(
    f"CASE WHEN coalesce(CAST({c} AS VARCHAR), 'missing') = '{v}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS {c}_{v}"
    for c, vals in OHE_COLS.items() for v in vals) + " FROM prepared",
          [f"{c}_{v}" for c, vals in OHE_COLS.items() for v in vals])
def q_onehot_features(spark, d):
    """M3 + M4 + M6: text categories, alphabetical one-hot, unseen -> all zeros; named
    output slots come from the vector's ML attributes."""
    p = R.prepared_checkpointed(spark, d)
    pipe = FE.preprocessor([], R.CATEGORICAL_FEATURES).fit(p)
    names = FE.feature_names(pipe, p)
    out = pipe.transform(p).select("row_id", vector_to_array("features").alias("__v"))
    return out.select("row_id", *[F.col("__v")[i].alias(n) for i, n in enumerate(names)])


@register("default_fill", S.with_(S.ALL_PREPARED) + """
SELECT row_id, (SELECT coalesce(median(cloud_cover), CAST(0 AS DOUBLE)) FROM prepared) AS cloud_cover,
       (SELECT v FROM (SELECT CAST(order_status AS VARCHAR) AS v, count(*) AS n FROM prepared
                       WHERE order_status IS NOT NULL GROUP BY v) ORDER BY n DESC, v LIMIT 1) AS order_status,
       hour FROM prepared""", ["cloud_cover"])
def q_default_fill(spark, d):
    """Absent input columns filled with stored defaults (computed by A23)."""
    p = R.prepared_checkpointed(spark, d)
    dfl = FE.feature_defaults(p, ["cloud_cover"], ["order_status"])
    cloud = dfl.filter("feature = 'cloud_cover'").select("numeric_default").scalar()
    status = dfl.filter("feature = 'order_status'").select("categorical_default").scalar()
    x = FE.fill_defaults(p.select("row_id", "hour"), ["cloud_cover", "order_status", "hour"],
                         {"cloud_cover": cloud, "order_status": status})
    return x.select("row_id", "cloud_cover", "order_status", "hour")


# ------------------------------------------------------------------ models and reliability (rows-only checks)

import uuid  # noqa: E402

from caliper.operators import models as MO  # noqa: E402
from caliper.operators import reliability as RE  # noqa: E402
from caliper.session import cut_lineage, ensure_checkpoint_dir  # noqa: E402


def _ml_split(spark, d):
    """Stratified 80/20 split of the prepared frame, written once per query."""
    sp = cut_lineage(SP.stratified_split(R.prepared_checkpointed(spark, d)))
    return sp.filter("side = 'train'").drop("side"), sp.filter("side = 'test'").drop("side")


def _fit_eval(spark, d, name):
    tr, te = _ml_split(spark, d)
    m = MO.fit_model(name, tr, R.NUMERIC_FEATURES, R.CATEGORICAL_FEATURES, R.CLASS_LABELS)
    return ME.evaluate(MO.judged(m, te, R.CRITICAL), R.CRITICAL).select(F.lit(name).alias("model_name"), "*")


@register("fit_logistic")
def q_fit_logistic(spark, d):
    """M7: balanced multinomial logistic regression, test metrics."""
    return _fit_eval(spark, d, "logistic_regression")


@register("fit_forest")
def q_fit_forest(spark, d):
    """M8: balanced random forest, test metrics."""
    return _fit_eval(spark, d, "random_forest")


@register("fit_boosting")
def q_fit_boosting(spark, d):
    """M9: balanced softmax gradient boosting, test metrics."""
    return _fit_eval(spark, d, "hist_gradient_boosting_balanced")


def _selected(spark, d):
    """The selected model, the metrics of all candidates, and both sides of the split."""
    tr, te = _ml_split(spark, d)
    best, metrics, _ = MO.fit_and_select(tr, te, R.NUMERIC_FEATURES, R.CATEGORICAL_FEATURES, R.CLASS_LABELS,
                                         R.CRITICAL)
    return best, metrics, tr, te


@register("model_selection")
def q_model_selection(spark, d):
    """M12 + A29: all candidates on one test split, comparison ordered by macro-F1."""
    return ME.compare_models(_selected(spark, d)[1])


@register("grid_search")
def q_grid_search(spark, d):
    """M11 + T5: grids of all three candidates, top 5 points each by mean macro-F1."""
    tr, _ = _ml_split(spark, d)
    shared = RE.search_rows(tr, R.NUMERIC_FEATURES, R.CATEGORICAL_FEATURES)
    trials = MO.parallel_map(lambda name: RE.grid_search(tr, name, MO.PARAM_GRIDS[name], R.NUMERIC_FEATURES, R.CATEGORICAL_FEATURES,
                                                         R.CLASS_LABELS, shared=shared)[1], MO.MODEL_ORDER, 3)
    return trials[0].unionByName(trials[1]).unionByName(trials[2])


@register("batch_score")
def q_batch_score(spark, d):
    """M14 + P16: score the test rows with absent inputs filled from stored defaults."""
    best, _, tr, te = _selected(spark, d)
    dfl = FE.feature_defaults(tr, best.numeric, best.categorical).collect()  # ≤ number of features rows
    best.defaults = {r["feature"]: (r["numeric_default"] if r["kind"] == "numeric" else r["categorical_default"])
                     for r in dfl}
    out = MO.batch_score(best, te.drop("order_status", "cloud_cover"))
    return out.select("row_id", "predicted_class_index", "predicted_class_label", "predicted_code", "probabilities")


def _model_dir(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/caliper-models/{uuid.uuid4().hex}"


@register("stored_model_eval")
def q_stored_model_eval(spark, d):
    """S11 + M15: save, load and re-evaluate on every prepared row (in-sample)."""
    best = _selected(spark, d)[0]
    path = _model_dir(spark)
    MO.save_model(best, path, spark)
    loaded = MO.load_model(path, spark)
    allrows = R.prepared_checkpointed(spark, d)
    return ME.evaluate(MO.judged(loaded, allrows, R.CRITICAL), R.CRITICAL).select(
        F.lit(loaded.name).alias("model_name"), F.lit("in_sample").alias("evaluation"), "*")


@register("calibrated_model")
def q_calibrated_model(spark, d):
    """M13 + X6: Platt-calibrate on a stratified quarter of train; Brier / ECE of raw and
    calibrated critical-class probabilities on test."""
    best, _, tr, te = _selected(spark, d)
    cs = cut_lineage(SP.stratified_split(tr, test_frac=0.25))
    fit_part, cal_part = cs.filter("side = 'train'"), cs.filter("side = 'test'")
    base = MO.fit_model(best.name, fit_part, best.numeric, best.categorical, R.CLASS_LABELS, best.params)
    cal = MO.calibrate(base, cal_part)
    raw = ME.ece_brier(MO.judged(best, te, R.CRITICAL), R.CRITICAL).withColumn("probability", F.lit("raw"))
    cs_ = cut_lineage(cal.transform(te).select("label", F.col("probabilities")[R.CRITICAL].alias("score")))
    calibrated = ME.ece_brier(cs_, R.CRITICAL).withColumn("probability", F.lit("calibrated"))
    return raw.unionByName(calibrated)


@register("model_importance")
def q_model_importance(spark, d):
    """M16 + T6: importances of the selected model (top 10)."""
    best, _, _, te = _selected(spark, d)
    return MO.model_importance(best, te).limit(10)


@register("permutation_importance")
def q_permutation_importance(spark, d):
    """M17 + W4 + T7: macro-F1 drop per permuted feature, 3 repeats, whole test split."""
    best, _, _, te = _selected(spark, d)
    return RE.permutation_importance(best, te, best.features, repeats=3)


@register("cv_reliability")
def q_cv_reliability(spark, d):
    """M18 + A24: stratified K-fold means / population stds per candidate."""
    return RE.cv_reliability(R.prepared_checkpointed(spark, d), R.NUMERIC_FEATURES, R.CATEGORICAL_FEATURES,
                             R.CLASS_LABELS, R.CRITICAL)


@register("time_holdout")
def q_time_holdout(spark, d):
    """Refit the selected model on the earliest 80 %."""
    best = _selected(spark, d)[0]
    return RE.time_holdout(R.prepared_checkpointed(spark, d), best.name, R.NUMERIC_FEATURES,
                           R.CATEGORICAL_FEATURES, R.CLASS_LABELS, R.CRITICAL, best.params)


@register("spatial_holdout")
def q_spatial_holdout(spark, d):
    """M20 + A27: refit with whole spatial groups held out."""
    best = _selected(spark, d)[0]
    return RE.spatial_holdout(R.prepared_checkpointed(spark, d), best.name, R.NUMERIC_FEATURES,
                              R.CATEGORICAL_FEATURES, R.CLASS_LABELS, R.CRITICAL, best.params)


@register("ablation")
def q_ablation(spark, d):
    """M21 + U1: pre-event vs post-event feature sets."""
    pre = R.prepared_checkpointed(spark, d, R.FEATURES)
    post = R.prepared_checkpointed(spark, d, R.POST_EVENT_FEATURES)
    post_num = [c for c in R.POST_EVENT_FEATURES if c not in R.CATEGORICAL_FEATURES]
    return RE.ablation({"pre_event": (pre, R.NUMERIC_FEATURES, R.CATEGORICAL_FEATURES),
                        "post_event": (post, post_num, R.CATEGORICAL_FEATURES)}, R.CLASS_LABELS, R.CRITICAL)


# ------------------------------------------------------------------ the model operators with a given model
# A raw fit has no SQL twin; what the library does with a model has one.  The model below is
# given (fixed values): two trees over three features, empty values filled with constants.

import json  # noqa: E402

import numpy as np  # noqa: E402
from pyspark.ml import PipelineModel  # noqa: E402
from pyspark.ml.feature import VectorAssembler  # noqa: E402

from caliper.operators import trees as TR  # noqa: E402

GIVEN_FEATURES = {"number_of_vehicles": 2.0, "hour": 12.0, "mean_temp": 10.0}  # and what fills empty values
GIVEN_LEAVES = [[0.6, 0.3, 0.1], [0.2, 0.5, 0.3], [0.1, 0.3, 0.6], [0.5, 0.25, 0.25], [0.15, 0.6, 0.25]]


def _given_model() -> MO.FittedModel:
    """Tree 1: hour up to 11.5, then vehicles up to 3.5; tree 2: mean_temp up to 12.5."""
    none = [0.0, 0.0, 0.0]
    trees = TR.Ensemble(3, roots=[0, 5], of=[-1, -1], feature=np.array([1, 0, -1, -1, -1, 2, -1, -1]), cut=np.zeros(8, np.int32),
                        left=np.array([1, 2, 0, 0, 0, 6, 0, 0]), right=np.array([4, 3, 0, 0, 0, 7, 0, 0]),
                        gain=np.array([0.3, 0.1, 0, 0, 0, 0.2, 0, 0]),
                        value=np.array([none, none, *GIVEN_LEAVES[:3], none, *GIVEN_LEAVES[3:]]))
    trees.threshold = np.array([11.5, 3.5, 0, 0, 0, 12.5, 0, 0])
    cols = list(GIVEN_FEATURES)
    fill = FE.ExactMedianImputerModel(inputCols=cols, stats=json.dumps({"median": GIVEN_FEATURES, "indicator": dict.fromkeys(cols, False), "dropped": []}))
    prep = PipelineModel([fill, VectorAssembler(inputCols=cols, outputCol="features")])
    return MO.FittedModel("random_forest", prep, MO.TreeModel(trees, 3), cols, [], R.CLASS_LABELS, defaults={"mean_temp": 15.0})


def _given_sql(source: str, name: str, values: dict[str, str] | None = None) -> str:
    """CTE ``name``: the rows of ``source`` with p0, p1, p2, prediction and score."""
    x = {c: f"coalesce({c}, {v})" for c, v in GIVEN_FEATURES.items()} | (values or {})

    def share(k: int) -> str:
        a, b, c, d, e = (leaf[k] for leaf in GIVEN_LEAVES)
        return (f"(CASE WHEN {x['hour']} <= 11.5 THEN CASE WHEN {x['number_of_vehicles']} <= 3.5 THEN {a} ELSE {b} END ELSE {c} END"
                f" + CASE WHEN {x['mean_temp']} <= 12.5 THEN {d} ELSE {e} END) / CAST(2 AS DOUBLE)")

    shares = ", ".join(f"{share(k)} AS p{k}" for k in range(3))
    return f"""{name} AS (SELECT *, CASE WHEN p0 > p1 AND p0 > p2 THEN 0 WHEN p1 > p2 THEN 1 ELSE 2 END AS prediction, p0 AS score
FROM (SELECT *, {shares} FROM {source}))"""


@register("given_model_scores", S.with_(S.ALL_PREPARED, _given_sql("prepared", "given", {"mean_temp": "15.0"})) + """
SELECT row_id, prediction AS predicted_class_index, ['Fatal', 'Serious', 'Slight'][prediction + 1] AS predicted_class_label,
       CAST(prediction + 1 AS INTEGER) AS predicted_code, p0, p1, p2 FROM given""", ["p0", "p1", "p2"])
def q_given_model_scores(spark, d):
    """M14 + P16 + S11: a stored model, loaded again, scores rows without one of its inputs."""
    path = _model_dir(spark)
    MO.save_model(_given_model(), path, spark)
    out = MO.batch_score(MO.load_model(path, spark), R.prepared(spark, d).drop("mean_temp"))
    return out.select("row_id", "predicted_class_index", "predicted_class_label", "predicted_code", *[F.col("probabilities")[k].alias(f"p{k}") for k in range(3)])


_GIVEN_EVAL = [_pc_sql("given", []), _overall_sql([]), _ovr_sql("given", []), _ap_sql("given", [])]
_EVAL_DOUBLES = ["accuracy", "balanced_accuracy", "f1_macro", "fatal_precision", "fatal_recall", "fatal_f1", "fatal_pr_auc"]


@register("given_model_eval", S.with_(S.ALL_PREPARED, _given_sql("prepared", "given"), *_GIVEN_EVAL) + """
SELECT accuracy, balanced_accuracy, f1_macro, fatal_precision, fatal_recall, fatal_f1, fatal_pr_auc FROM ov, ovr, ap""", _EVAL_DOUBLES)
def q_given_model_eval(spark, d):
    """All metrics of a stored model on every prepared row."""
    path = _model_dir(spark)
    MO.save_model(_given_model(), path, spark)
    return ME.evaluate(MO.score(MO.load_model(path, spark), R.prepared(spark, d), R.CRITICAL), R.CRITICAL)


_GIVEN_TIME = """cut AS (SELECT *, row_number() OVER (ORDER BY date, row_id) AS rn, count(*) OVER () AS n FROM prepared WHERE date IS NOT NULL),
held AS (SELECT * FROM cut WHERE rn > floor(n * CAST(0.8 AS DOUBLE)))"""


@register("given_time_holdout", S.with_(S.ALL_PREPARED, _GIVEN_TIME, _given_sql("held", "given"), *_GIVEN_EVAL) + """
SELECT TRUE AS available, 'random_forest' AS model_name, (SELECT count(*) FROM cut) - (SELECT count(*) FROM held) AS train_rows,
       (SELECT count(*) FROM held) AS test_rows, (SELECT min(date) FROM held) AS split_date_start,
       accuracy, balanced_accuracy, f1_macro, fatal_precision, fatal_recall, fatal_f1, fatal_pr_auc FROM ov, ovr, ap""", _EVAL_DOUBLES)
def q_given_time_holdout(spark, d):
    """M19 + X5: a given model on the latest fifth."""
    return RE.time_holdout(R.prepared_checkpointed(spark, d), "random_forest", [], [], R.CLASS_LABELS, R.CRITICAL, model=_given_model())


_GIVEN_FOLDS = """folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY h, row_id) - 1)
            % (SELECT greatest(2, least(5, min(nc))) FROM cc) AS INTEGER) AS fold FROM base)"""


@register("given_cv", S.with_(S.ALL_PREPARED, SPLIT_BASE, _GIVEN_FOLDS, _given_sql("folds", "given"), _pc_sql("given", ["fold"]), _overall_sql(["fold"]), _ovr_sql("given", ["fold"])) + """
SELECT 'given' AS model_name, CAST(count(*) AS INTEGER) AS cv_splits, avg(accuracy) AS accuracy_mean, stddev_pop(accuracy) AS accuracy_std,
       avg(f1_macro) AS f1_macro_mean, stddev_pop(f1_macro) AS f1_macro_std, avg(fatal_recall) AS fatal_recall_mean,
       stddev_pop(fatal_recall) AS fatal_recall_std FROM ov JOIN ovr USING (fold)""",
          ["accuracy_mean", "accuracy_std", "f1_macro_mean", "f1_macro_std", "fatal_recall_mean", "fatal_recall_std"])
def q_given_cv(spark, d):
    """A24 + U2 + X3: fold means and deviations of a given model's predictions."""
    folds = cut_lineage(SP.stratified_folds(R.prepared_checkpointed(spark, d)))
    k = int(SP.min_class_count(folds).first()["n_splits"])
    return RE.fold_summary(MO.score(_given_model(), folds, R.CRITICAL).withColumn("model_name", F.lit("given")), k, R.CRITICAL)


def _platt_sql(steps: int = 15) -> str:
    """Newton's method on every class's sigmoid, a CTE a step."""
    out = [_given_sql("prepared", "given"),
           "s AS MATERIALIZED (SELECT k, CAST(label = k AS INTEGER) AS hit, CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p FROM given CROSS JOIN range(3) r(k))",
           "c AS (SELECT k, sum(hit) AS pos, count(*) - sum(hit) AS neg FROM s GROUP BY k)",
           "t AS MATERIALIZED (SELECT s.k, p, CASE WHEN hit = 1 THEN (pos + 1) / (pos + CAST(2 AS DOUBLE)) ELSE 1 / (neg + CAST(2 AS DOUBLE)) END AS t FROM s JOIN c USING (k))",
           "w0 AS MATERIALIZED (SELECT k, CAST(0 AS DOUBLE) AS a, ln(sum(t) / (count(*) - sum(t))) AS b FROM t GROUP BY k)"]
    for i in range(steps):
        out.append(f"""w{i + 1} AS MATERIALIZED (SELECT k, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b
FROM (SELECT k, a, b, sum((q - t) * p) AS ga, sum(q - t) AS gb, sum(q * (1 - q) * p * p) AS haa, sum(q * (1 - q) * p) AS hab, sum(q * (1 - q)) AS hbb
      FROM (SELECT t.k, p, t, a, b, 1 / (1 + exp(-(a * p + b))) AS q FROM t JOIN w{i} w ON t.k = w.k) GROUP BY k, a, b))""")
    return S.with_(S.ALL_PREPARED, *out) + f"SELECT CAST(k AS INTEGER) AS class_index, a AS slope, b AS intercept FROM w{steps}"


@register("given_platt", _platt_sql(), ["slope", "intercept"])
def q_given_platt(spark, d):
    """The sigmoids of all classes on a given model's probabilities."""
    scored = cut_lineage(MO.score(_given_model(), R.prepared(spark, d), R.CRITICAL).select("label", "probabilities"))
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(MO.platt(scored, 3))]
    return spark.createDataFrame(rows, "class_index int, slope double, intercept double")


def _permutation_sql(repeats: int = 3) -> str:
    def key(part: int) -> str:
        return _H.format(f"(CAST(row_id AS VARCHAR) || ':' || CAST(perm_repeat AS VARCHAR) || ':{part}')")

    cols = list(GIVEN_FEATURES)
    ctes = ["x AS (SELECT * EXCLUDE (b), b % greatest(1, (SELECT count(*) FROM prepared) // 20000) AS b FROM (SELECT row_id, label, " + ", ".join(cols)
            + f", perm_repeat, {key(0)} AS b, {key(1)} AS h1, {key(2)} AS h2 FROM prepared CROSS JOIN range({repeats}) r(perm_repeat)))",
            "takers AS (SELECT *, row_number() OVER (PARTITION BY perm_repeat, b ORDER BY h1, row_id) AS rn FROM x)",
            "lenders AS (SELECT perm_repeat, b, row_number() OVER (PARTITION BY perm_repeat, b ORDER BY h2, row_id) AS rn, "
            + ", ".join(f"{c} AS lent_{c}" for c in cols) + " FROM x)",
            "paired AS (SELECT * FROM takers JOIN lenders USING (perm_repeat, b, rn))",
            "mixed AS (" + " UNION ALL ".join(
                f"SELECT '{f}' AS feature, perm_repeat, label, " + ", ".join((f"lent_{c} AS {c}" if c == f else c) for c in cols) + " FROM paired"
                for f in ["", *cols]) + ")"]
    return S.with_(S.ALL_PREPARED, *ctes, _given_sql("mixed", "given"), _pc_sql("given", ["feature", "perm_repeat"]), _overall_sql(["feature", "perm_repeat"])) + """
SELECT feature, avg(drop_) AS importance_mean, stddev_pop(drop_) AS importance_std, 'permutation_f1_macro' AS method, (SELECT count(*) FROM prepared) AS rows
FROM (SELECT feature, (SELECT f1_macro FROM ov WHERE feature = '' AND perm_repeat = 0) - f1_macro AS drop_ FROM ov WHERE feature <> '') GROUP BY feature"""


@register("given_permutation", _permutation_sql(), ["importance_mean", "importance_std"])
def q_given_permutation(spark, d):
    """M17 + W4 + T7: macro-F1 drops of a given model under the same pairing of rows."""
    return RE.permutation_importance(_given_model(), R.prepared_checkpointed(spark, d), repeats=3).withColumn("rows", F.col("rows").cast("long"))


# ------------------------------------------------------------------ audit

from caliper.operators import audit as AU  # noqa: E402

AUDIT_WARN, AUDIT_FAIL = 16 * 1024, 32 * 1024  # size bands for the document binding (bytes)
_PAT_SQL = AU.SECRET_PATTERN.replace("'", "''")

DOC_FILES_SQL = """files AS (SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path, CAST(strlen(text) AS BIGINT) AS size,
                          text, source FROM documents)"""
PAGE_PATHS_SQL = r"""pp AS (SELECT CASE page_id % 16
    WHEN 0 THEN 'artifacts/model.joblib' WHEN 1 THEN 'artifacts/error_cases.csv'
    WHEN 2 THEN 'data/sample/merged_sample.csv' WHEN 3 THEN 'keys/' || base || '.PEM' WHEN 4 THEN base || '/.env.local'
    WHEN 5 THEN 'data/raw/' || base WHEN 6 THEN 'data/raw/.gitkeep' WHEN 7 THEN 'data/sample/' || base
    WHEN 8 THEN 'artifacts/' || base || '.pkl' WHEN 9 THEN 'p' || CAST(page_id AS VARCHAR) || '.zip'
    WHEN 10 THEN 'p' || CAST(page_id AS VARCHAR) || '.pdf' WHEN 11 THEN 'practical' || CAST(page_id AS VARCHAR) || '.ipynb'
    WHEN 12 THEN 'docs/practical.ipynb' WHEN 13 THEN base || '/biplot_2d.png' WHEN 14 THEN 'data/processed/x.key'
    ELSE base END AS path
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/?([^?#]*)', 1) AS base FROM pages))"""

_BREAKS = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'"
SECRET_SQL = f"""sd AS (SELECT * FROM files WHERE source IS DISTINCT FROM 'src0' AND regexp_matches(text, '{_PAT_SQL}')),
sl AS (SELECT path, text, unnest(string_split_regex(text, {_BREAKS})) AS line,
              generate_subscripts(string_split_regex(text, {_BREAKS}), 1) AS pos FROM sd),
secret AS (SELECT 'FAIL' AS level, path, 'possible secret-like text at line ' || CAST(min(pos) AS VARCHAR) AS message
           FROM sl WHERE regexp_matches(line, '{_PAT_SQL}') GROUP BY path)"""

SIZE_SQL = """sizes AS (SELECT CASE WHEN size >= 32768 THEN 'FAIL' ELSE 'WARN' END AS level, path,
                 'tracked file is ' || CASE WHEN size < 1048576 THEN printf('%.1f KiB', size / 1024)
                                            ELSE printf('%.1f MiB', size / 1048576) END ||
                 CASE WHEN size >= 32768 THEN '; public repo limit is 32 KiB' ELSE '; consider release storage' END AS message
          FROM files WHERE size >= 16384)"""

RULES_SQL = r"""rules AS (SELECT 'FAIL' AS level, path, CASE
      WHEN path = 'artifacts/model.joblib' THEN 'trained model artifact must not be tracked'
      WHEN path = 'artifacts/error_cases.csv' THEN 'row-level error cases must not be tracked'
      WHEN path = 'data/sample/merged_sample.csv' THEN 'sample data is not approved for public tracking'
      WHEN regexp_matches(lower(path), '[^/]\.(env|pem|key|p12|sqlite|sqlite3)$') OR regexp_matches(path, '(^|/)\.env[^/]*$')
        THEN 'secret, private key, or local database file must not be tracked'
      WHEN regexp_matches(path, '^data/(raw|interim|processed)/') AND NOT regexp_matches(path, '^data/[a-z]+/\.gitkeep$')
        THEN 'raw/interim/processed data must stay local'
      WHEN path LIKE 'data/sample/%' THEN 'sample data requires explicit anonymization approval before tracking'
      WHEN regexp_matches(path, '^artifacts/') AND regexp_matches(lower(path), '[^/]\.(joblib|pkl|pickle)$')
        THEN 'model binary must not be tracked in regular Git'
      WHEN regexp_matches(path, '^[^/]*\.zip$') THEN 'root-level archive is treated as local/private coursework or source data'
      WHEN regexp_matches(path, '^[^/]*\.pdf$') THEN 'root-level PDF is treated as local/private coursework'
      WHEN regexp_matches(path, '^[^/]*\.ipynb$') AND regexp_matches(lower(path), '^practical|solution|^template_submission')
        THEN 'coursework notebook is not part of the public release'
      WHEN regexp_matches(path, '(^|/)(Cluster-House-Prices-Raw|biplot_2d)\.png$')
        THEN 'local coursework/reference file must not be tracked' END AS message FROM pp)"""


REQUIRED_SQL = "req AS (SELECT 'FAIL' AS level, r.path, r.message FROM (VALUES " + ", ".join(
    f"('{k}', '{v}')" for k, v in AU.REQUIRED.items()) + ") AS r(path, message) WHERE r.path NOT IN (SELECT path FROM pp))"

AUDIT_SQL = S.with_(DOC_FILES_SQL, PAGE_PATHS_SQL, SECRET_SQL, SIZE_SQL, RULES_SQL, REQUIRED_SQL)


def _findings(spark, d):
    files = R.documents_as_files(spark, d)
    exempt = files.filter(F.col("source") == "src0").select("path")
    secret = AU.secret_findings(files, "path", "text", exempt=exempt)
    sizes = AU.size_findings(files, "path", "size", AUDIT_WARN, AUDIT_FAIL)
    pages = R.page_paths(spark, d)
    rules = AU.path_findings(pages, "path")
    req = AU.missing_required(pages, "path")
    return secret, sizes, rules, req


@register("secret_scan", AUDIT_SQL + "SELECT * FROM secret")
def q_secret_scan(spark, d):
    """D1 + J11: first secret-like line per document (whole texts, exempt ids skipped)."""
    return _findings(spark, d)[0]


@register("size_bands", AUDIT_SQL + "SELECT * FROM sizes")
def q_size_bands(spark, d):
    """WARN / FAIL size bands."""
    return _findings(spark, d)[1]


@register("path_rules", AUDIT_SQL + "SELECT * FROM rules WHERE message IS NOT NULL")
def q_path_rules(spark, d):
    """D3: path rules by priority, on page paths that reach every rule."""
    return _findings(spark, d)[2]


@register("required_keys", AUDIT_SQL + "SELECT * FROM req")
def q_required_keys(spark, d):
    """D4 + J10: required entries missing from the observed paths."""
    return _findings(spark, d)[3]


@register("audit_summary", AUDIT_SQL + """
SELECT count(*) FILTER (WHERE level = 'FAIL') AS failures, count(*) FILTER (WHERE level = 'WARN') AS warnings,
       count(*) FILTER (WHERE level = 'FAIL') = 0 AS passed
FROM (SELECT * FROM secret UNION ALL SELECT * FROM sizes UNION ALL
      SELECT * FROM rules WHERE message IS NOT NULL UNION ALL SELECT * FROM req)""")
def q_audit_summary(spark, d):
    """D5 + U3: stacked findings rolled up."""
    return AU.summarise(_findings(spark, d))[1]
