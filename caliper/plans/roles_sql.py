"""The same role binding as ``roles.py`` written as DuckDB SQL CTEs (oracle side)."""

COLLISION = """collision AS (
  SELECT o_orderkey AS accident_index,
         TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS accident_severity,
         CAST(o_orderdate AS DATE) AS date,
         CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_custkey % 4 END AS number_of_casualties,
         o_totalprice AS location_easting_osgr,
         o_custkey * 10 AS location_northing_osgr,
         o_orderstatus AS order_status,
         CASE WHEN starts_with(o_orderpriority, '3')
              THEN CAST(o_custkey % 24 AS VARCHAR) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':00'
              ELSE CAST(o_custkey % 24 AS VARCHAR) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') END AS time
  FROM orders)"""

VEHICLE = """vehicle AS (SELECT l_orderkey AS accident_index, l_linenumber AS number_of_vehicles FROM lineitem)"""

CASUALTY = """casualty AS (SELECT CASE WHEN l_returnflag = 'R' THEN l_orderkey END AS accident_index FROM lineitem)"""

WEATHER = """weather AS (
  SELECT date, CASE WHEN n > 0 THEN CAST(n % 9 AS DOUBLE) END AS cloud_cover, lo / 4 AS sunshine,
         price / 100 AS global_radiation, hi / 2 AS max_temp, mean / 2 AS mean_temp, lo / 2 AS min_temp,
         tax * 10 AS precipitation, CAST(1000 + lines % 40 AS DOUBLE) AS pressure,
         CASE WHEN lo > 45 THEN CAST(1 AS DOUBLE) WHEN n > 0 THEN CAST(0 AS DOUBLE) END AS snow_depth
  FROM (SELECT CAST(l_shipdate AS DATE) AS date, count(*) FILTER (WHERE r) AS n, min(l_quantity) FILTER (WHERE r) AS lo,
               max(l_quantity) FILTER (WHERE r) AS hi, avg(l_quantity) FILTER (WHERE r) AS mean,
               max(l_extendedprice) FILTER (WHERE r) AS price, max(l_tax) FILTER (WHERE r) AS tax,
               sum(l_linenumber) FILTER (WHERE r) AS lines
        FROM (SELECT *, l_returnflag = 'R' AND l_discount = CAST(0.05 AS DOUBLE) AS r FROM lineitem)
        GROUP BY CAST(l_shipdate AS DATE)))"""

CALENDAR = """holidays AS (
  SELECT make_date(CAST(y AS BIGINT), h.m, h.dd) AS date, 1 AS is_bank_holiday, h.t AS bank_holiday_title
  FROM (SELECT unnest(generate_series(year(min(o_orderdate)), year(max(o_orderdate)))) AS y FROM orders) ys,
       (VALUES (1, 1, 'New Year''s Day'), (12, 25, 'Christmas Day'), (12, 26, 'Boxing Day')) AS h(m, dd, t))"""

VAGG = """vagg AS (SELECT accident_index, count(*) AS vehicle_record_count,
                 max(CAST(number_of_vehicles AS DOUBLE)) AS vmax
          FROM vehicle GROUP BY accident_index)"""
CAGG = """cagg AS (SELECT accident_index, count(*) AS casualty_record_count FROM casualty GROUP BY accident_index)"""

MASTER = """m1 AS (
  SELECT f.*, v.vehicle_record_count, v.vmax, c.casualty_record_count,
         w.cloud_cover, w.sunshine, w.global_radiation, w.max_temp, w.mean_temp, w.min_temp,
         w.precipitation, w.pressure, w.snow_depth, h.is_bank_holiday AS hb, h.bank_holiday_title AS ht
  FROM collision f
  LEFT JOIN vagg v ON f.accident_index IS NOT DISTINCT FROM v.accident_index
  LEFT JOIN cagg c ON f.accident_index IS NOT DISTINCT FROM c.accident_index
  LEFT JOIN weather w ON f.date IS NOT DISTINCT FROM w.date
  LEFT JOIN holidays h ON f.date IS NOT DISTINCT FROM h.date),
m2 AS (SELECT *, CAST(coalesce(CASE WHEN regexp_full_match(time, '[0-9]{1,2}:[0-9]{1,2}')
                                   THEN hour(try_strptime(time, '%H:%M')) END, 12) AS INTEGER) AS hour
       FROM m1),
master AS (
  SELECT accident_index, accident_severity, date, time, location_easting_osgr, location_northing_osgr, order_status,
         vehicle_record_count, casualty_record_count, cloud_cover, sunshine, global_radiation, max_temp,
         mean_temp, min_temp, precipitation, pressure, snow_depth,
         CAST(coalesce(hb, 0) AS INTEGER) AS is_bank_holiday,
         coalesce(ht, 'none') AS bank_holiday_title,
         coalesce(vmax, CAST(vehicle_record_count AS DOUBLE), CAST(0 AS DOUBLE)) AS number_of_vehicles,
         coalesce(CAST(number_of_casualties AS DOUBLE), CAST(casualty_record_count AS DOUBLE), CAST(0 AS DOUBLE)) AS number_of_casualties,
         CAST(CAST(floor(trunc(location_easting_osgr) / 1000) AS BIGINT) AS VARCHAR) || '_' ||
           CAST(CAST(floor(trunc(CAST(location_northing_osgr AS DOUBLE)) / 1000) AS BIGINT) AS VARCHAR) AS spatial_key,
         CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
         CAST(month(date) AS INTEGER) AS month,
         CAST(coalesce(isodow(date) IN (6, 7), false) AS INTEGER) AS is_weekend,
         CAST(floor((month(date) % 12) / 3) AS INTEGER) AS season,
         hour, CAST(hour IN (7, 8, 9, 16, 17, 18) AS INTEGER) AS hour_peak,
         coalesce(precipitation, CAST(0 AS DOUBLE)) * CAST(CAST(hour IN (7, 8, 9, 16, 17, 18) AS INTEGER) AS DOUBLE)
           AS precipitation_peak_interaction,
         CASE WHEN coalesce(cloud_cover, 0) >= 7 AND coalesce(sunshine, 0) <= 1 THEN 1 ELSE 0 END AS low_visibility_proxy,
         CAST(NULL AS DOUBLE) AS road_class, CAST(NULL AS DOUBLE) AS maxspeed,
         CAST(NULL AS DOUBLE) AS junction_density, CAST(NULL AS DOUBLE) AS no2,
         CAST(NULL AS DOUBLE) AS pm25, CAST(NULL AS DOUBLE) AS imd_decile
  FROM m2)"""

ALL_MASTER = ",\n".join([COLLISION, VEHICLE, CASUALTY, WEATHER, CALENDAR, VAGG, CAGG, MASTER])


PREPARED = """prepared AS (
  SELECT accident_index AS row_id,
         number_of_vehicles, hour, day_of_week, month, is_weekend, season,
         CASE WHEN isinf(cloud_cover) OR isnan(cloud_cover) THEN NULL ELSE cloud_cover END AS cloud_cover,
         sunshine, global_radiation, max_temp, mean_temp, min_temp, precipitation, pressure,
         CAST(coalesce(TRY_CAST(snow_depth AS DOUBLE), 0) > 0 AS INTEGER) AS snow,
         hour_peak, precipitation_peak_interaction, low_visibility_proxy, order_status, is_bank_holiday,
         CAST(CASE CAST(TRY_CAST(accident_severity AS DOUBLE) AS INTEGER) WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS INTEGER) AS label,
         date, spatial_key
  FROM master
  WHERE TRY_CAST(accident_severity AS DOUBLE) IN (1, 2, 3))"""

ALL_PREPARED = ALL_MASTER + ",\n" + PREPARED

TIMED_EVENTS = """timed AS (
  SELECT event_id, CAST(ts AS DATE) AS date,
         CASE WHEN event_type = 'error' THEN strftime(ts, '%H:%M:%S')
              ELSE CAST(hour(ts) AS VARCHAR) || ':' || strftime(ts, '%M') END AS time
  FROM events)"""

TEXT_DATES = """text_dates AS (
  SELECT o_orderkey AS accident_index,
         CASE WHEN starts_with(o_orderpriority, '5') THEN 'not a date'
              WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
              WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%d/%m/%Y')
              ELSE strftime(o_orderdate, '%Y%m%d') END AS date_text
  FROM orders)"""

HOUR_SQL = ("CAST(coalesce(CASE WHEN regexp_full_match(time, '[0-9]{1,2}:[0-9]{1,2}') "
            "THEN hour(try_strptime(time, '%H:%M')) END, 12) AS INTEGER)")


SCORED = """scored AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
         l_linenumber % 3 AS prediction,
         l_quantity / 50 AS score
  FROM lineitem)"""

SCORED_MODELS = """scored_models AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, 'forest' AS model_name,
         0 AS train_order, CAST(l_linenumber % 3 AS INTEGER) AS prediction, l_quantity / 50 AS score FROM lineitem
  UNION ALL
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, 'boosting', 1,
         CAST(l_partkey % 3 AS INTEGER), l_discount * 10 FROM lineitem
  UNION ALL
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, 'logistic', 2,
         CAST((l_suppkey + l_linenumber) % 3 AS INTEGER), l_tax * 12.5 FROM lineitem)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def rnd(sql: str, doubles: list[str]) -> str:
    """Round the listed double columns of a query to 6 places (value-hash hygiene)."""
    if not doubles:
        return sql
    rep = ", ".join(f"round({c}, 6) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS q"
