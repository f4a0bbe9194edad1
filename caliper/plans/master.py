"""C1 build-master and C5 fact × daily merge as single lazy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from caliper.functions.columns import interaction_features, spatial_key, temporal_features
from caliper.operators.enrich import (KEY_ALIASES, TARGET_ALIASES, add_placeholders,
                                      apply_aliases,
                                      child_counts, count_fallback, daily_left_join, date_window,
                                      holiday_defaults, left_join_null_safe, match_rates,
                                      normalise_dates)

# fixed values: date formats of the fact table (ISO first, then day-first)
FACT_DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy")


def build_master(collision: DataFrame, vehicle: DataFrame, casualty: DataFrame, weather: DataFrame,
                 holidays: DataFrame, key: str = "accident_index", date: str = "date",
                 weather_probe: str = "mean_temp") -> tuple[DataFrame, DataFrame]:
    """One lazy plan — aliases, date parsing, child aggregates, four left joins,
    count fallbacks, spatial/temporal/interaction features and placeholders.

    Returns ``(master, join_stats)``; ``join_stats`` is a one-row frame of match rates
    computed in a single pass over ``master``."""
    fact = apply_aliases(apply_aliases(collision, KEY_ALIASES), TARGET_ALIASES)
    fact = normalise_dates(fact, date, FACT_DATE_FORMATS)
    weather = normalise_dates(weather, date, ("yyyy-MM-dd", "yyyyMMdd", "dd/MM/yyyy"))

    v = child_counts(vehicle, key, "vehicle_record_count", ["number_of_vehicles"], for_join=True)
    v = v.withColumnRenamed("number_of_vehicles", "__vehicle_max") if "number_of_vehicles" in v.columns else v
    c = child_counts(casualty, key, "casualty_record_count", for_join=True)
    merged = left_join_null_safe(fact, v, key)
    merged = left_join_null_safe(merged, c, key)
    merged = daily_left_join(merged, weather, date, suffix="_weather")
    merged = daily_left_join(merged, holidays, date, suffix="_holiday")
    merged = holiday_defaults(merged)
    merged = count_fallback(merged, "number_of_vehicles", "__vehicle_max", "vehicle_record_count")
    merged = count_fallback(merged, "number_of_casualties", "casualty_record_count")
    merged = merged.drop("__vehicle_max")
    merged = spatial_key(merged)
    merged = temporal_features(merged, date=date)
    merged = interaction_features(merged)
    master = add_placeholders(merged)
    stats = join_stats(master, weather_probe)
    return master, stats


def join_stats(master: DataFrame, weather_probe: str = "mean_temp") -> DataFrame:
    """A4 on the master: vehicle / casualty / weather match rates (weather judged by a
    non-NULL probe column)."""
    return match_rates(master, {
        "vehicle_match_rate": "vehicle_record_count",
        "casualty_match_rate": "casualty_record_count",
        "weather_match_rate": weather_probe,
    })


def write_master(spark, master: DataFrame, path: str, metadata_path: str, target: str = "accident_severity",
                 join_keys: tuple[str, ...] = ("accident_index", "date", "spatial_key"), weather_probe: str = "mean_temp") -> DataFrame:
    """S8 + A13: write the master once; the metadata document (counts, target validity,
    match rates, missing rate per column, join keys, build time) reads the written table.
    Returns the written master."""
    from datetime import datetime, timezone

    from caliper.operators.quality import master_metadata, missing_rates
    from caliper.sources.tables import write_document, write_table

    write_table(master, path)
    done = spark.read.parquet(path)
    stats = join_stats(done, weather_probe)
    row = master_metadata(done, stats, target).first().asDict()                       # one row
    rates = {r["column"]: r["missing_rate"] for r in missing_rates(done).collect()}   # a row a column
    match = {k: row.pop(k) for k in stats.columns}
    write_document(spark, {"built_at_utc": datetime.now(timezone.utc).isoformat(timespec="seconds")} | row | {
        "missing_rate_by_column": rates, "join_keys": list(join_keys), "join_match_rates": match}, metadata_path)
    return done


def merge_daily_inner(fact: DataFrame, daily: DataFrame, date: str = "date", start_year: int = 2010,
                      fact_formats=FACT_DATE_FORMATS, daily_formats=("yyyyMMdd", "yyyy-MM-dd")) -> DataFrame:
    """C5 (J5, P10): both sides from ``start_year`` on, inner join on the date.

    The year bound is a range on the date column (pushdown-friendly), and the daily side
    is broadcast after a size check."""
    from caliper.session import bounded_broadcast
    from caliper.operators.enrich import MAX_DAILY_ROWS

    lo = f"{start_year:04d}-01-01"
    def window(df, formats):
        # raw timestamp / date columns are filtered before parsing so the bound reaches the scan
        if dict(df.dtypes)[date] == "string":
            return date_window(normalise_dates(df, date, formats), date, lo)
        return normalise_dates(date_window(df, date, lo), date, formats)

    f = window(fact, fact_formats)
    d = window(daily, daily_formats)
    clashes = [c for c in d.columns if c != date and c in f.columns]
    for cc in clashes:
        d = d.withColumnRenamed(cc, cc + "_daily")
    return f.join(bounded_broadcast(d, MAX_DAILY_ROWS), date, "inner")
