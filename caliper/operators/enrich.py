"""Fact-table enrichment: child aggregates, left joins, match rates, count fallbacks.

Shape at scale: every child table is aggregated *before* it is joined (partial
aggregation map-side, one row per key), so the fact side meets at most one row per key.
Daily and calendar tables carry one row per day; they are broadcast only after their
size is checked (``bounded_broadcast``), otherwise the join stays a shuffle join and AQE
splits skewed keys.  Keys are matched NULL-safe (a NULL key matches a NULL key).
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.functions.columns import parse_date, to_double
from caliper.session import bounded_broadcast

# fixed values: enrichment columns added as typed NULL placeholders when absent
PLACEHOLDER_COLUMNS = ("road_class", "maxspeed", "junction_density", "no2", "pm25", "imd_decile")
# fixed values: key / target alias pairs (newer name -> canonical name)
KEY_ALIASES = {"collision_index": "accident_index"}
TARGET_ALIASES = {"collision_severity": "accident_severity"}

MAX_DAILY_ROWS = 200_000  # ~550 years of days: anything above is not a daily table


def apply_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Copy an alias column to its canonical name when the canonical one is absent."""
    for alt, canon in aliases.items():
        if canon not in df.columns and alt in df.columns:
            df = df.withColumn(canon, F.col(alt))
    return df


def child_counts(child: DataFrame, key: str, count_name: str, max_cols: Iterable[str] = (),
                 for_join: bool = False) -> DataFrame:
    """A1–A3 + J6: records per key (NULL key kept as its own group) and, in the same
    aggregate, the max of selected columns.  One ``groupBy`` – no self-join.

    ``for_join`` groups on (key, key is NULL) and drops the flag: the same groups, but a
    join on the key then gets an exchange of its own over the (small) aggregate, without
    which AQE could not split a hot key of the other side."""
    child = apply_aliases(child, KEY_ALIASES)
    aggs = [F.count(F.lit(1)).alias(count_name)]
    aggs += [F.max(to_double(c)).alias(c) for c in max_cols if c in child.columns]
    if for_join:
        return child.groupBy(key, F.col(key).isNull().alias("__null")).agg(*aggs).drop("__null")
    return child.groupBy(key).agg(*aggs)


def left_join_null_safe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left outer equi-join where NULL matches NULL; ``right`` has at most one row
    per key.

    The join runs on the plain key, so NULL and hot keys of the left side are split by
    AQE like any skewed key.  NULL-key rows then take the right side's single NULL-key
    row, which is a scalar subquery: it is never joined."""
    cols = [c for c in right.columns if c != key]
    null_row = right.filter(F.col(key).isNull()).agg(F.first(F.struct(*cols)).alias("r")).scalar()
    out = left.join(right.filter(F.col(key).isNotNull()), key, "left")
    return out.withColumns({c: F.when(F.col(key).isNull(), null_row[c]).otherwise(F.col(c)) for c in cols})


def daily_left_join(fact: DataFrame, daily: DataFrame, date: str = "date",
                    suffix: str = "_weather", max_rows: int = MAX_DAILY_ROWS) -> DataFrame:
    """Fact ⟕ a per-day table on the date; clashing right columns get ``suffix``.

    A daily table is bounded by the number of calendar days, so it is broadcast after a
    size check — the fact side is never shuffled on its (skewed, low-cardinality) date."""
    clashes = [c for c in daily.columns if c != date and c in fact.columns]
    for c in clashes:
        daily = daily.withColumnRenamed(c, c + suffix)
    rd = "__rd_date"
    daily = bounded_broadcast(daily.withColumnRenamed(date, rd), max_rows)
    return fact.join(daily, fact[date].eqNullSafe(F.col(rd)), "left").drop(rd)


def count_fallback(df: DataFrame, own: str, *fallbacks: str) -> DataFrame:
    """Own value (coerced) -> related counts in order -> 0, as double."""
    chain = ([to_double(own)] if own in df.columns else [])
    chain += [to_double(c) for c in fallbacks if c in df.columns]
    return df.withColumn(own, F.coalesce(*chain, F.lit(0.0)))


def holiday_defaults(df: DataFrame, flag: str = "is_bank_holiday",
                     title: str = "bank_holiday_title") -> DataFrame:
    """Flag NULL -> 0, title NULL -> ``none``."""
    return df.withColumns({
        flag: F.coalesce(F.col(flag), F.lit(0)).cast("int"),
        title: F.coalesce(F.col(title), F.lit("none")),
    })


def add_placeholders(df: DataFrame, cols: Iterable[str] = PLACEHOLDER_COLUMNS) -> DataFrame:
    """Typed NULL columns for enrichments not available yet."""
    missing = {c: F.lit(None).cast("double") for c in cols if c not in df.columns}
    return df.withColumns(missing) if missing else df


def match_rates(df: DataFrame, indicators: dict[str, str]) -> DataFrame:
    """A4: one-row frame ``{name: share of rows where column is non-NULL}``; an absent
    column gives 0.0.  One pass."""
    aggs = []
    for name, c in indicators.items():
        if c in df.columns:
            aggs.append(F.coalesce(F.avg(F.col(c).isNotNull().cast("double")), F.lit(0.0)).alias(name))
        else:
            aggs.append(F.lit(0.0).alias(name))
    return df.agg(*aggs)


def date_window(df: DataFrame, date: str, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Inclusive window of calendar days; NULL dates drop out.

    Written as a plain range on the *stored* column so it reaches the parquet scan as
    pushed filters: a timestamp column is compared with ``[lo 00:00, hi + 1 day)``, a
    date column with ``[lo, hi]``.  Text dates are parsed first (no pushdown possible)."""
    t = dict(df.dtypes)[date]
    c = F.col(date)
    if t.startswith("timestamp"):
        cast = "timestamp_ntz" if t == "timestamp_ntz" else "timestamp"
        cond = c.isNotNull()
        if lo is not None:
            cond = cond & (c >= F.lit(f"{lo} 00:00:00").cast(cast))
        if hi is not None:
            cond = cond & (c < (F.to_date(F.lit(hi)) + F.expr("INTERVAL 1 DAY")).cast(cast))
        return df.filter(cond)
    if t == "string":
        df = normalise_dates(df, date)
        c = F.col(date)
    cond = c.isNotNull()
    if lo is not None:
        cond = cond & (c >= F.to_date(F.lit(lo)))
    if hi is not None:
        cond = cond & (c <= F.to_date(F.lit(hi)))
    return df.filter(cond)


def normalise_dates(df: DataFrame, date: str = "date", formats=None) -> DataFrame:
    """F1 applied in place (text / timestamp -> date)."""
    if date not in df.columns:
        return df
    return df.withColumn(date, parse_date(df, date, formats) if formats else parse_date(df, date))
