"""Data-quality reports (A5–A13, A25–A27, J7): one-pass aggregates, long format.

Every report is a single aggregate over the table (partial aggregation map-side), then
``unpivot`` into long rows; no per-feature jobs, no row explode."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.functions.columns import is_missing, is_missing_numeric, parse_date, year_month
from caliper.operators.common import attach
from caliper.operators.prepare import POST_EVENT_COLUMNS, VALID_CODES, valid_target


def missing_rates(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """A5: ``(column, missing_rate)`` for every column, highest first (ties by name)."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.coalesce(F.avg(is_missing(df, c).cast("double")), F.lit(0.0)).alias(c) for c in cols])
    return (row.unpivot([], [F.col(f"`{c}`") for c in cols], "column", "missing_rate")
            .orderBy(F.desc("missing_rate"), F.asc("column")))


def top_missing(df: DataFrame, n: int = 12, cols: Iterable[str] | None = None) -> DataFrame:
    """The ``n`` columns with the highest missing rate (a top-k report)."""
    return missing_rates(df, cols).limit(n)


def missing_by_month(df: DataFrame, features: list[str], date: str = "date") -> DataFrame:
    """``(year_month, feature, missing_rate, rows)``; non-numeric values count as
    missing, an absent feature column as fully missing, NULL dates drop out.

    One ``groupBy(year_month)`` with one average per feature, then ``unpivot``; the
    output is ordered by month, then by the given feature order (T10)."""
    if date not in df.columns:
        return df.sparkSession.createDataFrame([], "year_month string, feature string, missing_rate double, rows bigint")
    d = parse_date(df, date)
    work = df.withColumn("__ym", year_month(d)).filter(d.isNotNull())
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(features):
        rate = F.avg(is_missing_numeric(work, c).cast("double")) if c in df.columns else F.lit(1.0)
        aggs.append(rate.alias(f"f{i}"))
    wide = work.groupBy(F.col("__ym").alias("year_month")).agg(*aggs)
    longf = wide.unpivot(["year_month", "rows"], [f"f{i}" for i in range(len(features))], "fpos", "missing_rate")
    names = F.create_map(*[x for i, c in enumerate(features) for x in (F.lit(f"f{i}"), F.lit(c))])
    pos = F.create_map(*[x for i, c in enumerate(features) for x in (F.lit(f"f{i}"), F.lit(i))])
    return (longf.select("year_month", names[F.col("fpos")].alias("feature"), "missing_rate", "rows",
                         pos[F.col("fpos")].alias("__pos"))
            .orderBy("year_month", "__pos").drop("__pos"))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class (NULL kept as its own group), sorted by class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.asc_nulls_last(label))


def target_validity(df: DataFrame, target: str = "accident_severity", codes=VALID_CODES) -> DataFrame:
    """Raw rows, valid / invalid target counts and the valid ratio."""
    ok = valid_target(target, codes) if target in df.columns else F.lit(False)
    return df.agg(F.count(F.lit(1)).alias("rows_raw"), F.count_if(ok).alias("rows_valid_target"),
                  F.count_if(~ok).alias("rows_invalid_target"),
                  F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("target_valid_ratio"))


def date_coverage(df: DataFrame, date: str = "date") -> DataFrame:
    """A10: min / max date and distinct days (NULLs ignored)."""
    d = parse_date(df, date)
    return df.agg(F.min(d).alias("date_min"), F.max(d).alias("date_max"),
                  F.count_distinct(d).alias("unique_days"))


def spatial_coverage(df: DataFrame, key: str = "spatial_key", unknown: str = "unknown",
                     approx_rsd: float | None = None) -> DataFrame:
    """Distinct keys and the share of ``unknown`` keys.  ``approx_rsd`` switches the
    distinct count to HyperLogLog for very large key sets."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(unknown))
    distinct = F.approx_count_distinct(k, approx_rsd) if approx_rsd else F.count_distinct(k)
    return df.agg(distinct.alias("unique_spatial_keys"),
                  F.coalesce(F.avg((k == unknown).cast("double")), F.lit(0.0)).alias("unknown_spatial_key_ratio"))


def quality_report(raw: DataFrame, prepared: DataFrame, target: str = "accident_severity",
                   date: str = "date", codes=VALID_CODES) -> DataFrame:
    """One-row report = A9 + A10 on the raw table and A11 on the prepared one.

    Two single-pass aggregates; the prepared one is attached as a scalar subquery."""
    d = parse_date(raw, date) if date in raw.columns else F.lit(None).cast("date")
    ok = valid_target(target, codes)
    r = raw.agg(F.count(F.lit(1)).alias("rows_raw"), F.count_if(ok).alias("rows_valid_target"),
                F.count_if(~ok).alias("rows_invalid_target"), F.min(d).alias("date_min"),
                F.max(d).alias("date_max"), F.count_distinct(d).alias("unique_days"))
    return attach(r, spatial_coverage(prepared))


def master_metadata(master: DataFrame, join_stats: DataFrame, target: str = "accident_severity",
                    codes=VALID_CODES) -> DataFrame:
    """Row / column counts, target validity and the join match rates (one row)."""
    ok = valid_target(target, codes)
    m = master.agg(F.count(F.lit(1)).alias("row_count"),
                   F.lit(len(master.columns)).alias("column_count"),
                   F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("target_valid_ratio"),
                   F.count_if(~ok).alias("target_invalid_count"))
    return attach(m, join_stats)


def error_dispersion(errors: DataFrame, features: list[str], top: int | None = None) -> DataFrame:
    """A25 (+T8): sample standard deviation of numeric features over error rows, highest
    first (ties by name); ``top`` keeps the first n."""
    numeric = [c for c, t in errors.dtypes if c in features and t in ("int", "bigint", "double", "float", "smallint")]
    row = errors.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in numeric])
    out = row.unpivot([], numeric, "feature", "std").filter(F.col("std").isNotNull()) \
        .orderBy(F.desc("std"), F.asc("feature"))
    return out.limit(top) if top else out


def duplicate_overlap(train: DataFrame, test: DataFrame, features: list[str]) -> DataFrame:
    """Test rows whose full feature row also occurs in train (NULL-safe equality).

    Both sides are keyed by one 64-bit hash of the feature row (F17).  The train rows are
    deduplicated first (partial aggregation keeps one copy a map task), so a hot train row
    reaches the join once; the left-semi join has the hash as its only equi-key and its
    exchanges lie directly under it, so AQE splits a hot test row.  The exact NULL-safe
    comparison of the whole row is the join's residual (hash collisions match nothing)."""
    k = F.xxhash64(*[F.col(c) for c in features])
    right = train.select(*features).distinct().select(k.alias("__k"), F.struct(*features).alias("__r"))
    left = test.withColumn("__k", k)
    lrow, rrow = F.struct(*[left[c] for c in features]), right["__r"]
    # both terms mix the two sides, so the planner keeps this as a residual (the hash is
    # the only join key); greatest == least holds exactly when the rows are equal
    same_row = F.greatest(lrow, rrow).eqNullSafe(F.least(lrow, rrow))
    return left.join(right, (left["__k"] == right["__k"]) & same_row, "left_semi").drop("__k")


def leakage_report(train: DataFrame, test: DataFrame, features: list[str], date: str = "date") -> DataFrame:
    """Suspicious post-event columns, duplicate overlap count, temporal overlap
    (train max date >= test min date; NULL when either side has no dates) and risk."""
    suspicious = sorted(c for c in features if c in POST_EVENT_COLUMNS)
    dup = duplicate_overlap(train, test, features).agg(F.count(F.lit(1)).alias("duplicate_row_overlap_count"))
    tr = train.agg(F.max(date).alias("train_max"))
    te = test.agg(F.min(date).alias("test_min"))
    has_s = F.lit(bool(suspicious))
    over = F.col("duplicate_row_overlap_count") > 0
    risk = (F.when(has_s & over, "high").when(has_s | over, "medium").otherwise("low"))
    return (attach(attach(dup, tr), te)
            .select(risk.alias("risk_level"), has_s.alias("suspicious_feature_present"),
                    F.lit(",".join(suspicious)).alias("suspicious_features_present"),
                    over.alias("row_overlap_train_test"),
                    F.col("duplicate_row_overlap_count"),
                    F.when(F.col("train_max").isNull() | F.col("test_min").isNull(), F.lit(None).cast("boolean"))
                    .otherwise(F.col("train_max") >= F.col("test_min")).alias("temporal_overlap_possible")))
