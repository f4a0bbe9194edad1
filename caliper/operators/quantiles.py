"""Exact order statistics from balanced ranges of distinct values.

One algorithm serves ranks, quantiles, medians and cumulative curves:

1. rows collapse to one row per distinct value and its sums (partial aggregation, so a
   value that most rows share is one row);
2. the distinct values are range-partitioned by (group, value).  Spark samples them, so
   ranges are balanced however the values cluster and wherever outliers lie;
3. the sums per (group, range) — at most ranges + groups rows — are prefix-summed;
4. a window inside each range adds the rest.

No task sees more than one range, no group is collected, and the ranges grow in number
with ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caliper.session import cut_lineage


def ordered_sums(per_value: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (),
                 descending: bool = False) -> DataFrame:
    """Cumulative sums over distinct values in order.

    ``per_value`` has one row per (``by``, ``value``) with the columns ``sums``; the result
    adds ``<s>_before`` (the sum over all earlier values of the group) and ``<s>_total``."""
    by = list(by)
    ranges = int(per_value.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.desc(value) if descending else F.asc(value)
    kept = per_value.select(*by, value, *sums)
    kept = cut_lineage(kept.repartitionByRange(ranges, *by, order).withColumn("__range", F.spark_partition_id()))
    part = kept.groupBy(*by, "__range").agg(*[F.sum(s).alias(s) for s in sums])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    offsets = part.select(*by, "__range",
                          *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"__{s}_offset") for s in sums],
                          *[F.sum(s).over(group).alias(f"{s}_total") for s in sums])
    inside = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = kept.withColumns({f"__{s}_inside": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    out = out.join(offsets, [*by, "__range"])
    return out.select(*by, value, *sums,
                      *[(F.col(f"__{s}_offset") + F.col(f"__{s}_inside")).alias(f"{s}_before") for s in sums],
                      *[f"{s}_total" for s in sums])


def exact_quantiles(df: DataFrame, col: str, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles (as numpy / pandas), ``by…, fraction, value``;
    NULL and NaN values are left out."""
    by = list(by)
    x = F.col(col).cast("double")
    values = df.select(*by, x.alias("__x")).filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
    values = values.groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__n"))
    ranked = ordered_sums(values, "__x", ["__n"], by)
    asked = F.transform(F.array(*[F.lit(float(f)) for f in fractions]), lambda f: F.struct(
        f.alias("fraction"), ((F.col("__n_total") - 1).cast("double") * f).alias("at")))

    def here(rank):
        return (rank >= F.col("__n_before")) & (rank < F.col("__n_before") + F.col("__n"))

    mine = F.filter(asked, lambda a: here(F.floor(a["at"])) | here(F.ceil(a["at"])))
    hits = ranked.select(*by, "__x", "__n", "__n_before", F.explode(mine).alias("a"))
    at = F.col("a.at")
    ends = hits.groupBy(*by, F.col("a.fraction").alias("fraction")).agg(
        F.max(F.when(here(F.floor(at)), F.col("__x"))).alias("lo"),
        F.max(F.when(here(F.ceil(at)), F.col("__x"))).alias("hi"), F.max(at).alias("at"))
    part = F.col("at") - F.floor("at")
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(
        F.col("lo") + (F.col("hi") - F.col("lo")) * part)
    return ends.select(*by, "fraction", value.alias("value"))


def exact_quantile_array(df: DataFrame, col: str, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The same as one row per group with ``values`` = array in the order of ``fractions``."""
    q = exact_quantiles(df, col, fractions, by)
    idx = F.create_map(*[t for i, f in enumerate(fractions) for t in (F.lit(float(f)), F.lit(i))])
    q = q.withColumn("__i", idx[F.col("fraction")])
    return q.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__i", "value"))).alias("__s")) \
        .select(*by, F.transform("__s", lambda s: s["value"]).alias("values"))


def kth_smallest(df: DataFrame, col: str, k: int):
    """Exact k-th smallest (1-based) value of a column: the rows of each balanced range reach
    the driver (a number a range), and only the range that holds rank k is put in order."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(F.col(col).alias("__x")).filter(F.col("__x").isNotNull())
    values = values.groupBy("__x").agg(F.count(F.lit(1)).alias("__n"))
    kept = cut_lineage(values.repartitionByRange(ranges, "__x").withColumn("__range", F.spark_partition_id()))
    sums = kept.groupBy("__range").agg(F.sum("__n").alias("n")).collect()
    before = 0
    for r in sorted(sums, key=lambda r: r["__range"]):
        if k >= 1 and before + r["n"] >= k:
            inside = Window.partitionBy("__range").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
            own = kept.filter(F.col("__range") == r["__range"]).withColumn("__upto", F.sum("__n").over(inside))
            return own.filter(F.col("__upto") >= k - before).agg(F.min("__x")).first()[0]
        before += r["n"]
    raise ValueError(f"rank {k} outside the rows")


def most_frequent(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """The most frequent text of each column (ties to the smallest; None without values):
    counts per (column, text), then one row per column."""
    if not cols:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols]))
    counts = df.select(pairs.alias("p")).filter(F.col("p.v").isNotNull()).groupBy("p.c", "p.v").agg(
        F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), "v"))["v"].alias("v")).collect()
    return dict.fromkeys(cols) | {r["c"]: r["v"] for r in best}
