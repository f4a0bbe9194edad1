"""Deterministic, exact, scale-safe splits.

Order is a seeded 32-bit md5 value of the row id (any SQL engine can recompute it), ties
broken by the row id.  "First n rows per class in that order" is found with a bucketed
prefix sum:

1. rows fall into ordered buckets (high bits of the order key);
2. a small table (≤ classes × buckets rows) of bucket counts is prefix-summed;
3. buckets wholly inside / outside the quota are decided from that table alone;
4. only the one boundary bucket per class gets a ``row_number`` window.

So no class — however hot — is ever sorted in a single task, and nothing is collected.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliper.functions.columns import md5_order
from caliper.operators.common import attach

BUCKETS = 4096
HASH_SPAN = 2 ** 32
MAX_BUCKET_ROWS = 2_000_000  # bound on any broadcast (group × bucket) table


def coarsen(counts: DataFrame, work: DataFrame, part: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Keep the (group × bucket) table under ``MAX_BUCKET_ROWS`` rows: with many groups,
    merge adjacent buckets (``__b div f`` stays monotone).  One bounded action on the
    small written count table."""
    rows = counts.count()
    if rows <= MAX_BUCKET_ROWS:
        return counts, work
    f = -(-rows // MAX_BUCKET_ROWS)
    nb = (F.col("__b") / F.lit(f)).cast("int")
    counts = counts.groupBy(*part, nb.alias("__b")).agg(F.sum("__c").alias("__c"))
    return counts, work.withColumn("__b", nb)


def order_key(df: DataFrame, row_id: str = "row_id", seed: int = 42, name: str = "__h") -> DataFrame:
    return df.withColumn(name, md5_order(F.col(row_id), seed))


def flag_first_n(df: DataFrame, quota: DataFrame, part: Sequence[str], key: str, tiebreak: str,
                 out: str = "__first", buckets: int = BUCKETS, key_range: tuple[int, int] | None = None,
                 counts: DataFrame | None = None) -> DataFrame:
    """Add boolean ``out``: the row is among the first ``quota.n`` rows of its ``part``
    group in ``(key, tiebreak)`` order.  ``quota`` has columns ``part… , n`` (one row per
    group, broadcast: its size is the number of groups).  A caller that already has the
    ``__b`` column and its ``(part…, __b, __c)`` count table passes them in.

    ``key`` must be numeric; buckets are ``floor((key - lo) · B / (hi - lo + 1))`` — a
    monotone map, so bucket order agrees with key order."""
    part = list(part)
    if key_range is None:
        rng = df.groupBy(*part).agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))
        work = attach(df, rng, part)
        lo, hi = F.col("__lo").cast("double"), F.col("__hi").cast("double")
    else:
        work = df
        lo, hi = F.lit(float(key_range[0])), F.lit(float(key_range[1]))
    b = F.floor((F.col(key).cast("double") - lo) * F.lit(float(buckets)) / (hi - lo + F.lit(1.0)))
    if "__b" not in work.columns:
        work = work.withColumn("__b", F.least(F.greatest(b, F.lit(0)), F.lit(buckets - 1)).cast("int"))
    if counts is None:
        counts = work.groupBy(*part, "__b").agg(F.count(F.lit(1)).alias("__c"))
    counts = attach(counts, quota, part)
    w = Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    decided = counts.select(*part, "__b", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__before"),
                            "__c", F.col("n").alias("__n"))
    decided = decided.select(*part, "__b",
                             F.when(F.col("__before") + F.col("__c") <= F.col("__n"), F.lit("all"))
                             .when(F.col("__before") >= F.col("__n"), F.lit("none"))
                             .otherwise(F.lit("partial")).alias("__status"),
                             (F.col("__n") - F.col("__before")).alias("__m"))
    work = work.join(F.broadcast(decided), [*part, "__b"])
    drop = ["__b", "__status", "__m"] + (["__lo", "__hi"] if key_range is None else [])
    whole = work.filter(F.col("__status") != "partial").withColumn(out, F.col("__status") == "all")
    edge = work.filter(F.col("__status") == "partial")
    rn = F.row_number().over(Window.partitionBy(*part, "__b").orderBy(key, tiebreak))
    edge = edge.withColumn(out, rn <= F.col("__m"))
    return whole.unionByName(edge).drop(*drop)


def ordinal_within(df: DataFrame, part: Sequence[str], key: str, tiebreak: str, out: str = "__ord",
                   buckets: int = BUCKETS, key_range: tuple[int, int] = (0, HASH_SPAN - 1)) -> DataFrame:
    """Exact 1-based ordinal of every row inside its ``part`` group in
    ``(key, tiebreak)`` order: bucket offset (small prefix-summed table) + a window per
    (group, bucket)."""
    part = list(part)
    lo, hi = key_range
    b = F.floor((F.col(key).cast("double") - F.lit(float(lo))) * F.lit(float(buckets)) / F.lit(float(hi - lo + 1)))
    work = df.withColumn("__b", F.least(F.greatest(b, F.lit(0)), F.lit(buckets - 1)).cast("int"))
    from caliper.session import cut_lineage
    counts = cut_lineage(work.groupBy(*part, "__b").agg(F.count(F.lit(1)).alias("__c")))
    counts, work = coarsen(counts, work, part)
    w = Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*part, "__b", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__off"))
    work = work.join(F.broadcast(offs), [*part, "__b"])
    rn = F.row_number().over(Window.partitionBy(*part, "__b").orderBy(key, tiebreak))
    return work.withColumn(out, F.col("__off") + rn).drop("__b", "__off")


# ------------------------------------------------------------------ allocation

def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))


def allocate(counts: DataFrame, label: str, total: Column) -> DataFrame:
    """Largest-remainder allocation of ``total`` rows across classes proportionally to
    their counts (integer arithmetic; equal remainders go to the smaller label).
    ``counts`` has ``label, __nc``; ``total`` may refer to ``__n`` (all rows).  K rows."""
    all_rows = Window.partitionBy()
    c = counts.withColumn("__n", F.sum("__nc").over(all_rows)).withColumn("__t", total.cast("bigint"))
    c = c.withColumns({"__base": F.expr("(__nc * __t) div __n").cast("bigint"),
                       "__rem": (F.col("__nc") * F.col("__t")) % F.col("__n")})
    c = c.withColumn("__left", F.col("__t") - F.sum("__base").over(all_rows))
    r = F.row_number().over(Window.orderBy(F.desc("__rem"), F.asc(label)))
    return c.select(label, (F.col("__base") + F.when(r <= F.col("__left"), 1).otherwise(0)).alias("n"))


def min_class_count(df: DataFrame, label: str = "label") -> DataFrame:
    """Smallest class count, the fold count ``max(2, min(5, smallest))`` and
    whether stratification is possible (every class has ≥ 2 rows)."""
    c = class_counts(df, label).agg(F.min("__nc").alias("min_class_count"))
    return c.select("min_class_count",
                    F.greatest(F.lit(2), F.least(F.lit(5), F.col("min_class_count"))).cast("int").alias("n_splits"),
                    (F.col("min_class_count") >= 2).alias("stratify"))


def stratified_take(df: DataFrame, label: str, total: Column, row_id: str = "row_id", seed: int = 42,
                    out: str = "__take", stratify: bool | None = True) -> DataFrame:
    """Mark ``total`` rows (a Column over ``__n`` = all rows) taken per class in
    proportion, first in seeded hash order.

    One pass builds the (class, bucket) count table (≤ K × buckets rows, written once);
    class counts, the stratification check and the quotas all come from it, so the data
    is read three times in total (counts, decided buckets, boundary buckets)."""
    from caliper.session import cut_lineage

    work = order_key(df, row_id, seed)
    work = work.withColumn("__b", F.floor(F.col("__h") * F.lit(float(BUCKETS)) / F.lit(float(HASH_SPAN))).cast("int"))
    counts = cut_lineage(work.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__c")))
    counts, work = coarsen(counts, work, [label])
    per_class = counts.groupBy(label).agg(F.sum("__c").alias("__nc"))
    if stratify is None:
        stratify = bool(per_class.agg(F.min("__nc")).first()[0] >= 2)
    if stratify:
        quota = allocate(per_class, label, total)
        res = flag_first_n(work, quota, [label], "__h", row_id, out, key_range=(0, HASH_SPAN - 1), counts=counts)
    else:
        quota = counts.agg(F.sum("__c").alias("__n")).select(total.cast("bigint").alias("n"))
        c1 = counts.groupBy("__b").agg(F.sum("__c").alias("__c"))
        res = flag_first_n(work, quota, [], "__h", row_id, out, key_range=(0, HASH_SPAN - 1), counts=c1)
    return res.drop("__h")


def stratified_split(df: DataFrame, label: str = "label", row_id: str = "row_id", test_frac: float = 0.2,
                     seed: int = 42, stratify: bool | None = None) -> DataFrame:
    """Adds ``side`` = 'test' for ``ceil(test_frac·n)`` rows (allocated to classes
    by largest remainder), 'train' otherwise.  Unstratified when a class has < 2 rows."""
    total = F.ceil(F.col("__n") * F.lit(float(test_frac)))
    res = stratified_take(df, label, total, row_id, seed, "__take", stratify)
    return res.withColumn("side", F.when(F.col("__take"), F.lit("test")).otherwise(F.lit("train"))).drop("__take")


def stratified_cap(df: DataFrame, n: int, label: str = "label", row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Keep at most ``n`` rows, stratified (all rows when there are fewer)."""
    total = F.least(F.col("__n"), F.lit(int(n)))
    return stratified_take(df, label, total, row_id, seed, "__take").filter("__take").drop("__take")


def stratified_folds(df: DataFrame, k: int | None = None, label: str = "label", row_id: str = "row_id",
                     seed: int = 42) -> DataFrame:
    """``fold`` = (ordinal within class in seeded order − 1) mod k; k defaults to
    ``max(2, min(5, smallest class))``.  Fold sizes per class differ by at most one."""
    if k is None:
        k = int(min_class_count(df, label).first()["n_splits"])
    work = ordinal_within(order_key(df, row_id, seed), [label], "__h", row_id)
    return work.withColumn("fold", ((F.col("__ord") - 1) % k).cast("int")).drop("__h", "__ord")


def group_split(df: DataFrame, group: str = "spatial_key", test_frac: float = 0.2, seed: int = 42,
                min_groups: int = 5, max_broadcast_groups: int = 2_000_000) -> DataFrame:
    """Whole groups go to one side; ``ceil(test_frac·G)`` groups (first in seeded
    order of the group key) are test.  Needs ``min_groups`` distinct groups.

    The distinct-group table is split with the same bucketed machinery and joined back
    (broadcast after a size check, else a shuffle join with AQE skew splitting)."""
    from caliper.session import bounded_broadcast

    g = F.coalesce(F.col(group).cast("string"), F.lit("unknown"))
    groups = df.select(g.alias("__g")).distinct()
    groups = groups.withColumn("__h", md5_order(F.col("__g"), seed))
    quota = groups.agg(F.count(F.lit(1)).alias("__G")).select(
        F.when(F.col("__G") < min_groups, F.raise_error(F.lit("Not enough groups for a group holdout.")))
        .otherwise(F.ceil(F.col("__G") * F.lit(float(test_frac)))).cast("bigint").alias("n"))
    flagged = flag_first_n(groups, quota, [], "__h", "__g", "__test", key_range=(0, HASH_SPAN - 1))
    side = flagged.select("__g", F.when(F.col("__test"), F.lit("test")).otherwise(F.lit("train")).alias("side"))
    side = bounded_broadcast(side, max_broadcast_groups)
    return df.withColumn("__g", g).join(side, "__g").drop("__g")


def time_split(df: DataFrame, date: str = "date", row_id: str = "row_id", train_frac: float = 0.8,
               min_valid: int = 10, min_valid_frac: float = 0.4) -> DataFrame:
    """Rows with a date, ordered by (date, row_id); the first
    ``int(train_frac·n)`` are 'train', the rest 'test'.

    The cut is one (date, row id): the date of the last train row is found by ranges of
    balanced size (:func:`~caliper.operators.quantiles.kth_smallest`), then, among that
    date's rows alone, the row id in the same way.  Rows are told apart by a comparison with
    the cut, whether ``date`` holds a few days or a timestamp for every row: no join, no
    window over the rows.  ``row_id`` must be sortable and unique.  Needs
    ``max(min_valid, int(min_valid_frac·N))`` dates."""
    from caliper.operators.quantiles import kth_smallest

    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count(date).alias("v")).first()
    if counts["v"] < max(min_valid, int(min_valid_frac * counts["n"])):
        raise ValueError("Not enough valid date values for time-based holdout.")
    k = int(train_frac * counts["v"])
    if k <= 0 or k >= counts["v"]:
        raise ValueError("Invalid split index for time holdout.")
    valid = df.filter(F.col(date).isNotNull())
    day = F.lit(kth_smallest(valid, date, k))
    before = valid.filter(F.col(date) < day).count()
    last = F.lit(kth_smallest(valid.filter(F.col(date) == day), row_id, k - before))
    train = (F.col(date) < day) | ((F.col(date) == day) & (F.col(row_id) <= last))
    return valid.withColumn("side", F.when(train, F.lit("train")).otherwise(F.lit("test")))


def holdout_sizes(split: DataFrame, group: str = "spatial_key", side: str = "side") -> DataFrame:
    """Rows and distinct groups per side."""
    return split.groupBy(side).agg(F.count(F.lit(1)).alias("rows"),
                                   F.count_distinct(F.coalesce(F.col(group).cast("string"), F.lit("unknown")))
                                   .alias("groups"))
