import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from caliper.operators import splits as SP


def _h(k, seed=42):
    return int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:8], 16)


def _frame(spark, n=3000, hot=0.75, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lab = 2 if rnd.random() < hot else rnd.choice([0, 1])   # one class holds most rows
        rows.append((i * 7 + 3, lab, f"g{rnd.randint(0, 40) if rnd.random() < 0.7 else 0}",
                     None if rnd.random() < 0.05 else f"2024-01-{1 + (0 if rnd.random() < 0.4 else rnd.randint(0, 27)):02d}"))
    return spark.createDataFrame(rows, "row_id long, label int, spatial_key string, date string") \
        .withColumn("date", F.to_date("date")), rows


def _expected_alloc(counts, total):
    n = sum(counts.values())
    base = {c: (k * total) // n for c, k in counts.items()}
    rem = {c: (k * total) % n for c, k in counts.items()}
    left = total - sum(base.values())
    for c in sorted(counts, key=lambda c: (-rem[c], c))[:left]:
        base[c] += 1
    return base


def test_stratified_split_exact_and_matches_bruteforce(spark):
    df, rows = _frame(spark)
    out = SP.stratified_split(df, test_frac=0.2).select("row_id", "label", "side").collect()
    assert len(out) == len(rows) and len({r.row_id for r in out}) == len(rows)    # exhaustive, disjoint
    counts = {}
    for _, lab, _, _ in rows:
        counts[lab] = counts.get(lab, 0) + 1
    alloc = _expected_alloc(counts, math.ceil(len(rows) * 0.2))
    exp_test = set()
    for c in counts:
        ids = sorted((r[0] for r in rows if r[1] == c), key=lambda k: (_h(k), k))
        exp_test |= set(ids[:alloc[c]])
    got_test = {r.row_id for r in out if r.side == "test"}
    assert got_test == exp_test
    assert len(got_test) == math.ceil(len(rows) * 0.2)


def test_flag_first_n_small_buckets_hot_group(spark):
    df, rows = _frame(spark, n=2000)
    work = SP.order_key(df)
    quota = spark.createDataFrame([(0, 17), (1, 250), (2, 999)], "label int, n long")
    out = SP.flag_first_n(work, quota, ["label"], "__h", "row_id", buckets=8, key_range=(0, 2 ** 32 - 1))
    got = {r.row_id for r in out.filter("__first").collect()}
    exp = set()
    for c, q in [(0, 17), (1, 250), (2, 999)]:
        ids = sorted((r[0] for r in rows if r[1] == c), key=lambda k: (_h(k), k))
        exp |= set(ids[:q])
    assert got == exp


def test_stratified_cap_and_unstratified(spark):
    df, rows = _frame(spark, n=1000)
    assert SP.stratified_cap(df, 300).count() == 300
    assert SP.stratified_cap(df, 5000).count() == 1000
    single = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 1), (5, 1)], "row_id long, label int")
    out = SP.stratified_split(single)        # class 0 has one row -> unstratified
    assert out.filter("side = 'test'").count() == 1


def test_folds_balanced_per_class(spark):
    df, rows = _frame(spark, n=1500)
    out = SP.stratified_folds(df, 5).collect()
    assert {r.fold for r in out} == {0, 1, 2, 3, 4}
    for c in (0, 1, 2):
        sizes = [sum(1 for r in out if r.label == c and r.fold == f) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    ids = sorted((r[0] for r in rows if r[1] == 2), key=lambda k: (_h(k), k))
    fold_of = {r.row_id: r.fold for r in out}
    assert [fold_of[k] for k in ids[:10]] == [i % 5 for i in range(10)]


def test_group_split_keeps_groups_whole(spark):
    df, rows = _frame(spark, n=1500)
    out = SP.group_split(df, "spatial_key", 0.2).collect()
    side_of = {}
    for r in out:
        assert side_of.setdefault(r.spatial_key, r.side) == r.side
    groups = sorted({r[2] for r in rows}, key=lambda g: (_h(g), g))
    exp_test = set(groups[:math.ceil(len(groups) * 0.2)])
    assert {g for g, s in side_of.items() if s == "test"} == exp_test
    sizes = {r.side: r for r in SP.holdout_sizes(SP.group_split(df, "spatial_key", 0.2)).collect()}
    assert sizes["train"].rows + sizes["test"].rows == 1500


def test_group_split_needs_five_groups(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}") for i in range(20)], "row_id long, spatial_key string")
    with pytest.raises(Exception, match="Not enough groups"):
        SP.group_split(df).collect()


def test_time_split_exact_with_hot_day(spark):
    df, rows = _frame(spark, n=2000)
    out = SP.time_split(df).collect()
    valid = sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3], r[0]))
    k = int(len(valid) * 0.8)
    exp_train = {r[0] for r in valid[:k]}
    assert {r.row_id for r in out if r.side == "train"} == exp_train
    assert len(out) == len(valid)


def test_min_class_count(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "row_id long, label int")
    r = SP.min_class_count(df).first()
    assert (r.min_class_count, r.n_splits, r.stratify) == (1, 2, False)


def test_coarsened_buckets_keep_exactness(spark, monkeypatch):
    df, rows = _frame(spark, n=1200)
    monkeypatch.setattr(SP, "MAX_BUCKET_ROWS", 50)        # force merging of adjacent buckets
    out = SP.stratified_split(df, test_frac=0.25).collect()
    counts = {}
    for _, lab, _, _ in rows:
        counts[lab] = counts.get(lab, 0) + 1
    alloc = _expected_alloc(counts, math.ceil(len(rows) * 0.25))
    exp = set()
    for c in counts:
        ids = sorted((r[0] for r in rows if r[1] == c), key=lambda k: (_h(k), k))
        exp |= set(ids[:alloc[c]])
    assert {r.row_id for r in out if r.side == "test"} == exp
    folds = SP.stratified_folds(df, 4).collect()
    ids = sorted((r[0] for r in rows if r[1] == 2), key=lambda k: (_h(k), k))
    fold_of = {r.row_id: r.fold for r in folds}
    assert [fold_of[k] for k in ids] == [i % 4 for i in range(len(ids))]


def test_kth_smallest_clustered_values(spark):
    from caliper.operators.quantiles import kth_smallest
    vals = list(range(1000)) + [10 ** 15 + i for i in range(5)] + [-(10 ** 12)]
    df = spark.createDataFrame([(v,) for v in vals], "x long")
    srt = sorted(vals)
    for k in (1, 2, 500, 1001, len(vals)):
        assert kth_smallest(df, "x", k) == srt[k - 1]
