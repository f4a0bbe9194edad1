"""Tree ensembles, shared fits, Platt scaling and permutation importance against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from caliper.operators import features as FE
from caliper.operators import metrics as ME
from caliper.operators import models as MO
from caliper.operators import reliability as RE
from caliper.operators import splits as SP
from caliper.operators import trees as TR


def sample(n, seed=0, d=4, levels=12):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, levels, (n, d)).astype(np.uint8)
    label = ((codes[:, 0] > 5).astype(int) + (codes[:, 1] * (codes[:, 2] > 3) > 6) + (rng.random(n) < 0.1)) % 3
    return codes, label, rng.integers(-(1 << 62), 1 << 62, n)


def plain_boosting(codes, label, classes, rounds, rate, leaves, min_leaf):
    """Softmax boosting, one split at a time over all rows, features and codes."""
    n = len(label)
    counts = [sum(label == k) for k in range(classes)]
    weight = np.array([n / (sum(c > 0 for c in counts) * counts[y]) for y in label])
    share = np.array([weight[label == k].sum() for k in range(classes)]) / weight.sum()
    raw = np.tile(np.log(share) - np.log(share).mean(), (n, 1))
    scale = TR.fixed_point(n, max(weight))
    for _ in range(rounds):
        p = np.exp(raw) / np.exp(raw).sum(1, keepdims=True)
        step = np.zeros_like(raw)
        for k in range(classes):
            g, h = np.rint(scale * weight * (p[:, k] - (label == k))), np.rint(scale * weight * p[:, k] * (1 - p[:, k]))

            def best(rows):
                found = (0.0, None)
                for f in range(codes.shape[1]):
                    for c in sorted(set(codes[rows, f]))[:-1]:
                        low, high = rows[codes[rows, f] <= c], rows[codes[rows, f] > c]
                        if min(len(low), len(high)) >= min_leaf and min(h[low].sum(), h[high].sum()) >= 1e-3 * scale:
                            gain = g[low].sum() ** 2 / h[low].sum() + g[high].sum() ** 2 / h[high].sum() - g[rows].sum() ** 2 / h[rows].sum()
                            if gain > found[0]:
                                found = (gain, (low, high))
                return found

            parts = [(np.arange(n), *best(np.arange(n)))]
            while len(parts) < leaves and max(gain for _, gain, _ in parts) > 0:
                at = max(range(len(parts)), key=lambda i: parts[i][1])
                _, _, halves = parts.pop(at)
                parts += [(rows, *best(rows)) for rows in halves]
            for rows, _, _ in parts:
                step[rows, k] = -rate * g[rows].sum() / h[rows].sum()
        raw += step
    return raw


def test_boosting_equals_a_plain_sequential_version():
    codes, label, key = sample(60, 3)
    bins = np.full(4, 12)
    how = TR.Boosting(rounds=8, rate=0.3, leaves=6, min_leaf=4)
    *_, own = TR.boost_rows(codes, label, key, bins, 3, how)
    assert np.allclose(own.scores(codes) + own.base, plain_boosting(codes, label, 3, 8, 0.3, 6, 4), rtol=0, atol=1e-9)


@pytest.mark.parametrize("small", [0, 1 << 14])
def test_features_of_few_bins_are_summed_together(monkeypatch, small):
    monkeypatch.setattr(TR, "SMALL", small)
    bins = np.array([8, 24, 256, 1, 2, 2, 255, 3, 2, 1])
    rng = np.random.default_rng(4)
    columns = np.stack([rng.integers(0, b, 700) for b in bins]).astype(np.uint8)
    columns[:, :2] = (bins - 1)[:, None]  # the last code of every feature
    joint = TR.Joint(bins)
    assert len(joint.groups) == 4 and sorted(f for g in joint.groups for f, _ in g) == list(range(len(bins)))
    rows = np.append(np.flatnonzero(rng.random(700) < 0.6), [0, 1])
    own, g, h = rng.integers(0, 3, len(rows)), rng.integers(-(2**40), 2**40, len(rows)) * 1.0, rng.integers(0, 2**40, len(rows)) * 1.0
    got = joint.sums(joint.of(columns), rows, own, 3, g, h)
    first = np.cumsum(bins) - bins
    for f, b in enumerate(bins):
        for c, w in enumerate((g, h, np.ones(len(rows)))):
            want = np.zeros((3, b))
            np.add.at(want, (own, columns[f, rows]), w)
            assert np.array_equal(got[c, :, first[f] : first[f] + b], want)


def test_tasks_read_sums_with_and_without_places(tmp_dir):
    from concurrent.futures import ThreadPoolExecutor

    class Context:
        def __init__(self, own):
            self.own = own

        def allGather(self, told):
            return ["a", "b", "c"]

        def partitionId(self):
            return self.own

        taskAttemptId = partitionId

    dense, thin = np.arange(-6.0, 6.0).reshape(3, 4), np.zeros((3, 4))
    thin[2, 1] = -(2.0**50)

    def run(i):
        together = TR.meeting(tmp_dir, Context(i))
        return [together(x) for x in ([dense, thin, thin][i], np.zeros((3, 4)), [thin, thin, dense][i])]

    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(run, range(3)))
    for own in found:
        assert all(np.array_equal(a, b) for a, b in zip(own, [dense + 2 * thin, 0 * thin, dense + 2 * thin]))


@pytest.mark.parametrize("early", [False, True])
def test_distributed_fit_gives_the_same_trees(spark, monkeypatch, early):
    monkeypatch.setattr(TR, "REFRESH", 2)
    codes, label, key = sample(900, 5)
    bins, how = np.full(4, 12), TR.Boosting(rounds=5 if not early else 60, rate=0.6, leaves=8, early_stop=early, patience=2)
    *_, own = TR.boost_rows(codes, label, key, bins, 3, how)
    table = spark.createDataFrame([(int(k), int(y), bytes(c)) for k, y, c in zip(key, label, codes)], "row long, label int, codes binary").repartition(5)
    far = TR.boost_table(table, bins, 3, how)
    assert len(own.roots) == len(far.roots) and (not early or len(own.roots) < 180)
    for name in ("feature", "cut", "left", "right", "value"):
        assert np.array_equal(getattr(own, name), getattr(far, name)), name


@pytest.mark.parametrize("early", [False, True])
def test_a_barrier_stage_gives_the_same_trees_in_few_jobs(spark, monkeypatch, early):
    codes, label, key = sample(900, 5)
    bins, how = np.full(4, 12), TR.Boosting(rounds=5 if not early else 60, rate=0.6, leaves=8, early_stop=early, patience=2)
    *_, own = TR.boost_rows(codes, label, key, bins, 3, how)
    table = spark.createDataFrame([(int(k), int(y), bytes(c)) for k, y, c in zip(key, label, codes)], "row long, label int, codes binary").repartition(5)
    monkeypatch.setattr(TR, "TASK_ROWS", 300)
    group = f"barrier-{early}"
    spark.sparkContext.setJobGroup(group, "one fit")
    far = TR.boost_table(table, bins, 3, how)
    spark.sparkContext.setJobGroup("other", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 6  # whatever the number of rounds
    for other in (far, TR.boost_steps(table, bins, 3, how)):
        for name in ("roots", "feature", "cut", "left", "right", "value", "base"):
            assert np.array_equal(getattr(own, name), getattr(other, name)), name


def test_a_barrier_fit_is_not_the_last_stage_of_its_job(spark, monkeypatch):
    """Spark begins such a stage anew after a lost executor unless the job ends with it."""
    codes, label, key = sample(300, 5)
    table = spark.createDataFrame([(int(k), int(y), bytes(c)) for k, y, c in zip(key, label, codes)], "row long, label int, codes binary")
    plans, frame = [], type(table)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or collect(df))
    TR.boost_table(table, np.full(4, 12), 3, TR.Boosting(rounds=2, leaves=3))
    [plan] = [p for p in plans if "MapInArrow" in p]
    assert "Exchange" in plan.split("MapInArrow")[0]


def test_tasks_without_rows_take_part(spark, monkeypatch):
    monkeypatch.setattr(TR, "TASK_ROWS", 1)
    table = spark.createDataFrame([(5, y, bytes([y, 1])) for y in (0, 1, 1, 0)], "row long, label int, codes binary")  # one key: one task has all rows
    far = TR.boost_table(table, np.array([2, 3]), 2, TR.Boosting(rounds=3, min_leaf=1))
    *_, own = TR.boost_rows(np.array([[0, 1], [1, 1], [1, 1], [0, 1]], np.uint8), np.array([0, 1, 1, 0]), np.full(4, 5), np.array([2, 3]), 2, TR.Boosting(rounds=3, min_leaf=1))
    assert np.array_equal(own.value, far.value) and np.array_equal(own.feature, far.feature) and (far.feature == 0).any()


def test_where_cores_are_unknown_each_step_is_a_job(spark, monkeypatch):
    monkeypatch.setattr(TR, "cores", lambda spark: 0)
    codes, label, key = sample(80, 5)
    table = spark.createDataFrame([(int(k), int(y), bytes(c)) for k, y, c in zip(key, label, codes)], "row long, label int, codes binary")
    *_, own = TR.boost_rows(codes, label, key, np.full(4, 12), 3, TR.Boosting(rounds=2, leaves=3))
    assert np.array_equal(own.value, TR.boost_table(table, np.full(4, 12), 3, TR.Boosting(rounds=2, leaves=3)).value)


def test_a_prefix_of_a_fit_is_the_shorter_fit():
    codes, label, key = sample(400, 1)
    bins = np.full(4, 12)
    stages = {n: e.scores(codes) for n, e in enumerate(TR.boost_rows(codes, label, key, bins, 3, TR.Boosting(rounds=9)), 1)}
    *_, short = TR.boost_rows(codes, label, key, bins, 3, TR.Boosting(rounds=4))
    assert np.array_equal(stages[4], short.scores(codes))
    drawn = TR.bootstrap(key, 7, 1.0, 42)
    deep, flat = TR.Ensemble(3), TR.Ensemble(3)
    deep.add([TR.forest_tree(codes, label, drawn, 3, 7, TR.Forest())], [-1])
    flat.add([TR.forest_tree(codes, label, drawn, 3, 7, TR.Forest(depth=3))], [-1])
    assert np.array_equal(deep.scores(codes, depth=3), flat.scores(codes)) and len(deep.feature) > len(flat.feature)


@pytest.mark.parametrize("judged", [False, True])
def test_forests_grow_from_drawn_rows_alone(spark, monkeypatch, judged):
    codes, label, key = sample(4000, 7)
    held = np.arange(4000) % 4 == 0 if judged else np.zeros(4000, bool)
    table = spark.createDataFrame([(0, bool(h), int(k), int(y), bytes(c)) for h, k, y, c in zip(held, key, label, codes)],
                                  "fit int, held boolean, row long, label int, codes binary").repartition(3)
    how, n = TR.Forest(trees=23, rows=60), int((~held).sum())
    passed = TR._drawn(table, {0: how}, {0: 0}, {0: n}, {0: 3}, judged).groupBy("chunk").agg(F.count_if(~F.col("held")).alias("n"), F.count_if("held").alias("held")).collect()
    assert len(passed) == 3 and all(r.n < 60 * 10 * 1.3 and (r.held == held.sum()) for r in passed)  # not all 4000 rows
    order = np.lexsort((label, key))
    mine = order[~held[order]]
    own = TR.Ensemble(3)
    own.add([TR.forest_tree(codes[mine], label[mine], TR.bootstrap(key[mine], t, 60 / n, how.seed), 3, t, how) for t in range(23)], [-1] * 23)
    if not judged:
        far = TR.merged(TR.forest_groups(table, {}, 3, {0: how}, {0: 0}, {0: n}))[0]
        for name in ("roots", "feature", "cut", "left", "right", "value"):
            assert np.array_equal(getattr(own, name), getattr(far, name)), name
        return
    got = TR.forest_groups(table, {}, 3, {0: how}, {0: 0}, {0: n}, [(23, None), (12, 2)]).groupBy("stage", "row").agg(*[F.sum(F.col("shares")[c]).alias(f"s{c}") for c in range(3)]).collect()
    told = {(r.stage, r.row): (r.s0, r.s1, r.s2) for r in got}
    at = np.flatnonzero(held)
    for stage, depth in ((23, None), (12, 2)):
        want = own.scores(codes[at], trees=range(stage), depth=depth)
        assert np.allclose([told[stage, int(k)] for k in key[at]], want, atol=1e-9)


def test_a_chunk_whose_trees_draw_nothing_keeps_them(spark):
    table = spark.createDataFrame([(0, False, 3, 1, bytes([1]))], "fit int, held boolean, row long, label int, codes binary")
    far = TR.merged(TR.forest_groups(table, {}, 2, {0: TR.Forest(trees=41)}, {0: 0}, {0: 10**9}))[0]  # a rate of next to nothing
    assert len(far.roots) == 41


def test_forest_tree_equals_plain_gini_splits():
    codes, label, _ = sample(70, 9, d=3, levels=40)
    weight = TR.balanced(np.bincount(label, minlength=3))[label]
    own = TR.Ensemble(3)
    own.add([TR.forest_tree(codes, label, np.ones(70, np.int64), 3, 0, TR.Forest(min_leaf=3, features=3))], [-1])

    def mass(rows):
        return np.bincount(label[rows], weight[rows], 3)

    def gini(rows):
        m = mass(rows)
        return m.sum() - (m**2).sum() / m.sum()

    def grow(rows, out):
        splits = []
        if len(rows) >= 6 and gini(rows) > 1e-9:
            for f, c in itertools.product(range(3), range(40)):
                low, high = rows[codes[rows, f] <= c], rows[codes[rows, f] > c]
                if min(len(low), len(high)) >= 3:
                    splits.append((gini(rows) - gini(low) - gini(high), low, high))
        if not splits:
            out[rows] = mass(rows) / mass(rows).sum()
            return
        top = max(s[0] for s in splits)
        _, low, high = next(s for s in splits if s[0] >= top - 1e-12)
        grow(low, out), grow(high, out)

    want = np.zeros((70, 3))
    grow(np.arange(70), want)
    same = np.abs(own.scores(codes) - want).max(1) < 1e-9
    assert same.mean() > 0.9  # splits of equal gain on different features may part


def test_bootstrap_counts_are_poisson_and_weights_balance_each_sample():
    key = np.arange(40_000)
    for rate in (1.0, 0.25):
        drawn = TR.bootstrap(key, 3, rate, 1)
        assert abs(drawn.mean() - rate) < 0.02 and abs(drawn.var() - rate) < 0.03
    assert (TR.bootstrap(key, 3, 1.0, 1) != TR.bootstrap(key, 4, 1.0, 1)).mean() > 0.4
    label = np.array([0] * 90 + [1] * 10)
    tree = TR.forest_tree(np.zeros((100, 1), np.uint8), label, np.array([1] * 90 + [3] * 10), 2, 0, TR.Forest())
    assert np.allclose(tree["value"], [[0.5, 0.5]])  # equal mass whatever was drawn


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        a, b, c = rng.normal(), rng.normal(), "xyz"[rng.integers(3)]
        label = int(a + (c == "x") > 0.4) + int(b > 1)
        rows.append((i, label, None if i % 11 == 0 else float(a), float("nan") if i % 17 == 0 else float(b), None, None if i % 13 == 0 else c))
    return spark.createDataFrame(rows, "row_id long, label int, a double, b double, none double, c string").repartition(3).cache()


NUM, CAT, NAMES = ["a", "b", "none"], ["c"], ["l0", "l1", "l2"]


@pytest.mark.parametrize("name", MO.MODEL_ORDER)
def test_default_models_learn_and_survive_saving(spark, frame, tmp_dir, name):
    train, test = frame.where("row_id % 5 != 0"), frame.where("row_id % 5 = 0")
    model = MO.fit_model(name, train, NUM, CAT, NAMES)
    scored = MO.score(model, test)
    assert ME.overall(ME.confusion(scored)).first()["f1_macro"] > (0.6 if name == "logistic_regression" else 0.75)
    MO.save_model(model, f"{tmp_dir}/m", spark)
    again = MO.score(MO.load_model(f"{tmp_dir}/m", spark), test)
    want = {r.row_id: r.probabilities for r in scored.collect()}
    for r in again.collect():
        assert r.probabilities == pytest.approx(want[r.row_id], abs=1e-12) and sum(r.probabilities) == pytest.approx(1)
    assert MO.model_importance(model, test).count() == len(FE.feature_names(model.prep, test))


def test_fold_preprocessors_equal_one_fit_a_fold(spark, frame):
    folds = SP.stratified_folds(frame, 3).withColumn("c", F.when(F.col("row_id") == 1, "only once").otherwise(F.col("c"))).cache()
    for f, prep in enumerate(FE.fold_preprocessors(folds, 3, NUM, CAT)):
        own = FE.preprocessor(NUM, CAT).fit(folds.where(F.col("fold") != f))
        assert FE.feature_names(prep, folds) == FE.feature_names(own, folds)
        got = {r.row_id: r.features.toArray() for r in prep.transform(folds).collect()}
        for r in own.transform(folds).collect():
            assert np.allclose(got[r.row_id], r.features.toArray(), atol=1e-9)
    folds.unpersist()


def test_points_equal_fits_by_hand(spark, frame):
    points = [{"max_iter": 3, "max_depth": 2}, {"max_iter": 6, "max_depth": 2}]
    folds = SP.stratified_folds(frame, 2).cache()
    got = RE.judged_points(RE.fold_rows(folds, 2, NUM, CAT), 2, "hist_gradient_boosting_balanced", points, 3)
    per = {(r.point, r.fold): r.f1_macro for r in ME.overall(ME.confusion(got, by=["point", "fold"]), by=["point", "fold"]).collect()}
    for (p, point), f in itertools.product(enumerate(points), range(2)):
        m = MO.fit_model("hist_gradient_boosting_balanced", folds.where(F.col("fold") != f), NUM, CAT, NAMES, point)
        want = ME.overall(ME.confusion(MO.score(m, folds.where(F.col("fold") == f)))).first()["f1_macro"]
        assert per[p, f] == pytest.approx(want)
    folds.unpersist()


def test_large_folds_take_the_distributed_way(spark, frame, monkeypatch):
    folds = SP.stratified_folds(frame.where("row_id < 200"), 2).cache()
    x = RE.fold_rows(folds, 2, NUM, CAT)
    points = [{"max_iter": 1}, {"max_iter": 2}]
    near = RE.judged_points(x, 2, "hist_gradient_boosting_balanced", points, 3).collect()
    monkeypatch.setattr(TR, "LOCAL_ROWS", 10)
    far = RE.judged_points(x, 2, "hist_gradient_boosting_balanced", points, 3).collect()
    assert sorted(near) == sorted(far)
    folds.unpersist()


def test_held_rows_of_large_folds_stay_out_of_the_tasks_that_grow_trees(spark, frame, monkeypatch):
    folds = SP.stratified_folds(frame.where("row_id < 200"), 2).cache()
    x = RE.fold_rows(folds, 2, NUM, CAT)
    points = [{"num_trees": 12, "max_depth": 2}, {"num_trees": 5}]
    near = RE.judged_points(x, 2, "random_forest", points, 3).collect()
    monkeypatch.setattr(TR, "LOCAL_ROWS", 10)
    seen, drawn = [], TR._drawn
    monkeypatch.setattr(TR, "_drawn", lambda *args: seen.append(args[-1]) or drawn(*args))
    far = RE.judged_points(x, 2, "random_forest", points, 3).collect()
    assert seen == [False, False] and len(near) == len(far) == 400

    def plain(rows):
        return sorted((r.point, r.fold, r.label, r.prediction, round(r.score, 9)) for r in rows)

    assert plain(near) == plain(far)
    folds.unpersist()


def test_sigmoids_equal_a_logistic_regression(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(400):
        p = rng.dirichlet([1, 2, 1])
        rows.append((int(rng.choice(3, p=p**0.5 / (p**0.5).sum())), [float(v) for v in p]))
    df = spark.createDataFrame(rows, "label int, probabilities array<double>").cache()
    got = MO.platt(df, 3)
    for k in range(3):
        pos = sum(y == k for y, _ in rows)
        hi, lo = (pos + 1.0) / (pos + 2.0), 1.0 / (len(rows) - pos + 2.0)
        two = [(t, (hi if y == k else lo) if t else 1 - (hi if y == k else lo), p[k]) for y, p in rows for t in (1.0, 0.0)]
        x = spark.createDataFrame(two, "label double, w double, p double").select("label", "w", array_to_vector(F.array("p")).alias("features"))
        lr = LogisticRegression(weightCol="w", regParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(x)
        assert got[k] == pytest.approx((lr.coefficients[0], lr.intercept), rel=1e-5, abs=1e-5)
    assert MO.platt(df.limit(0), 3) == [(1.0, 0.0)] * 3
    one = spark.createDataFrame([(0, [0.9, 0.1])] * 5, "label int, probabilities array<double>")
    assert all(np.isfinite(v) for c in MO.platt(one, 2) for v in c)  # a class without rows, one distinct score


def test_donors_are_permutations(spark):
    df = spark.createDataFrame([(i, float(i) * 1.5) for i in range(300)], "row_id long, b double")
    rows = RE.donors(df, repeats=2, seed=7, bucket_rows=50).collect()
    for repeat in (0, 1):
        mine = [r for r in rows if r.perm_repeat == repeat]
        assert sorted(r.own.row_id for r in mine) == sorted(r.other.row_id for r in mine) == list(range(300))
        assert sum(r.own.row_id != r.other.row_id for r in mine) > 250
    assert len(rows) == 600 and [r for r in rows if r.perm_repeat == 0] != [r for r in rows if r.perm_repeat == 1]


@pytest.mark.parametrize("name", ["logistic_regression", "random_forest"])
def test_permutation_importance_equals_permuted_tables(spark, frame, name):
    model = MO.fit_model(name, frame, NUM, CAT, NAMES, {"num_trees": 10} if name == "random_forest" else None)
    test = frame.where("row_id % 3 = 0").cache()
    got = {r.feature: r for r in RE.permutation_importance(model, test, repeats=2).collect()}
    base = ME.overall(ME.confusion(MO.score(model, test))).first()["f1_macro"]
    other = {(r.perm_repeat, r.own.row_id): r.other.row_id for r in RE.donors(test.select("row_id"), 2).collect()}
    rows = {r.row_id: r.asDict() for r in test.collect()}
    for feature in NUM + CAT:
        drops = []
        for repeat in range(2):
            mixed = [{**r, feature: rows[other[repeat, i]][feature]} for i, r in rows.items()]
            told = MO.score(model, spark.createDataFrame(mixed, test.schema))
            drops.append(base - ME.overall(ME.confusion(told)).first()["f1_macro"])
        assert got[feature].importance_mean == pytest.approx(np.mean(drops), abs=1e-9)
        assert got[feature].importance_std == pytest.approx(np.std(drops), abs=1e-9)
    assert got["a"].importance_mean > 0.05 and got["none"].importance_mean == 0 and got["a"].rows == test.count()
    assert RE.permutation_importance(model, test, ["a"], repeats=1, max_rows=50).first().rows == 50
    test.unpersist()


def _walked(e: TR.Ensemble, tree: int, row, depth: int | None = None) -> int:
    x = e.roots[tree]
    while e.feature[x] >= 0 and depth != 0:
        x = int(e.left[x] if row[e.feature[x]] <= (e.cut[x] if row.dtype == np.uint8 else e.threshold[x]) else e.right[x])
        depth = None if depth is None else depth - 1
    return x


def test_leaves_of_small_and_deep_trees_equal_a_plain_walk():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, [256, 9, 2, 40], (700, 4)).astype(np.uint8)
    label = (codes[:, 0].astype(int) * 7 + codes[:, 1] * 5 + rng.integers(0, 60, 700)) // 40 % 3
    edges = [np.arange(256)[: n - 1] + 0.5 for n in (256, 9, 2, 40)]
    *_, boosted = TR.boost_rows(codes, label, np.arange(700), np.array([256, 9, 2, 40]), 3, TR.Boosting(rounds=3, early_stop=False, min_leaf=2))
    forest = TR.Ensemble(3)
    forest.add([TR.forest_tree(codes, label, np.ones(700, np.int64), 3, t, TR.Forest(trees=2, min_leaf=1)) for t in range(2)], [-1, -1])
    assert (forest.feature < 0).sum() > 2 * TR.MASKED  # both ways of finding leaves are taken
    values = codes + rng.choice([0.0, 0.5, np.nan, np.inf, -np.inf], codes.shape, p=[0.5, 0.2, 0.1, 0.1, 0.1])
    for e in (boosted, forest):
        e.with_thresholds(edges)
        for t in range(len(e.roots)):
            assert e.leaves(codes, t).tolist() == [_walked(e, t, r) for r in codes]
            assert e.leaves(values, t, limits=True).tolist() == [_walked(e, t, r) for r in values]
            assert e.leaves(codes, t, depth=2).tolist() == [_walked(e, t, r, 2) for r in codes]
        assert not any(k.startswith("_") for k in e.__getstate__())


def test_saplings_open_leaves_under_opened_ones_too():
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 200, (6000, 6)).astype(np.uint8)
    label = ((codes[:, 0] > 90).astype(int) + (codes[:, 1] * codes[:, 2].astype(int) > 9000)) % 3
    calls = [0]

    def together(own):
        calls[0] += 1
        return own

    *_, whole = TR.boost_rows(codes, label, np.arange(6000), np.full(6, 200), 3, TR.Boosting(rounds=5, early_stop=False), together)
    assert len(whole.roots) == 15
    assert calls[0] <= 60  # 82 where a step opens the best closed leaf and its rivals alone


def test_permutation_scores_only_rows_that_get_another_value(spark, monkeypatch):
    from caliper.plans import catalog
    model = catalog._given_model()
    seen = spark.sparkContext.accumulator(0)
    plain = MO.shares_of(model.clf)

    def counted(x):
        seen.add(len(x))
        return plain(x)

    monkeypatch.setattr(MO, "shares_of", lambda clf: counted)
    # one value of number_of_vehicles in all rows, two of hour, another mean_temp in each row
    rows = [(i, i % 3, 2.0, float(6 + 12 * (i % 2)), float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, label int, number_of_vehicles double, hour double, mean_temp double")
    got = {r["feature"]: r for r in RE.permutation_importance(model, df, repeats=2).collect()}
    assert got["number_of_vehicles"]["importance_mean"] == 0 and got["mean_temp"]["rows"] == 200
    assert 2 * 200 < seen.value < 2 * 200 * 3  # all once a repeat, then those that get another value


def _grove(spark, monkeypatch, codes, label, key, how, held=None, **limits):
    for name, value in limits.items():
        monkeypatch.setattr(TR, name, value)
    held = np.zeros(len(label), bool) if held is None else held
    import pandas as pd
    table = spark.createDataFrame(pd.DataFrame({"fit": 0, "held": held, "row": key, "label": label, "codes": [bytes(c) for c in codes]}),
                                  "fit int, held boolean, row long, label int, codes binary").repartition(3)
    return TR.planted(table, [np.arange(255) + 0.5] * codes.shape[1], 3, how, 0, int((~held).sum()))


def test_forests_draw_from_all_rows_however_they_are_grown(spark, monkeypatch):
    codes, label, key = sample(45_000, 11, levels=30)
    label = np.where(np.random.default_rng(1).random(45_000) < 0.2, key % 3, label)
    how = TR.Forest(trees=12)
    order = np.lexsort((label, key))
    own = TR.Ensemble(3)
    for t in range(12):
        drawn = TR.bootstrap(key[order], t, 1.0, how.seed)
        assert (drawn > 0).sum() > TR.NODE_ROWS  # some nodes are split by counts
        own.add([TR.forest_tree(codes[order], label[order], drawn, 3, t, how)], [-1])
    near = _grove(spark, monkeypatch, codes, label, key, how)
    far = _grove(spark, monkeypatch, codes, label, key, how, TREE_ROWS=1000, PART_ROWS=TR.NODE_ROWS)
    assert {part for _, part, *_ in near._read()} == {0} and max(part for _, part, *_ in far._read()) > 1
    points = [(12, None), (7, None), (12, 3), (3, 9)]
    for grove in (near, far):
        for (n, depth), sums in zip(points, grove.sums(codes[:3000], points)):
            assert np.array_equal(sums, own.scores(codes[:3000], trees=range(n), depth=depth))
        assert np.allclose(grove.importances(4), own.importances(4), atol=1e-12)
        values = codes[:50].astype(float)
        values[::7, 0] = np.nan
        assert np.allclose(grove.probabilities(values), own.scores(np.where(np.isnan(values), 255, values).astype(np.uint8)) / 12)


def test_splits_by_counts_equal_splits_by_sorted_rows(monkeypatch):
    codes, label, key = sample(3000, 3, levels=200)
    drawn = TR.bootstrap(key, 5, 1.0, 42)
    whole = TR.Ensemble(3)
    whole.add([TR.forest_tree(codes, label, drawn, 3, 5, TR.Forest(min_leaf=5))], [-1])
    monkeypatch.setattr(TR, "NODE_ROWS", 100)
    parts = TR.Ensemble(3)
    parts.add([TR.forest_tree(codes, label, drawn, 3, 5, TR.Forest(min_leaf=5))], [-1])
    assert len(parts.feature) > 100
    assert (np.abs(whole.scores(codes) - parts.scores(codes)).max(1) < 1e-9).mean() > 0.95  # splits of equal gain may part


def test_stored_forests_stay_out_of_the_driver(spark, frame, monkeypatch, tmp_dir):
    train = frame.where("row_id % 5 != 0")
    model = MO.fit_model("random_forest", train, NUM, CAT, NAMES, {"num_trees": 25})
    monkeypatch.setattr(TR, "merged", None)  # nothing brings trees together
    monkeypatch.setattr(TR.Grove, "_read", None)  # and the driver reads none
    MO.save_model(model, f"{tmp_dir}/m", spark)
    again = MO.load_model(f"{tmp_dir}/m", spark)
    assert np.array_equal(again.clf.featureImportances, model.clf.featureImportances) and model.clf.featureImportances.sum() == pytest.approx(1)


def test_a_forest_saved_over_another_is_the_one_that_scores(spark, monkeypatch, tmp_dir):
    codes, label, key = sample(300, 12)
    values, seen = codes.astype(float), []
    for y in (label, (label + 1) % 3):
        grove = _grove(spark, monkeypatch, codes, y, key, TR.Forest(trees=3))
        grove.save(f"{tmp_dir}/m", spark)
        again = TR.Grove(f"{tmp_dir}/m", 3, 3, grove.edges)
        assert np.array_equal(again.probabilities(values), grove.probabilities(values))
        seen.append(again.probabilities(values))
    assert not np.array_equal(*seen)
