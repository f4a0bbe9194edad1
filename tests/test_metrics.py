import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caliper.operators import metrics as ME

# published confusion matrix of the reference run (rows = truth, columns = prediction)
PUBLISHED_CM = [[207, 527, 764], [1263, 6308, 14424], [2618, 15205, 59379]]


def _cm_frame(spark, cm):
    return spark.createDataFrame([(i, j, n) for i, row in enumerate(cm) for j, n in enumerate(row)],
                                 "label int, prediction int, n long")


def test_published_confusion_matrix_reproduces_published_metrics(spark):
    cm = _cm_frame(spark, PUBLISHED_CM)
    o = ME.overall(cm).first()
    assert o.accuracy == pytest.approx(0.6543919757684096, abs=1e-12)
    assert o.f1_macro == pytest.approx(0.381035014927215, abs=1e-12)
    assert o.balanced_accuracy == pytest.approx(0.3980382679071681, abs=1e-12)
    rep = {r["class"]: r for r in ME.class_report(cm).collect()}
    assert rep["0"].precision == pytest.approx(0.05063600782778865)
    assert rep["2"].f1 == pytest.approx(0.7824918132161377)
    assert rep["weighted avg"].f1 == pytest.approx(0.6636129826143758)
    assert rep["macro avg"].support == 100695
    ovr = ME.one_vs_rest(cm, 0).first()
    assert ovr.fatal_recall == pytest.approx(0.13818424566088117)


# published threshold sweep counts (threshold, tp, fp, fn, tn)
SWEEP = [(0.05, 1260, 53978, 238, 45219), (0.1, 1017, 32373, 481, 66824), (0.15, 772, 21207, 726, 77990),
         (0.2, 621, 14804, 877, 84393), (0.25, 504, 10765, 994, 88432), (0.3, 382, 7335, 1116, 91862),
         (0.35, 249, 4692, 1249, 94505), (0.4, 166, 3025, 1332, 96172), (0.45, 122, 1997, 1376, 97200),
         (0.5, 78, 1293, 1420, 97904), (0.55, 51, 736, 1447, 98461), (0.6, 27, 363, 1471, 98834),
         (0.65, 14, 146, 1484, 99051), (0.7, 5, 44, 1493, 99153), (0.75, 0, 13, 1498, 99184),
         (0.8, 0, 2, 1498, 99195), (0.85, 0, 0, 1498, 99197), (0.9, 0, 0, 1498, 99197), (0.95, 0, 0, 1498, 99197)]


def test_published_sweep_picks_published_threshold(spark):
    rows = []
    for t, tp, fp, fn, tn in SWEEP:
        prec = tp / (tp + fp) if tp + fp else 0.0
        rows.append((t, prec, tp / (tp + fn), fp / max(1, fp + tn)))
    sweep = spark.createDataFrame(rows, "threshold double, precision double, recall double, false_positive_rate double")
    assert ME.pick_threshold(sweep, 0.2).first().threshold == 0.2
    # no eligible row -> falls back to all rows
    assert ME.pick_threshold(sweep, -1.0).first().threshold == 0.05


# published calibration bins (count, abs_gap)
BINS = [(10070, 0.0018559822934126006), (10069, 0.009319393935801721), (10070, 0.01821715828264759),
        (10069, 0.02798362467587213), (10070, 0.04035260162726938), (10069, 0.058077201414557834),
        (10069, 0.07980049687812822), (10070, 0.11238696659091932), (10070, 0.1800741445700134),
        (10069, 0.33183259940684096)]


def test_published_bins_give_published_ece(spark):
    bins = spark.createDataFrame(BINS, "count long, abs_gap double")
    assert ME.ece_from_bins(bins).first().expected_calibration_error == pytest.approx(0.08598925165415962, abs=1e-12)


def _random_scored(n, seed, ties=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = rnd.choice([0, 1, 2, 2, 2])
        p = round(rnd.random(), 2) if ties else rnd.random()
        if rnd.random() < 0.05:
            p = 0.4  # exactly on a grid threshold
        rows.append((i, y, rnd.choice([0, 1, 2]), p))
    return rows


def _ap_bruteforce(y, p):
    order = sorted(set(p), reverse=True)
    pos = sum(y)
    if pos == 0:
        return 0.0
    ap, prev_r, ctp, cn = 0.0, 0.0, 0, 0
    for s in order:
        idx = [i for i in range(len(p)) if p[i] == s]
        ctp += sum(y[i] for i in idx)
        cn += len(idx)
        r = ctp / pos
        ap += (r - prev_r) * (ctp / cn)
        prev_r = r
    return ap


@pytest.mark.parametrize("ties", [True, False])
def test_average_precision_matches_bruteforce(spark, ties):
    rows = _random_scored(700, 3 if ties else 4, ties)
    df = spark.createDataFrame(rows, "row_id long, label int, prediction int, score double")
    got = ME.average_precision(df, 0).first().fatal_pr_auc
    exp = _ap_bruteforce([1 if r[1] == 0 else 0 for r in rows], [r[3] for r in rows])
    assert got == pytest.approx(exp, abs=1e-12)


def test_average_precision_no_positive_and_groups(spark):
    df = spark.createDataFrame([(1, 0.3, "a"), (2, 0.5, "a"), (0, 0.9, "b"), (1, 0.1, "b")],
                               "label int, score double, g string")
    out = {r.g: r.fatal_pr_auc for r in ME.average_precision(df, 0, by=["g"]).collect()}
    assert out["a"] == 0.0 and out["b"] == pytest.approx(1.0)


def test_threshold_sweep_matches_cross_join_oracle(spark):
    rows = _random_scored(500, 5)
    df = spark.createDataFrame(rows, "row_id long, label int, prediction int, score double")
    got = {r.threshold: r for r in ME.threshold_sweep(df, 0).collect()}
    th = spark.createDataFrame([(t,) for t in ME.default_thresholds()], "t double")
    oracle = (df.crossJoin(th).groupBy("t").agg(
        F.sum(((F.col("label") == 0) & (F.col("score") >= F.col("t"))).cast("int")).alias("tp"),
        F.sum(((F.col("label") != 0) & (F.col("score") >= F.col("t"))).cast("int")).alias("fp")).collect())
    assert len(got) == 19
    for o in oracle:
        g = got[round(o.t, 2)]
        assert (g.tp, g.fp) == (o.tp, o.fp)
        assert g.tp + g.fp + g.fn + g.tn == 500
    # 0.4 is on the grid as 0.39999999999999997, so scores of exactly 0.4 are positive at "0.4"
    assert ME.default_thresholds()[7] < 0.4


def test_calibration_bins_match_pandas_qcut(spark):
    import pandas as pd
    rows = _random_scored(400, 6)
    df = spark.createDataFrame(rows, "row_id long, label int, prediction int, score double")
    got = ME.calibration_bins(df, 0).orderBy("bin").collect()
    pdf = pd.DataFrame({"p": [r[3] for r in rows], "y": [1 if r[1] == 0 else 0 for r in rows]})
    pdf["bin"] = pd.qcut(pdf["p"], q=min(10, pdf["p"].nunique()), duplicates="drop")
    exp = pdf.groupby("bin", observed=True).agg(count=("p", "size"), mp=("p", "mean"), oy=("y", "mean")).reset_index()
    assert [r["count"] for r in got] == list(exp["count"])
    for r, (_, e) in zip(got, exp.iterrows()):
        assert r.mean_predicted_probability == pytest.approx(e.mp)
        assert r.observed_rate == pytest.approx(e.oy)
    eb = ME.ece_brier(df, 0).first()
    y = pdf["y"].to_numpy()
    assert eb.brier_score == pytest.approx(float(np.mean((pdf["p"].to_numpy() - y) ** 2)))


def test_calibration_single_distinct_score(spark):
    df = spark.createDataFrame([(0, 0.3), (1, 0.3), (2, 0.3)], "label int, score double")
    out = ME.calibration_bins(df, 0).collect()
    assert len(out) == 1 and out[0]["count"] == 3 and out[0].observed_rate == pytest.approx(1 / 3)


def test_metrics_with_absent_classes(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (2, 2)], "label int, prediction int")
    cm = ME.confusion(df)
    o = ME.overall(cm).first()
    assert o.accuracy == pytest.approx(0.5)
    # class 0 never predicted: precision 0, recall 0, f1 0 (zero division -> 0)
    rep = {r["class"]: r for r in ME.class_report(cm).collect()}
    assert rep["0"].precision == 0.0 and rep["0"].recall == 0.0
    assert o.balanced_accuracy == pytest.approx((0 + 1 + 1) / 3)
    assert o.f1_macro == pytest.approx((0 + 0.5 + 1) / 3)


def test_model_selection_rules(spark):
    m = spark.createDataFrame([("a", 0, 0.5, 0.2, 0.1, 0.3), ("b", 1, 0.5, 0.9, 0.1, 0.2), ("c", 2, 0.4, 0.9, 0.5, 0.1)],
                              "model_name string, train_order int, f1_macro double, fatal_recall double, "
                              "fatal_pr_auc double, fatal_precision double")
    assert ME.best_model(m).first().model_name == "a"            # tie on metric: first trained wins
    assert ME.screening_model(m).first().model_name == "c"       # recall tie -> higher AP


def test_error_cases_labels(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 2)], "label int, prediction int")
    out = ME.error_cases(df, ["Fatal", "Serious", "Slight"]).orderBy("label").collect()
    assert [(r.actual_class_label, r.predicted_class_label) for r in out] == [("Fatal", "Slight"), ("Serious", "Slight")]
    assert not math.isnan(len(out))


@pytest.mark.parametrize("case", range(4))
def test_exact_quantiles_match_numpy(spark, case):
    from caliper.operators.quantiles import exact_quantiles
    rnd = random.Random(case)
    n = [1, 7, 1000, 3000][case]
    vals = [round(rnd.random(), 3) if case % 2 else rnd.gauss(0, 1) for _ in range(n)]
    if case == 3:
        vals += [0.5] * 2000                     # a third-plus of the rows on one value
    df = spark.createDataFrame([(v, "a" if i % 3 else "b") for i, v in enumerate(vals)], "x double, g string")
    fr = [float(f) for f in np.linspace(0, 1, 11)]
    exp = np.quantile(np.array(vals), fr)
    got = {r.fraction: r.value for r in exact_quantiles(df, "x", fr).collect()}
    for f, e in zip(fr, exp):
        assert got[f] == pytest.approx(e, abs=1e-12)
    med = {r.g: r.value for r in exact_quantiles(df, "x", [0.5], by=["g"]).collect()}
    for g in med:
        sub = [v for i, v in enumerate(vals) if ("a" if i % 3 else "b") == g]
        assert med[g] == pytest.approx(float(np.median(sub)), abs=1e-12)
