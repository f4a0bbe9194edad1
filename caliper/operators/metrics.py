"""Evaluation metrics on a scored frame.

Everything derives from small aggregates:

* the confusion matrix (≤ K² rows per group) gives the per-class report, accuracy,
  balanced accuracy, macro-F1 and one-vs-rest metrics;
* average precision uses a bucketed prefix sum over distinct scores (no global sort
  of the scored rows, no single-partition window over fact-size data);
* the threshold sweep is one pass of conditional sums (no cross join with the grid);
* calibration bins come from exact quantile edges attached as a scalar subquery.

Every operator takes ``by`` so models, folds or permutation repeats are evaluated in
one job.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliper.functions.columns import label_of
from caliper.operators.common import attach



def _safe_div(a: Column, b: Column) -> Column:
    """a / b with 0 when b == 0 (zero_division = 0)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def _attach(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    return attach(df, small, by)


def _join_rows(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Combine two one-row-per-group frames."""
    return a.join(b, list(by)) if by else attach(a, b)


# ------------------------------------------------------------------ confusion-matrix family

def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction",
              by: Sequence[str] = ()) -> DataFrame:
    """``(by…, label, prediction, n)`` — at most K² rows per group."""
    return df.groupBy(*by, label, prediction).agg(F.count(F.lit(1)).alias("n"))


def per_class(cm: DataFrame, label: str = "label", prediction: str = "prediction",
              by: Sequence[str] = ()) -> DataFrame:
    """Per class of the union of true and predicted labels: tp, support, predicted,
    precision, recall, f1 (zero division -> 0)."""
    truth = cm.groupBy(*by, F.col(label).alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)).alias("tp"))
    pred = cm.groupBy(*by, F.col(prediction).alias("cls")).agg(F.sum("n").alias("predicted"))
    j = truth.join(pred, [*by, "cls"], "full_outer").fillna(0, ["support", "tp", "predicted"])
    return j.select(*by, "cls", "tp", "support", "predicted",
                    _safe_div(F.col("tp"), F.col("predicted")).alias("precision"),
                    _safe_div(F.col("tp"), F.col("support")).alias("recall"),
                    _safe_div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def class_report(cm: DataFrame, label: str = "label", prediction: str = "prediction",
                 by: Sequence[str] = ()) -> DataFrame:
    """Per-class precision / recall / f1 / support plus ``macro avg`` and
    ``weighted avg`` rows; ``class`` is text."""
    pc = per_class(cm, label, prediction, by)
    rows = pc.select(*by, F.col("cls").cast("string").alias("class"), "precision", "recall", "f1",
                     F.col("support").cast("bigint").alias("support"))
    tot = F.sum("support")
    macro = pc.groupBy(*by).agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                                F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                                tot.cast("bigint").alias("support"))
    wavg = lambda c: _safe_div(F.sum(F.col(c) * F.col("support")), tot)
    weighted = pc.groupBy(*by).agg(F.lit("weighted avg").alias("class"), wavg("precision").alias("precision"),
                                   wavg("recall").alias("recall"), wavg("f1").alias("f1"),
                                   tot.cast("bigint").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def overall(cm: DataFrame, label: str = "label", prediction: str = "prediction",
            by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy (mean recall over classes present in the truth)
    and macro-F1 (mean over the union of labels)."""
    pc = per_class(cm, label, prediction, by)
    return pc.groupBy(*by).agg(
        _safe_div(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("f1_macro"))


def one_vs_rest(cm: DataFrame, positive: int, label: str = "label", prediction: str = "prediction",
                by: Sequence[str] = (), prefix: str = "fatal") -> DataFrame:
    """Binary precision / recall / f1 of one class against the rest."""
    t = F.col(label) == positive
    p = F.col(prediction) == positive
    agg = cm.groupBy(*by).agg(F.sum(F.when(t & p, F.col("n")).otherwise(0)).alias("tp"),
                              F.sum(F.when(t, F.col("n")).otherwise(0)).alias("support"),
                              F.sum(F.when(p, F.col("n")).otherwise(0)).alias("predicted"))
    return agg.select(*by, _safe_div(F.col("tp"), F.col("predicted")).alias(f"{prefix}_precision"),
                      _safe_div(F.col("tp"), F.col("support")).alias(f"{prefix}_recall"),
                      _safe_div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias(f"{prefix}_f1"))


# ------------------------------------------------------------------ ranking metrics

def average_precision(df: DataFrame, positive: int, label: str = "label", score: str = "score",
                      by: Sequence[str] = (), name: str = "fatal_pr_auc") -> DataFrame:
    """Σ (Rᵢ − Rᵢ₋₁)·Pᵢ over distinct scores in decreasing order; 0 without positives.

    Rows collapse to one row per distinct score (partial aggregation); the cumulative
    counts come from balanced score ranges (``ordered_sums``), wherever scores cluster."""
    from caliper.operators.quantiles import ordered_sums
    y = (F.col(label) == positive).cast("long")
    per_score = df.groupBy(*by, F.col(score).cast("double").alias("__s")).agg(
        F.sum(y).alias("tp"), F.count(F.lit(1)).alias("n"))
    j = ordered_sums(per_score, "__s", ["tp", "n"], by, descending=True)
    precision = (F.col("tp_before") + F.col("tp")).cast("double") / (F.col("n_before") + F.col("n"))
    term = F.when(F.col("tp_total") > 0, F.col("tp").cast("double") / F.col("tp_total") * precision).otherwise(0.0)
    return j.groupBy(*by).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias(name))


def default_thresholds() -> list[float]:
    """19 cut-offs 0.05 … 0.95 as the exact doubles of an evenly spaced grid."""
    return [float(x) for x in np.linspace(0.05, 0.95, 19)]


def threshold_sweep(df: DataFrame, positive: int, label: str = "label", score: str = "score",
                    thresholds: Sequence[float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, f1, fpr, positive rate and tp/fp/fn/tn per cut-off
    (predicted positive when ``score >= t``; compared with the exact doubles, rounded
    to 2 places only for output).

    One aggregate of conditional sums per threshold, then one generator row per
    threshold — no cross join with the grid."""
    th = list(thresholds) if thresholds is not None else default_thresholds()
    y = F.col(label) == positive
    s = F.col(score).cast("double")
    aggs = [F.count_if(y).alias("P"), F.count(F.lit(1)).alias("N")]
    for i, t in enumerate(th):
        hit = s >= F.lit(float(t))
        aggs += [F.count_if(y & hit).alias(f"tp{i}"), F.count_if(hit).alias(f"pp{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(t)).alias("t"),
                                        F.col(f"tp{i}").alias("tp"), F.col(f"pp{i}").alias("pp"))
                               for i, t in enumerate(th)])).alias("r")
    x = wide.select(*by, "P", "N", rows)
    tp, pp, P, N = F.col("r.tp"), F.col("r.pp"), F.col("P"), F.col("N")
    fp, fn = pp - tp, P - tp
    tn = N - P - fp
    return x.select(
        *by, F.round(F.col("r.t"), 2).alias("threshold"),
        _safe_div(tp, pp).alias("precision"), _safe_div(tp, P).alias("recall"),
        _safe_div(2 * tp, P + pp).alias("f1"),
        (fp.cast("double") / F.greatest(F.lit(1), fp + tn)).alias("false_positive_rate"),
        _safe_div(pp, N).alias("predicted_positive_rate"),
        tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"), fn.cast("bigint").alias("fn"),
        tn.cast("bigint").alias("tn"))


def pick_threshold(sweep: DataFrame, max_fpr: float = 0.2, by: Sequence[str] = ()) -> DataFrame:
    """T4: among rows with fpr ≤ max (all rows when none qualifies) take the highest
    recall, then precision, then the lowest threshold."""
    eligible = (F.col("false_positive_rate") <= F.lit(float(max_fpr))).cast("int")
    w = Window.partitionBy(*by).orderBy(F.desc("__e"), F.desc("recall"), F.desc("precision"), F.asc("threshold"))
    return (sweep.withColumn("__e", eligible).withColumn("__r", F.row_number().over(w))
            .filter(F.col("__r") == 1).drop("__e", "__r")
            .withColumn("selection_rule", F.lit(f"max recall with false_positive_rate <= {max_fpr}")))


# ------------------------------------------------------------------ calibration

def _fractions(q: int) -> list[float]:
    return [float(x) for x in np.linspace(0, 1, q + 1)]


def calibration_bins(df: DataFrame, positive: int, label: str = "label", score: str = "score",
                     max_bins: int = 10, by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """Quantile bins of the score (q = min(max_bins, distinct scores); linear
    interpolated edges; duplicate edges dropped; right-closed, first bin includes its
    lower edge; empty bins never appear).  ``bin, lo, hi, count, mean_predicted_probability,
    observed_rate, abs_gap``.

    Edges are exact order statistics over the union of every candidate grid (so q needs
    no extra job), from ``exact_quantiles`` (balanced value ranges, no single-task
    value map); ``accuracy`` switches to ``percentile_approx``."""
    s = F.col(score).cast("double")
    fr = sorted({f for q in range(1, max_bins + 1) for f in _fractions(q)})
    idx = {f: i for i, f in enumerate(fr)}
    nd = df.groupBy(*by).agg(F.count_distinct(s).alias("__nd"))
    if accuracy:
        pv = df.groupBy(*by).agg(F.percentile_approx(s, fr, accuracy).alias("__pv"))
    else:
        from caliper.operators.quantiles import exact_quantile_array
        pv = exact_quantile_array(df, score, fr, by).withColumnRenamed("values", "__pv")
    stats = pv.join(nd, list(by)) if by else attach(pv, nd)
    q = F.least(F.lit(max_bins), F.col("__nd"))
    pick = None
    for qq in range(1, max_bins + 1):
        arr = F.array(*[F.col("__pv")[idx[f]] for f in _fractions(qq)])
        pick = F.when(q == qq, arr) if pick is None else pick.when(q == qq, arr)
    edges = stats.select(*by, F.array_distinct(pick).alias("__edges"), F.col("__nd"))
    j = _attach(df.select(*by, s.alias("__p"), (F.col(label) == positive).cast("double").alias("__y")), edges, by)
    nb = F.size(F.filter(F.col("__edges"), lambda e: e < F.col("__p")))
    binned = j.withColumn("bin", F.when(F.col("__nd") <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), nb)))
    g = binned.groupBy(*by, "bin").agg(
        F.first("__edges").alias("__edges"), F.count(F.lit(1)).alias("count"),
        F.avg("__p").alias("mean_predicted_probability"), F.avg("__y").alias("observed_rate"),
        F.min("__p").alias("__minp"), F.max("__p").alias("__maxp"), F.max("__nd").alias("__nd"))
    single = F.col("__nd") <= 1
    return g.select(*by, "bin",
                    F.when(single, F.col("__minp")).otherwise(F.col("__edges")[F.col("bin") - 1]).alias("lo"),
                    F.when(single, F.col("__maxp")).otherwise(F.col("__edges")[F.col("bin")]).alias("hi"),
                    "count", "mean_predicted_probability", "observed_rate",
                    F.abs(F.col("mean_predicted_probability") - F.col("observed_rate")).alias("abs_gap"))


def ece_from_bins(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Σ gap·count / Σ count over the bins."""
    return bins.groupBy(*by).agg((F.sum(F.col("abs_gap") * F.col("count")) / F.sum("count"))
                                 .alias("expected_calibration_error"))


def brier(df: DataFrame, positive: int, label: str = "label", score: str = "score",
          by: Sequence[str] = ()) -> DataFrame:
    """Mean squared gap between score and the 0/1 truth."""
    y = (F.col(label) == positive).cast("double")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("sample_count"),
                               F.avg(F.pow(F.col(score).cast("double") - y, 2)).alias("brier_score"))


def ece_brier(df: DataFrame, positive: int, label: str = "label", score: str = "score",
              by: Sequence[str] = (), max_bins: int = 10) -> DataFrame:
    """A21 + A22 in one row per group."""
    bins = calibration_bins(df, positive, label, score, max_bins, by)
    e = ece_from_bins(bins, by)
    b = brier(df, positive, label, score, by)
    return _join_rows(b, e, by)


# ------------------------------------------------------------------ per-model evaluation and selection

def evaluate(df: DataFrame, positive: int, label: str = "label", prediction: str = "prediction",
             score: str | None = "score", by: Sequence[str] = (), prefix: str = "fatal") -> DataFrame:
    """One row per group with accuracy, balanced accuracy, macro-F1, the
    one-vs-rest metrics of ``positive`` and its average precision."""
    cm = confusion(df, label, prediction, by)
    out = overall(cm, label, prediction, by)
    ovr = one_vs_rest(cm, positive, label, prediction, by, prefix)
    out = _join_rows(out, ovr, by)
    if score is not None:
        ap = average_precision(df, positive, label, score, by, name=f"{prefix}_pr_auc")
        out = _join_rows(out, ap, by)
    return out


def compare_models(metrics: DataFrame, model: str = "model_name", prefix: str = "fatal",
                   order: str = "train_order") -> DataFrame:
    """A29 + T1: comparison table ordered by macro-F1, ties in training order (the same
    rule that picks the best model), missing metrics -> 0."""
    cols = ["accuracy", "f1_macro", "balanced_accuracy", f"{prefix}_precision", f"{prefix}_recall", f"{prefix}_pr_auc"]
    tie = [F.asc(order)] if order in metrics.columns else []
    return metrics.orderBy(F.desc(F.coalesce(F.col("f1_macro"), F.lit(0.0))), *tie, F.asc(model)) \
        .select(model, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])


def best_model(metrics: DataFrame, metric: str = "f1_macro", order: str = "train_order",
               model: str = "model_name") -> DataFrame:
    """Strictly best metric; the earliest trained model wins ties."""
    return metrics.orderBy(F.desc(F.coalesce(F.col(metric), F.lit(0.0))), F.asc(order)).limit(1) \
        .select(model, F.col(metric))


def screening_model(metrics: DataFrame, prefix: str = "fatal", order: str = "train_order",
                    model: str = "model_name") -> DataFrame:
    """Highest critical recall, then average precision, then macro-F1 (stable)."""
    keys = [f"{prefix}_recall", f"{prefix}_pr_auc", "f1_macro"]
    return (metrics.orderBy(*[F.desc(F.coalesce(F.col(k), F.lit(0.0))) for k in keys], F.asc(order)).limit(1)
            .select(model, f"{prefix}_recall", f"{prefix}_precision", f"{prefix}_pr_auc", "f1_macro")
            .withColumn("selection_rule", F.lit(f"highest {prefix}_recall, then {prefix}_pr_auc, then macro_f1")))


def error_cases(df: DataFrame, labels: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Misclassified rows with actual / predicted class labels (row-level output;
    keep its partitioning when writing)."""
    return (df.filter(F.col(label) != F.col(prediction))
            .withColumns({"actual_class_index": F.col(label), "predicted_class_index": F.col(prediction),
                          "actual_class_label": label_of(F.col(label), labels),
                          "predicted_class_label": label_of(F.col(prediction), labels)}))
