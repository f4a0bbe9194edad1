"""Balanced classifiers, selection, calibration, scoring and persistence.

* logistic regression: multinomial, class-weighted, sklearn's ``C`` mapped to Spark's
  ``regParam = 1 / (C · Σw)`` with ``standardization=False`` (the preprocessor already
  standardises);
* random forest: trees on bootstrap samples with class weights balanced in each sample;
* boosting: a tree a class and round on the softmax loss, leaf by leaf (``operators/trees``).

Every candidate is evaluated on the same test frame in one grouped metrics job.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.functions.columns import label_of
from caliper.operators import metrics as ME
from caliper.operators import trees as TR
from caliper.operators.features import feature_names, preprocessor, with_class_weights

# fixed values: candidate models, their training order and default hyper-parameters
DEFAULT_PARAMS = {
    "logistic_regression": {"C": 1.0, "max_iter": 1000},
    "random_forest": {"num_trees": 220, "min_leaf": 2, "max_depth": None},
    "hist_gradient_boosting_balanced": {"max_iter": 180, "learning_rate": 0.08, "max_depth": None, "max_leaf_nodes": 31, "min_leaf": 20},
}
# fixed values: grids of the hyper-parameter search (max_depth None: no limit)
PARAM_GRIDS = {
    "logistic_regression": {"C": [0.1, 1.0, 3.0]},
    "random_forest": {"num_trees": [200, 400], "max_depth": [None, 12], "min_leaf": [1, 3]},
    "hist_gradient_boosting_balanced": {"learning_rate": [0.05, 0.1], "max_iter": [150, 300], "max_depth": [None, 8]},
}
MODEL_ORDER = ["logistic_regression", "random_forest", "hist_gradient_boosting_balanced"]


# ------------------------------------------------------------------ tree ensembles as models

class TreeModel:
    """A fitted ensemble that scores a ``features`` vector column."""

    def __init__(self, trees: TR.Ensemble | TR.Grove, width: int):
        self.trees, self.width = trees, width

    def transform(self, df: DataFrame) -> DataFrame:
        return TR.predicted(df, self.trees)

    @property
    def featureImportances(self) -> np.ndarray:
        return self.trees.importances(self.width)

    def save(self, path: str, spark: SparkSession) -> None:
        """A table of nodes and one of the ensemble's trees."""
        import pandas as pd
        t = self.trees
        if isinstance(t, TR.Grove):  # nodes go from table to table
            t.save(f"{path}/nodes", spark)
            whole = json.dumps({"classes": t.classes, "trees": t.trees, "edges": [e.tolist() for e in t.edges], "width": self.width})
            spark.createDataFrame([(whole,)], "trees string").coalesce(1).write.mode("overwrite").json(f"{path}/trees")
            return
        nodes = pd.DataFrame({"node": np.arange(len(t.feature)), "feature": t.feature, "cut": t.cut, "threshold": t.threshold,
                              "left": t.left, "right": t.right, "gain": t.gain, "value": t.value.tolist()})
        spark.createDataFrame(nodes, "node long, feature int, cut int, threshold double, left int, right int, gain double, value array<double>") \
            .write.mode("overwrite").parquet(f"{path}/nodes")
        whole = json.dumps({"classes": t.classes, "roots": t.roots, "of": t.of, "base": None if t.base is None else list(t.base), "width": self.width})
        spark.createDataFrame([(whole,)], "trees string").coalesce(1).write.mode("overwrite").json(f"{path}/trees")

    @classmethod
    def load_from(cls, path: str, spark: SparkSession) -> "TreeModel":
        told = json.loads(spark.read.json(f"{path}/trees").first()["trees"])
        if "edges" in told:
            return cls(TR.Grove(f"{path}/nodes", told["classes"], told["trees"], [np.array(e, np.float64) for e in told["edges"]]), told["width"])
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values("node")
        t = TR.Ensemble(told["classes"], told["roots"], told["of"], None if told["base"] is None else np.array(told["base"]))
        for name in ("feature", "cut", "left", "right", "gain", "threshold"):
            setattr(t, name, nodes[name].to_numpy())
        t.value = np.stack(nodes["value"].to_numpy())
        return cls(t, told["width"])


def shares_of(clf):
    """A function of a (rows, features) array that gives the classifier's class shares."""
    if isinstance(clf, TreeModel):
        return lambda x: clf.trees.probabilities(x, limits=True)
    weights, bias = clf.coefficientMatrix.toArray(), clf.interceptVector.toArray()
    return lambda x: TR.softmax(x @ weights.T + bias)


# ------------------------------------------------------------------ candidates

def build_estimator(params: dict, n_rows: int) -> LogisticRegression:
    """M7 with class weights in column ``weight``."""
    p = {**DEFAULT_PARAMS["logistic_regression"], **(params or {})}
    return LogisticRegression(family="multinomial", weightCol="weight", maxIter=int(p["max_iter"]),
                              regParam=1.0 / (float(p["C"]) * max(1, n_rows)), elasticNetParam=0.0,
                              standardization=False, tol=1e-6)


def tree_settings(name: str, params: dict | None, seed: int = 42) -> TR.Boosting | TR.Forest:
    """M8, M9: the settings of a tree candidate; a depth of None is no limit."""
    p = {**DEFAULT_PARAMS[name], **(params or {})}
    depth = None if p["max_depth"] is None else int(p["max_depth"])
    if name == "random_forest":
        return TR.Forest(int(p["num_trees"]), depth, int(p["min_leaf"]), seed=seed)
    if name == "hist_gradient_boosting_balanced":
        return TR.Boosting(int(p["max_iter"]), float(p["learning_rate"]), depth, int(p["max_leaf_nodes"]), int(p["min_leaf"]))
    raise ValueError(name)


def fit_trees(x: DataFrame, name: str, params: dict | None, classes: int, seed: int = 42) -> TreeModel:
    """Bins of :func:`assembled` rows, then the ensemble."""
    how = tree_settings(name, params, seed)
    edges = TR.bin_edges(x)
    table = TR.coded(x, edges)
    n = table.count()
    if isinstance(how, TR.Forest):
        return TreeModel(TR.planted(table, edges[0], classes, how, 0, n), len(edges[0]))
    if n <= TR.LOCAL_ROWS:
        trees = TR.merged(TR.boost_groups(table, edges, classes, {0: how}, {0: 0}))[0]
    else:
        trees = TR.boost_table(table, np.array([len(e) + 1 for e in edges[0]]), classes, how)
    return TreeModel(trees.with_thresholds(edges[0]), len(edges[0]))


def assembled(prep: PipelineModel, df: DataFrame, label: str = "label", fit: int = 0, held=False) -> DataFrame:
    """``fit, held, row, label, features`` (array) of preprocessed rows."""
    x = prep.transform(df.withColumns({"__row": TR.row_key(df), "__held": F.lit(held)}))
    return x.select(F.lit(fit).cast("int").alias("fit"), F.col("__held").alias("held"), F.col("__row").alias("row"),
                    F.col(label).cast("int").alias("label"), vector_to_array("features").alias("features"))


@dataclass
class FittedModel:
    """A fitted preprocessor + classifier and everything needed to score later."""
    name: str
    prep: PipelineModel
    clf: object
    numeric: list[str]
    categorical: list[str]
    class_labels: list[str]
    code_map: dict = field(default_factory=lambda: {1: 0, 2: 1, 3: 2})
    params: dict = field(default_factory=dict)
    defaults: dict = field(default_factory=dict)
    info: dict = field(default_factory=dict)  # target, label version, feature mode, screening and calibration records

    @property
    def features(self) -> list[str]:
        return self.numeric + self.categorical

    def transform(self, df: DataFrame) -> DataFrame:
        return self.clf.transform(self.prep.transform(df))


def fit_model(name: str, train: DataFrame, numeric: list[str], categorical: list[str], class_labels: list[str],
              params: dict | None = None, label: str = "label", seed: int = 42, prep: PipelineModel | None = None) -> FittedModel:
    """Fit preprocessor (or take a fitted one) and classifier on ``train``."""
    from caliper.session import cut_lineage
    prep = prep or preprocessor(numeric, categorical).fit(train)
    if name == "logistic_regression":
        x = with_class_weights(prep.transform(train).withColumn(label, F.col(label).cast("int")), label)
        x = x.withColumn("label", F.col(label).cast("double")).select("features", "label", "weight").persist()
        try:
            clf = build_estimator(params or {}, x.count()).fit(x)
        finally:
            x.unpersist()
    else:
        clf = fit_trees(cut_lineage(assembled(prep, train, label)), name, params, len(class_labels), seed)
    return FittedModel(name, prep, clf, list(numeric), list(categorical), list(class_labels), params=params or {})


def score(model: FittedModel, df: DataFrame, positive: int = 0) -> DataFrame:
    """The input columns unchanged, plus class index (int), probabilities (array) and
    the positive-class score.  The original row rides through the preprocessing (which
    rewrites numeric columns in place) inside one struct column."""
    cols = [c for c in df.columns if c not in ("prediction", "probabilities", "score")]
    out = model.transform(df.withColumn("__orig", F.struct(*[F.col(f"`{c}`") for c in cols])))
    return out.select(*[F.col("__orig")[c].alias(c) for c in cols],
                      F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array(F.col("probability")).alias("probabilities")) \
        .withColumn("score", F.col("probabilities")[positive])


def judged(model: FittedModel, df: DataFrame, positive: int = 0) -> DataFrame:
    """``label, prediction, probabilities, score``, written once: metrics read them several times."""
    from caliper.session import cut_lineage
    return cut_lineage(score(model, df, positive).select("label", "prediction", "probabilities", "score"))


def parallel_map(fn, items, parallelism: int = 4):
    """Run independent fits from a small thread pool: Spark schedules concurrent jobs
    from several driver threads (what ``CrossValidator(parallelism=…)`` does)."""
    items = list(items)
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=min(parallelism, len(items))) as pool:
        return list(pool.map(fn, items))


def fit_and_select(train: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str],
                   class_labels: list[str], positive: int = 0, models: list[str] | None = None,
                   params: dict | None = None, metric: str = "f1_macro", seed: int = 42, parallelism: int = 3,
                   grids: dict | None = None, records: list | None = None):
    """M11 + M12: fit every candidate, score the same test rows, evaluate all models in one
    grouped job, pick the best by ``metric`` (T2).  Returns ``(best, metrics, scored)``.

    ``grids`` (model -> parameter grid) switches the hyper-parameter search on: the best
    point of each model's grid is refitted on all training rows.  ``records`` collects one
    search record per model."""
    models = models or MODEL_ORDER
    chosen = {name: dict((params or {}).get(name) or {}) for name in models}
    found = dict.fromkeys(models)
    if grids:
        from caliper.operators import reliability as RE
        shared = RE.search_rows(train, numeric, categorical, seed=seed)
        found = dict(zip(models, parallel_map(lambda name: RE.grid_search(
            train, name, grids.get(name, {}), numeric, categorical, class_labels, seed=seed, base=chosen[name], shared=shared), models, parallelism)))
    for name in models:
        record = {"model_name": name, "search_enabled": bool(grids), "best_params": {}, "best_score_f1_macro": None,
                  "top_trials": []}
        if found[name]:
            best, _, record = found[name]
            chosen[name] |= best
        if records is not None:
            records.append(record)
    prep = preprocessor(numeric, categorical).fit(train)  # the same for all candidates
    fitted = parallel_map(lambda name: fit_model(name, train, numeric, categorical, class_labels, chosen[name],
                                                 seed=seed, prep=prep), models, parallelism)
    scored = None
    for order, (name, m) in enumerate(zip(models, fitted)):
        s = score(m, test, positive).withColumns({"model_name": F.lit(name), "train_order": F.lit(order)})
        scored = s if scored is None else scored.unionByName(s)
    from caliper.session import cut_lineage
    scored = cut_lineage(scored)   # several metric aggregates read it: score each model once
    metrics = cut_lineage(ME.evaluate(scored, positive, by=["model_name", "train_order"]))
    best_name = ME.best_model(metrics, metric).first()["model_name"]
    best = next(m for m in fitted if m.name == best_name)
    return best, metrics, scored


# ------------------------------------------------------------------ calibration

class PlattCalibrated:
    """Per-class sigmoid on the model's class probability, fitted on held-out rows with
    Platt's smoothed targets, then normalised across classes (all-zero -> uniform)."""

    def __init__(self, base: FittedModel, coefs: list[tuple[float, float]]):
        self.base, self.coefs = base, coefs

    def transform(self, df: DataFrame) -> DataFrame:
        s = score(self.base, df)
        k = len(self.coefs)
        cal = [F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.col("probabilities")[i] + F.lit(b))))
               for i, (a, b) in enumerate(self.coefs)]
        total = sum(cal, F.lit(0.0))
        probs = F.array(*[F.when(total > 0, c / total).otherwise(F.lit(1.0 / k)) for c in cal])
        s = s.withColumn("probabilities", probs)
        return s.withColumn("prediction", (F.array_position("probabilities", F.array_max("probabilities")) - 1)
                            .cast("int"))


def platt(scored: DataFrame, classes: int, label: str = "label", probabilities: str = "probabilities",
          steps: int = 100, tolerance: float = 1e-9) -> list[tuple[float, float]]:
    """Slope and intercept of every class's sigmoid by Newton's method: each step sums the
    gradients and curvatures of all classes in one aggregate (and the loss at the point; a
    step that doesn't lower a class's loss is halved).  A class is done when its next step
    is under ``tolerance`` of where it stands."""
    y = F.col(label).cast("int")
    x = scored.select(y.alias("y"), *[F.col(probabilities)[k].cast("double").alias(f"p{k}") for k in range(classes)])
    counts = x.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("y") == k).alias(f"n{k}") for k in range(classes)]).first()
    n = counts["n"]
    targets = [((counts[f"n{k}"] + 1.0) / (counts[f"n{k}"] + 2.0), 1.0 / (n - counts[f"n{k}"] + 2.0)) for k in range(classes)]

    def sums(points: list[tuple[float, float]]) -> list[list[float]]:
        aggs = []
        for k, (a, b) in enumerate(points):
            p = F.col(f"p{k}")
            z = F.lit(a) * p + F.lit(b)
            q = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
            t = F.when(F.col("y") == k, F.lit(targets[k][0])).otherwise(F.lit(targets[k][1]))
            loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - t * z
            w = q * (F.lit(1.0) - q)
            aggs += [F.sum(v).alias(f"s{k}_{i}") for i, v in enumerate((loss, (q - t) * p, q - t, w * p * p, w * p, w))]
        row = x.agg(*aggs).first()
        return [[row[f"s{k}_{i}"] for i in range(6)] for k in range(classes)]

    if not n:
        return [(1.0, 0.0)] * classes
    here = [(0.0, float(np.log((targets[k][0] * counts[f"n{k}"] + targets[k][1] * (n - counts[f"n{k}"])) / max(1e-12, n - targets[k][0] * counts[f"n{k}"] - targets[k][1] * (n - counts[f"n{k}"]))))) for k in range(classes)]
    known = sums(here)
    move = [1.0] * classes
    for _ in range(steps):
        trial = list(here)
        for k, (_, ga, gb, haa, hab, hbb) in enumerate(known):
            ridge = 1e-13 * max(haa, hbb, 1e-12)
            det = (haa + ridge) * (hbb + ridge) - hab * hab
            da, db = ((hbb + ridge) * ga - hab * gb) / det, ((haa + ridge) * gb - hab * ga) / det
            if abs(da) + abs(db) > tolerance * (1 + abs(here[k][0]) + abs(here[k][1])):
                trial[k] = (here[k][0] - move[k] * da, here[k][1] - move[k] * db)
        if trial == here:
            break
        found = sums(trial)
        for k in range(classes):
            if found[k][0] <= known[k][0] + 1e-11 * abs(known[k][0]):  # sums are good to that
                here[k], known[k], move[k] = trial[k], found[k], 1.0
            else:
                move[k] /= 2
        if all(m < 1e-8 for m, point, old in zip(move, trial, here) if point != old) and trial != here:
            break
    return here


def calibrate(base: FittedModel, cal: DataFrame, label: str = "label") -> PlattCalibrated:
    """Sigmoids fitted on rows that the model hasn't seen."""
    from caliper.session import cut_lineage
    scored = cut_lineage(score(base, cal).select(F.col(label).alias("label"), "probabilities"))
    return PlattCalibrated(base, platt(scored, len(base.class_labels)))


# ------------------------------------------------------------------ importances, scoring, persistence

def model_importance(model: FittedModel, df: DataFrame) -> DataFrame:
    """Tree importances, or the mean |coefficient| across classes; zeros when the
    classifier offers neither.  Sorted descending (T6 takes the head)."""
    names = feature_names(model.prep, df)
    clf = model.clf
    if isinstance(clf, LogisticRegressionModel):
        imp, method = np.abs(clf.coefficientMatrix.toArray()).mean(axis=0), "avg_abs_coef"
    elif isinstance(clf, TreeModel):
        imp, method = clf.featureImportances, "tree_importance"
    else:
        imp, method = np.zeros(len(names)), "not_available"
    if len(names) != len(imp):
        names = [f"feature_{i}" for i in range(len(imp))]
    spark = df.sparkSession
    rows = [(n, float(v), method) for n, v in zip(names, imp)]
    return spark.createDataFrame(rows, "feature string, importance double, method string") \
        .orderBy(F.desc("importance"), F.asc("feature"))


def batch_score(model: FittedModel, df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """M14 + P16: fill absent feature columns with stored defaults, then class index,
    label, source code (inverse of the code map) and probabilities per row."""
    from caliper.operators.features import fill_defaults
    x = fill_defaults(df, model.features, defaults or model.defaults)
    s = score(model, x)
    inv = {int(v): int(k) for k, v in model.code_map.items()}
    code = F.create_map(*[t for k, v in sorted(inv.items()) for t in (F.lit(k), F.lit(v))])
    return s.withColumns({"predicted_class_index": F.col("prediction"),
                          "predicted_class_label": label_of(F.col("prediction"), model.class_labels),
                          "predicted_code": code[F.col("prediction")]})


def save_model(model: FittedModel, path: str, spark: SparkSession) -> None:
    """Preprocessor and classifier through Spark ML persistence, plus a one-row
    metadata table (feature lists, defaults, labels, code map)."""
    model.prep.write().overwrite().save(f"{path}/preprocessor")
    if isinstance(model.clf, TreeModel):
        model.clf.save(f"{path}/classifier", spark)
    else:
        model.clf.write().overwrite().save(f"{path}/classifier")
    meta = {"name": model.name, "numeric": model.numeric, "categorical": model.categorical,
            "class_labels": model.class_labels, "code_map": {str(k): v for k, v in model.code_map.items()},
            "params": model.params, "defaults": model.defaults, "info": model.info}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(path: str, spark: SparkSession) -> FittedModel:
    meta = json.loads(spark.read.json(f"{path}/metadata").first()["meta"])
    prep = PipelineModel.load(f"{path}/preprocessor")
    name = meta["name"]
    if name == "logistic_regression":
        clf = LogisticRegressionModel.load(f"{path}/classifier")
    else:
        clf = TreeModel.load_from(f"{path}/classifier", spark)
    return FittedModel(name, prep, clf, meta["numeric"], meta["categorical"], meta["class_labels"],
                       {int(k): v for k, v in meta["code_map"].items()}, meta["params"], meta["defaults"],
                       meta.get("info", {}))
