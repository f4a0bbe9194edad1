"""Reliability evidence.

All per-fold / per-copy predictions are stacked into one frame keyed by
``(model_name, fold)`` or ``(feature, repeat)`` and evaluated with one grouped metrics
job, instead of one job per fold or per copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caliper.functions.columns import md5_order
from caliper.operators import features as FE
from caliper.operators import metrics as ME
from caliper.operators import models as MO
from caliper.operators import splits as SP
from caliper.operators import trees as TR
from caliper.session import cut_lineage, ship_package


def _stack(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def fold_rows(folds: DataFrame, k: int, numeric: list[str], categorical: list[str]) -> DataFrame:
    """``fit, held, row, label, features``, written once: for each fold all rows as the
    preprocessing of the other folds' rows gives them, ``held`` those of the fold."""
    preps = FE.fold_preprocessors(folds, k, numeric, categorical)
    parts = [MO.assembled(prep, folds, fit=f, held=F.col("fold") == f) for f, prep in enumerate(preps)]
    return cut_lineage(_stack(parts))


def judged_points(x: DataFrame, k: int, name: str, points: list[dict], classes: int, positive: int = 0, seed: int = 42,
                  parallelism: int = 4) -> DataFrame:
    """``point, fold, label, prediction, score`` of every fold's held rows under models of the
    fold's other rows (:func:`fold_rows`), for several settings of one candidate.

    Settings that are prefixes of others share a fit: of boosting, all numbers of rounds are
    read from the longest fit of each (rate, depth); of forests, all numbers of trees and all
    depths from the largest forest of each leaf size.  Fits run side by side."""
    if name == "logistic_regression":
        weighted = {}
        for f in range(k):
            own = MO.with_class_weights(x.where((F.col("fit") == f) & ~F.col("held")))
            own = own.select(MO.array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"), "weight").persist()
            weighted[f] = (own, own.count())

        def scored(job):
            p, f = job
            own, n = weighted[f]
            shares = MO.shares_of(MO.build_estimator(points[p], n).fit(own))
            return held_shares(x.where((F.col("fit") == f) & F.col("held")), shares).withColumns({"point": F.lit(p), "fold": F.lit(f)})

        try:
            found = _stack(MO.parallel_map(scored, [(p, f) for p in range(len(points)) for f in range(k)], parallelism))
            return cut_lineage(_decided(found, positive))
        finally:
            for own, _ in weighted.values():
                own.unpersist()
    edges = TR.bin_edges(x)
    table = TR.coded(x, edges)
    rows = {r["fit"]: r["count"] for r in table.where("not held").groupBy("fit").count().collect()}  # a row a fold
    settings = [MO.tree_settings(name, p, seed) for p in points]
    frames = []
    if name == "random_forest":
        same: dict[tuple, list[int]] = {}
        for i, how in enumerate(settings):
            same.setdefault((how.min_leaf, how.features, how.rows, how.seed), []).append(i)
        for mine in same.values():
            depths = [settings[i].depth for i in mine]
            largest = TR.Forest(max(settings[i].trees for i in mine), None if None in depths else max(depths), *list(same.keys())[list(same.values()).index(mine)])
            asked = sorted({(settings[i].trees, settings[i].depth) for i in mine}, key=str)
            if max(rows.values()) <= TR.LOCAL_ROWS:
                got = TR.forest_groups(table, edges, classes, dict.fromkeys(range(k), largest), {f: f for f in range(k)}, rows, asked)
            else:
                got = _stack([cut_lineage(_planted(table.where(F.col("fit") == f), edges, classes, largest, rows, asked, f)) for f in range(k)])
            share = [(F.sum(F.col("shares")[c]) / F.col("stage")).alias(f"s{c}") for c in range(classes)]
            got = got.groupBy("fit", "stage", "depth", "row", "label").agg(*share)
            got = cut_lineage(got.select("fit", "stage", "depth", "row", "label", F.array(*[f"s{c}" for c in range(classes)]).alias("shares")))
            for i in mine:
                frames.append((i, got.where((F.col("stage") == settings[i].trees) & (F.col("depth") == (settings[i].depth or 0)))))
    else:
        same = {}
        for i, how in enumerate(settings):
            same.setdefault((how.rate, how.depth, how.leaves, how.min_leaf), []).append(i)
        jobs = {g * k + f: (g, f) for g in range(len(same)) for f in range(k)}
        longest = [TR.Boosting(max(settings[i].rounds for i in mine), *key) for key, mine in same.items()]
        stages = sorted({settings[i].rounds for mine in same.values() for i in mine})
        if max(rows.values()) <= TR.LOCAL_ROWS:
            got = cut_lineage(TR.boost_groups(table, edges, classes, {j: longest[g] for j, (g, _) in jobs.items()}, {j: f for j, (_, f) in jobs.items()}, stages))
        else:
            parts = MO.parallel_map(lambda job: _staged(table.where(F.col("fit") == job[1][1]), edges[job[1][1]], classes, longest[job[1][0]], stages, job[0]), jobs.items(), parallelism)
            got = cut_lineage(_stack(parts))
        for g, mine in enumerate(same.values()):
            for i in mine:
                own = got.where((F.floor(F.col("fit") / k) == g) & (F.col("stage") == settings[i].rounds))
                frames.append((i, own.withColumn("fit", F.col("fit") % k)))
    told = [f.select(F.lit(i).alias("point"), F.col("fit").cast("int").alias("fold"), "label", "shares") for i, f in frames]
    return cut_lineage(_decided(_stack(told), positive))


def _staged(rows: DataFrame, edges: list, classes: int, how: TR.Boosting, stages: list[int], job: int) -> DataFrame:
    """One distributed fit, judged after each of several numbers of rounds."""
    whole = TR.boost_table(rows.where("not held").select("row", "label", "codes"), np.array([len(e) + 1 for e in edges]), classes, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for n in stages:
                    raw = whole.scores(codes, trees=range(min(n * classes, len(whole.roots)))) + whole.base
                    yield from TR._judged(job, 0, n, None, batch.column("row").to_numpy(), batch.column("label").to_numpy(), TR.softmax(raw)).to_batches()

    return rows.where("held").mapInArrow(run, TR._JUDGED)


def _planted(table: DataFrame, edges: dict, classes: int, how: TR.Forest, rows: dict[int, int], points: list[tuple[int, int | None]], fit: int) -> DataFrame:
    """One fold's forest, whose held rows are too many for the tasks that grow its trees: they
    are scored where they are read."""
    whole = TR.planted(table, edges[fit], classes, how, fit, rows[fit])
    ship_package(table.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, label, key in TR._blocks(batches):
            for (n, depth), sums in zip(points, whole.sums(codes, points)):
                yield from TR._judged(fit, 0, n, depth, key, label, sums).to_batches(10_000)

    return table.where("held").mapInArrow(run, TR._JUDGED)


def held_shares(x: DataFrame, shares) -> DataFrame:
    """``label, shares`` of rows with a ``features`` array."""
    ship_package(x.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
                found = pa.array(list(shares(values)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("label"), found], ["label", "shares"])

    return x.select("label", "features").mapInArrow(run, "label int, shares array<double>")


def _decided(found: DataFrame, positive: int) -> DataFrame:
    best = (F.array_position("shares", F.array_max("shares")) - 1).cast("int")
    return found.select("point", "fold", "label", best.alias("prediction"), F.col("shares")[positive].alias("score"))


def cv_reliability(df: DataFrame, numeric: list[str], categorical: list[str], class_labels: list[str],
                   positive: int = 0, models: list[str] | None = None, params: dict | None = None,
                   k: int | None = None, seed: int = 42, parallelism: int = 4) -> DataFrame:
    """M18 + A24: stratified K-fold for every candidate; per model the fold mean and
    population std of accuracy, macro-F1 and critical recall, best mean macro-F1 first."""
    models = models or MO.MODEL_ORDER
    k = k or int(SP.min_class_count(df).first()["n_splits"])
    folds = cut_lineage(SP.stratified_folds(df, k, seed=seed))
    x = fold_rows(folds, k, numeric, categorical)
    parts = MO.parallel_map(lambda name: judged_points(x, k, name, [(params or {}).get(name) or {}], len(class_labels), positive, seed, parallelism)
                            .withColumn("model_name", F.lit(name)), models, len(models))
    return fold_summary(cut_lineage(_stack(parts)), k, positive)


def fold_summary(scored: DataFrame, k: int, positive: int = 0) -> DataFrame:
    """A24 + U2: per ``model_name`` the mean and population std over folds of predictions
    ``model_name, fold, label, prediction, score``, best mean macro-F1 first."""
    per_fold = ME.evaluate(scored, positive, by=["model_name", "fold"])
    return (per_fold.groupBy("model_name").agg(
        F.lit(k).alias("cv_splits"),
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"),
        F.avg("f1_macro").alias("f1_macro_mean"), F.stddev_pop("f1_macro").alias("f1_macro_std"),
        F.avg("fatal_recall").alias("fatal_recall_mean"), F.stddev_pop("fatal_recall").alias("fatal_recall_std"))
        .orderBy(F.desc("f1_macro_mean"), F.asc("model_name")))


def _holdout_metrics(train: DataFrame, test: DataFrame, name: str, numeric, categorical, class_labels,
                     positive, params, seed, model: MO.FittedModel | None = None) -> DataFrame:
    m = model or MO.fit_model(name, train, numeric, categorical, class_labels, params, seed=seed)
    return ME.evaluate(MO.judged(m, test, positive), positive)


def unavailable(spark, name: str, reason: str) -> DataFrame:
    """The "not available + reason" record of a holdout that cannot run."""
    return spark.createDataFrame([(False, name, reason)], "available boolean, model_name string, reason string")


def time_holdout(df: DataFrame, name: str, numeric: list[str], categorical: list[str], class_labels: list[str],
                 positive: int = 0, params: dict | None = None, seed: int = 42, date: str = "date",
                 train_frac: float = 0.8, model: MO.FittedModel | None = None) -> DataFrame:
    """Refit on the earliest 80 % (by date, row id) and evaluate on the rest; a
    one-row "unavailable" record when there are too few dated rows or no valid cut.  A given
    ``model`` is evaluated without a refit."""
    c = df.agg(F.count(F.lit(1)).alias("n"), F.count(date).alias("v")).first()
    if c["v"] < max(10, int(0.4 * c["n"])):
        return unavailable(df.sparkSession, name, "Not enough valid date values for time-based holdout.")
    k = int(train_frac * c["v"])
    if k <= 0 or k >= c["v"]:
        return unavailable(df.sparkSession, name, "Invalid split index for time holdout.")
    sp = cut_lineage(SP.time_split(df, date, train_frac=train_frac))
    tr, te = sp.filter("side = 'train'"), sp.filter("side = 'test'")
    met = _holdout_metrics(tr, te, name, numeric, categorical, class_labels, positive, params, seed, model)
    sizes = sp.agg(F.count_if(F.col("side") == "train").alias("train_rows"),
                   F.count_if(F.col("side") == "test").alias("test_rows"),
                   F.min(F.when(F.col("side") == "test", F.col(date))).alias("split_date_start"))
    from caliper.operators.common import attach
    return attach(sizes, met).select(F.lit(True).alias("available"), F.lit(name).alias("model_name"), "*")


def spatial_holdout(df: DataFrame, name: str, numeric: list[str], categorical: list[str], class_labels: list[str],
                    positive: int = 0, params: dict | None = None, seed: int = 42, group: str = "spatial_key",
                    test_frac: float = 0.2, model: MO.FittedModel | None = None) -> DataFrame:
    """M20 + A27: refit with whole spatial groups held out; a one-row "unavailable"
    record when there are fewer than five groups.  A given ``model`` is evaluated without a
    refit."""
    g0 = F.coalesce(F.col(group).cast("string"), F.lit("unknown"))
    if df.agg(F.count_distinct(g0).alias("g")).first()["g"] < 5:
        return unavailable(df.sparkSession, name, "Not enough spatial groups for group holdout.")
    sp = cut_lineage(SP.group_split(df, group, test_frac, seed))
    tr, te = sp.filter("side = 'train'"), sp.filter("side = 'test'")
    met = _holdout_metrics(tr, te, name, numeric, categorical, class_labels, positive, params, seed, model)
    g = F.coalesce(F.col(group).cast("string"), F.lit("unknown"))
    sizes = sp.agg(F.count_if(F.col("side") == "train").alias("train_rows"),
                   F.count_if(F.col("side") == "test").alias("test_rows"),
                   F.count_distinct(F.when(F.col("side") == "train", g)).alias("train_groups"),
                   F.count_distinct(F.when(F.col("side") == "test", g)).alias("test_groups"))
    from caliper.operators.common import attach
    return attach(sizes, met).select(F.lit(True).alias("available"), F.lit(name).alias("model_name"), "*")


def donors(df: DataFrame, repeats: int = 3, seed: int = 42, row_id: str = "row_id", bucket_rows: int = 20_000) -> DataFrame:
    """``perm_repeat, own, other``: for every repeat each row (``own``) with the row that
    lends it its values (``other``), both as structs of all columns; each row lends once.

    Rows fall into hash buckets of about ``bucket_rows`` rows; inside a bucket, rank by one
    hash gives the row and rank by another the lender.  One pairing a repeat serves all
    features, so what is shuffled doesn't grow with their number."""
    n = df.count()
    nb = max(1, n // bucket_rows)
    x = df.select(F.struct("*").alias("own"), F.col(row_id).alias("__id"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("perm_repeat"))

    def order(part: int):
        return md5_order(F.concat_ws(":", F.col("__id").cast("string"), F.col("perm_repeat").cast("string"), F.lit(str(part))), seed)

    x = x.withColumns({"__b": order(0) % nb, "__h1": order(1), "__h2": order(2)})
    w1 = Window.partitionBy("perm_repeat", "__b").orderBy("__h1", "__id")
    w2 = Window.partitionBy("perm_repeat", "__b").orderBy("__h2", "__id")
    takers = x.select("perm_repeat", "__b", F.row_number().over(w1).alias("__rn"), "own")
    lenders = x.select("perm_repeat", "__b", F.row_number().over(w2).alias("__rn"), F.col("own").alias("other"))
    return takers.join(lenders, ["perm_repeat", "__b", "__rn"]).select("perm_repeat", "own", "other")


def feature_places(model: MO.FittedModel, df: DataFrame) -> dict[str, list[int]]:
    """For each input feature the places that it fills in the assembled vector."""
    meta = model.prep.transform(df.limit(0)).schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    out: dict[str, list[int]] = {f: [] for f in model.features}
    for attr in sorted((a for kind in meta.values() for a in kind), key=lambda a: a["idx"]):
        name = attr.get("name", "")
        base = name.split("__ohe_", 1)[0] if "__ohe_" in name else name.removeprefix("missingindicator_")
        if base in out:
            out[base].append(attr["idx"])
    return out


def permutation_importance(model: MO.FittedModel, test: DataFrame, features: list[str] | None = None,
                           repeats: int = 3, seed: int = 42, positive: int = 0, max_rows: int | None = None) -> DataFrame:
    """M17 + T7: macro-F1 drop when one feature is permuted; mean and population std over
    repeats.  Rows are preprocessed once and paired once a repeat; a task scores its rows once
    and again for each feature with its places in the vector taken from the lenders, in blocks,
    and passes on confusion counts only.  ``max_rows`` (off by default) bounds the rows by a
    stratified cap."""
    features = features or model.features
    if max_rows is not None:
        test = cut_lineage(SP.stratified_cap(test, max_rows, seed=seed))
    x = model.prep.transform(test).select("row_id", F.col("label").cast("int").alias("label"), vector_to_array("features").alias("v"))
    x = cut_lineage(x)
    places = feature_places(model, test)
    ship_package(test.sparkSession)
    shares = MO.shares_of(model.clf)
    classes = len(model.class_labels)
    names = [None, *features]  # None: nothing permuted

    most = max(1, TR.BLOCK // len(names))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in held) >= most:
                yield pa.Table.from_batches(held)
                held = []
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            own, other = (batch.column(c).combine_chunks().flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("v", "w"))
            label, repeat = batch.column("label").to_numpy().astype(np.int64), batch.column("perm_repeat").to_numpy().astype(np.int64)
            lent = {f: (own[:, places[f]] != other[:, places[f]]).any(1).nonzero()[0] for f in features if places[f]}  # who gets its own value is told the same
            all_ = [own]
            for f, rows in lent.items():
                mixed = own[rows]
                mixed[:, places[f]] = other[rows][:, places[f]]
                all_.append(mixed)
            best = shares(np.concatenate(all_)).argmax(1)
            base, at = best[: len(own)], len(own)
            out = []
            for i, f in enumerate(names):
                told = base
                if f is not None:
                    if f not in lent:
                        continue
                    told = base.copy()
                    told[lent[f]] = best[at : at + len(lent[f])]
                    at += len(lent[f])
                cells = np.bincount((repeat * classes + label) * classes + told, minlength=repeats * classes * classes)
                some = np.flatnonzero(cells)
                out.append((np.full(len(some), i), some // (classes * classes), some // classes % classes, some % classes, cells[some]))
            columns = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in columns[:4]] + [pa.array(columns[4])], ["at", "perm_repeat", "label", "prediction", "n"])

    paired = donors(x, repeats, seed).select("perm_repeat", "own.label", "own.v", F.col("other.v").alias("w"))
    cells = paired.mapInArrow(run, "at int, perm_repeat int, label int, prediction int, n long")
    cells = cut_lineage(cells.groupBy("at", "perm_repeat", "label", "prediction").agg(F.sum("n").alias("n")))  # rows: features x repeats x classes^2
    per = ME.overall(cells, by=["at", "perm_repeat"])
    base = per.where("at = 0 and perm_repeat = 0").select(F.col("f1_macro").alias("__base"))
    from caliper.operators.common import attach
    per = attach(per.where("at > 0"), base).withColumn("drop", F.col("__base") - F.col("f1_macro"))
    named = F.array(*[F.lit(f) for f in features])
    found = per.groupBy(named[F.col("at") - 1].alias("feature")).agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
    unused = [f for f in features if not places[f]]  # dropped at fit: nothing hangs on them
    if unused:
        found = found.unionByName(test.sparkSession.createDataFrame([(f, 0.0, 0.0) for f in unused], found.schema))
    rows = x.count()
    return (found.withColumns({"method": F.lit("permutation_f1_macro"), "rows": F.lit(rows)})
            .orderBy(F.desc("importance_mean"), F.asc("feature")))


def ablation(prepared_by_mode: dict[str, tuple[DataFrame, list[str], list[str]]], class_labels: list[str],
             positive: int = 0, params: dict | None = None, seed: int = 42) -> DataFrame:
    """M21 + U1: fit-and-select per feature-set mode on the same split recipe; one row
    per mode (rows, selected model, accuracy, macro-F1, balanced accuracy, features)."""
    rows = []
    for mode, (df, numeric, categorical) in prepared_by_mode.items():
        sp = cut_lineage(SP.stratified_split(df, seed=seed))
        tr, te = sp.filter("side = 'train'"), sp.filter("side = 'test'")
        best, metrics, _ = MO.fit_and_select(tr, te, numeric, categorical, class_labels, positive, params=params,
                                             seed=seed)
        m = metrics.filter(F.col("model_name") == best.name).select(
            F.lit(mode).alias("feature_set_mode"), F.lit(sp.count()).alias("rows"),
            F.col("model_name").alias("selected_model"), "accuracy", "f1_macro", "balanced_accuracy",
            F.lit(len(numeric) + len(categorical)).alias("feature_count"))
        rows.append(m)
    return _stack(rows)


def search_rows(train: DataFrame, numeric: list[str], categorical: list[str], k: int | None = None, seed: int = 42,
                max_rows: int = 120_000) -> tuple[int, DataFrame, int]:
    """The number of folds, their preprocessed rows (:func:`fold_rows`) and the number of
    rows searched: what the searches of all candidates share."""
    rows = SP.stratified_cap(train, max_rows, seed=seed)
    k = k or int(SP.min_class_count(train).first()["n_splits"])
    folds = cut_lineage(SP.stratified_folds(rows, k, seed=seed))
    return k, fold_rows(folds, k, numeric, categorical), folds.count()


def grid_search(train: DataFrame, name: str, grid: dict[str, list], numeric: list[str], categorical: list[str],
                class_labels: list[str], k: int | None = None, seed: int = 42, top: int = 5, base: dict | None = None,
                max_rows: int = 120_000, parallelism: int = 4, shared: tuple[int, DataFrame, int] | None = None):
    """M11 + T5: stratified K-fold search over a parameter grid by mean macro-F1.

    ``max_rows`` bounds the labelled rows of the search (a stratified cap, as in the
    reference; the refit uses all rows).  In each fold the preprocessing is fitted once,
    and class weights and the row count behind ``regParam`` are the fold's own.  Points that
    are prefixes of others share their fits (:func:`judged_points`).  All predictions are
    stacked and judged by one grouped metrics job.  ``shared`` (:func:`search_rows`) spares
    searches over several candidates the same folds.

    Returns ``(best_params, trials, record)``: ``trials`` has the ``top`` points, ``record``
    is the search record of the run evidence."""
    import itertools
    import json

    k, x, fit_rows = shared or search_rows(train, numeric, categorical, k, seed, max_rows)
    keys = sorted(grid)
    points = [dict(zip(keys, values)) for values in itertools.product(*[grid[c] for c in keys])]
    stacked = judged_points(x, k, name, [{**(base or {}), **p} for p in points], len(class_labels), 0, seed, parallelism)
    per = ME.overall(ME.confusion(stacked, by=["point", "fold"]), by=["point", "fold"])
    means = {r["point"]: r["m"] for r in per.groupBy("point").agg(F.avg("f1_macro").alias("m")).collect()}  # a row a point
    order = sorted(range(len(points)), key=lambda p: (-means[p], json.dumps(points[p])))
    ranked = [(name, i + 1, json.dumps(points[p]), float(means[p])) for i, p in enumerate(order[:top])]
    trials = train.sparkSession.createDataFrame(ranked, "model_name string, rank int, params string, mean_test_f1_macro double")
    record = {"model_name": name, "cv_splits": k, "search_enabled": True, "best_params": points[order[0]],
              "best_score_f1_macro": float(means[order[0]]), "fit_rows_for_search": fit_rows,
              "top_trials": [{"rank": r, "mean_test_f1_macro": m, "params": json.loads(p)} for _, r, p, m in ranked]}
    return points[order[0]], trials, record
