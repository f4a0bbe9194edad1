import json
import os

import pytest
from pyspark.sql import functions as F

from caliper.operators import models as MO
from caliper.plans.train_run import RunConfig, critical_index, train_run

LIGHT = {"logistic_regression": {"max_iter": 20}, "random_forest": {"num_trees": 10, "max_depth": 4},
         "hist_gradient_boosting_balanced": {"max_iter": 3, "max_depth": 2}}


def _master_rows(rows=60):
    out = []
    for i in range(rows):
        out.append((f"2024-01-{(i % 28) + 1:02d}", f"{i % 24:02d}:00", (i % 3) + 1, (i % 4) + 1, (i % 2) + 1,
                    float(i % 9), float((i * 2) % 12), float(80 + i), float(15 + (i % 10)), float(10 + (i % 8)),
                    float(4 + (i % 6)), float((i % 5) / 10), float(1000 + (i % 20)), 0, f"E010{i % 8:05d}",
                    [1, 2, 3, 6][i % 4], [20, 30, 40, 60][i % 4], [0, 13, 16][i % 3], [2, 4, -1][i % 3],
                    [1, 4, 6][i % 3], [1, 2, 8][i % 3], [1, 2, 4][i % 3], [1, 2][i % 2]))
    return out


SCHEMA = ("date string, time string, accident_severity int, number_of_vehicles int, number_of_casualties int, "
          "cloud_cover double, sunshine double, global_radiation double, max_temp double, mean_temp double, "
          "min_temp double, precipitation double, pressure double, snow_depth int, lsoa_of_accident_location string, "
          "road_type int, speed_limit int, junction_detail int, junction_control int, light_conditions int, "
          "weather_conditions int, road_surface_conditions int, urban_or_rural_area int")


def test_critical_index():
    assert critical_index(["Fatal", "Serious", "Slight"]) == 0
    assert critical_index(["a", "FATAL"]) == 1 and critical_index(["x"]) == 0


def test_missing_master_fails_without_fallback(spark, tmp_dir):
    with pytest.raises(FileNotFoundError, match="Master dataset not found"):
        train_run(spark, os.path.join(tmp_dir, "missing_master.parquet"), os.path.join(tmp_dir, "out"))


def test_training_generates_artifacts(spark, tmp_dir):
    master = os.path.join(tmp_dir, "processed_master.parquet")
    spark.createDataFrame(_master_rows(), SCHEMA).coalesce(1).write.parquet(master)
    out_dir = os.path.join(tmp_dir, "artifacts")
    cfg = RunConfig(min_training_rows=10, model_params=LIGHT)
    res = train_run(spark, master, out_dir, cfg)
    s = res["summary"]
    assert s["rows_total"] == 60 and s["rows_used_for_training"] == 60
    assert s["selected_model"] in MO.MODEL_ORDER
    assert "f1_macro" in s["selected_model_metrics"] and s["data_version_tag"] == "processed_master.parquet_60rows"
    for k in ("overall_metrics_on_test_split", "safety_metrics_on_test_split", "probability_metrics_on_test_split",
              "fatal_screening_model", "safety_threshold"):
        assert k in s
    for d in ("model", "model_compare", "threshold_report", "calibration_bins", "metrics", "cv", "ablation",
              "permutation_importance", "time_holdout", "spatial_holdout", "missingness_by_time"):
        assert os.path.exists(os.path.join(out_dir, d)), d
    cmp = spark.read.option("header", True).option("inferSchema", True).csv(os.path.join(out_dir, "model_compare"))
    assert {"balanced_accuracy", "fatal_recall"} <= set(cmp.columns)
    best_f1 = cmp.agg(F.max("f1_macro")).first()[0]
    assert s["selected_model_metrics"]["f1_macro"] == pytest.approx(best_f1, abs=1e-9)
    assert cmp.first()["model_name"] == s["selected_model"]     # written in selection order
    # reload and score a row with an unseen category value
    model = MO.load_model(os.path.join(out_dir, "model"), spark)
    assert "road_type" in model.categorical
    row = {c: model.defaults.get(c, 0) for c in model.features}
    one = spark.createDataFrame([row]).withColumn("road_type", F.lit("unseen_test_category"))
    scored = MO.batch_score(model, one).collect()
    assert len(scored) == 1 and scored[0].predicted_code in (1, 2, 3)
    assert abs(sum(scored[0].probabilities) - 1.0) < 1e-9
    doc = spark.read.json(os.path.join(out_dir, "metrics")).first().asDict(recursive=True)
    assert doc["rows_total"] == 60 and doc["data_quality_report"]["target_distribution_after_filter"] == {"1": 20, "2": 20, "3": 20}
    assert doc["safety_metrics_on_test_split"]["fatal_support"] == 4 and len(doc["all_model_metrics"]) == 3
    assert doc["selected_model_by_cv"] in MO.MODEL_ORDER and doc["calibration_model_report"]["available"] is True
    assert model.info["target_column"] == "accident_severity" and model.info["calibration_model_report"]["available"]
    assert sum(r["n"] for r in res["reports"]["confusion_matrix"].collect()) == 12


def test_search_prefers_the_better_point_and_weighs_per_fold(spark):
    from caliper.operators import reliability as RE
    rows = [(i, i % 3, float(i % 3) + (i % 7) * 0.01, float(i % 5)) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id long, label int, x double, y double")
    best, trials, record = RE.grid_search(df, "random_forest", {"num_trees": [1, 12], "max_depth": [1, None]}, ["x", "y"], [],
                                          ["a", "b", "c"], k=3, base={"max_depth": 6})
    t = [r.asDict() for r in trials.collect()]
    assert [r["rank"] for r in t] == [1, 2, 3, 4] and t[0]["mean_test_f1_macro"] == pytest.approx(record["best_score_f1_macro"])
    assert json.loads(t[0]["params"]) == best == record["best_params"] and record["best_score_f1_macro"] > 0.9
    by_hand = []                                   # the best point again, fold by fold
    from caliper.operators import metrics as ME
    from caliper.operators import splits as SP
    folds = SP.stratified_folds(df, 3).cache()
    for f in range(3):
        m = MO.fit_model("random_forest", folds.filter(F.col("fold") != f), ["x", "y"], [], ["a", "b", "c"], {"max_depth": 6, **best})
        by_hand.append(ME.overall(ME.confusion(MO.score(m, folds.filter(F.col("fold") == f)))).first()["f1_macro"])
    folds.unpersist()
    assert record["best_score_f1_macro"] == pytest.approx(sum(by_hand) / 3)
    assert record["cv_splits"] == 3 and record["fit_rows_for_search"] == 90
    recs = []
    tr, te = df.filter("row_id < 70"), df.filter("row_id >= 70")
    chosen, _, _ = MO.fit_and_select(tr, te, ["x", "y"], [], ["a", "b", "c"], models=["logistic_regression"],
                                     grids={"logistic_regression": {"C": [0.1, 3.0]}}, records=recs)
    assert chosen.params == recs[0]["best_params"] and recs[0]["search_enabled"]


def test_no_depth_is_no_limit():
    assert MO.tree_settings("hist_gradient_boosting_balanced", {"max_depth": None}).depth is None
    assert MO.tree_settings("random_forest", {"max_depth": 12, "num_trees": 3}).depth == 12


def test_row_ids_do_not_depend_on_partitioning(spark):
    from caliper.plans.train_run import with_row_id
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "b")], "x int, y string")
    one = sorted(r.row_id for r in with_row_id(df.coalesce(1), "row_id").collect())
    assert one == sorted(r.row_id for r in with_row_id(df.repartition(3), "row_id").collect()) and len(set(one)) == 4


def test_json_records_scoring_ignores_extra_fields(spark, tmp_dir):
    from caliper.operators import features as FE
    from caliper.sources.tables import read_records
    from caliper.plans.train_run import CATEGORICAL, NUMERIC
    rows = spark.createDataFrame(_master_rows(), SCHEMA)
    from caliper.operators import prepare as PR
    prepared = PR.prepare(rows.withColumn("row_id", F.monotonically_increasing_id()), NUMERIC + CATEGORICAL)
    model = MO.fit_model("logistic_regression", prepared, NUMERIC, CATEGORICAL, ["Fatal", "Serious", "Slight"],
                         {"max_iter": 10})
    rec = {c: 1 for c in NUMERIC + CATEGORICAL}
    rec.update({"number_of_casualties": 3, "cloud_cover": 5.0, "precipitation": 0.2})
    p = os.path.join(tmp_dir, "sample_input.json")
    with open(p, "w") as f:
        json.dump(rec, f)
    df = read_records(spark, p, multiline=True)
    dfl = {r["feature"]: (r["numeric_default"] if r["kind"] == "numeric" else r["categorical_default"])
           for r in FE.feature_defaults(prepared, NUMERIC, CATEGORICAL).collect()}
    model.defaults = dfl
    out = MO.batch_score(model, df.drop("road_type")).collect()
    assert len(out) == 1 and out[0].predicted_class_label in ("Fatal", "Serious", "Slight")


def test_holdouts_report_unavailable(spark):
    from caliper.operators import reliability as RE
    df = spark.createDataFrame([(i, i % 3, None, f"g{i % 2}", float(i)) for i in range(30)],
                               "row_id long, label int, date date, spatial_key string, x double")
    t = RE.time_holdout(df, "logistic_regression", ["x"], [], ["a", "b", "c"]).first()
    assert t.available is False and "date" in t.reason
    s = RE.spatial_holdout(df, "logistic_regression", ["x"], [], ["a", "b", "c"]).first()
    assert s.available is False and "groups" in s.reason
