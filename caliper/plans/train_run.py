"""C4 train-and-evidence run and A30 run summary.

One Spark application: scan -> guard -> prepare (checkpointed once) -> stratified split
(checkpointed) -> fit and select -> evidence.  Every report is an action on the
checkpointed prepared frame or on the scored test frame; reports are written with the
Spark writers (small reports as one file, row-level error cases partitioned)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.operators import features as FE
from caliper.operators import metrics as ME
from caliper.operators import models as MO
from caliper.operators import prepare as PR
from caliper.operators import quality as QU
from caliper.operators import reliability as RE
from caliper.operators import splits as SP
from caliper.session import cut_lineage, ensure_checkpoint_dir
from caliper.sources import tables as TB

# fixed values: default feature configuration of the reference run
NUMERIC = ["number_of_vehicles", "hour", "day_of_week", "month", "is_weekend", "season", "cloud_cover", "sunshine",
           "global_radiation", "max_temp", "mean_temp", "min_temp", "precipitation", "pressure", "snow", "hour_peak",
           "precipitation_peak_interaction", "low_visibility_proxy"]
CATEGORICAL = ["road_type", "speed_limit", "junction_detail", "junction_control", "light_conditions",
               "weather_conditions", "road_surface_conditions", "urban_or_rural_area"]
WEATHER = ["cloud_cover", "sunshine", "global_radiation", "max_temp", "mean_temp", "min_temp", "precipitation",
           "pressure"]


@dataclass
class RunConfig:
    feature_set_mode: str = "pre_event"
    pre_event: list = field(default_factory=lambda: NUMERIC + CATEGORICAL)
    post_event: list = field(default_factory=lambda: NUMERIC[:1] + ["number_of_casualties"] + NUMERIC[1:] + CATEGORICAL)
    numeric: list = field(default_factory=lambda: list(NUMERIC))
    categorical: list = field(default_factory=lambda: list(CATEGORICAL))
    target: str = "accident_severity"
    code_map: dict = field(default_factory=lambda: {1: 0, 2: 1, 3: 2})
    class_labels: list = field(default_factory=lambda: ["Fatal", "Serious", "Slight"])
    label_mapping_version: str = "stats19_2025_v1"
    test_size: float = 0.2
    seed: int = 42
    min_training_rows: int = 100_000
    safety_max_fpr: float = 0.2
    model_params: dict = field(default_factory=dict)
    hyperparameter_search: bool = False
    param_grids: dict = field(default_factory=lambda: dict(MO.PARAM_GRIDS))
    run_reliability: bool = True
    run_permutation: bool = True
    run_ablation: bool = True
    row_id: str = "row_id"


def critical_index(labels: list[str], name: str = "fatal") -> int:
    """case-insensitive index of the critical class, default 0."""
    low = [x.lower() for x in labels]
    return low.index(name) if name in low else 0


def train_run(spark: SparkSession, master_path: str, out_dir: str, cfg: RunConfig | None = None) -> dict:
    cfg = cfg or RunConfig()
    ensure_checkpoint_dir(spark)
    raw = TB.read_table(spark, master_path)
    TB.require_rows(raw, cfg.min_training_rows)
    feats = PR.select_features(cfg.feature_set_mode, cfg.pre_event, cfg.post_event, cfg.pre_event)
    numeric, categorical = PR.split_types(feats, cfg.numeric, cfg.categorical)
    PR.guard_policy(feats, cfg.feature_set_mode)
    raw = with_row_id(raw, cfg.row_id)
    prepared = cut_lineage(PR.prepare(raw, feats, cfg.target, cfg.code_map, cfg.row_id))
    pos = critical_index(cfg.class_labels)

    stratify = bool(SP.min_class_count(prepared).first()["stratify"])
    split = cut_lineage(SP.stratified_split(prepared, test_frac=cfg.test_size, seed=cfg.seed, stratify=stratify))
    train, test = split.filter("side = 'train'").drop("side"), split.filter("side = 'test'").drop("side")

    search: list[dict] = []
    best, metrics, _ = MO.fit_and_select(train, test, numeric, categorical, cfg.class_labels, pos,
                                         params=cfg.model_params, seed=cfg.seed, records=search,
                                         grids=cfg.param_grids if cfg.hyperparameter_search else None)
    defaults_df = FE.feature_defaults(prepared, numeric, categorical)
    best.defaults = {r["feature"]: (r["numeric_default"] if r["kind"] == "numeric" else r["categorical_default"])
                     for r in defaults_df.collect()}           # one row per feature
    best.code_map = dict(cfg.code_map)

    out: dict[str, DataFrame] = {}
    out["model_compare"] = ME.compare_models(metrics)
    out["screening_model"] = ME.screening_model(metrics)
    best_scored = cut_lineage(MO.score(best, test, pos))
    cells = ME.confusion(best_scored)
    out["confusion_matrix"], out["class_report"] = cells, ME.class_report(cells)
    out["error_cases"] = ME.error_cases(best_scored.drop("probabilities"), cfg.class_labels)
    out["threshold_report"] = ME.threshold_sweep(best_scored, pos)
    out["safety_threshold"] = ME.pick_threshold(out["threshold_report"], cfg.safety_max_fpr)
    out["calibration_bins"] = ME.calibration_bins(best_scored, pos)
    out["calibration"] = ME.ece_brier(best_scored, pos)
    out["feature_importance"] = MO.model_importance(best, test)
    out["data_quality"] = QU.quality_report(raw, prepared, cfg.target)
    out["feature_missing"] = PR.feature_missing_rates(raw, feats, cfg.target)
    out["class_distribution"] = QU.class_distribution(prepared)
    out["leakage"] = QU.leakage_report(train, test, feats)
    out["missingness_by_time"] = QU.missing_by_month(raw, WEATHER)
    out["error_dispersion"] = QU.error_dispersion(out["error_cases"], feats, top=3)

    calibration = {"available": False, "reason": "Not enough rows per class for calibration."}  # fixed value: reason
    if stratify and train.count() >= 20:
        cs = cut_lineage(SP.stratified_split(train, test_frac=0.25, seed=cfg.seed))
        fit_part = cs.filter("side = 'train'")
        base = MO.fit_model(best.name, fit_part, numeric, categorical, cfg.class_labels, best.params, seed=cfg.seed)
        cal = MO.calibrate(base, cs.filter("side = 'test'"))
        cal_scored = cal.transform(test).withColumn("score", F.col("probabilities")[pos])
        out["calibrated"] = cut_lineage(ME.ece_brier(cal_scored, pos))
        calibration = {"available": True, "method": "sigmoid", "fit_rows": fit_part.count(),
                       "calibration_rows": cs.count() - fit_part.count()} | out["calibrated"].first().asDict()
    best.info = {"target_column": cfg.target, "label_mapping_version": cfg.label_mapping_version,
                 "feature_set_mode": cfg.feature_set_mode, "fatal_screening_model": out["screening_model"].first().asDict(),
                 "calibration_model_report": calibration}
    MO.save_model(best, f"{out_dir}/model", spark)
    if cfg.run_permutation:
        out["permutation_importance"] = RE.permutation_importance(best, test, feats, 3, cfg.seed, pos)
    if cfg.run_reliability:
        out["cv"] = RE.cv_reliability(prepared, numeric, categorical, cfg.class_labels, pos, params=cfg.model_params,
                                      seed=cfg.seed)
        out["time_holdout"] = RE.time_holdout(prepared, best.name, numeric, categorical, cfg.class_labels, pos,
                                              cfg.model_params.get(best.name), cfg.seed)
        out["spatial_holdout"] = RE.spatial_holdout(prepared, best.name, numeric, categorical, cfg.class_labels, pos,
                                                    cfg.model_params.get(best.name), cfg.seed)
    if cfg.run_ablation:
        modes = {}
        for mode, cols in (("pre_event", cfg.pre_event), ("post_event", cfg.post_event)):
            n_, c_ = PR.split_types(cols, cfg.numeric, cfg.categorical)
            same = mode == cfg.feature_set_mode
            modes[mode] = (prepared if same else cut_lineage(PR.prepare(raw, cols, cfg.target, cfg.code_map, cfg.row_id)),
                           n_, c_)
        out["ablation"] = RE.ablation(modes, cfg.class_labels, pos, cfg.model_params, cfg.seed)

    for name, df in out.items():
        TB.write_report(df, f"{out_dir}/{name}", "csv", single_file=(name != "error_cases"))

    summary = run_summary(raw, prepared, metrics, best, out, cfg, master_path, pos, calibration)
    TB.write_document(spark, summary, f"{out_dir}/metrics")
    TB.write_document(spark, {"models": search}, f"{out_dir}/hyperparameter_search")
    TB.write_document(spark, summary["data_quality_report"], f"{out_dir}/data_quality_report")
    return {"summary": summary, "model": best, "reports": out}


def with_row_id(raw: DataFrame, row_id: str) -> DataFrame:
    """The table with a row id that doesn't hang on its partitioning: the 64-bit hash of
    the whole row, and for equal rows their number among them."""
    if row_id in raw.columns:
        return raw
    from pyspark.sql import Window
    h = F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns])
    same = Window.partitionBy("__row_hash").orderBy(F.lit(0))
    numbered = raw.withColumn("__row_hash", h).withColumn("__copy", F.row_number().over(same))
    return numbered.withColumn(row_id, F.xxhash64("__row_hash", "__copy")).drop("__row_hash", "__copy")


def run_summary(raw: DataFrame, prepared: DataFrame, metrics: DataFrame, best, out: dict, cfg: RunConfig,
                master_path: str, pos: int, calibration: dict) -> dict:
    """One small nested document assembled from one-row and one-row-per-feature
    reports (keys are fixed values)."""
    quality = out["data_quality"].first().asDict()
    counts = int(quality["rows_raw"])
    used = int(prepared.count())
    every = [r.asDict() for r in metrics.orderBy(F.desc("f1_macro"), "train_order").collect()]   # a row a model
    sel = next(r for r in every if r["model_name"] == best.name)
    dist = {str(int(r["label"]) + 1): int(r["rows"]) for r in out["class_distribution"].collect()}
    missing = {r["feature"]: r["missing_rate"] for r in out["feature_missing"].collect()}
    fatal = {r["class"]: r.asDict() for r in out["class_report"].collect()}.get(str(pos), {})
    cal = out["calibration"].first()
    calibrated = out["calibrated"].first() if "calibrated" in out else None
    by_cv = out["cv"].first()["model_name"] if "cv" in out else None
    name = master_path.rstrip("/").split("/")[-1]
    critical = {k: float(sel[f"fatal_{k}"]) for k in ("precision", "recall", "f1")}
    support = int(fatal.get("support") or 0)
    return {
        "selected_model": best.name,
        "selected_model_by_cv": by_cv,
        "selected_model_metrics": sel,
        "all_model_metrics": every,
        "fatal_screening_model": out["screening_model"].first().asDict(),
        "calibration_model_report": calibration,
        "rows_total": counts, "rows_used_for_training": used,
        "rows_removed_invalid_target": counts - used,
        "missing_rate_by_feature": missing,
        "feature_columns": best.features, "numeric_feature_columns": best.numeric,
        "categorical_feature_columns": best.categorical,
        "feature_set_mode": cfg.feature_set_mode, "label_mapping_version": cfg.label_mapping_version,
        "data_version_tag": f"{name}_{counts}rows", "dataset_used": master_path,
        "overall_metrics_on_test_split": {k: sel[k] for k in ("accuracy", "f1_macro", "balanced_accuracy")},
        "safety_metrics_on_test_split": {f"fatal_{k}": v for k, v in critical.items()} | {
            "fatal_pr_auc": float(sel["fatal_pr_auc"]), "fatal_support": support},
        "fatal_metrics_on_test_split": critical | {"support": support},
        "fatal_recall_on_test_split": critical["recall"],
        "probability_metrics_on_test_split": {
            "fatal_brier": cal["brier_score"], "fatal_ece": cal["expected_calibration_error"],
            "calibrated_fatal_brier": calibrated["brier_score"] if calibrated else 0.0,
            "calibrated_fatal_ece": calibrated["expected_calibration_error"] if calibrated else 0.0},
        "class_distribution": dist,
        "data_quality_report": {
            "dataset_used": master_path, "rows_raw": counts, "rows_valid_target": int(quality["rows_valid_target"]),
            "rows_invalid_target": int(quality["rows_invalid_target"]), "target_distribution_after_filter": dist,
            "missing_rate_by_feature": missing,
            "date_coverage": {"min": quality["date_min"], "max": quality["date_max"],
                              "unique_days": int(quality["unique_days"])},
            "spatial_coverage": {"unique_spatial_keys": int(quality["unique_spatial_keys"]),
                                 "unknown_spatial_key_ratio": quality["unknown_spatial_key_ratio"]}},
        "safety_threshold": out["safety_threshold"].first().asDict(),
        "error_case_count": int(out["error_cases"].count()),
        "critical_class_index": pos,
    }
