import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from caliper.operators import audit as AU
from caliper.operators import quality as QU


def test_missing_by_month_matches_pandas(spark):
    rows = [("2024-01-05", 1.0, "x"), ("2024-01-20", None, "2"), ("2024-02-01", float("nan"), None),
            (None, 3.0, "4"), ("2024-02-11", 2.0, "5")]
    df = spark.createDataFrame(rows, "date string, a double, b string")
    got = [(r.year_month, r.feature, r.missing_rate, r.rows)
           for r in QU.missing_by_month(df, ["a", "b", "zz"]).collect()]
    pdf = pd.DataFrame(rows, columns=["date", "a", "b"])
    pdf["date"] = pd.to_datetime(pdf["date"])
    pdf = pdf[pdf["date"].notna()]
    pdf["ym"] = pdf["date"].dt.to_period("M").astype(str)
    exp = []
    for ym, part in pdf.groupby("ym"):
        for f in ["a", "b"]:
            exp.append((ym, f, float(pd.to_numeric(part[f], errors="coerce").isna().mean()), len(part)))
        exp.append((ym, "zz", 1.0, len(part)))
    assert got == exp


def test_missing_rates_sorted(spark):
    df = spark.createDataFrame([(1, None, 1.0), (None, None, float("nan")), (3, "a", 2.0)], "a int, b string, c double")
    out = [(r.column, r.missing_rate) for r in QU.missing_rates(df).collect()]
    assert out[0] == ("b", pytest.approx(2 / 3))
    assert out[1][0] in ("a", "c") and out[1][1] == pytest.approx(1 / 3)


def test_quality_report_and_coverage(spark):
    raw = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (9, None), (None, "2024-01-02")],
                                "accident_severity int, date string")
    prepared = spark.createDataFrame([("a",), ("unknown",), (None,)], "spatial_key string")
    r = QU.quality_report(raw, prepared).first()
    assert (r.rows_raw, r.rows_valid_target, r.rows_invalid_target, r.unique_days) == (4, 2, 2, 2)
    assert r.date_min == dt.date(2024, 1, 1) and r.unique_spatial_keys == 2
    assert r.unknown_spatial_key_ratio == pytest.approx(2 / 3)


def test_leakage_report_duplicates_and_overlap(spark):
    tr = spark.createDataFrame([(1.0, None, dt.date(2024, 1, 5)), (2.0, "a", dt.date(2024, 1, 1))],
                               "x double, c string, date date")
    te = spark.createDataFrame([(1.0, None, dt.date(2024, 1, 3)), (3.0, "a", dt.date(2024, 1, 9))],
                               "x double, c string, date date")
    r = QU.leakage_report(tr, te, ["x", "c"]).first()
    assert r.duplicate_row_overlap_count == 1 and r.risk_level == "medium"
    assert r.temporal_overlap_possible is True
    tr2 = tr.withColumn("number_of_casualties", F.lit(1))
    te2 = te.withColumn("number_of_casualties", F.lit(1))
    r2 = QU.leakage_report(tr2, te2, ["x", "number_of_casualties"]).first()
    assert r2.risk_level == "high" and r2.suspicious_features_present == "number_of_casualties"


def test_forbidden_reason_blocks_private_release_files(spark):
    paths = ["artifacts/model.joblib", "artifacts/error_cases.csv", "data/processed/processed_master.parquet",
             "Practical-01-Getting_Started.ipynb", "Practical-01-Getting_Started_SOLUTION.ipynb", "README.md",
             "data/raw/.gitkeep", "notes/.env.local", "x/y.PEM", "a.zip", "docs/a.zip"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.reason for r in df.select("path", AU.forbidden_reason(F.col("path")).alias("reason")).collect()}
    for p in paths[:5]:
        assert got[p]
    assert got["README.md"] is None and got["data/raw/.gitkeep"] is None and got["docs/a.zip"] is None
    assert got["notes/.env.local"] == AU.REASON_SECRET_FILE and got["x/y.PEM"] == AU.REASON_SECRET_FILE


def test_size_findings_fail_large(spark):
    df = spark.createDataFrame([("large.bin", 51 * 1024 * 1024), ("mid.bin", 30 * 1024 * 1024), ("s", 10)],
                               "path string, size long")
    out = {r.path: r for r in AU.size_findings(df).collect()}
    assert out["large.bin"].level == "FAIL" and "51.0 MiB" in out["large.bin"].message
    assert out["mid.bin"].level == "WARN" and "s" not in out


def test_secret_findings_first_line_and_exempt(spark):
    df = spark.createDataFrame([("settings.py", "API_KEY = 'not-a-real-value-for-test'\n"),
                                ("b.txt", "hello\nworld\npassword: 'abcdefghij'\nsk-" + "a" * 25),
                                ("audit.py", "token = 'abcdefghijkl'"), ("clean.md", "nothing here")],
                               "path string, text string")
    exempt = spark.createDataFrame([("audit.py",)], "path string")
    out = {r.path: r.message for r in AU.secret_findings(df, exempt=exempt).collect()}
    assert out == {"settings.py": "possible secret-like text at line 1", "b.txt": "possible secret-like text at line 3"}


def test_secret_lines_follow_all_line_breaks_and_any_length(spark):
    secret = "token = 'abcdefghijkl'"
    texts = {"breaks": f"a\rb\x0cc\r\n{secret}", "late": "line of text\n" * 250_000 + secret, "twice": secret,
             "spread": "token =\n'abcdefghijkl'"}
    rows = [*texts.items(), ("twice", f"x\n{secret}"), (None, secret), ("null", None)]
    got = sorted(((r.path, r.message.rsplit(" ", 1)[1]) for r in AU.secret_findings(
        spark.createDataFrame(rows, "path string, text string")).collect()), key=str)
    lines = {k: next((i + 1 for i, x in enumerate(v.splitlines()) if secret in x), None) for k, v in texts.items()}
    assert len(texts["late"]) > 3 * 1024 * 1024 and lines["breaks"] == 4
    assert got == sorted([("breaks", "4"), ("late", "250001"), ("twice", "1"), ("twice", "2"), (None, "1")], key=str)


def test_path_rules_apply_by_priority(spark):
    rules = (AU.PathRule("prefix", ("a/",), "first"), AU.PathRule("extension", (".key",), "second", unless=("b.key",)),
             AU.PathRule("name_regex", ("^n",), "third", root_only=True, pattern=r"\.txt$"))
    paths = {"a/x.key": "first", "c/x.KEY": "second", "b.key": None, "note.txt": "third", "d/note.txt": None, "note.md": None}
    df = spark.createDataFrame([(p,) for p in [*paths, None]], "path string")
    got = {r.path: r.reason for r in df.select("path", AU.forbidden_reason(F.col("path"), rules).alias("reason")).collect()}
    assert got == paths | {None: None}


def test_required_and_summary(spark):
    observed = spark.createDataFrame([("README.md",)], "path string")
    req = AU.missing_required(observed)
    assert [r.path for r in req.collect()] == ["LICENSE"]
    sizes = AU.size_findings(spark.createDataFrame([("m", 30 * 1024 * 1024)], "path string, size long"))
    allf, roll = AU.summarise([req, sizes])
    r = roll.first()
    assert (r.failures, r.warnings, r.passed) == (1, 1, False)
