"""Publication audit re-aimed at tables of texts and paths.

Findings are rows ``(level, path, message)``; every check is a narrow DataFrame job and
the roll-up is one grouped count.  The secret scan reads whole texts of any length: a
whole-text ``rlike`` prefilter (a superset: a matching line makes the text match), then
the first matching line by ``array_position`` within the row, one finding per document.
Path rules are a table that the caller extends, applied in priority order.
"""

from __future__ import annotations

from typing import Iterable, NamedTuple, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: secret-like text pattern (case-insensitive)
SECRET_PATTERN = (
    r"(?i)("
    r"(api[_-]?key|secret|token|password|passwd|authorization|credential|private[_-]?key)"
    r"\s*[:=]\s*['\"][^'\"]{8,}['\"]|"
    r"bearer\s+[A-Za-z0-9._~+/=-]{20,}|"
    r"aws_access_key_id\s*[:=]\s*['\"]?[A-Z0-9]{16,}|"
    r"postgres://[^\s]+|mysql://[^\s]+|mongodb://[^\s]+|"
    r"-----BEGIN (RSA|OPENSSH|DSA|EC|PRIVATE) KEY-----|"
    r"sk-[A-Za-z0-9]{20,}"
    r")"
)

# fixed values: size bands in bytes
WARN_SIZE_BYTES = 25 * 1024 * 1024
FAIL_SIZE_BYTES = 50 * 1024 * 1024
# fixed values: line breaks
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

class PathRule(NamedTuple):
    """One row of the path rule table.  ``kind`` says what ``values`` are compared with:

    ``exact`` the path; ``prefix`` / ``suffix`` its ends; ``extension`` the lower-cased
    text after the name's last dot; ``name`` the file name; ``name_prefix`` its start;
    ``name_regex`` a pattern found in it.  ``below`` and ``root_only`` restrict the rule
    to paths under a folder / without a folder; ``unless`` lists excepted paths."""

    kind: str
    values: tuple[str, ...]
    reason: str
    below: str = ""
    root_only: bool = False
    unless: tuple[str, ...] = ()
    pattern: str = ""


# fixed values: reasons
REASON_SECRET_FILE = "secret, private key, or local database file must not be tracked"
REASON_LOCAL_DATA = "raw/interim/processed data must stay local"
REASON_SAMPLE = "sample data requires explicit anonymization approval before tracking"
REASON_MODEL_BINARY = "model binary must not be tracked in regular Git"
REASON_ZIP = "root-level archive is treated as local/private coursework or source data"
REASON_PDF = "root-level PDF is treated as local/private coursework"
REASON_NOTEBOOK = "coursework notebook is not part of the public release"
REASON_LOCAL_FILE = "local coursework/reference file must not be tracked"

# fixed values: path rules in priority order (the first that fits gives the reason)
PATH_RULES = (
    PathRule("exact", ("artifacts/model.joblib",), "trained model artifact must not be tracked"),
    PathRule("exact", ("artifacts/error_cases.csv",), "row-level error cases must not be tracked"),
    PathRule("exact", ("data/sample/merged_sample.csv",), "sample data is not approved for public tracking"),
    PathRule("extension", (".env", ".pem", ".key", ".p12", ".sqlite", ".sqlite3"), REASON_SECRET_FILE),
    PathRule("name_prefix", (".env",), REASON_SECRET_FILE),
    PathRule("prefix", ("data/raw/", "data/interim/", "data/processed/"), REASON_LOCAL_DATA,
             unless=("data/raw/.gitkeep", "data/interim/.gitkeep", "data/processed/.gitkeep")),
    PathRule("prefix", ("data/sample/",), REASON_SAMPLE),
    PathRule("extension", (".joblib", ".pkl", ".pickle"), REASON_MODEL_BINARY, below="artifacts/"),
)
# fixed values: further rules of a coursework project, for callers that want them
COURSEWORK_RULES = (
    PathRule("suffix", (".zip",), REASON_ZIP, root_only=True),
    PathRule("suffix", (".pdf",), REASON_PDF, root_only=True),
    PathRule("name_regex", (r"(?i)^Practical", r"(?i)SOLUTION", r"(?i)^Template_submission"), REASON_NOTEBOOK,
             root_only=True, pattern=r"\.ipynb$"),
    PathRule("name", ("Cluster-House-Prices-Raw.png", "biplot_2d.png"), REASON_LOCAL_FILE),
)
# fixed values: required entries and their messages (project-specific entries are passed in)
REQUIRED = {
    "README.md": "README is required for public GitHub use",
    "LICENSE": "LICENSE is required for open-source publication",
}

FINDING_SCHEMA = "level string, path string, message string"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_suffix(path: Column) -> Column:
    """Lower-cased text after the last dot of the name (none for dot-files)."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def rule_fits(rule: PathRule, path: Column) -> Column:
    """Whether one rule applies to a path."""
    subject = {"extension": file_suffix, "name": file_name, "name_prefix": file_name,
               "name_regex": file_name}.get(rule.kind, lambda p: p)(path)
    if rule.kind in ("exact", "extension", "name"):
        fits = subject.isin(*rule.values)
    else:
        test = {"prefix": subject.startswith, "name_prefix": subject.startswith, "suffix": subject.endswith,
                "name_regex": subject.rlike}[rule.kind]
        fits = F.lit(False)
        for value in rule.values:
            fits = fits | test(value)
    if rule.below:
        fits = fits & path.startswith(rule.below)
    if rule.root_only:
        fits = fits & ~path.contains("/")
    if rule.pattern:
        fits = fits & path.rlike(rule.pattern)
    if rule.unless:
        fits = fits & ~path.isin(*rule.unless)
    return fits


def forbidden_reason(path: Column, rules: Sequence[PathRule] = PATH_RULES + COURSEWORK_RULES) -> Column:
    """D3: the reason of the fitting rule of highest priority; NULL when none fits."""
    hits = F.array(*[F.when(rule_fits(r, path), F.struct(F.lit(i).alias("priority"), F.lit(r.reason).alias("reason")))
                     for i, r in enumerate(rules)])
    return F.array_min(hits)["reason"]


def path_findings(df: DataFrame, path: str = "path",
                  rules: Sequence[PathRule] = PATH_RULES + COURSEWORK_RULES) -> DataFrame:
    """D3 applied: FAIL rows for paths that hit a rule."""
    r = forbidden_reason(F.col(path), rules)
    return df.select(F.lit("FAIL").alias("level"), F.col(path).alias("path"), r.alias("message")) \
        .filter(F.col("message").isNotNull())


def size_text(size: Column) -> Column:
    """Bytes as ``x.x MiB``, below one MiB as ``x.x KiB`` (ties to even)."""
    small = size < 1024 * 1024
    scaled = F.when(small, size / F.lit(1024)).otherwise(size / F.lit(1024 * 1024))
    return F.concat(F.format_string("%.1f", F.bround(scaled, 1)), F.when(small, " KiB").otherwise(" MiB"))


def limit_text(limit: int) -> str:
    unit, name = (1024 * 1024, "MiB") if limit >= 1024 * 1024 else (1024, "KiB")
    return f"{limit / unit:g} {name}"


def size_findings(df: DataFrame, path: str = "path", size: str = "size", warn: int = WARN_SIZE_BYTES,
                  fail: int = FAIL_SIZE_BYTES) -> DataFrame:
    """FAIL at ≥ ``fail`` bytes, WARN at ≥ ``warn`` bytes."""
    told = F.concat(F.lit("tracked file is "), size_text(F.col(size)))
    return df.select(
        F.when(F.col(size) >= fail, F.lit("FAIL")).when(F.col(size) >= warn, F.lit("WARN")).alias("level"),
        F.col(path).cast("string").alias("path"),
        F.when(F.col(size) >= fail, F.concat(told, F.lit(f"; public repo limit is {limit_text(fail)}")))
        .otherwise(F.concat(told, F.lit("; consider release storage"))).alias("message"),
    ).filter(F.col("level").isNotNull())


def secret_findings(df: DataFrame, path: str = "path", text: str = "text", exempt: DataFrame | None = None,
                    pattern: str = SECRET_PATTERN) -> DataFrame:
    """D1 + J11: the first secret-like line (1-based) of each text, whatever its length,
    one finding per row; exempt paths are taken out of the few findings (left-anti)."""
    hit = F.col(text).rlike(pattern)
    line = F.array_position(F.transform(F.split(F.col(text), LINE_BREAKS), lambda x: x.rlike(pattern)), F.lit(True))
    d = df.filter(hit).select(F.lit("FAIL").alias("level"), F.col(path).cast("string").alias("path"),
                              line.alias("__line"))
    d = d.filter(F.col("__line") > 0)
    if exempt is not None:
        out = exempt.select(F.col(exempt.columns[0]).cast("string").alias("path")).distinct()
        d = d.join(out, "path", "left_anti").select("level", "path", "__line")
    return d.select("level", "path", F.concat(F.lit("possible secret-like text at line "),
                                              F.col("__line").cast("string")).alias("message"))


def missing_required(observed: DataFrame, key: str = "path", required: dict[str, str] | None = None) -> DataFrame:
    """Required entries absent from the observed keys (left-anti join of the
    small expected table against the observed keys)."""
    spark = observed.sparkSession
    req = required or REQUIRED
    expected = spark.createDataFrame([(k, v) for k, v in req.items()], "path string, message string")
    obs = observed.select(F.col(key).cast("string").alias("path")).distinct()
    return expected.join(obs, "path", "left_anti").select(F.lit("FAIL").alias("level"), "path", "message")


def summarise(findings: Iterable[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """D5 + U3: all findings stacked, and the roll-up ``failures, warnings, passed``."""
    fs = list(findings)
    allf = fs[0]
    for f in fs[1:]:
        allf = allf.unionByName(f)
    roll = allf.agg(F.count_if(F.col("level") == "FAIL").alias("failures"),
                    F.count_if(F.col("level") == "WARN").alias("warnings"))
    return allf, roll.withColumn("passed", F.col("failures") == 0)
