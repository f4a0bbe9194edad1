"""Table scans and sinks.

Scans are lazy ``spark.read`` calls (column pruning and filter pushdown come from
Catalyst); guards touch only file listings or a bounded ``limit(n)`` action.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUPPORTED = (".parquet", ".csv", ".txt")


class DatasetNotFound(FileNotFoundError):
    pass


def _exists(spark: SparkSession, path: str) -> bool:
    """Existence through the Hadoop FileSystem API so remote stores work too."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


CORRUPT = "_corrupt_record"
SAMPLE_LINES = 1000


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or CSV/TXT (header) by extension; a missing path raises
    ``DatasetNotFound``, any other extension ``ValueError``.  Of CSV, the rows that fit
    their types; :func:`read_csv` keeps the others, too."""
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix not in SUPPORTED:
        raise ValueError(f"Unsupported dataset format: {path}")
    if not _exists(spark, path):
        raise DatasetNotFound(f"Master dataset not found: {path}")
    if suffix == ".parquet":
        return spark.read.parquet(path)
    return accepted(read_csv(spark, path, schema))


def sampled_schema(spark: SparkSession, path: str, lines: int = SAMPLE_LINES) -> T.StructType:
    """Column names and types of a CSV from its first ``lines`` lines alone; whole numbers
    become long, so that larger ones further down fit."""
    head = [r["value"] for r in spark.read.text(path).limit(lines).collect()]
    told = spark.read.option("header", True).option("inferSchema", True).csv(spark.sparkContext.parallelize(head, 1)).schema
    return T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType) for f in told])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, sample_lines: int = SAMPLE_LINES) -> DataFrame:
    """A CSV with a header, read once, with types from ``schema`` or from its first
    lines.  A row with too many or too few fields, or with a value that isn't of its
    column's type, keeps its text in ``_corrupt_record``; see :func:`accepted` and
    :func:`rejected`."""
    schema = schema or sampled_schema(spark, path, sample_lines)
    fields = [f for f in schema.fields if f.name != CORRUPT]
    whole = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(whole).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def _all_parsed(csv: DataFrame) -> F.Column:
    """Always true, and reads every column: the reader only tells misfits of columns that a
    query reads, and whether a row fits must not hang on the query."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in csv.columns if c != CORRUPT]) >= F.lit(-(2**63))


def accepted(csv: DataFrame) -> DataFrame:
    """The rows of :func:`read_csv` that fit."""
    return csv.where(_all_parsed(csv) & F.col(CORRUPT).isNull()).drop(CORRUPT)


def rejected(csv: DataFrame, keep: int = 20) -> DataFrame:
    """One row: how many rows were read and rejected, and up to ``keep`` of their texts."""
    csv = csv.where(_all_parsed(csv))
    told = csv.agg(F.count(F.lit(1)).alias("rows_read"), F.count(CORRUPT).alias("rows_rejected"))
    some = csv.where(F.col(CORRUPT).isNotNull()).select(CORRUPT).limit(keep).agg(F.sort_array(F.collect_list(CORRUPT)).alias("texts"))
    return told.withColumn("texts", some.scalar())


def read_files(spark: SparkSession, path: str, max_bytes: int | None = None, pattern: str | None = None) -> DataFrame:
    """D1 on files: ``path, size, text`` of all files below a folder whose bytes are UTF-8;
    others can't hold text to scan and are left out, as are empty files.  ``max_bytes`` (off by default) skips
    larger files before they are opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    text = F.col("content").cast("string")
    return files.where(F.is_valid_utf8(text)).select("path", F.col("length").alias("size"), text.alias("text"))


def require_inputs(spark: SparkSession, paths: dict[str, str]) -> None:
    """Check every named input first and report all missing ones in one error."""
    missing = {k: v for k, v in paths.items() if not _exists(spark, v)}
    if missing:
        raise FileNotFoundError("Missing required inputs: " + ", ".join(f"{k}={v}" for k, v in missing.items()))


def require_rows(df: DataFrame, min_rows: int) -> int:
    """Bounded row guard — reads at most ``min_rows`` rows."""
    n = df.limit(min_rows).count()
    if n < min_rows:
        raise RuntimeError(
            "Master dataset was not loaded correctly: "
            f"found {n} rows, expected at least {min_rows}.")
    return n


CALENDAR_SCHEMA = T.StructType([
    T.StructField("england-and-wales", T.StructType([
        T.StructField("events", T.ArrayType(T.StructType([
            T.StructField("title", T.StringType()),
            T.StructField("date", T.StringType()),
        ]))),
    ])),
])


def read_calendar(spark: SparkSession, path: str, region: str = "england-and-wales") -> DataFrame:
    """Nested calendar JSON -> rows ``(date, is_bank_holiday=1, bank_holiday_title)``.

    An absent region / events list gives an empty, typed frame; a NULL title becomes
    ``unknown``; unparseable dates become NULL."""
    schema = T.StructType([T.StructField(region, CALENDAR_SCHEMA.fields[0].dataType)])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    ev = raw.select(F.explode(F.coalesce(F.col(f"`{region}`.events"),
                                         F.array().cast(schema.fields[0].dataType["events"].dataType))).alias("e"))
    return ev.select(
        F.coalesce(F.try_to_date(F.col("e.date"), "yyyy-MM-dd"), F.try_to_date(F.col("e.date"), "dd/MM/yyyy")).alias("date"),
        F.lit(1).alias("is_bank_holiday"),
        F.coalesce(F.col("e.title"), F.lit("unknown")).alias("bank_holiday_title"),
    )


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Parquet sink (``mode='ignore'`` keeps an existing landed file)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_keyed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """A table stored in ``buckets`` hash buckets of ``key``, each sorted by it.  Joins
    and groupings on the key read it without a shuffle; a side that isn't stored so is
    dealt into the same buckets.  Rows are dealt before the write, so each bucket is one
    file.  Returns the stored table."""
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def write_report(df: DataFrame, path: str, fmt: str = "csv", single_file: bool = True) -> None:
    """Small report sinks.  ``single_file`` coalesces to one partition and must
    only be used for bounded reports (metrics, sweeps); row-level outputs keep their
    partitioning."""
    out = df.coalesce(1) if single_file else df
    if fmt == "csv":
        out.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        out.write.mode("overwrite").json(path)
    else:
        raise ValueError(fmt)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One nested JSON document (objects stay objects)."""
    text = F.lit(json.dumps(document, default=str))
    spark.range(1).select(F.from_json(text, F.schema_of_json(text)).alias("d")).select("d.*") \
        .coalesce(1).write.mode("overwrite").json(path)


def land(src: DataFrame, dst: str, date_col: str | None = None, lo: str | None = None, hi: str | None = None,
         if_exists: str = "overwrite", source: str | None = None, partition_by: list[str] | None = None,
         manifest: str | None = None) -> DataFrame:
    """Source -> optional inclusive date window -> landed parquet.  Returns the
    landing manifest row (S13): source, rows, min/max date, output, timestamp.

    With ``partition_by`` a run replaces the partitions that its rows fall into and leaves
    the others, so runs over parts of the source, in any order and repeated, end in one
    state; the counts are then those of the run's rows.  ``manifest`` names a table to which
    the row is added by :func:`record_landing`."""
    from caliper.operators.enrich import date_window, normalise_dates
    from caliper.session import cut_lineage

    df = src
    if date_col:
        df = date_window(normalise_dates(df, date_col), date_col, lo, hi)
    if partition_by:
        df = cut_lineage(df)  # read for the write and for the counts; may come from the landed table itself
        writer = df.write.mode(if_exists).partitionBy(*partition_by)
        (writer.option("partitionOverwriteMode", "dynamic") if if_exists == "overwrite" else writer).parquet(dst)
        landed = df
    else:
        write_table(df, dst, mode=if_exists)
        landed = src.sparkSession.read.parquet(dst)
    aggs = [F.count(F.lit(1)).alias("rows")]
    if date_col:
        aggs += [F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date")]
    row = landed.agg(*aggs).withColumns({
        "source": F.lit(source),
        "output": F.lit(dst),
        "from_date": F.lit(lo),
        "to_date": F.lit(hi),
        "landed_at_utc": F.current_timestamp(),
    })
    return record_landing(row, manifest) if manifest else row


def record_landing(row: DataFrame, manifest: str) -> DataFrame:
    """Add a landing to an append-only manifest table.  A landing that equals one
    recorded before in all but its time adds nothing, so a repeated run leaves the manifest
    as it is.  Returns the manifest's row for the landing."""
    spark = row.sparkSession
    facts = [c for c in row.columns if c != "landed_at_utc"]
    key = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(facts)]), {"ignoreNullFields": "false"}), 256)
    own = row.withColumn("landing", key).first()
    if _exists(spark, manifest):
        known = spark.read.parquet(manifest).where(F.col("landing") == own["landing"])
        if not known.isEmpty():
            return known
    spark.createDataFrame([own], row.withColumn("landing", key).schema).coalesce(1).write.mode("append").parquet(manifest)
    return spark.read.parquet(manifest).where(F.col("landing") == own["landing"])


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                 multiline: bool = False) -> DataFrame:
    """JSON records to score (one object per line, or one multi-line document).
    Fields beyond the model's features are carried along and ignored by scoring."""
    reader = spark.read.option("multiLine", multiline)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)
