"""Shared-folder helpers of the ``llm`` operators.

Everything an operator leaves for a later job lies under the folder that the session
names in ``spark.checkpoint.dir``.  Only where that setting is empty in a local session
(tests) a scratch folder is made and set.  Lineage is cut by a written Parquet table, so a
lost executor costs the running tasks and nothing that was written before.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.session import ensure_checkpoint_dir

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: What Python workers are started with: memory that a task gives back goes to the system.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1048576", "OMP_NUM_THREADS": "1"}
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver found it (a cluster that
    gets the package with ``--py-files`` needs nothing more), and keep what is in flight
    between them and the JVM small: texts are long, so Arrow batches are bounded by bytes."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in parts:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *parts])
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if re.fullmatch(r"-1b?|67108864b?", spark.conf.get(key)):  # no bound, or the default
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a new scratch folder if it is unset in
    a local session (a cluster without a shared folder is refused)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or ensure_checkpoint_dir(spark)).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The address of a folder of its own in the shared folder."""
    return f"{shared_dir(spark)}/caliper-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def row_keys(df: DataFrame, id_col: str, key: str) -> DataFrame:
    """``df`` with a long column ``key`` of its own for every row, in the order of ``id_col``
    (nulls last).  Where ids are whole numbers, present and unique, the key is the id; else
    rows are numbered in a written table.  One id may have any share of the rows: they are
    dealt by the id and their place."""
    id_ = F.col(f"`{id_col}`").cast("long")
    if df.groupBy(id_.alias("id")).count().where("count > 1 or id is null").isEmpty():
        return df.withColumn(key, id_)
    order = [F.asc_nulls_last("__id"), F.asc("__place")]
    placed = df.withColumns({"__id": id_, "__place": F.monotonically_increasing_id()})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id())
    return written(numbered.drop("__id", "__place"), "row-keys")


def delete(spark: SparkSession, address: str) -> None:
    """Delete a folder of :func:`new_folder` that no later job reads."""
    if "/caliper-llm/" not in address:
        raise ValueError(f"not a folder of this module: {address}")
    path = spark._jvm.org.apache.hadoop.fs.Path(address)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(address: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system and the path in it for a folder or file address."""
    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address[5:].lstrip("/")
    if "://" in address:
        return fs.FileSystem.from_uri(address)
    return fs.LocalFileSystem(), address


def put_file(address: str, write) -> None:
    """Write a file whole or not at all: ``write(stream)`` fills a name of this attempt,
    which then takes the final name.  A repeated or speculative task writes the same
    bytes, so whichever attempt ends last leaves the same file."""
    system, path = filesystem(address)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.attempt"
    with system.open_output_stream(attempt) as out:
        write(out)
    system.move(attempt, path)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes in ``column`` (one
    row at least), so that working memory follows ``limit`` and the longest single text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def as_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names of their own: whatever other
    columns a table has, and however they are called, can't clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
