"""Session helpers: a sane local/cluster session, checkpoint folder, checked broadcast."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "caliper", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with AQE and skew-join handling switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.  Where it is unset, a local
    master gets a scratch folder; a cluster is refused: its executors do not see each
    other's local folders, and re-reads would miss files."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="caliper-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver found it (a cluster that gets
    the package with ``--py-files`` needs nothing more)."""
    env = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
    env.setdefault("OMP_NUM_THREADS", "1")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and read it
    back (a written table survives executor loss; lineage is cut).

    Compared with ``Dataset.checkpoint()`` this runs the plan once (a reliable RDD
    checkpoint recomputes it unless cached) and stores columns, so later reads get
    column pruning and filter pushdown."""
    import uuid
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/caliper-tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast-hint ``df`` only after proving it has at most ``max_rows`` rows.

    The frame is written to the checkpoint folder once; the proof reads the row counts in
    its Parquet footers and the join reads the written rows, so nothing stays persisted.
    Beyond the bound the frame is returned unhinted: the planner uses a shuffle join and
    AQE splits skewed keys."""
    small = cut_lineage(df)
    return F.broadcast(small) if small.count() <= max_rows else small
