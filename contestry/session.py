"""Session helpers: where intermediate tables go, and a local test session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local-mode session
    may fall back to a folder of its own, because there every task sees the
    driver's disk.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="contestry-")
    return _local_roots[app]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let iterative fits checkpoint: keep the cluster's folder, else use ours."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch root; nothing is ever overwritten."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/contestry/{app}/{label}-{uuid.uuid4().hex[:12]}"


#: Compression of intermediate tables, which are written once and read a few times.
COMPRESSION = "zstd"


def materialise(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", COMPRESSION)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cores: int | str = 8, app_name: str = "contestry") -> SparkSession:
    """A single-JVM session for tests and the benchmark, with a checkpoint folder of its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(_CHECKPOINT_KEY, tempfile.mkdtemp(prefix="contestry-"))
        .getOrCreate()
    )
