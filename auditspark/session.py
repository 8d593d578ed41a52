"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # sessions of one key merge inside each partition before the shuffle
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    n = shuffle_partitions or (os.cpu_count() or 8 if cores == "*" else int(cores))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("auditspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # iterative jobs run more statements than the 1,000 whose plans are kept for looking at scans
        .config("spark.sql.ui.retainedExecutions", "10000")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's own, or a fresh one in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="auditspark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise *df* on reliable storage so that a lost executor costs no recomputation chain."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """*df* as compressed columns beside the checkpoints: cuts lineage like one, in a fraction of the room for lists and texts."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores when a small input has fewer splits than that; large inputs stay as they are.

    For narrow rows in front of heavy per-row work. A scan that already has enough splits is not
    shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt evenly in front of heavy per-row work, four tasks a core or more.

    Splits follow a file's size, but rows lie in row groups: a split without a group of its own has nothing to do while
    another has all of several. A task's rows stay bounded, as the number grows with the splits.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(4 * tasks, *keys)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="auditspark-package-"), "auditspark")
    archive = shutil.make_archive(base, "zip", root_dir=os.path.dirname(root), base_dir="auditspark")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
