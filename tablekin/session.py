"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g", scratch: str | None = None) -> SparkSession:
    """Session for tests and benches; a cluster brings its own. ``scratch`` becomes ``spark.checkpoint.dir``."""
    builder = SparkSession.builder if scratch is None else SparkSession.builder.config("spark.checkpoint.dir", scratch)
    return (
        builder.master(f"local[{cores}]")
        .appName("tablekin")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _LOCAL_SCRATCH.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="tablekin-"))


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    return os.path.join(scratch_root(spark), f"tablekin-{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage and keeps column pruning; a lost executor costs a file read, not a recompute.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that comes in fewer pieces than there are cores, dealt out to all of them.

    Large tables have enough pieces and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to a stated number of tasks.

    For groups whose work is large next to their bytes: without a number, small shuffles are merged into few tasks.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)
