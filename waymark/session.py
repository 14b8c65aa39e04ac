"""Session and shared-folder helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "waymark") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    A local session, whose driver and executors are one process, may leave it unset: a folder of our own is then made, once
    per session. A cluster has to name it, since a folder of one machine would lose data there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("waymark.shared.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that driver and executors of {master} share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("waymark.shared.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/waymark-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """As :func:`cut_lineage`, but packed: a checkpoint writes rows as they are, which takes several times the room. File sizes then say little
    about the rows, so large sides have to be joined with a hint."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so that lost executors do not replay a whole loop."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
