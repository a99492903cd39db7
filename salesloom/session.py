"""Session settings the jobs expect, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the skew work: a hot product or customer splits
# into several join tasks, and broadcasts happen only below the size threshold.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = 8, name: str = "salesloom", shuffle_partitions: int = 8) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints: the cluster's own, or a local one where unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not configured and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="salesloom-"))
        current = context.getCheckpointDir()
    return configured or current


_noted: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The scratch paths that are given out meanwhile, for an owner who removes them."""
    paths: list[str] = []
    _noted.append(paths)
    try:
        yield paths
    finally:
        _noted[:] = [p for p in _noted if p is not paths]  # by identity: an owner inside another may list the same paths


def remove(spark: SparkSession, paths: list[str], unless_read_by: DataFrame | None = None) -> list[str]:
    """Deletes scratch paths; those that a frame still reads stay and are returned."""
    read = unless_read_by.inputFiles() if unless_read_by is not None else []
    kept = [p for p in paths if any(p.rsplit("/", 1)[-1] in f for f in read)]
    for path in set(paths) - set(kept):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return kept


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _noted:
        paths.append(path)
    return path


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read from there."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
