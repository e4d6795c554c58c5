"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan in this package is written for.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot name or tenant shows up as one big join partition; let AQE split it.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Top-n per group is cut before its shuffle up to this n.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
}

# Spark removes the shuffle files of a query that ends while this is set.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loregraph")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster it would
    be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="loregraph-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Staged folders made inside are removed at the end: for jobs that write their results themselves.

    Frames made inside cannot be read afterwards. Blocks may be nested, but not shared by threads."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path for staged data that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``more`` frames of the same columns go to the same folder.

    Several sinks then reuse it, a lost executor does not redo its lineage, and being
    Parquet it still prunes columns and has a known size, by which Spark picks joins.
    What a write shuffled is of no use to another job, so its files go with its end: frames
    that are slices of a whole, written one after another, hold the shuffles of one slice at a time.
    """
    spark = df.sparkSession
    path = new_folder(spark, "staged")
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    kept = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        for part in (df, *more):
            part.write.mode("append").parquet(path)
    finally:
        if kept is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, kept)
    return spark.read.schema(df.schema).parquet(path)
