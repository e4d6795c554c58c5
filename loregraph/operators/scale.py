"""Building blocks that keep plans safe under skew and growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
LOOKUP_ROWS = 1_000_000  # of a number and a name
SLICE_BYTES = 1 << 30    # of input whose shuffles are on disk at a time
FAN_IN = 64   # input partitions of a slice
TINY_BYTES = 256 << 10
MANY_GROUPS = 1000
UNKNOWN_BYTES = 1 << 60  # Spark's estimate of what it knows nothing of is larger


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is shown to fit a broadcast; reads at most ``max_rows + 1`` of its rows.

    Meant for request-sized or staged frames: it runs a job.
    """
    size = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(8))
    seen = df.select(size.alias("size")).limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    row = seen.first()
    return row.n <= max_rows and (row.b or 0) <= max_bytes


def hint_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only if it is shown to be small; otherwise leave the join to shuffle."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def of_groups(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``group_id`` is among those of ``groups``.

    Up to a thousand groups become a filter that prunes partitions before the scan; more
    of them stay distributed and meet ``df`` in a semi-join.
    """
    wanted = groups.select("group_id").distinct()
    few = [row.group_id for row in wanted.limit(MANY_GROUPS + 1).collect()]
    if len(few) <= MANY_GROUPS:
        return df.filter(F.col("group_id").isin(few))
    return df.join(wanted, "group_id", "left_semi")


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    """First ``n`` rows of every group with their 1-based ``rank``; ``order`` must be total.

    Every task cuts its rows to ``n`` per group before the shuffle. What is left of a group
    is then ranked in slices of ``FAN_IN`` neighbouring input partitions, and only ``n`` rows per
    slice meet in the end. So a slice never ranks more than ``FAN_IN * n`` rows of a group,
    however large the input; there are as many slices as it has partitions by ``FAN_IN``. A
    slice is made of whole partitions, so slicing costs the first cut nothing; the result does
    not depend on the slices.
    """
    sliced = Window.partitionBy(*group, "_slice").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_slice", F.floor(F.spark_partition_id() / F.lit(FAN_IN)))
        .withColumn(rank, F.row_number().over(sliced)).filter(F.col(rank) <= n)
        .withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n)
        .drop("_slice")
    )


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``; an aggregate, so copies of a hot key are
    reduced before the shuffle (a ``row_number`` would send them all to one task)."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash the rows of a modest input over all cores before per-row heavy work.

    A file with a single row group is read by one task however many cores there are.
    Inputs with enough splits for the cluster, and tiny ones, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not TINY_BYTES <= scan_bytes(df) < cores * (16 << 20):
        return df
    return df.repartition(cores, key)


def scan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files ``df`` reads, as far as Spark knows them; no job is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN_BYTES)


def by_bytes(df: DataFrame, of: DataFrame, max_bytes: int, *keys: str) -> DataFrame:
    """``df`` by ``keys``, in as many partitions as what ``of`` reads has ``max_bytes``: the default number
    doesn't grow with the input, and adaptive execution only merges partitions."""
    parts = -(-input_bytes(of) // max_bytes)
    if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(*keys)
    return df.repartition(parts, *keys)


def in_slices(df: DataFrame, *keys: str) -> list[DataFrame]:
    """``df`` in slices by ``keys``, one for every ``SLICE_BYTES`` of what it reads. Staged one after another
    (``materialize(*slices)``) the disk holds what one of them shuffles, and each reads the input again."""
    slices = -(-input_bytes(df) // SLICE_BYTES)
    if slices <= 1:
        return [df]
    return [df.filter(F.pmod(F.xxhash64(*keys), F.lit(slices)) == i) for i in range(slices)]
