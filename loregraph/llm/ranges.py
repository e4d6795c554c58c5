"""Documents in ranges of their order, each range with the row that follows it."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_RANGE = 64


def range_of(rows: DataFrame, key: str, parts: int, bounds_of: DataFrame | None = None) -> DataFrame:
    """Add ``bucket int``: the range of the numeric column ``key`` among at most ``parts`` of like size.

    Bounds are quantiles of about ``PER_RANGE * parts`` distinct keys, chosen by a hash of the key, of all rows
    (of ``bounds_of``, if given), so they are the same however the rows are partitioned. They only
    decide which task gets a row. A null key is in the first range."""
    keys = (rows if bounds_of is None else bounds_of).select(F.col(key).alias("k")).filter(F.col(key).isNotNull())
    share = min(1.0, PER_RANGE * parts / max(1, keys.count()))
    chosen = keys.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else keys
    chosen = sorted(float(r.k) for r in chosen.distinct().collect())
    cuts = [chosen[len(chosen) * i // parts] for i in range(1, parts)] if chosen else []
    if not cuts:
        return rows.withColumn("bucket", F.lit(0))
    bounds = [float("-inf"), *sorted(set(cuts)), float("inf")]
    number = rows.withColumn("_key", F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    found = Bucketizer(splits=bounds, inputCol="_key", outputCol="_bucket").transform(number)
    return found.withColumn("bucket", F.col("_bucket").cast("int")).drop("_key", "_bucket")


def range_buckets(rows: DataFrame, order: list[str], tie: Column) -> DataFrame:
    """``rows`` in partitions by ranges of ``order[0]``, sorted by bucket and order, with columns
    ``bucket``, ``guest`` (0 or 1). Each bucket ends with a guest: the first row of the next bucket
    that has rows, after the last that of the first. Only one row per bucket comes to the driver."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = range_of(rows, order[0], parts).withColumn("_tie", tie)
    key = F.struct(*order, "_tie")
    firsts = sorted(placed.groupBy("bucket").agg(F.min(key).alias("first")).collect(), key=lambda r: r.bucket)
    if not firsts:
        return placed.withColumn("guest", F.lit(0)).drop("_tie")
    before = [(r.bucket, r.first, firsts[i - 1].bucket) for i, r in enumerate(firsts)]
    kinds = {f.name: f.dataType for f in placed.schema}
    inner = ", ".join(f"{c}: {kinds[c].simpleString()}" for c in [*order, "_tie"])
    table = rows.sparkSession.createDataFrame(before, f"bucket int, _first struct<{inner}>, _before int")
    own = F.struct(F.col("bucket"), F.lit(0).alias("guest"))
    visit = F.struct(F.col("_before").alias("bucket"), F.lit(1).alias("guest"))
    homes = F.when(key.eqNullSafe(F.col("_first")), F.array(own, visit)).otherwise(F.array(own))
    dealt = placed.join(F.broadcast(table), "bucket").withColumn("_home", F.explode(homes))
    dealt = dealt.withColumn("bucket", F.col("_home.bucket")).withColumn("guest", F.col("_home.guest"))
    dealt = dealt.drop("_home", "_first", "_before").repartitionById(parts, F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "guest", *order, "_tie").drop("_tie")
