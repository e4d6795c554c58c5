"""Stored graphs the registered queries read, built from the given tables once per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.functions import domains
from loregraph.plans.ingest import ingest_structured
from loregraph.session import materialize, new_folder
from loregraph.sources.store import GraphStore
from loregraph.streaming.ingest import stream_structured
from workload import inputs

_BUILT: dict[tuple[str, str], GraphStore] = {}


def fixed_now():
    """A fixed ingest time, so that stored rows can be compared."""
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def staged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order requests, staged: an ingest reads them once per frame, and so orders meet customers only once."""
    return materialize(inputs.order_requests(spark, sf_dir))


def order_store(spark: SparkSession, sf_dir: str) -> GraphStore:
    """All order requests ingested into an empty store."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        store = GraphStore(spark, new_folder(spark, "orders"))
        requests = staged_requests(spark, sf_dir)
        store.append(ingest_structured(requests, None, fixed_now()), "all", fixed_now())
        _BUILT[key] = store
    return _BUILT[key]


def slugs(spark: SparkSession, sf_dir: str, *kept: str) -> DataFrame:
    """Admin requests, one per market segment; only the ``kept`` ones carry the right sentence."""
    confirm = F.when(F.col("c_mktsegment").isin(list(kept)), F.lit(domains.CONFIRM_SENTENCE)).otherwise(
        F.lit(domains.CONFIRM_SENTENCE.lower())
    )
    segments = inputs.table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    return segments.select(F.col("c_mktsegment").alias("client_slug"), confirm.alias("confirm"))


def administered_store(spark: SparkSession, sf_dir: str) -> GraphStore:
    """Order graphs after an init of the region graphs, a reset and a delete."""
    store = GraphStore(spark, new_folder(spark, "admin"))
    requests = staged_requests(spark, sf_dir)
    store.append(ingest_structured(requests, None, fixed_now()), "all", fixed_now())
    store.init_graphs(inputs.table(spark, sf_dir, "region").select(F.col("r_name").alias("client_slug")))
    store.init_graphs(slugs(spark, sf_dir))
    store.reset_graphs(slugs(spark, sf_dir, "MACHINERY"))
    store.delete_graphs(slugs(spark, sf_dir, "BUILDING"))
    return store


def streamed_store(spark: SparkSession, sf_dir: str, steps: int = 3) -> GraphStore:
    """Order requests arriving in ``steps`` files-at-a-time, in request order."""
    store = GraphStore(spark, new_folder(spark, "stream"))
    landing, checkpoint = new_folder(spark, "landing"), new_folder(spark, "progress")
    requests = inputs.order_requests(spark, sf_dir)
    low, high = requests.agg(F.min("ingest_seq"), F.max("ingest_seq")).first()
    width = (high - low) // steps + 1
    for step in range(steps):
        start = low + step * width
        arriving = requests.filter(F.col("ingest_seq").between(start, start + width - 1))
        arriving.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(requests.schema).parquet(landing)
        running = stream_structured(stream, store, checkpoint).trigger(availableNow=True).start()
        running.awaitTermination()
    return store
