"""Structured requests as a stream: every micro-batch is one resolved ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import DataStreamWriter

from loregraph.functions import keys
from loregraph.plans.ingest import ingest_structured
from loregraph.session import scratch
from loregraph.sources.store import GraphStore, one_time


def ingest_batch(store: GraphStore, requests: DataFrame, batch_id: str, now: Column | None = None) -> None:
    """Ingest one batch; running it again rewrites the same rows.

    Entities this very batch wrote in an earlier attempt are not taken for stored ones,
    so a replay makes the same decisions as the first attempt.
    """
    now = one_time() if now is None else now
    groups = requests.select(keys.client_graph("client_slug").alias("group_id"))
    with scratch(store.spark):
        stored = store.entities_for(groups, batch_id)
        store.append(ingest_structured(requests, stored, now), batch_id, now)


def stream_structured(
    requests: DataFrame, store: GraphStore, checkpoint: str, prefix: str = "stream", compact_every: int | None = None
) -> DataStreamWriter:
    """A writer to start; ``ingest_seq`` must come from the source, since it orders episodes.

    With ``compact_every``, the store's batches are merged after so many micro-batches."""

    def each(batch: DataFrame, number: int) -> None:
        ingest_batch(store, batch, f"{prefix}-{number:012d}")
        if compact_every and number % compact_every == compact_every - 1:
            store.compact()

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
