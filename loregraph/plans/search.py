"""Context search: ranked client facts and segment insights for many queries in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.functions import domains, keys
from loregraph.operators import rank, requests
from loregraph.operators.scale import hint_if_small, of_groups
from loregraph.session import materialize

DEFAULT_RESULTS = 10
FACTS_RETURNED = 15
INSIGHTS_RETURNED = 5


def fact_result(facts: DataFrame) -> DataFrame:
    """Stored facts as search results; expired facts stay in."""
    return facts.select(
        "group_id", "uuid", F.col("source_uuid").alias("subject"), F.col("name").alias("predicate"),
        F.col("target_uuid").alias("object"), "fact", F.col("valid_at").alias("valid_from"),
        F.col("invalid_at").alias("valid_to"), "expired_at",
    )


def scoped_queries(search: DataFrame) -> DataFrame:
    """One row per query and graph to search: (query_id, scope, group_id, text, keep)."""
    wanted = F.least(F.coalesce("max_results", F.lit(DEFAULT_RESULTS)), F.lit(FACTS_RETURNED))
    client = search.select(
        "query_id", F.lit("client").alias("scope"), keys.client_graph("client_slug").alias("group_id"),
        F.col("query").alias("text"), wanted.alias("keep"),
    )
    segment = search.filter(F.coalesce("include_segment", F.lit(True))).select(
        "query_id", F.lit("segment"),
        keys.segment_graph(F.coalesce("industry", F.lit(domains.DEFAULT_INDUSTRY))),
        "query", F.lit(INSIGHTS_RETURNED),
    )
    return client.union(segment)


def ranked_facts(
    scoped: DataFrame, facts: DataFrame, fact_vectors: DataFrame | None = None, query_vectors: DataFrame | None = None,
) -> DataFrame:
    """(query_id, group_id, doc_id, rank): lexical, or where both vectors are given fused with them over
    the whole lists. A fact that is stored more than once is ranked once."""
    docs = facts.select("group_id", F.col("uuid").alias("doc_id"), F.col("fact").alias("text"))
    asked = scoped.select("query_id", "group_id", "text")
    if fact_vectors is None or query_vectors is None:
        return rank.bm25(docs, asked, FACTS_RETURNED)
    vectors = scoped.select("query_id", "group_id").join(query_vectors, "query_id")
    return rank.fuse_whole(docs, asked, fact_vectors, vectors, FACTS_RETURNED)


def search_hits(
    search: DataFrame, facts: DataFrame, fact_vectors: DataFrame | None = None, query_vectors: DataFrame | None = None,
) -> DataFrame:
    """One row per returned fact with its scope and rank."""
    scoped = scoped_queries(search)
    found = ranked_facts(scoped, facts, fact_vectors, query_vectors)
    kept = found.join(scoped.drop("text"), ["query_id", "group_id"]).filter("rank <= keep")
    # A handful of rows per query; staged, so that its size is known before it meets the facts.
    hits = materialize(kept.select("query_id", "scope", "group_id", F.col("doc_id").alias("uuid"), "rank"))
    rows = fact_result(of_groups(facts, hits)).join(hint_if_small(hits), ["group_id", "uuid"])
    # A request that was submitted again has stored its facts again, under the same ids.
    return rows.dropDuplicates(["query_id", "scope", "group_id", "uuid"])


def search_context(
    search: DataFrame, facts: DataFrame, fact_vectors: DataFrame | None = None, query_vectors: DataFrame | None = None,
) -> DataFrame:
    """One row per valid query: graph_name, at most 15 facts, at most 5 segment insights.

    A missing graph gives empty lists; empty segment facts drop out after the cut.
    """
    valid, _ = requests.validate(search, "search")
    hits = search_hits(valid, facts, fact_vectors, query_vectors)
    result = F.struct("rank", "subject", "predicate", "object", "fact", "valid_from", "valid_to", "expired_at")
    is_client = F.col("scope") == "client"
    is_insight = (F.col("scope") == "segment") & F.col("fact").isNotNull() & (F.col("fact") != "")
    answers = hits.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.when(is_client, result))).alias("facts"),
        F.sort_array(F.collect_list(F.when(is_insight, F.struct("rank", "fact")))).alias("insights"),
    )
    asked = valid.select("query_id", keys.client_graph("client_slug").alias("graph_name"))
    empty = F.array()
    return asked.join(answers, "query_id", "left").select(
        "query_id", "graph_name",
        F.coalesce(F.transform("facts", lambda x: x.dropFields("rank")), empty).alias("facts"),
        F.coalesce(F.transform("insights", lambda x: x["fact"]), empty).alias("segment_insights"),
    )
