"""Request validation and the row forms of the three ingest requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions import defaults, domains, keys, text

REQUIRED = {
    "episode": ["client_slug", "engagement_id", "episode_type", "content", "source_id", "source_type", "ingest_seq"],
    "bootstrap": ["client_slug", "engagement_id", "documents", "ingest_seq"],
    "structured": ["client_slug", "episode_name", "ingest_seq"],
    "search": ["client_slug", "engagement_id", "query"],
}


def rejection(kind: str) -> Column:
    """Why a request is rejected, NULL when it is valid."""
    checks = [(F.col(c).isNull(), f"missing {c}") for c in REQUIRED[kind]]
    if kind == "episode":
        checks.append((~F.col("episode_type").isin(domains.EPISODE_TYPES), "unknown episode_type"))
    if kind == "search":
        checks.append((~F.coalesce("max_results", F.lit(10)).between(1, 50), "max_results not in 1..50"))
    if kind == "structured":
        for array, fields in (("entities", ["name", "type"]), ("relationships", ["source", "target", "relation"])):
            for field in fields:
                missing = F.array_contains(F.transform(F.col(f"{array}.{field}"), F.isnull), F.lit(True))
                checks.append((F.coalesce(missing, F.lit(False)), f"missing {array}.{field}"))
    case = F
    for test, reason in checks:
        case = case.when(test, F.lit(reason))
    return case


def validate(requests: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Split requests into (valid, rejected with a ``reason``)."""
    checked = requests.withColumn("reason", rejection(kind))
    return checked.filter("reason IS NULL").drop("reason"), checked.filter("reason IS NOT NULL")


def structured_rows(requests: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested structured requests as (episodes, entity rows, relationship rows)."""
    now = F.current_timestamp() if now is None else now
    base = requests.withColumn("group_id", keys.client_graph("client_slug")).withColumn(
        "episode_uuid", keys.episode_id("group_id", "ingest_seq", "episode_name")
    )
    episodes = base.select(
        "group_id", "episode_uuid", F.col("ingest_seq").alias("seq"), F.col("episode_name").alias("name"),
        F.lit("").alias("content"), F.coalesce("source_description", F.lit("")).alias("source_description"),
        F.coalesce("reference_time", now).alias("valid_at"), now.alias("created_at"),
    )
    head = ["group_id", "episode_uuid", F.col("ingest_seq").alias("seq")]
    entities = base.select(*head, F.posexplode("entities").alias("pos", "e")).select(
        "group_id", "episode_uuid", "seq", F.col("pos").cast("long"), "e.name", "e.type", "e.description"
    )
    relationships = base.select(*head, F.posexplode("relationships").alias("pos", "r")).select(
        "group_id", "episode_uuid", "seq", F.col("pos").cast("long"), "r.source", "r.target", "r.relation", "r.fact"
    )
    return episodes, entities, relationships


def occurrences(entities: DataFrame) -> DataFrame:
    """Entity rows with defaults applied; blank names are skipped."""
    return entities.select(
        "group_id", "episode_uuid", "seq", "pos",
        keys.strip("name").alias("name"), keys.normalize_name("name").alias("name_lower"),
        defaults.entity_label("type").alias("label"), defaults.entity_summary("description").alias("summary"),
    ).filter("name_lower <> ''")


def relations(relationships: DataFrame) -> DataFrame:
    """Relationship rows with normalized endpoints and defaults applied."""
    return relationships.select(
        "group_id", "episode_uuid", "seq", "pos",
        keys.normalize_name("source").alias("source_key"), keys.normalize_name("target").alias("target_key"),
        defaults.fact_name("relation").alias("name"), defaults.fact_text("fact", "relation").alias("fact"),
    )


def episode_rows(requests: DataFrame, now: Column | None = None) -> DataFrame:
    """Text episode requests as episodes with enriched content."""
    now = F.current_timestamp() if now is None else now
    named = requests.select(
        keys.client_graph("client_slug").alias("group_id"), F.col("ingest_seq").alias("seq"),
        text.episode_name("episode_type", "source_type", "source_id").alias("name"),
        text.enrich_content("content", "metadata").alias("content"),
        text.episode_description("engagement_id", "episode_type", "source_type").alias("source_description"),
        F.coalesce("timestamp", now).alias("valid_at"), now.alias("created_at"),
    )
    return named.withColumn("episode_uuid", keys.episode_id("group_id", "seq", "name"))


def bootstrap_rows(requests: DataFrame, now: Column | None = None) -> DataFrame:
    """One episode per document, in array order.

    ``seq`` orders the documents of the batch, request after request: the request's number times
    the longest request's length, plus the document's place. Ids are made from the two numbers
    themselves, and a product beyond 64 bits fails instead of wrapping.
    """
    now = F.current_timestamp() if now is None else now
    longest = requests.agg(F.max(F.size("documents"))).first()[0] or 1
    each = requests.select(
        keys.client_graph("client_slug").alias("group_id"), F.col("ingest_seq").alias("request_seq"),
        F.posexplode("documents").alias("doc_pos", "doc"),
    )
    named = each.select(
        "group_id", "request_seq", F.col("doc_pos").cast("long"), F.col("doc")["name"].alias("document"),
        (F.col("request_seq") * F.lit(int(longest)).cast("long") + F.col("doc_pos")).alias("seq"),
        text.bootstrap_name("doc").alias("name"), F.coalesce(F.col("doc")["content"], F.lit("")).alias("content"),
        text.bootstrap_description("doc").alias("source_description"),
        F.coalesce(F.nullif(F.col("doc")["timestamp"], F.lit("")).cast("timestamp"), now).alias("valid_at"),
        now.alias("created_at"),
    )
    return named.withColumn("episode_uuid", keys.episode_id("group_id", F.concat_ws("/", "request_seq", "doc_pos"), "name"))
