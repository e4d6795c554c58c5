"""Ingest plans: structured requests, text episodes and bootstrap documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.operators import extract, requests, resolve


def ingest_structured(
    structured: DataFrame, stored: DataFrame | None = None, now: Column | None = None, staged: bool = True
) -> resolve.Resolution:
    """Resolve valid structured requests against ``stored`` entities of the same graphs.

    ``staged`` runs jobs right away to write the name dictionary, which all frames share.
    """
    valid, _ = requests.validate(structured, "structured")
    episodes, entities, relationships = requests.structured_rows(valid, now)
    return ingest_rows(episodes, entities, relationships, stored, staged)


def ingest_rows(
    episodes: DataFrame, entities: DataFrame, relationships: DataFrame,
    stored: DataFrame | None = None, staged: bool = True,
) -> resolve.Resolution:
    """The same for rows that are already flat, as a large load should be."""
    return resolve.resolve(
        episodes, requests.occurrences(entities), requests.relations(relationships), stored, staged
    )


def ingest_text(
    episodes: DataFrame, gazetteer: DataFrame | None, stored: DataFrame | None = None, staged: bool = True
) -> resolve.Resolution:
    """Extract known names from episode texts, then resolve them like structured rows.

    Known are the gazetteer's names and those already in the graphs of the episodes; either
    may be missing.
    """
    entities, relationships = extract.extract(episodes, gazetteer, stored)
    return ingest_rows(episodes, entities, relationships, stored, staged)


def ingest_episodes(
    episode_requests: DataFrame, gazetteer: DataFrame | None, stored: DataFrame | None = None, now: Column | None = None
) -> resolve.Resolution:
    valid, _ = requests.validate(episode_requests, "episode")
    return ingest_text(requests.episode_rows(valid, now), gazetteer, stored)


def bootstrap(
    bootstrap_requests: DataFrame, gazetteer: DataFrame | None, stored: DataFrame | None = None, now: Column | None = None
) -> tuple[resolve.Resolution, DataFrame]:
    """Ingest all documents; also report the processed documents per request."""
    valid, _ = requests.validate(bootstrap_requests, "bootstrap")
    rows = requests.bootstrap_rows(valid, now)
    return ingest_text(rows, gazetteer, stored), bootstrap_report(rows)


def bootstrap_report(rows: DataFrame) -> DataFrame:
    """Documents processed per request, with (document, episode_id) in array order.

    The list regroups what one request row held, so it is as long as that request was.
    """
    listed = F.sort_array(F.collect_list(F.struct("doc_pos", "document", F.col("episode_uuid").alias("episode_id"))))
    return rows.groupBy("group_id", "request_seq").agg(
        F.count("*").alias("documents_processed"),
        F.transform(listed, lambda x: F.struct(x["document"], x["episode_id"])).alias("results"),
    )


def extraction_counts(result: resolve.Resolution) -> DataFrame:
    """Distinct entities and facts per episode, zero where none was found."""
    key = ["group_id", "episode_uuid"]
    none = F.lit(None).cast("string")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = (
        result.episodes.select(*key, none.alias("entity"), zero.alias("facts"))
        .union(result.mentions.select(*key, "entity_uuid", zero).distinct())
        .union(result.facts.select("group_id", F.col("episodes")[0], none, one))
    )
    return rows.groupBy(*key).agg(F.count("entity").alias("entities_extracted"), F.sum("facts").alias("facts_created"))
