"""Findings -> drafts -> review -> promotion into segment graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions import keys, redact, text
from loregraph.operators import resolve
from loregraph.plans import ingest

DRAFT, APPROVED, REJECTED = "draft", "approved", "rejected"


def draft_insights(findings: DataFrame, placeholder: str = redact.CLIENT_PLACEHOLDER) -> DataFrame:
    """Anonymized drafts beside their originals, for review; other columns pass through.

    ``client_name`` and ``known_names`` are optional columns of the findings.
    """
    client = F.col("client_name") if "client_name" in findings.columns else None
    names = F.col("known_names") if "known_names" in findings.columns else None
    fields = {"title", "content", "type", "client_name", "known_names"}

    def given(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("")) if column in findings.columns else F.lit("")

    rows = findings.select(
        *[c for c in findings.columns if c not in fields],
        given("title").alias("original_title"), given("content").alias("original_content"),
        given("type").alias("finding_type"),
        *[c.alias(n) for c, n in ((client, "_client"), (names, "_names")) if c is not None],
    )
    options = {
        "client": F.col("_client") if client is not None else None,
        "names": F.col("_names") if names is not None else None,
        "placeholder": placeholder,
    }
    return rows.select(
        *[c for c in rows.columns if c not in ("_client", "_names", "finding_type")],
        redact.redact("original_title", **options).alias("draft_title"),
        redact.redact("original_content", **options).alias("draft_content"),
        "finding_type", F.lit(DRAFT).alias("status"),
    )


def review(drafts: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Set the status of drafts from (key, approved) decisions; undecided ones stay drafts.

    Of several decisions on one draft a rejection counts."""
    verdict = (
        F.when(F.col("approved"), F.lit(APPROVED)).when(~F.col("approved"), F.lit(REJECTED)).otherwise(F.lit(DRAFT))
    )
    joined = drafts.drop("status").join(decisions.groupBy(key).agg(F.min("approved").alias("approved")), key, "left")
    return joined.withColumn("status", verdict).drop("approved")


def promotion_episodes(drafts: DataFrame, now: Column | None = None) -> DataFrame:
    """Approved drafts as episodes of their industry's segment graph.

    ``drafts`` carries ``industry``, ``source_description`` and ``ingest_seq``.
    """
    now = F.current_timestamp() if now is None else now
    named = drafts.filter(F.col("status") == APPROVED).select(
        keys.segment_graph("industry").alias("group_id"), F.col("ingest_seq").alias("seq"),
        text.insight_name("industry").alias("name"), F.col("draft_content").alias("content"),
        "source_description", now.alias("valid_at"), now.alias("created_at"),
    )
    return named.withColumn("episode_uuid", keys.episode_id("group_id", "seq", "name"))


def promote(
    drafts: DataFrame, gazetteer: DataFrame | None, stored: DataFrame | None = None, now: Column | None = None
) -> resolve.Resolution:
    return ingest.ingest_text(promotion_episodes(drafts, now), gazetteer, stored)
