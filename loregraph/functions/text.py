"""Text expressions: naming, enrichment, tokens and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loregraph.functions.keys import _col, strip

TOKEN_BREAK = r"[^\p{L}\p{N}]+"
SENTENCE_BREAK = r"[.!?\n]+"


def episode_name(kind: Column | str, source_type: Column | str, source_id: Column | str) -> Column:
    return F.concat(_col(kind), F.lit(": "), _col(source_type), F.lit("/"), _col(source_id))


def episode_description(engagement: Column | str, kind: Column | str, source_type: Column | str) -> Column:
    return F.concat(
        F.lit("Engagement "), _col(engagement), F.lit(" — "), _col(kind), F.lit(" from "), _col(source_type)
    )


def enrich_content(content: Column | str, metadata: Column | str) -> Column:
    """Put non-empty metadata in front of the text; pairs follow each other without a break."""
    pairs = F.transform(
        F.map_entries(_col(metadata)),
        lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))),
    )
    enriched = F.concat(F.lit("Metadata:\n"), F.array_join(pairs, ""), F.lit("\n\n"), _col(content))
    return F.when(F.coalesce(F.size(_col(metadata)), F.lit(0)) > 0, enriched).otherwise(_col(content))


def bootstrap_name(document: Column | str) -> Column:
    return F.concat(F.lit("bootstrap: "), F.coalesce(_col(document)["name"], F.lit("unknown")))


def bootstrap_description(document: Column | str) -> Column:
    return F.concat(F.lit("Bootstrap document: "), F.coalesce(_col(document)["category"], F.lit("general")))


def insight_name(industry: Column | str) -> Column:
    return F.concat(F.lit("segment_insight: "), _col(industry))


def tokens(text: Column | str) -> Column:
    """Lower-case letter/digit runs, in order and with repeats."""
    return F.array_remove(F.split(F.lower(_col(text)), TOKEN_BREAK), "")


def token_key(text: Column | str) -> Column:
    """The n-gram key of a name: its tokens joined by single spaces."""
    return F.array_join(tokens(text), " ")


def sentences(text: Column | str) -> Column:
    """Trimmed sentences; empty pieces stay, so that positions match the split."""
    return F.transform(F.split(_col(text), SENTENCE_BREAK), strip)

