"""Graph keys, name normalization and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a full-Unicode strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NOT_KEY_CHAR = r"[^\p{L}\p{N}_]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim all Unicode whitespace; plain ``trim`` only removes spaces."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def normalize_name(c: Column | str) -> Column:
    return F.lower(strip(c))


def graph_key(prefix: str, c: Column | str) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.lower(F.regexp_replace(_col(c), NOT_KEY_CHAR, "")))


def client_graph(slug: Column | str) -> Column:
    return graph_key("client", slug)


def segment_graph(industry: Column | str) -> Column:
    return graph_key("segment", industry)


def stable_id(*parts: Column | str) -> Column:
    """A uuid-shaped digest of ``parts``.

    Unlike ``uuid()`` it survives task retries and recomputed lineage, so ids written
    by one job always join to ids written by another.
    """
    texts = [F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]
    digest = F.md5(F.concat_ws("\x01", *texts))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def episode_id(group: Column | str, seq: Column | str, name: Column | str) -> Column:
    return stable_id(F.lit("episode"), group, seq, name)


def entity_id(group: Column | str, name_lower: Column | str) -> Column:
    return stable_id(F.lit("entity"), group, name_lower)


def fact_id(episode: Column | str, pos: Column | str) -> Column:
    return stable_id(F.lit("fact"), episode, pos)
