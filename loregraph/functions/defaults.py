"""Defaults of structured entities and relationships."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loregraph.functions.keys import _col, strip


def entity_label(kind: Column | str) -> Column:
    """Empty type -> ``Entity``; a whitespace-only type stays empty."""
    kind = F.coalesce(_col(kind), F.lit(""))
    return F.when(kind == "", F.lit("Entity")).otherwise(strip(kind))


def entity_summary(description: Column | str) -> Column:
    return strip(F.coalesce(_col(description), F.lit("")))


def fact_name(relation: Column | str) -> Column:
    """Empty relation -> ``relates_to``; a whitespace-only relation stays empty."""
    relation = F.coalesce(_col(relation), F.lit(""))
    return F.when(relation == "", F.lit("relates_to")).otherwise(strip(relation))


def fact_text(fact: Column | str, relation: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(fact), F.lit("")), _col(relation), F.lit(""))
