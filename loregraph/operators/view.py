"""Node and edge views of graphs.

Node frames hold (group_id, native_id, node_labels, labels, properties), edge frames
(group_id, source_* and target_* ids, rel_type, fact, and created_at and edge_uuid to order by).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions import labels, nodes
from loregraph.operators.rules import RULE_COLUMNS, rule_types
from loregraph.operators.scale import first_wins, top_n

EPISODIC = "Episodic"


def entity_nodes(entities: DataFrame) -> DataFrame:
    """Stored entities as node rows, with all their properties: their own map, and over it the columns."""
    shown = [c for c in ("uuid", "name", "summary", "group_id", "created_at") if c in entities.columns]
    columns = {c: F.col(c).cast("string") for c in shown}
    if "labels" in entities.columns:
        columns["labels"] = F.to_json("labels")
    own = F.create_map(*[x for name, value in columns.items() for x in (F.lit(name), value)])
    own = F.map_filter(own, lambda _, value: value.isNotNull())
    if "properties" in entities.columns:
        given = F.coalesce("properties", F.create_map().cast("map<string,string>"))
        own = F.map_concat(F.map_filter(given, lambda key, _: ~F.map_contains_key(own, key)), own)
    return entities.select(
        "group_id", F.lit(None).cast("long").alias("native_id"), F.array(F.lit("Entity")).alias("node_labels"),
        "labels", own.alias("properties"),
    )


def fact_edges(facts: DataFrame) -> DataFrame:
    """Stored facts as edge rows. Facts only ever link entities, so their ends need no label check."""
    none = F.lit(None)
    return facts.select(
        "group_id",
        "source_uuid", none.cast("string").alias("source_id"), none.cast("long").alias("source_native"),
        "target_uuid", none.cast("string").alias("target_id"), none.cast("long").alias("target_native"),
        "rel_type", "fact", _created(facts), F.col("uuid").alias("edge_uuid"),
    )


def _created(rows: DataFrame) -> Column:
    """``created_at`` of rows that carry it; within one ingest it is the same for all."""
    return F.col("created_at") if "created_at" in rows.columns else F.lit(None).cast("timestamp").alias("created_at")


def not_episodic(node_rows: DataFrame) -> DataFrame:
    """A node without labels is not episodic either."""
    return node_rows.filter(~F.coalesce(F.array_contains("node_labels", EPISODIC), F.lit(False)))


def typed_nodes(node_rows: DataFrame, rules=labels.RULES, tenant_rules: DataFrame | None = None) -> DataFrame:
    """Non-episodic nodes as (group_id, id, name, type, properties); a narrow projection.

    ``tenant_rules`` (see ``operators.rules``; rule_set is a graph) count with ``rules``, by priority."""
    props = F.col("properties")
    named = not_episodic(node_rows).select(
        "group_id", nodes.node_id("properties", "native_id").alias("id"),
        nodes.node_name("properties", "native_id").alias("name"),
        "node_labels", "labels", props["labels"].alias("labels_text"), props["summary"].alias("summary"),
        nodes.clean_properties("properties").alias("properties"),
    )
    typed_by = None
    if tenant_rules is not None:
        every = labels.rule_table(node_rows.sparkSession, rules).unionByName(tenant_rules.select(*RULE_COLUMNS))
        typed_by = lambda df: rule_types(df, every)
    return labels.with_node_type(named, rules, typed_by).select("group_id", "id", "name", "type", "properties")


def limited_nodes(node_rows: DataFrame, max_nodes: int = 500) -> DataFrame:
    """First ``max_nodes`` nodes per graph by id, then one row per id.

    The cut runs on rows, before the dedupe, so copies of an id use up the limit.
    """
    order = ["id", "name", "native_id"]
    ranked = node_rows.withColumn("id", nodes.node_id("properties", "native_id")).withColumn(
        "name", nodes.node_name("properties", "native_id")
    )
    cut = top_n(not_episodic(ranked), ["group_id"], [F.col(c) for c in order], max_nodes, "_rank")
    unique = first_wins(cut, ["group_id", "id"], ["_rank"])
    return typed_nodes(unique.drop("_rank", "name", "id"))


def dedupe_nodes(typed: DataFrame, order: list[str]) -> DataFrame:
    return first_wins(typed, ["group_id", "id"], order)


def edge_ends(edge_rows: DataFrame) -> DataFrame:
    """Edges with their end ids, edge id and label; a missing fact is empty."""
    ends = edge_rows.select(
        "group_id",
        nodes.endpoint_id("source_uuid", "source_id", "source_native").alias("source"),
        nodes.endpoint_id("target_uuid", "target_id", "target_native").alias("target"),
        "rel_type", F.coalesce("fact", F.lit("")).alias("fact"), _created(edge_rows), "edge_uuid",
    )
    return ends.select(
        "group_id", nodes.edge_id("source", "rel_type", "target").alias("id"), "source", "target",
        nodes.edge_label("rel_type").alias("label"), "fact", "created_at", "edge_uuid",
    )


def edge_pattern(edges: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Directed edges whose two ends are non-episodic nodes."""
    ids = not_episodic(node_rows).select("group_id", nodes.node_id("properties", "native_id").alias("node")).distinct()
    return within(edges, ids)


def within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids(group_id, node)``."""
    for end in ("source", "target"):
        side = ids.select("group_id", F.col("node").alias(end))
        edges = edges.join(side, ["group_id", end], "left_semi")
    return edges


def limited_edges(edges: DataFrame, max_nodes: int = 500) -> DataFrame:
    """First 2 x ``max_nodes`` edges per graph by creation, then edge uuid."""
    order = [F.asc_nulls_last("created_at"), F.asc("edge_uuid")]
    return top_n(edges, ["group_id"], order, 2 * max_nodes, "_rank").drop("_rank")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge per edge id, the oldest, then the one with the lowest uuid; predicates sharing it collapse."""
    dated = edges.withColumn("_undated", F.col("created_at").isNull())
    return first_wins(dated, ["group_id", "id"], ["_undated", "created_at", "edge_uuid"]).drop("_undated")


def view_counts(view_nodes: DataFrame, view_edges: DataFrame) -> DataFrame:
    """Counts of what the view returns, per graph."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = view_nodes.select("group_id", one.alias("n"), zero.alias("e")).union(
        view_edges.select("group_id", zero, one)
    )
    return rows.groupBy("group_id").agg(F.sum("n").alias("node_count"), F.sum("e").alias("edge_count"))
