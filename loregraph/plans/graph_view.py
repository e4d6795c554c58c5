"""Deduplicated node and edge export of many graphs at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.functions import labels
from loregraph.operators import view


class GraphView(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    counts: DataFrame


def graph_view(
    node_rows: DataFrame,
    edge_rows: DataFrame,
    max_nodes: int = 500,
    check_ends: bool = False,
    collapse: bool = True,
) -> GraphView:
    """At most ``max_nodes`` nodes and twice as many edges per graph.

    Edges are cut before they are deduplicated and before ends outside the cut nodes drop
    out, so fewer edges than exist may come back. ``check_ends`` adds the label check of
    edge ends for edges that are not stored facts; ``collapse=False`` keeps every predicate.
    """
    picked = view.limited_nodes(node_rows, max_nodes)
    edges = view.edge_ends(edge_rows)
    if check_ends:
        edges = view.edge_pattern(edges, node_rows)
    edges = view.limited_edges(edges, max_nodes)
    if collapse:
        edges = view.dedupe_edges(edges)
    edges = view.within(edges, picked.select("group_id", F.col("id").alias("node")))
    edges = edges.select("group_id", "id", "source", "target", "label", "fact")
    return GraphView(picked, edges, view.view_counts(picked, edges))


def stored_view(entities: DataFrame, facts: DataFrame, max_nodes: int = 500, **options) -> GraphView:
    """The view of stored entities and facts."""
    return graph_view(view.entity_nodes(entities), view.fact_edges(facts), max_nodes, **options)


def write_view(shown: GraphView, path: str, fmt: str = "json") -> None:
    """Nodes, edges and counts of a view, each in a folder below ``path``."""
    for name, frame in shown._asdict().items():
        frame.write.format(fmt).save(f"{path.rstrip('/')}/{name}")


__all__ = ["GraphView", "graph_view", "labels", "stored_view", "write_view"]
