"""Graph views on small fixtures."""

from pyspark.sql import functions as F

from loregraph.operators import view
from loregraph.plans import graph_view
from workload import inputs

NODE = "group_id string, native_id long, node_labels array<string>, labels array<string>, properties map<string,string>"
EDGE = ("group_id string, source_uuid string, source_id string, source_native long, target_uuid string, target_id string, "
        "target_native long, rel_type string, fact string, edge_uuid string")


def nodes(spark, *rows):
    return spark.createDataFrame([("g", i, labels, None, props) for i, (labels, props) in enumerate(rows)], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([("g", s, None, None, t, None, None, r, f, u) for s, t, r, f, u in rows], EDGE)


def test_nodes_are_typed_cleaned_and_unique(spark):
    got = view.limited_nodes(nodes(
        spark, (["Entity"], {"uuid": "a", "name": "TLS", "content": "big", "k": "v"}), (["Entity"], {"uuid": "a", "name": "zz"}),
        (["Episodic"], {"uuid": "e"}), (["Community"], {"id": "c"}), ([], {"labels": "['Risk']"}), (None, {"uuid": "n"}),
    )).collect()
    assert {r.id: (r.name, r.type, r.properties) for r in got} == {
        "a": ("TLS", "system", {"k": "v"}), "c": ("Node 3", "community", {}),
        "4": ("Node 4", "pain_point", {"labels": "['Risk']"}), "n": ("Node 5", "entity", {}),
    }


def test_edges_collapse_or_not(spark):
    n = nodes(spark, (["Entity"], {"uuid": "a"}), (["Entity"], {"uuid": "b"}), (["Episodic"], {"uuid": "e"}))
    e = edges(spark, ("a", "b", "R", "p", "1"), ("a", "b", "R", "q", "2"), ("b", "a", "R", None, "3"), ("a", "a", None, "self", "4"),
              ("e", "a", "MENTIONS", "m", "5"), ("a", "gone", "R", "x", "6"))
    got = graph_view.graph_view(n, e, check_ends=True)
    assert {(r.id, r.label, r.fact) for r in got.edges.collect()} == {
        ("a-R-b", "R", "p"), ("b-R-a", "R", ""), ("a-RELATED_TO-a", "RELATED_TO", "self")}
    assert tuple(got.counts.first()) == ("g", 2, 3)
    every = graph_view.graph_view(n, e, check_ends=True, collapse=False)
    assert every.edges.count() == 4


def test_limits_apply_before_dedupe_and_ends(spark):
    n = nodes(spark, *[(["Entity"], {"uuid": u}) for u in "abcd"])
    e = edges(spark, ("a", "b", "R", "1", "1"), ("a", "b", "R", "2", "2"), ("a", "c", "R", "3", "3"), ("a", "d", "R", "4", "4"),
              ("b", "a", "R", "5", "5"))
    got = graph_view.graph_view(n, e, max_nodes=2)
    assert {r.id for r in got.nodes.collect()} == {"a", "b"}
    assert [r.id for r in got.edges.collect()] == ["a-R-b"]  # four edges cut, two collapsed, two without an end


def test_empty_view(spark):
    got = graph_view.graph_view(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE))
    assert got.nodes.count() == 0 and got.edges.count() == 0 and got.counts.count() == 0


def test_view_edges_are_stored_facts(spark, sf_dir):
    nodes_, edges_ = inputs.region_nodes(spark, sf_dir), inputs.region_edges(spark, sf_dir)
    got = graph_view.graph_view(nodes_, edges_, 50, check_ends=True)
    sizes = {r.group_id: r.node_count for r in got.counts.collect()}
    assert sizes and all(n <= 50 for n in sizes.values())
    ids = got.nodes.select("group_id", F.col("id").alias("node"))
    assert got.edges.count() == view.within(got.edges, ids).count()
    missing = got.edges.join(view.edge_ends(edges_).select("group_id", "id"), ["group_id", "id"], "left_anti")
    assert missing.count() == 0
