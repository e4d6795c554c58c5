"""Stored graphs: sinks, administration, streaming and replay."""

import os

import pytest
from pyspark.sql import functions as F

from loregraph import schemas
from loregraph.functions import domains
from loregraph.plans import graph_view, ingest
from loregraph.session import new_folder
from loregraph.sources import requests as sources
from loregraph.sources.store import CompactionConflict, GraphStore
from loregraph.streaming.ingest import ingest_batch, stream_structured
from workload import inputs, stores


def structured(spark, rows):
    """(slug, seq, entity names, relations) as requests."""
    full = [(slug, f"e{seq}", "", None, [(n, "Role", "") for n in names], [(a, b, "knows", "") for a, b in rels], seq)
            for slug, seq, names, rels in rows]
    return spark.createDataFrame(full, schemas.STRUCTURED_REQUEST)


ROWS = [
    ("A", 0, ["x", "y"], [("x", "y"), ("x", "late")]), ("A", 1, ["X", "late"], [("late", "y")]), ("B", 2, ["x"], []),
    ("A", 3, ["z"], [("z", "x"), ("z", "nobody")]), ("B", 4, ["q", "x"], [("q", "x")]),
]


@pytest.fixture
def store(spark):
    return GraphStore(spark, new_folder(spark, "test"))


def content(store):
    drop = ["created_at", "valid_at", "batch_id"]
    return {t: sorted(map(str, store.table(t).drop(*drop).collect())) for t in schemas.TABLES}


def test_batches_equal_one_batch(spark, store):
    ingest_batch(store, structured(spark, ROWS), "all")
    parts = GraphStore(spark, new_folder(spark, "test"))
    for number, start in enumerate((0, 2, 3)):
        end = (2, 3, 5)[number]
        ingest_batch(parts, structured(spark, ROWS[start:end]), f"p{number}")
    assert content(parts) == content(store)
    assert store.table("facts").count() == 4


def test_replay_adds_nothing(spark, store):
    ingest_batch(store, structured(spark, ROWS[:2]), "p0")
    ingest_batch(store, structured(spark, ROWS[2:]), "p1")
    before = content(store)
    ingest_batch(store, structured(spark, ROWS[2:]), "p1")
    assert content(store) == before


def test_a_crash_between_sinks_is_repaired(spark, store):
    requests = structured(spark, ROWS)
    now = F.lit("2024-01-01").cast("timestamp")
    got = ingest.ingest_structured(requests, None, now)
    none = F.lit(None).cast(schemas.PROPERTIES)
    store._write("entities", got.entities.withColumn("properties", none), "p0", now)  # then the job dies
    ingest_batch(store, requests, "p0", now)
    clean = GraphStore(spark, new_folder(spark, "test"))
    ingest_batch(clean, requests, "p0", now)
    assert content(store) == content(clean)


def test_an_unfinished_batch_is_not_seen(spark, store):
    ingest_batch(store, structured(spark, ROWS[:1]), "p0")
    before = content(store)
    now = F.lit("2024-01-01").cast("timestamp")
    got = ingest.ingest_structured(structured(spark, ROWS[2:]), None, now)
    store._write("entities", got.entities.withColumn("properties", F.lit(None).cast(schemas.PROPERTIES)), "p1", now)
    store._write("facts", got.facts, "p1", now)
    assert content(store) == before


def test_a_batch_has_one_time(spark, store):
    ingest_batch(store, structured(spark, ROWS), "p0")
    times = [r.created_at for t in schemas.TABLES for r in store.table(t).select("created_at").distinct().collect()]
    assert len(set(times)) == 1


def test_resubmitting_duplicates_facts_but_not_entities(spark, store):
    ingest_batch(store, structured(spark, ROWS[:1]), "p0")
    again = structured(spark, [("A", 9, *ROWS[0][2:])])
    ingest_batch(store, again, "p1")
    assert store.table("entities").count() == 2
    assert store.table("facts").count() == 2 and store.table("mentions").count() == 4


def test_stream_equals_batch(spark, store):
    landing = new_folder(spark, "landing")
    for start, end in ((0, 2), (2, 5)):
        structured(spark, ROWS[start:end]).write.mode("append").parquet(landing)
        stream = sources.read_requests(spark, "structured", landing, "parquet", stream=True)
        stream_structured(stream, store, f"{landing}-progress").trigger(availableNow=True).start().awaitTermination()
    batch = GraphStore(spark, new_folder(spark, "test"))
    ingest_batch(batch, structured(spark, ROWS), "all")
    assert content(store) == content(batch)
    assert store.table("episodes").select("batch_id").distinct().count() == 2


def files(store):
    return sum(len(store._fs(t).globStatus(store._path(f"{t}/group_id=*/batch_id=*/*.parquet")) or []) for t in schemas.TABLES)


def test_compaction(spark, store):
    parts = [ROWS[i:i + 1] for i in range(5)]
    for number, rows in enumerate(parts[:3]):
        ingest_batch(store, structured(spark, rows), f"p{number}")
    before, reader, many = content(store), store.snapshot(), files(store)
    frame = store.table("facts")
    merged = store.compact()
    assert content(store) == before and {r.batch_id for r in store.visible_batches().collect()} == {merged}
    assert content(reader) == before and frame.count() == len(before["facts"])      # those that began before
    ingest_batch(store, structured(spark, parts[2]), "p2")                             # a late replay
    assert content(store) == before
    for number, rows in enumerate(parts[3:], 3):
        ingest_batch(store, structured(spark, rows), f"p{number}")
    whole = GraphStore(spark, new_folder(spark, "test"))
    ingest_batch(whole, structured(spark, ROWS), "all")
    assert content(store) == content(whole)
    store.compact()
    assert store.compact() is None and store.vacuum() == 6
    assert content(store) == content(whole) and files(store) < many
    yes = domains.CONFIRM_SENTENCE
    store.delete_graphs(admin(spark, ("A", yes)))
    assert {r.group_id for r in store.table("entities").collect()} == {"client_b"}


def test_of_two_compactions_one_is_undone(spark, store, monkeypatch):
    for number in range(2):
        ingest_batch(store, structured(spark, ROWS[number:number + 1]), f"p{number}")
    before, other, commit = content(store), GraphStore(spark, store.root), GraphStore._commit

    def late(self, version, folder):
        monkeypatch.setattr(GraphStore, "_commit", commit)
        assert other.compact() is not None                     # gets ahead of the first
        return commit(self, version, folder)

    monkeypatch.setattr(GraphStore, "_commit", late)
    with pytest.raises(CompactionConflict):
        store.compact()
    assert content(store) == before and len(store.visible_batches().collect()) == 1


def test_stream_that_compacts_and_leaves_no_staged_folders(spark, store):
    landing = new_folder(spark, "landing")
    root = os.path.dirname(landing)
    staged = lambda: {n for n in os.listdir(root) if n.startswith("staged-")}
    before = staged()
    for number in range(4):
        structured(spark, ROWS[number:number + 1]).write.mode("append").parquet(landing)
        stream = sources.read_requests(spark, "structured", landing, "parquet", stream=True)
        stream_structured(stream, store, f"{landing}-progress", compact_every=2).trigger(availableNow=True).start().awaitTermination()
    batch = GraphStore(spark, new_folder(spark, "test"))
    ingest_batch(batch, structured(spark, ROWS[:4]), "all")
    assert content(store) == content(batch) and len(store.visible_batches().collect()) == 1
    assert staged() == before


def admin(spark, *pairs):
    return spark.createDataFrame(list(pairs), schemas.ADMIN_REQUEST)


def sizes(store):
    return {r.group_id: tuple(r)[1:] for r in store.graph_sizes().collect()}


def test_init_reset_delete(spark, store):
    ingest_batch(store, structured(spark, ROWS), "all")
    yes = domains.CONFIRM_SENTENCE
    full = sizes(store)
    assert full == {"client_a": (3, 4, 5, 3), "client_b": (2, 2, 3, 1)}

    done = store.init_graphs(admin(spark, ("New-One", None), ("A", None)))
    assert {tuple(r) for r in done.collect()} == {("client_newone", "initialized"), ("client_a", "initialized")}
    assert sizes(store) == {**full, "client_newone": (0, 0, 0, 0)}

    done, refused = store.reset_graphs(admin(spark, ("A", yes), ("B", yes.upper()), ("B", None)))
    assert [tuple(r) for r in done.collect()] == [("client_a", "reset_and_reinitialized")]
    assert refused.count() == 2
    assert sizes(store) == {"client_a": (0, 0, 0, 0), "client_b": full["client_b"], "client_newone": (0, 0, 0, 0)}

    done, _ = store.delete_graphs(admin(spark, ("A", yes), ("absent", yes)))
    assert {tuple(r) for r in done.collect()} == {("client_a", "deleted"), ("client_absent", "deleted")}
    assert sizes(store) == {"client_b": full["client_b"], "client_newone": (0, 0, 0, 0)}
    assert store.graph_count() == 2

    ingest_batch(store, structured(spark, ROWS[:1]), "later")
    assert sizes(store)["client_a"] == (1, 2, 2, 1)


def test_empty_store(store):
    assert store.list_graphs().collect() == [] and store.graph_count() == 0 and sizes(store) == {}


def test_view_of_a_store(spark, store):
    ingest_batch(store, structured(spark, ROWS), "all")
    got = graph_view.stored_view(store.table("entities"), store.table("facts"))
    ids = {(r.group_id, r.id) for r in got.nodes.collect()}
    edges = got.edges.collect()
    assert len(ids) == 6 and {r.type for r in got.nodes.collect()} == {"role"}
    assert all((e.group_id, e.source) in ids and (e.group_id, e.target) in ids for e in edges)
    assert {r.group_id: (r.node_count, r.edge_count) for r in got.counts.collect()} == {"client_a": (4, 3), "client_b": (2, 1)}


def test_json_requests_get_defaults(spark):
    path = new_folder(spark, "json")
    spark.createDataFrame([('{"client_slug":"a","engagement_id":"e","query":"q"}',), ('{"query":"only"}',)], "value string").write.text(path)
    rows = {r.query: r for r in sources.read_requests(spark, "search", path).collect()}
    assert (rows["q"].max_results, rows["q"].include_segment, rows["q"].industry) == (10, True, domains.DEFAULT_INDUSTRY)
    assert rows["only"].client_slug is None


def test_taxonomy(spark, tmp_path):
    assert sources.entity_types(spark).count() == 16 and sources.episode_types(spark).count() == 18
    assert sources.entity_types(spark, str(tmp_path / "absent")).count() == 0
    (tmp_path / "types.json").write_text('{"name":"Role","description":"d"}\n')
    assert [tuple(r) for r in sources.entity_types(spark, str(tmp_path / "types.json")).collect()] == [("Role", "d")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_of_few_graphs_is_not_shuffled_by_graph(spark, store, monkeypatch):
    asked = []
    write = GraphStore._write
    monkeypatch.setattr(GraphStore, "_write", lambda self, *args: (asked.append(args[-1]), write(self, *args)))
    ingest_batch(store, structured(spark, ROWS), "few")
    monkeypatch.setattr("loregraph.sources.store.FEW_GRAPHS", 0)
    many = GraphStore(spark, new_folder(spark, "test"))
    ingest_batch(many, structured(spark, ROWS), "few")
    assert asked == [False] * 4 + [True] * 4 and content(many) == content(store)


def test_mentions_of_a_first_ingest_join_nothing(spark, store):
    requests = structured(spark, ROWS)
    first, later = ingest.ingest_structured(requests, None), ingest.ingest_structured(requests, store.table("entities"))
    assert "Join" not in plan_of(first.mentions)
    for name in ("mentions", "facts", "skipped", "counters"):
        one, other = getattr(first, name), getattr(later, name)
        assert one.dtypes == other.dtypes
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_order_stores_join_orders_and_customers_once(spark, sf_dir, monkeypatch):
    """Every frame of an ingest reads its requests, so a join behind them was made once per frame."""
    given = []

    def seen(requests, *rest):
        given.append(requests)
        return ingest.ingest_structured(requests, *rest)

    monkeypatch.setattr(stores, "ingest_structured", seen)
    monkeypatch.setattr(stores, "_BUILT", {})
    stores.order_store(spark, sf_dir)
    stores.administered_store(spark, sf_dir)
    assert len(given) == 2
    for requests in given:
        assert "Join" not in requests._jdf.queryExecution().optimizedPlan().toString()
    wanted = inputs.order_requests(spark, sf_dir)
    assert requests.exceptAll(wanted).count() == 0 and requests.count() == wanted.count()
