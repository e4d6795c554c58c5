"""Batch resolution against a one-at-a-time model, on random episode sequences."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loregraph import schemas, session
from loregraph.operators import requests, resolve, scale
from loregraph.plans import ingest
from workload import inputs

GROUP = "client_t"
NOW = "2024-01-01 00:00:00"


def sequential(episodes, stored):
    """Plain reading of the semantics: one episode after the other."""
    known = {}
    for uuid, name, created in sorted(stored, key=lambda r: (r[2], r[0])):
        known.setdefault(name.lower(), uuid)
    new, counts, mentions, facts = {}, {}, [], []
    for seq, entities, relations in episodes:
        made = merged = linked = skipped = 0
        for name, kind, description in entities:
            key = name.strip().lower()
            if not key:
                continue
            if key in known:
                merged += 1
            else:
                known[key] = key
                new[key] = (name.strip(), kind.strip() if kind else "Entity", description.strip())
                made += 1
            mentions.append((seq, known[key]))
        for source, target, relation, fact in relations:
            a, b = known.get(source.strip().lower()), known.get(target.strip().lower())
            if a and b:
                linked += 1
                facts.append((seq, a, b, relation.strip() if relation else "relates_to", fact or relation or ""))
            else:
                skipped += 1
        counts[seq] = (made, merged, linked, skipped)
    return new, counts, sorted(mentions), sorted(facts)


def random_case(seed):
    rng = random.Random(seed)
    names = ["Ann", "ann ", " ANN", "Bob", "Cé", "cé\t", "", "  ", "Dee", "Eve", "x ", "Stored", "stored", "Dup"]
    episodes = []
    for seq in range(12):
        entities = [(rng.choice(names), rng.choice(["", " Role ", "System", "  "]), rng.choice(["", " d "]))
                    for _ in range(rng.randint(0, 5))]
        relations = [(rng.choice(names), rng.choice(names), rng.choice(["", "  ", " owns "]), rng.choice(["", "f"]))
                     for _ in range(rng.randint(0, 4))]
        episodes.append((seq, entities, relations))
    stored = [("u1", "STORED", 2), ("u2", "dup", 5), ("u0", "Dup", 5), ("u9", "DUP", 7), ("u3", "Far", 1)]
    return episodes, rng.sample(stored, rng.randint(0, len(stored)))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("staged", [False, True])
def test_batch_equals_sequential(spark, seed, staged):
    episodes, stored = random_case(seed)
    rows = [("T", f"e{seq}", "", None, ents, rels, seq) for seq, ents, rels in episodes]
    requests = spark.createDataFrame(rows, schemas.STRUCTURED_REQUEST).repartition(3)
    kept = spark.createDataFrame(
        [(GROUP, u, n, c) for u, n, c in stored], "group_id string, uuid string, name string, c int"
    ).select("group_id", "uuid", "name", F.timestamp_seconds("c").alias("created_at"))
    got = ingest.ingest_structured(requests, kept, F.lit(NOW).cast("timestamp"), staged=staged)
    new, counts, mentions, facts = sequential(episodes, stored)

    seqs = {r.episode_uuid: r.seq for r in got.episodes.collect()}
    entities = {r.name_lower: r for r in got.entities.collect()}
    by_uuid = {r.uuid: key for key, r in entities.items()}
    assert {k: (r.name, r.labels[0], r.summary) for k, r in entities.items()} == new
    assert {seqs[r.episode_uuid]: tuple(r)[2:] for r in got.counters.collect()} == counts
    assert sorted((seqs[r.episode_uuid], by_uuid.get(r.entity_uuid, r.entity_uuid)) for r in got.mentions.collect()) == mentions
    linked = [(seqs[r.episodes[0]], by_uuid.get(r.source_uuid, r.source_uuid), by_uuid.get(r.target_uuid, r.target_uuid), r.name, r.fact)
              for r in got.facts.collect()]
    assert sorted(linked) == facts
    assert got.facts.select("uuid").distinct().count() == len(facts)


def test_graphs_do_not_mix(spark):
    rows = [("A", "e", "", None, [("x", "", "")], [("x", "y", "r", "")], 0), ("B", "e", "", None, [("y", "", "")], [], 1)]
    got = ingest.ingest_structured(spark.createDataFrame(rows, schemas.STRUCTURED_REQUEST))
    assert got.facts.count() == 0 and got.skipped.count() == 1
    assert {r.group_id for r in got.entities.collect()} == {"client_a", "client_b"}


def test_invalid_requests_are_left_out(spark):
    rows = [("A", None, "", None, [], [], 0), (None, "e", "", None, [], [], 1), ("A", "e", "", None, [("n", None, "")], [], 2),
            ("A", "e", "", None, [], [("a", None, "r", "")], 3), ("A", "ok", "", None, None, None, 4)]
    got = ingest.ingest_structured(spark.createDataFrame(rows, schemas.STRUCTURED_REQUEST))
    assert [r.name for r in got.episodes.collect()] == ["ok"]


def test_hot_name_in_most_rows(spark):
    """One name in nine of ten rows resolves like any other, and is reduced before the shuffle."""
    rows = spark.range(20_000).select(
        F.lit("client_a").alias("group_id"), F.col("id").cast("string").alias("episode_uuid"), F.col("id").alias("seq"),
        F.lit(0).cast("long").alias("pos"),
        F.when(F.col("id") % 10 != 0, F.lit("Hot")).otherwise(F.concat(F.lit("n"), (F.col("id") % 100).cast("string"))).alias("name"),
        F.lit("").alias("type"), F.lit("").alias("description"),
    )
    episodes = rows.select("group_id", "episode_uuid", "seq")
    relations = rows.select("group_id", "episode_uuid", "seq", "pos", F.col("name").alias("source"),
                            F.lit("hot").alias("target"), F.lit("r").alias("relation"), F.lit("").alias("fact"))
    got = ingest.ingest_rows(episodes, rows, relations)
    totals = got.counters.agg(*[F.sum(c) for c in got.counters.columns[2:]]).first()
    assert tuple(totals) == (11, 19_989, 19_999, 1)


def flat_rows(spark, seed):
    """Entity and relationship rows with nulls, copies and names that come late or never."""
    rng = random.Random(seed)
    names = ["Ann", "ann ", "Bob", "Cé", "", " ", "Dee", "Eve", None]

    def head():
        seq = rng.choice([0, 1, 2, 3, 4, 5, None])
        group = rng.choice(["g", "g", "h", None])
        return group, f"{group}{seq}", seq, rng.choice([0, 1, 2, 3, None])

    entities = [(*head(), rng.choice(names[:5] + [None]), rng.choice(["", "Role"]), "d") for _ in range(60)]
    relations = [(*head(), rng.choice(names), rng.choice(names), "r", "") for _ in range(60)]
    episodes = sorted({r[:3] for r in entities + relations}, key=str)
    head = "group_id string, episode_uuid string, seq long"
    return (spark.createDataFrame(episodes, head),
            spark.createDataFrame(entities + entities[:10], head + ", pos long, name string, type string, description string").repartition(3),
            spark.createDataFrame(relations + relations[:10], head + ", pos long, source string, target string, relation string, fact string").repartition(3))


@pytest.mark.parametrize("seed", range(4))
def test_many_names_resolve_like_few(spark, monkeypatch, seed):
    """A dictionary too large for a broadcast gives the same frames, and in slices too."""
    rows = flat_rows(spark, seed)

    def frames():
        got = ingest.ingest_rows(*rows)
        return {f: sorted(map(str, getattr(got, f).collect())) for f in ("entities", "mentions", "facts", "skipped", "counters")}

    few = frames()
    monkeypatch.setattr(resolve, "is_small", lambda df: False)
    assert frames() == few
    monkeypatch.setattr(resolve, "in_slices", lambda df, *keys: [df.filter(F.pmod(F.xxhash64(*keys), F.lit(3)) == i) for i in range(3)])
    assert frames() == few


def test_many_names_are_cut_before_their_shuffle(spark, monkeypatch):
    """With a large dictionary occurrences reach a shuffle as the first of each name, relationships not at all."""
    monkeypatch.setattr(resolve, "is_small", lambda df: False)
    entities = spark.range(5000).select(
        F.lit("g").alias("group_id"), F.col("id").cast("string").alias("episode_uuid"), F.col("id").alias("seq"), F.lit(0).cast("long").alias("pos"),
        (F.col("id") % 50).cast("string").alias("name"), F.lit("").alias("type"), F.lit("").alias("description"))
    relations = entities.select("group_id", "episode_uuid", "seq", "pos", F.col("name").alias("source"), F.col("name").alias("target"),
                                F.lit("r").alias("relation"), F.lit("").alias("fact"))
    got = ingest.ingest_rows(entities.select("group_id", "episode_uuid", "seq"), entities, relations)
    assert got.facts.count() == 5000 and got.skipped.count() == 0 and got.entities.count() == 50
    assert "WindowGroupLimit" in resolve.first_occurrences(requests.occurrences(entities))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in got.facts._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_staging_leaves_no_shuffle_files(spark):
    """What a staged write shuffles goes with its end, and the setting for it is as before."""
    before, kept = shuffle_files(spark), spark.conf.get(session.SHUFFLES_GO)
    staged = session.materialize(spark.range(1000).repartition(5, "id"), spark.range(1000, 1010).repartition(2, "id"))
    for _ in range(50):  # they are removed by another thread
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(session.SHUFFLES_GO) == kept
    assert staged.count() == 1010


def test_lines_are_joined_once_and_in_slices(spark, sf_dir, monkeypatch):
    """The frames of the lines read what was joined before, and neither slices nor a large supplier table change a row."""
    def texts(rows):
        return [sorted(map(str, df.collect())) for df in rows]

    wanted = texts(inputs.line_rows(spark, sf_dir, staged=False))
    rows = inputs.line_rows(spark, sf_dir)
    assert all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in rows[1:])
    assert texts(rows) == wanted
    monkeypatch.setattr(scale, "SLICE_BYTES", 40_000)
    monkeypatch.setattr(inputs, "is_small", lambda *_: False)
    written = []
    monkeypatch.setattr(inputs, "materialize", lambda *slices: (written.append(len(slices)), session.materialize(*slices))[1])
    assert texts(inputs.line_rows(spark, sf_dir)) == wanted and written[0] > 1
