"""Extraction, drafts and promotion against plain Python on small fixtures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loregraph import schemas
from loregraph.operators import extract, requests
from loregraph.plans import ingest, insights

def now():
    return F.lit("2024-01-01").cast("timestamp")


def tok(text):
    return [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]


def brute(episodes, names):
    """Entities per episode and neighbour facts per sentence."""
    grams = {" ".join(tok(n)): n for n in names if tok(n)}
    entities, links = set(), []
    for episode, text in episodes:
        for sentence in re.split(r"[.!?\n]+", text):
            toks, seen = tok(sentence), {}
            for i in range(len(toks)):
                for n in range(1, 9):
                    gram = " ".join(toks[i : i + n])
                    if i + n <= len(toks) and gram in grams:
                        seen.setdefault(gram, (i, n, gram))
            ordered = sorted(seen.values())
            entities |= {(episode, grams[g]) for *_, g in ordered}
            links += [(episode, grams[a], grams[b], sentence.strip()) for (*_, a), (*_, b) in zip(ordered, ordered[1:])]
    return entities, sorted(links)


@pytest.mark.parametrize("small", [True, False])
def test_extraction(spark, monkeypatch, small):
    rng = random.Random(5)
    vocabulary = "new york city bank of the river. old new! york? river\n alpha beta, gamma; delta".split(" ")
    episodes = [(f"e{i}", " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(25)]
    names = ["New York", "York", "new york city", "River", "the river", "Alpha-Beta", "of", "one two three four five six", "--"]
    if not small:
        monkeypatch.setattr(extract, "hint_if_small", lambda df: df)
    rows = spark.createDataFrame([("g", e, i, t) for i, (e, t) in enumerate(episodes)],
                                 "group_id string, episode_uuid string, seq long, content string")
    terms = spark.createDataFrame([(n,) for n in names], "name string")
    found, linked = extract.extract(rows, terms)
    entities, links = brute(episodes, names)
    assert {(r.episode_uuid, r.name) for r in found.collect()} == entities and found.count() == len(entities)
    assert sorted((r.episode_uuid, r.source, r.target, r.fact) for r in linked.collect()) == links
    assert linked.select("episode_uuid", "pos").distinct().count() == len(links)


def test_gazetteer_of_a_graph_stays_in_it(spark):
    rows = spark.createDataFrame([("a", "e1", 0, "Ann met Bob"), ("b", "e2", 0, "Ann met Bob")],
                                 "group_id string, episode_uuid string, seq long, content string")
    terms = spark.createDataFrame([("a", "ann", "Person"), ("b", "bob", "Person")], "group_id string, name string, type string")
    found, linked = extract.extract(rows, terms)
    assert {(r.group_id, r.name) for r in found.collect()} == {("a", "ann"), ("b", "bob")} and linked.count() == 0


def test_long_names_and_names_of_the_graph(spark):
    rows = spark.createDataFrame([("a", "e1", 0, "Then one two three four five six seven met Ann Lee."), ("b", "e2", 0, "Ann Lee met Bo")],
                                 "group_id string, episode_uuid string, seq long, content string")
    terms = spark.createDataFrame([("One two three four five six seven",), ("ann lee",)], "name string")
    stored = spark.createDataFrame([("a", "u1", "ANN LEE"), ("b", "u2", "Bo"), ("c", "u3", "Then")], "group_id string, uuid string, name string")
    found, linked = extract.extract(rows, terms, stored)
    assert {(r.group_id, r.name) for r in found.collect()} == {
        ("a", "One two three four five six seven"), ("a", "ann lee"), ("b", "ann lee"), ("b", "Bo")}
    assert linked.count() == 2
    only, _ = extract.extract(rows, None, stored)
    assert {(r.group_id, r.name) for r in only.collect()} == {("a", "ANN LEE"), ("b", "Bo")}


def test_one_long_sentence_is_read_whole(spark):
    text = " ".join(["filler"] * 5000 + ["needle"] + ["filler"] * 10 + ["thread"])
    rows = spark.createDataFrame([("g", "e", 0, text)], "group_id string, episode_uuid string, seq long, content string")
    found, linked = extract.extract(rows, spark.createDataFrame([("needle",), ("thread",)], "name string"))
    assert found.count() == 2 and [r.fact for r in linked.collect()] == [text]


def test_names_with_a_common_begin_and_names_that_are_refused(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "e1", 0, "x y z. a b c d e f. x y"), ("b", "e2", 1, "a b c d. x y z w")],
                                 "group_id string, episode_uuid string, seq long, content string")
    terms = spark.createDataFrame([("x",), ("x y",), ("X-Y z",), ("a b c d",), ("a b c d e",), ("b c d e f g",), ("q " * 4096,), ("--",), (None,)], "name string")
    got = {(r.group_id, r.gram) for r in extract.sightings(rows, extract.gazetteer(terms)).collect()}
    assert got == {("a", g) for g in ("x", "x y", "x y z", "a b c d", "a b c d e")} | {("b", g) for g in ("x", "x y", "x y z", "a b c d")}
    assert sorted(r.reason for r in extract.refused_names(terms).collect()) == ["more than 4095 tokens", "no token", "no token"]
    assert extract.sightings(rows, extract.gazetteer(terms.limit(0))).collect() == []


def test_ingest_episodes(spark):
    full = ("A", "e1", "status_update", "Ann met Bob. Bob left.", "7", "doc", {"k": "Carl"}, None, 0)
    bad = ("A", "e1", "nonsense", "Ann", "8", "doc", {}, None, 1)
    empty = ("A", "e1", "bootstrap", "nothing here", "9", "doc", {}, None, 2)
    got = ingest.ingest_episodes(spark.createDataFrame([full, bad, empty], schemas.EPISODE_REQUEST),
                                 spark.createDataFrame([("Ann",), ("Bob",), ("Carl",)], "name string"), now=now())
    assert {r.name: (r.content, r.source_description) for r in got.episodes.collect()} == {
        "status_update: doc/7": ("Metadata:\n  k: Carl\n\nAnn met Bob. Bob left.", "Engagement e1 — status_update from doc"),
        "bootstrap: doc/9": ("nothing here", "Engagement e1 — bootstrap from doc"),
    }
    assert sorted(r.name for r in got.entities.collect()) == ["Ann", "Bob", "Carl"]
    assert [r.fact for r in got.facts.collect()] == ["Ann met Bob"]
    counts = sorted((r.entities_extracted, r.facts_created) for r in ingest.extraction_counts(got).collect())
    assert counts == [(0, 0), (3, 1)]


def test_bootstrap(spark):
    docs = [{"name": "a", "content": "Ann"}, {"content": "Bob", "timestamp": "2024-05-06 00:00:00"}, {"name": ""}]
    rows = spark.createDataFrame([("A", "e", docs, 3), ("A", "e", [], 4)], schemas.BOOTSTRAP_REQUEST)
    got, report = ingest.bootstrap(rows, spark.createDataFrame([("ann",), ("bob",)], "name string"), now=now())
    line = report.first()
    assert report.count() == 1 and (line.request_seq, line.documents_processed) == (3, 3)
    assert [r.document for r in line.results] == ["a", None, ""]
    names = {r.episode_uuid: r for r in got.episodes.collect()}
    assert [names[r.episode_id].name for r in line.results] == ["bootstrap: a", "bootstrap: unknown", "bootstrap: "]
    assert str(names[line.results[1].episode_id].valid_at) == "2024-05-06 00:00:00"


def test_validation_splits_requests(spark):
    rows = [("A", "e", "status_update", "c", "1", "d", {}, None, 0), ("A", "e", "nope", "c", "1", "d", {}, None, 1),
            ("A", "e", "status_update", None, "1", "d", {}, None, 2)]
    rows.append(("A", "e", "status_update", "c", "1", "d", {}, None, None))
    good, bad = requests.validate(spark.createDataFrame(rows, schemas.EPISODE_REQUEST), "episode")
    assert [r.ingest_seq for r in good.collect()] == [0]
    assert {r.ingest_seq: r.reason for r in bad.collect()} == {1: "unknown episode_type", 2: "missing content", None: "missing ingest_seq"}


def test_bootstrap_takes_large_sequence_numbers(spark):
    docs = [{"name": "a", "content": "Ann"}, {"name": "b", "content": "Ann met Bob"}]
    late = 1_700_000_000_000
    rows = spark.createDataFrame([("A", "e", docs, late + 1), ("A", "e", docs[:1], late)], schemas.BOOTSTRAP_REQUEST)
    got, _ = ingest.bootstrap(rows, spark.createDataFrame([("ann",), ("bob",)], "name string"), now=now())
    order = [r.name for r in got.episodes.orderBy("seq").collect()]
    assert order == ["bootstrap: a", "bootstrap: a", "bootstrap: b"] and got.facts.count() == 1


def test_drafts_review_promotion(spark):
    schema = "id long, title string, content string, type string, client_name string, known_names array<string>"
    rows = [(1, "Acme on 1/2/2024", "Acme paid $5 to Ann Lee", "risk", "ACME", ["ann"]), (2, None, "x", None, None, None),
            (3, "t", "River bank", "risk", "", [])]
    drafts = insights.draft_insights(spark.createDataFrame(rows, schema))
    got = {r.id: r for r in drafts.collect()}
    assert (got[1].original_title, got[1].draft_title) == ("Acme on 1/2/2024", "the gaming commission on [date]")
    assert got[1].draft_content == "the gaming commission paid [amount] to [stakeholder] Lee"
    assert (got[2].original_title, got[2].draft_content, got[2].finding_type, got[2].status) == ("", "x", "", "draft")

    decisions = spark.createDataFrame([(1, True), (2, False), (1, True), (2, True)], "id long, approved boolean")
    reviewed = insights.review(drafts, decisions, "id")
    assert {r.id: r.status for r in reviewed.collect()} == {1: "approved", 2: "rejected", 3: "draft"}
    ready = reviewed.withColumns({"industry": F.lit("Tribal_Gaming"), "source_description": F.lit("s"), "ingest_seq": F.col("id")})
    result = insights.promote(ready, spark.createDataFrame([("gaming commission",), ("Lee",)], "name string"), now=now())
    episode = result.episodes.collect()
    assert [(e.group_id, e.name) for e in episode] == [("segment_tribal_gaming", "segment_insight: Tribal_Gaming")]
    assert [r.name for r in result.facts.collect()] == ["relates_to"]
    # Redacting a draft again changes nothing here, as no known name occurs in a placeholder.
    again = insights.draft_insights(drafts.select("id", F.col("draft_title").alias("title"), F.col("draft_content").alias("content"),
                                                  F.lit("Acme").alias("client_name"), F.array(F.lit("ann")).alias("known_names")))
    assert all(r.original_content == r.draft_content for r in again.collect())
