"""Rule tables against every rule tried on every row."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loregraph import schemas  # noqa: F401 - the package is importable on its own
from loregraph.functions import labels
from loregraph.operators import rules, view


def plain_type(tenant, name, summary, table):
    best = []
    for rule_set, priority, field, op, term, result in table:
        subject = (name if field == "name" else summary) or ""
        term = (term or "").lower()
        hit = {"equals": subject == term, "contains": term in subject, "startswith": subject.startswith(term)}.get(op, False)
        if term and field in ("name", "summary") and hit and rule_set in (None, tenant) and result and priority is not None:
            best.append((priority, result))
    return min(best)[1] if best else "entity"


@pytest.mark.parametrize("small", [True, False])
def test_against_every_rule(spark, monkeypatch, small):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    rows = [(rng.choice(["s", "t", None]), word(rng.randint(0, 9)).strip(), word(rng.randint(0, 40))) for _ in range(150)]
    rows += rows[:20] + [("s", None, None), ("t", "", "x" * 5000 + "needle")]
    table = [(rng.choice([None, "s", "t", "u"]), rng.randint(1, 30), rng.choice(["name", "summary"]), rng.choice(["equals", "contains", "startswith"]),
              word(rng.randint(1, 8)).upper(), f"r{i}") for i in range(60)]
    table += [(None, 40, "summary", "contains", "needle", "late"), (None, 1, "colour", "contains", "a", "x"), (None, 1, "name", "like", "a", "x"),
              (None, 1, "name", "contains", "", "x"), (None, None, "name", "contains", "a", "x"), (None, 1, "name", "contains", "a", None)]
    if not small:
        monkeypatch.setattr(rules, "hint_if_small", lambda df: df)
    frame = spark.createDataFrame(table, labels.RULE_SCHEMA)
    got = rules.rule_types(spark.createDataFrame(rows, "group_id string, name_key string, summary_key string").repartition(3), frame)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    want = [(*r, plain_type(*r, table)) for r in rows]
    assert sorted(map(str, map(tuple, got.select("group_id", "name_key", "summary_key", "type").collect()))) == sorted(map(str, want))
    assert rules.rejected_rules(frame).count() == 5
    assert {r.type for r in rules.rule_types(spark.createDataFrame(rows, "group_id string, name_key string, summary_key string"), frame.limit(0)).collect()} == {"entity"}


def test_same_as_the_chain_and_per_graph(spark):
    """The built-in rules as a table give what the chain gives; a tenant's rules only apply to its graph."""
    names = ["Internal Audit", "TLS", "AC-2 access", "FIPS 140-2", "Visitor Policy", "own council", "x"]
    rows = [(g, i, ["Entity"], None, {"name": n, "summary": s}) for g in ("a", "b") for i, (n, s) in enumerate((n, s) for n in names for s in ("", "a broken process", "the workflow"))]
    nodes = spark.createDataFrame(rows, "group_id string, native_id long, node_labels array<string>, labels array<string>, properties map<string,string>")
    own = spark.createDataFrame([("a", 1, "name", "equals", "Own Council", "department")], labels.RULE_SCHEMA)
    chain = {(r.group_id, r.id): (r.name, r.type) for r in view.typed_nodes(nodes).collect()}
    table = {(r.group_id, r.id): (r.name, r.type) for r in view.typed_nodes(nodes, tenant_rules=own).collect()}
    assert {k for k in chain if chain[k] != table[k]} == {k for k, (n, _) in chain.items() if k[0] == "a" and n == "own council"}
    assert {table[k][1] for k in table if k[0] == "a" and table[k][0] == "own council"} == {"department"}


def test_grams_of_terms_are_found_at_every_place():
    """One pattern finds the longest gram at each place: over one another, in one another, and of any characters."""
    grams = ["ab", "abc", "abcd", "b.c", "(", "\n\\", "é", "𝒳y", "c"]
    text = "xabcdab.c(ab\n\\é𝒳yabc𝒳"
    want = [max((g for g in grams if text.startswith(g, i)), key=len, default=None) for i in range(len(text))]
    assert re.findall(f"(?=({re.sub(r'[\\]x[{](.+?)[}]', lambda m: re.escape(chr(int(m[1], 16))), rules.longest_of(grams))}))", text) == [g for g in want if g]


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("small", [True, False])
def test_many_and_few_grams(spark, monkeypatch, few, small):
    """Terms of all lengths, over lines, with signs of patterns and characters beyond the first plane."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab.(\\\n$é𝒳 ") for _ in range(n))
    rows = [(rng.choice(["s", "t"]), word(rng.randint(0, 5)), word(rng.randint(0, 30))) for _ in range(120)] + [("s", "", ""), ("t", None, None)]
    table = [(rng.choice([None, "s", "t"]), i, rng.choice(["name", "summary"]), rng.choice(["equals", "contains", "startswith"]), word(rng.randint(1, 6)), f"r{i}")
             for i in range(80)]
    monkeypatch.setattr(rules, "FEW_GRAMS", 10_000 if few else 3)
    if not small:
        monkeypatch.setattr(rules, "hint_if_small", lambda df: df)
    got = rules.rule_types(spark.createDataFrame(rows, "group_id string, name_key string, summary_key string"), spark.createDataFrame(table, labels.RULE_SCHEMA))
    want = [(*r, plain_type(*r, table)) for r in rows]
    assert sorted(map(str, map(tuple, got.select("group_id", "name_key", "summary_key", "type").collect()))) == sorted(map(str, want))


def test_texts_are_not_exploded_into_all_substrings(spark):
    """What reaches the join follows the grams that the rules have, not the length of a text."""
    frame = spark.createDataFrame([(None, 1, "summary", "contains", t, t) for t in ("needle", "nee")], labels.RULE_SCHEMA)
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000)) + "needle"
    of = lambda op, sizes, grams: rules._anchors("summary", op, sizes, grams)
    row = spark.createDataFrame([(text,)], "summary_key string").select(
        F.size(of("contains", [3, 4], ["need", "nee"])), F.size(of("startswith", [3, 4], None)), F.size(of("contains", [4], None))).first()
    assert row[0] == 2 and row[1] == 2 and row[2] > 2000
    rows = spark.createDataFrame([("g", "", text)], "group_id string, name_key string, summary_key string")
    assert rules.rule_types(rows, frame).first().type == "nee"  # the first in the alphabet
