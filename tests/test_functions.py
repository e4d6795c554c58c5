"""Expressions on inline rows."""

import random

import pytest
from pyspark.sql import functions as F

from loregraph.functions import defaults, keys, labels, nodes, redact, text


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, value, column, schema="v string"):
    return [r[0] for r in values(spark, [(v,) for v in value], schema, column)]


def test_graph_keys(spark):
    got = one(spark, ["Acme-Corp_1", "---", "a b", "a.b", "Ünï²½"], keys.client_graph("v"))
    assert got == ["client_acmecorp_1", "client_", "client_ab", "client_ab", "client_ünï²½"]
    assert one(spark, ["Tribal Gaming"], keys.segment_graph("v")) == ["segment_tribalgaming"]


def test_whitespace_is_what_python_strips():
    assert {c for c in map(chr, range(0x110000)) if c.isspace()} == set(keys.WHITESPACE)


def test_normalize_name(spark):
    assert one(spark, ["  A b\t", "　Ü\x1c", "\xa0", "a\nb\n"], keys.normalize_name("v")) == ["a b", "ü", "", "a\nb"]


def test_stable_id_is_a_stable_uuid(spark):
    a, b = one(spark, ["x", "x"], keys.stable_id("v", F.lit(1)))
    assert a == b and [len(p) for p in a.split("-")] == [8, 4, 4, 4, 12]


def test_enrichment(spark):
    got = values(
        spark, [("t", {"a": "1", "b": "x"}), ("t", {}), ("t", None)], "c string, m map<string,string>",
        text.enrich_content("c", "m"),
    )
    assert got == [("Metadata:\n  a: 1  b: x\n\nt",), ("t",), ("t",)]


def test_episode_naming(spark):
    got = values(
        spark, [("status_update", "doc", "7", "e1")], "k string, t string, i string, e string",
        text.episode_name("k", "t", "i"), text.episode_description("e", "k", "t"),
    )
    assert got == [("status_update: doc/7", "Engagement e1 — status_update from doc")]


def test_bootstrap_defaults_are_by_key(spark):
    docs = [{}, {"name": "", "category": "org"}, {"name": "n"}]
    got = values(
        spark, [(d,) for d in docs], "d map<string,string>", text.bootstrap_name("d"), text.bootstrap_description("d")
    )
    assert got == [
        ("bootstrap: unknown", "Bootstrap document: general"),
        ("bootstrap: ", "Bootstrap document: org"),
        ("bootstrap: n", "Bootstrap document: general"),
    ]


def test_tokens(spark):
    assert one(spark, ["A b, c!", "", "--"], text.tokens("v")) == [["a", "b", "c"], [], []]


def test_sentences(spark):
    assert one(spark, ["One. Two!\nThree?"], text.sentences("v")) == [["One", "Two", "Three", ""]]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("call (555) 123-4567 or +1 555 123 4567", "call ([phone] or +[phone]"),
        ("paid $1,000, and $5.5 and $1.234 and $1234567890", "paid [amount] and [amount].5 and [amount]4 and $[phone]"),
        ("on 1/2/2024 & 12/31/99 not 2024-01-02", "on [date] & [date] not 2024-01-02"),
        ("éx@y.com", "éx@y.com"),
        ("mail a.b@c.co|m now", "mail [email] now"),
        ("٣/٤/٢٠٢٤", "[date]"),
    ],
)
def test_redaction_patterns(spark, given, expected):
    assert one(spark, [given], redact.redact("v")) == [expected]


def test_redaction_of_names(spark):
    rows = [
        ("ann b. met ÜNAL; annxb", ["Ann B.", "ünal"]), ("keep", None), ("x\\Ey and", ["X\\Ey", ""]), (None, ["a"]),
    ]
    got = values(spark, rows, "v string, n array<string>", redact.redact_names("v", "n"))
    assert [g[0] for g in got] == ["[stakeholder] met [stakeholder]; annxb", "keep", "[stakeholder] and", None]


def test_client_name_is_guarded(spark):
    rows = [("ACME and acme", "Acme"), ("text", None), ("text", "")]
    got = values(spark, rows, "v string, c string", redact.redact_client("v", "c"))
    assert [g[0] for g in got] == ["the gaming commission and the gaming commission", "text", "text"]


def test_names_in_order_then_patterns(spark):
    got = values(spark, [("Bob Ray bob ray@x.org",)], "v string", redact.redact(
        "v", names=F.array(F.lit("ray@x.org"), F.lit("bob"))))
    assert got == [("[stakeholder] Ray [stakeholder] [stakeholder]",)]


LABELS = [
    ((None, "['Role', 'System']"), "Role"), ((None, "[]"), ""), ((None, " Role "), "Role"), ((["Role", "X"], None), "Role"),
    (([], "Risk"), ""), ((None, None), ""), ((None, '["A"]'), "A"), (([" Role "], None), " Role "), ((None, "["), "["),
]


def test_domain_label(spark):
    got = values(spark, [given for given, _ in LABELS], "l array<string>, t string", labels.domain_label("l", "t"))
    assert [g[0] for g in got] == [expected for _, expected in LABELS]


def test_base_type(spark):
    rows = [(["EntityNode"],), (["Episode"],), (["Risk"],), ([],), (None,), (["CommunityNode", "x"],)]
    got = values(spark, rows, "l array<string>", labels.base_type("l"))
    assert [g[0] for g in got] == ["entity", "episode", "risk", "entity", "entity", "community"]


def test_every_mapped_label(spark):
    got = values(spark, [(k.upper(), v) for k, v in labels.VISUAL_TYPES.items()], "k string, v string",
                 labels.visual_type("k"), "v")
    assert len(got) == 20 and all(a == b for a, b in got)


def test_every_rule_term_hits_its_own_or_an_earlier_rule(spark):
    rows = []
    for rule in labels.RULES:
        for term in rule.terms:
            rows.append((rule.priority, term.title() if rule.field == "name" else "", "" if rule.field == "name" else f"x {term.upper()} y"))
    df = labels.with_rule_keys(spark.createDataFrame(rows, "p int, n string, s string"), "n", "s")
    got = [tuple(r) for r in df.select("p", "n", "s", labels.heuristic_type("name_key", "summary_key")).collect()]

    def model(name, summary):  # plain reading of the rule table
        subject = {"name": name.lower().strip(), "summary": summary.lower()}
        for rule in labels.RULES:
            text_ = subject[rule.field]
            test = {"equals": text_.__eq__, "contains": text_.__contains__, "startswith": text_.startswith}[rule.op]
            if any(test(t) for t in rule.terms):
                return rule.result
        return "entity"

    assert all(kind == model(n, s) and kind != "entity" for _, n, s, kind in got)


def node_types(spark, rows):
    schema = "node_labels array<string>, labels array<string>, labels_text string, name string, summary string"
    return [r.type for r in labels.with_node_type(spark.createDataFrame(rows, schema)).collect()]


@pytest.mark.parametrize(
    ("kind", "name", "summary", "expected"),
    [
        ("Entity", "Tool X", "error in process", "pain_point"),
        ("Deliverable", "x", "a broken process", "entity"),
        ("Entity", "SC-28", "", "regulation"), ("Entity", "FIPS 140-2", "", "regulation"),
        ("Entity", " TLS ", "", "system"), ("Entity", "Visitor Policy", "", "policy"),
        ("Entity", "Branch", "office in singapore", "pain_point"), ("Unknown", "Plain", "", "entity"),
        ("Entity", "Gaming Commission policy", "error", "department"),
    ],
)
def test_node_type(spark, kind, name, summary, expected):
    row = (["Entity"], [kind], None, name, summary)
    assert node_types(spark, [row]) == [expected]


def test_rules_only_see_plain_entities(spark):
    rows = [(["Risk"], None, "", "tls", "error"), (["Community"], None, None, "tls", "error")]
    assert node_types(spark, rows) == ["risk", "community"]


def test_rule_table_round_trip(spark):
    back = labels.rules_from_table(labels.rule_table(spark))
    rows = [("Casino Operations", ""), ("a", "the gap"), ("b", "steps to take"), ("fips", "")]
    df = labels.with_rule_keys(spark.createDataFrame(rows, "n string, s string"), "n", "s")
    a, b = (labels.heuristic_type("name_key", "summary_key", r) for r in (labels.RULES, back))
    assert all(r[0] == r[1] for r in df.select(a, b).collect())


def test_ids_and_names(spark):
    rows = [({"uuid": "", "id": "i", "label": "L"}, 5), ({}, 7), (None, 8)]
    got = values(spark, rows, "p map<string,string>, k bigint", nodes.node_id("p", "k"), nodes.node_name("p", "k"))
    assert got == [("", "L"), ("7", "Node 7"), ("8", "Node 8")]
    got = values(spark, [("", "i", 5), (None, "", 6), ("u", None, 7)], "u string, i string, k bigint",
                 nodes.endpoint_id("u", "i", "k"))
    assert [g[0] for g in got] == ["i", "6", "u"]


def test_properties_and_edge_id(spark):
    got = values(spark, [({"uuid": "1", "content": "c", "summary": "s", "x": "y"},)], "p map<string,string>",
                 nodes.clean_properties("p"))
    assert got == [({"summary": "s", "x": "y"},)]
    got = values(spark, [("a", "R", "b"), ("a", None, "b")], "s string, r string, t string", nodes.edge_id("s", "r", "t"))
    assert [g[0] for g in got] == ["a-R-b", "a-RELATED_TO-b"]


def test_defaults(spark):
    assert one(spark, ["", "  ", " T "], defaults.entity_label("v")) == ["Entity", "", "T"]
    assert one(spark, ["", "  ", " owns "], defaults.fact_name("v")) == ["relates_to", "", "owns"]
    got = values(spark, [("", "owns "), ("f", "r"), (None, None)], "f string, r string", defaults.fact_text("f", "r"))
    assert [g[0] for g in got] == ["owns ", "f", ""]


def test_a_placeholder_is_taken_as_it_is(spark):
    assert one(spark, ["Acme and acme"], redact.redact_client("v", F.lit("acme"), "$1\\x")) == ["$1\\x and $1\\x"]


def test_redaction_of_names_equals_one_name_after_another(spark):
    """Random names and texts: overlaps, parts of the placeholder, letters whose case is special."""
    draw, parts = random.Random(9), ["bob", "Ray", "stake", "holder]", "[s", " ", "é", "K", "\u212a", "\u017f", "S", "ß", "İ", "\\E", "$1", "."]
    word = lambda n: "".join(draw.choice(parts) for _ in range(draw.randint(0, n)))
    rows = [(word(14), [draw.choice([None, word(3), word(2)]) for _ in range(draw.randint(0, 5))]) for _ in range(300)] + [(None, ["bob"]), ("bob", None)]

    listed = F.coalesce("n", F.array().cast("array<string>"))
    fold = F.aggregate(listed, F.col("v"), lambda acc, name: redact.redact_name(acc, name, redact.NAME_PLACEHOLDER))
    got = values(spark, rows, "v string, n array<string>", "v", "n", redact.redact_names("v", "n"), fold)
    assert [g[2] for g in got] == [g[3] for g in got]
    assert sum(g[2] != g[0] for g in got) > 50   # the sample does meet names
