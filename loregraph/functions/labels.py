"""Node typing: label maps first, then an ordered rule table compiled to one CASE."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.functions.keys import _col, strip

# --- fixed values -----------------------------------------------------------
# Graph label -> base type.
BASE_TYPES = {
    "entity": "entity", "entitynode": "entity",
    "episode": "episode", "episodenode": "episode",
    "community": "community", "communitynode": "community",
}

# Domain label -> visual type.
VISUAL_TYPES = {
    "stakeholder": "person", "consultant": "person", "person": "person",
    "department": "department", "role": "role",
    "process": "process", "system": "system",
    "finding": "theme", "painpoint": "pain_point", "pain_point": "pain_point",
    "opportunity": "opportunity", "goal": "opportunity",
    "regulation": "regulation", "policy": "policy",
    "decision": "process", "risk": "pain_point", "metric": "metric",
    "deliverable": "entity", "document": "entity", "location": "entity",
}

DEPARTMENT_NAMES = [
    "internal audit", "audit department", "compliance & enforcement", "compliance and enforcement",
    "c&e", "compliance & enforcement (c&e)", "licensing & investigations",
    "licensing and investigations", "licensing and investigations (l&i)", "gaming technology", "gtu",
    "executive", "executive office", "casino operations", "surveillance",
    "information technology", "human resources",
    "gaming technology unit",
]
DEPARTMENT_PHRASES = [
    "gaming commission", "internal audit", "compliance & enforcement", "licensing & investigations",
    "gaming technology",
]
SYSTEM_NAMES = [
    "permitrak", "filemaker", "filemaker pro", "fmp", "teammate", "teamrisk", "teamschedule", "teamtec",
    "teamcentral", "key traka", "trakaweb", "premisys", "sharefile", "active directory", "vmware", "adp",
    "zendesk", "kambi", "crossmatch", "barracuda", "infogenesis", "itraq", "kiteworks", "powerkiosk",
    "geocomply", "pala interactive", "casino cash trac", "table manager", "igt", "iris", "merydyan prime",
    "pryme", "casino insight", "advantage monitor", "servicenow", "hms", "spasoft", "filemakergo",
    "filemaker go", "igc skins", "ez pay", "campo",
]
TECHNOLOGY_NAMES = [
    "javascript", "java applets", "html5", "vbscript", "webgl", "vpn", "virtual private network", "dnssec",
    "public key infrastructure", "dmz", "aes", "demilitarized zone network", "tls", "ssl",
]
CONTROL_PREFIXES = [
    "sc-", "ac-", "ia-", "au-", "at-", "si-", "ma-", "mp-", "pe-", "ps-", "cm-", "cp-", "ir-", "ra-", "ca-",
    "pl-", "sa-", "pm-",
]
REGULATION_NAMES = [
    "tribal gaming compact", "gaming regulatory act", "cjis security policy", "nist sp 800-53", "title 31",
    "title-31", "bsa", "bank secrecy act",
]
POLICY_PHRASES = ["policy", "lockout control", "audit checklist", "security checklist", "sample audit"]
# --- end of fixed values -----------------------------------------------------


class Rule(NamedTuple):
    priority: int
    field: str  # name | summary
    op: str  # equals | contains | startswith
    terms: list[str]
    result: str


# Evaluation order, fields, terms and results.
RULES = [
    Rule(1, "name", "equals", DEPARTMENT_NAMES, "department"),
    Rule(1, "name", "contains", DEPARTMENT_PHRASES, "department"),
    Rule(2, "name", "equals", SYSTEM_NAMES, "system"),
    Rule(2, "name", "equals", TECHNOLOGY_NAMES, "system"),
    Rule(3, "name", "startswith", CONTROL_PREFIXES, "regulation"),
    Rule(4, "name", "equals", REGULATION_NAMES, "regulation"),
    Rule(5, "name", "startswith", ["fips"], "regulation"),
    Rule(6, "name", "contains", POLICY_PHRASES, "policy"),
    Rule(7, "summary", "contains", [
        "failed", "broken", "defect", "error", "falsified", "breach", "vulnerability", "violation"], "pain_point"),
    Rule(7, "summary", "contains", [
        "pain point", "problem", "crisis", "gap", "missing", "absent", "no documentation"], "pain_point"),
    Rule(8, "summary", "contains", [
        "opportunity", "should consider", "recommend", "potential benefit", "could improve"], "opportunity"),
    Rule(9, "summary", "contains", [
        "software", "platform", "application", "database", "system used"], "system"),
    Rule(10, "summary", "contains", [
        "process", "workflow", "procedure", "protocol", "lifecycle", "steps to"], "process"),
    Rule(11, "summary", "contains", [
        "department", "division", "unit within", "organizational"], "department"),
    Rule(12, "summary", "contains", [
        "regulation", "compliance standard", "regulatory requirement", "statute"], "regulation"),
    Rule(13, "summary", "contains", [
        "standard operating procedure", "internal rule", "directive"], "policy"),
]


RULE_SCHEMA = "rule_set string, priority int, field string, op string, term string, result string"


def rule_table(spark: SparkSession, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The rules as data, one row per term and for all tenants (no ``rule_set``), for inspection or editing."""
    rows = [(None, r.priority, r.field, r.op, term, r.result) for r in rules for term in r.terms]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rules_from_table(table: DataFrame) -> list[Rule]:
    """Read an edited rule table back as one chain for all rows; rules are configuration, a few hundred rows.
    Rules of tenants, or many, stay tables: see ``operators.rules``."""
    grouped: dict[tuple, list[str]] = {}
    for row in table.orderBy("priority").toLocalIterator():
        grouped.setdefault((row.priority, row.field, row.op, row.result), []).append(row.term)
    return [Rule(p, field, op, terms, result) for (p, field, op, result), terms in grouped.items()]


def _map_literal(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def base_type(node_labels: Column | str) -> Column:
    first = F.lower(F.try_element_at(_col(node_labels), F.lit(1)))
    return F.coalesce(_map_literal(BASE_TYPES)[first], first, F.lit("entity"))


def domain_label(labels: Column | str, labels_text: Column | str) -> Column:
    """First domain label from a native list, else from a plain or list-looking string."""
    raw = strip(F.coalesce(_col(labels_text), F.lit("")))
    inner = strip(F.substring(raw, F.lit(2), F.length(raw) - 2))
    head = F.btrim(strip(F.split_part(inner, F.lit(","), F.lit(1))), F.lit("'\""))
    parsed = F.when(raw.startswith("[") & raw.endswith("]"), head).otherwise(raw)
    return F.when(
        _col(labels).isNotNull(), F.coalesce(F.try_element_at(_col(labels), F.lit(1)), F.lit(""))
    ).otherwise(parsed)


def visual_type(label: Column | str) -> Column:
    """Mapped type of a domain label, NULL when the map has none."""
    return _map_literal(VISUAL_TYPES)[F.lower(_col(label))]


def _matches(rule: Rule, subject: Column) -> Column:
    if rule.op == "equals":
        return subject.isin(rule.terms)
    tests = [subject.contains(t) if rule.op == "contains" else subject.startswith(t) for t in rule.terms]
    return reduce(lambda a, b: a | b, tests)


def heuristic_type(name_key: Column | str, summary_key: Column | str, rules: Iterable[Rule] = RULES) -> Column:
    """First matching rule wins; terms match as substrings, without word boundaries.

    Takes normalized *columns* (see ``with_rule_keys``): the chain refers to them well over
    a hundred times, and an expression put in their place would be computed each time.
    """
    subjects = {"name": _col(name_key), "summary": _col(summary_key)}
    case = F
    for rule in sorted(rules, key=lambda r: r.priority):
        case = case.when(_matches(rule, subjects[rule.field]), F.lit(rule.result))
    return case.otherwise(F.lit("entity"))


def with_rule_keys(df: DataFrame, name: Column | str, summary: Column | str) -> DataFrame:
    """Add what the rules read: ``name_key`` and ``summary_key``."""
    return df.withColumns(
        {"name_key": strip(F.lower(_col(name))), "summary_key": F.lower(F.coalesce(_col(summary), F.lit("")))}
    )


def with_node_type(df: DataFrame, rules: Iterable[Rule] = RULES, typed_by: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add ``type`` from (node_labels, labels, labels_text, name, summary).

    Domain map first; the rules only see plain entities the map does not know. ``typed_by`` adds
    ``type`` from ``name_key`` and ``summary_key`` in place of the chain of ``rules``.
    """
    bound = with_rule_keys(df.withColumn("labels_text", strip(F.coalesce("labels_text", F.lit("")))), "name", "summary")
    bound = bound.withColumns(
        {"_base": base_type("node_labels"), "_mapped": visual_type(domain_label("labels", "labels_text"))}
    )
    if typed_by is not None:
        guessed = typed_by(bound).withColumnRenamed("type", "_guessed")
        return guessed.withColumn("type", F.coalesce("_mapped", F.when(F.col("_base") == "entity", F.col("_guessed")), "_base")).drop(
            "_base", "_mapped", "name_key", "summary_key", "_guessed")
    guessed = F.when(F.col("_base") == "entity", heuristic_type("name_key", "summary_key", rules))
    return bound.withColumn("type", F.coalesce("_mapped", guessed, "_base")).drop(
        "_base", "_mapped", "name_key", "summary_key"
    )
