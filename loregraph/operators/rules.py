"""Typing rules held in tables, of any number and per tenant: substrings found by an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.operators.scale import hint_if_small
from loregraph.session import materialize

GRAM = 4
FEW_GRAMS = 10_000
FIELDS = ("name", "summary")
OPS = ("equals", "contains", "startswith")
NONE = "entity"
RULE_COLUMNS = ["rule_set", "priority", "field", "op", "term", "result"]


def rejected_rules(rules: DataFrame) -> DataFrame:
    """Rules that cannot be applied, with the ``reason``."""
    reason = (
        F.when(~F.coalesce(F.col("field").isin(*FIELDS), F.lit(False)), "unknown field")
        .when(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), "unknown op")
        .when(F.coalesce(F.col("term"), F.lit("")) == "", "no term").when(F.col("result").isNull(), "no result").when(F.col("priority").isNull(), "no priority")
    )
    return rules.withColumn("reason", reason).filter("reason IS NOT NULL")


def anchored(rules: DataFrame) -> DataFrame:
    """The index: rules with the first ``GRAM`` characters of their term as ``gram`` (all of a shorter one; all
    of one that must equal), ``size`` characters long (0: the whole subject)."""
    kept = rules.filter(F.col("field").isin(*FIELDS) & F.col("op").isin(*OPS) & (F.col("term") != "") & F.col("result").isNotNull() & F.col("priority").isNotNull())
    kept = kept.select(*(F.lower(c).alias(c) if c == "term" else c for c in RULE_COLUMNS))
    size = F.when(F.col("op") == "equals", F.lit(0)).otherwise(F.least(F.lit(GRAM), F.length("term")))
    gram = F.when(F.col("op") == "equals", F.col("term")).otherwise(F.left("term", F.lit(GRAM)))
    return kept.withColumn("size", size).withColumn("gram", gram).withColumn("anchor", F.xxhash64("field", "op", "size", "gram"))


def longest_of(grams: list[str]) -> str:
    """A pattern of the longest of ``grams`` at a place, as a tree of their characters: a text is compared with the
    characters that may follow, however many grams there are."""
    tree: dict = {}
    for gram in grams:
        at = tree
        for c in gram:
            at = at.setdefault(c, {})
        at[""] = {}  # a gram ends here

    def below(at: dict) -> str:
        each = [(c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}") + below(at[c]) for c in sorted(at) if c]
        return "" if not each else f"(?:{'|'.join(each)}){'?' if '' in at else ''}"

    return below(tree)


def _anchors(field: str, op: str, sizes: list[int], grams: list[str] | None) -> Column:
    """Hashes of what a term can be found by: the whole subject, its begin, or all its substrings of ``sizes``
    characters; if ``grams`` are given, of those that hold one of them at their begin. One pass over the
    subject finds the longest for each place."""
    subject = F.col(f"{field}_key")

    def hashed(size: int, of: Column) -> Column:
        return F.xxhash64(F.lit(field), F.lit(op), F.lit(size), of if op == "equals" else F.left(of, F.lit(size)))

    if op != "contains":
        return F.array(*(hashed(size, subject) for size in sizes))
    longest = f".{{{min(sizes)},{max(sizes)}}}" if grams is None else longest_of(grams)
    found = F.array_distinct(F.regexp_extract_all(subject, F.lit(f"(?s)(?=({longest}))"), F.lit(1)))
    return F.flatten(F.transform(found, lambda gram: F.array(*(hashed(size, gram) for size in sizes))))


def rule_types(rows: DataFrame, rules: DataFrame, tenant: str = "group_id") -> DataFrame:
    """``rows`` (with ``name_key``, ``summary_key`` and ``tenant``) and their ``type``: the result of the matching rule
    with the lowest priority, of equal ones the first in the alphabet, else "entity".

    ``rules``: rule_set (a tenant, or null for all), priority, field, op, term, result. Terms match as
    substrings, without word boundaries. Every subject is cut into the anchors that occur among the
    rules' lengths, and if the rules have few, into those among them alone; they meet the rules' anchors
    in a hash join, and only then are strings compared. So the work grows with the text and the matches,
    not with rows times rules. Rules shown to be small are broadcast; else only the hashes of anchors are
    shuffled, and rows that have one join later. Rows with the same subjects are typed once."""
    index = materialize(anchored(rules))
    kinds = index.groupBy("field", "op").agg(F.sort_array(F.collect_set("size")).alias("sizes")).orderBy("field", "op").collect()
    inside = index.filter("op = 'contains'").select("field", "gram").distinct().limit(FEW_GRAMS + 1).collect()
    few = len(inside) <= FEW_GRAMS
    keyed = rows.withColumn("_tenant", F.col(tenant).cast("string")).withColumn("_h", F.xxhash64("_tenant", "name_key", "summary_key"))
    each = keyed.select("_tenant", "_h", "name_key", "summary_key").dropDuplicates(["_tenant", "_h"])
    each = materialize(each.withColumn("name_key", F.coalesce("name_key", F.lit(""))).withColumn("summary_key", F.coalesce("summary_key", F.lit(""))))
    anchors = [F.array().cast("array<bigint>")]
    for field, op, sizes in kinds:
        anchors.append(_anchors(field, op, sizes, [r.gram for r in inside if r.field == field] if few else None))
    thin = each.select("_tenant", "_h", "name_key", "summary_key", F.explode(F.array_distinct(F.concat(*anchors))).alias("anchor"))
    asked = hint_if_small(index)
    if asked is index:
        met = thin.select(F.col("_tenant").alias("_t"), F.col("_h").alias("_k"), "anchor").join(index.select("anchor").distinct(), "anchor", "left_semi")
        thin = met.join(each, (F.col("_k") == F.col("_h")) & F.col("_t").eqNullSafe(F.col("_tenant"))).drop("_t", "_k")
    subject = F.when(F.col("field") == "name", F.col("name_key")).otherwise(F.col("summary_key"))
    fits = F.when(F.col("op") == "equals", subject == F.col("term")).when(F.col("op") == "contains", subject.contains(F.col("term"))).otherwise(
        subject.startswith(F.col("term")))
    found = thin.join(asked, "anchor").filter(F.col("rule_set").isNull() | (F.col("rule_set") == F.col("_tenant"))).filter(fits)
    best = found.groupBy("_tenant", "_h").agg(F.min(F.struct("priority", "result")).alias("best"))
    best = materialize(best.select(F.col("_tenant").alias("_t"), F.col("_h").alias("_k"), F.col("best.result").alias("_result")))
    typed = keyed.join(hint_if_small(best), (F.col("_h") == F.col("_k")) & F.col("_tenant").eqNullSafe(F.col("_t")), "left")
    return typed.withColumn("type", F.coalesce("_result", F.lit(NONE))).drop("_tenant", "_h", "_t", "_k", "_result")
