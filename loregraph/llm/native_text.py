"""Words and pattern matches of texts as DataFrame expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64   # places of a block
# Runs of everything that is no word character: ASCII without digits and letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; the built-in is the same where all is ASCII."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def keyed_texts(texts: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``h``, a hash of the text: rows of one doc_id with other texts stay apart,
    and repeated rows share what is found for them."""
    return texts.withColumn("h", F.xxhash64("text"))


def with_words(texts: DataFrame) -> DataFrame:
    """Add ``pieces`` (words between an empty first and last piece, where the text begins or ends with
    none), ``skip`` (whether the first is empty, 0 or 1) and ``n_words``."""
    rows = texts.withColumn("pieces", F.split(ascii_lower(F.col("text")), NOT_WORD, -1))
    empty_first, empty_last = F.element_at("pieces", 1) == "", F.element_at("pieces", -1) == ""
    rows = rows.withColumn("skip", empty_first.cast("int"))
    return rows.withColumn("n_words", F.greatest(F.lit(0), F.size("pieces") - F.col("skip") - empty_last.cast("int")))


def word_blocks(rows: DataFrame, words: str, overlap: int) -> DataFrame:
    """A row per place of the array column ``words``: ``base + i`` is the place, ``block`` an array that
    holds it at ``i`` and ``overlap`` more elements, where there are as many.

    An exploded row copies the array it comes from, so the array is first cut into blocks: the work
    is linear in it, however long a text is."""
    kept = [c for c in rows.columns if c != words]
    starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(BLOCK))
    cut = F.transform(starts, lambda s: F.struct(s.alias("base"), F.slice(words, s + 1, F.lit(BLOCK + overlap)).alias("block")))
    parts = rows.filter(F.size(words) > 0).select(*kept, F.explode(cut).alias("_part")).select(*kept, "_part.base", "_part.block")
    return parts.select(*kept, "base", "block", F.posexplode(F.slice("block", 1, BLOCK)).alias("i", "_word")).drop("_word")


def same(names: list[str], left: str, right: str) -> Column:
    """Join condition that also pairs nulls."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return out


def pattern_matches(texts: DataFrame, patterns: dict[str, tuple[str, int]], context: int = 0) -> DataFrame:
    """Leftmost non-overlapping matches of each pattern: ``doc_id, h, kind, start, end, found, before``,
    the last being up to ``context`` characters ahead of a match, back to the match before it.

    ``patterns``: kind to (pattern, group whose text is ``found``). Starts and ends count code points,
    the end exclusive: they are running sums of the lengths of the matches and of the pieces between
    them. The texts are read once; only texts with a match are split, and only lengths are shuffled."""
    rows = texts
    for i, (pattern, _) in enumerate(patterns.values()):
        rows = rows.withColumn(f"_m{i}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    kinds = []

    def between(piece: Column) -> Column:
        return F.struct(F.length(piece).alias("size"), (F.right(piece, F.lit(context)) if context else F.lit("")).alias("before"))

    for i, (kind, (pattern, group)) in enumerate(patterns.items()):
        some = F.size(f"_m{i}") > 0
        found = F.col(f"_m{i}") if group == 0 else F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
        kinds.append(F.when(some, F.struct(
            F.lit(kind).alias("kind"),
            F.transform(F.split("text", pattern, -1), between).alias("gap"),
            F.transform(F.col(f"_m{i}"), lambda m: F.length(m)).alias("size"), found.alias("found"))))
    each = rows.select("doc_id", "h", F.explode(F.filter(F.array(*kinds), lambda k: k.isNotNull())).alias("k"))
    each = each.select("doc_id", "h", F.col("k.kind").alias("kind"), F.posexplode(F.arrays_zip("k.gap", "k.size", "k.found")).alias("at", "m"))
    each = each.filter(F.col("m.size").isNotNull())   # the piece after the last match
    each = each.select("doc_id", "h", "kind", "at", F.col("m.gap.size").alias("gap"), F.col("m.size").alias("size"),
                       F.col("m.found").alias("found"), F.col("m.gap.before").alias("before"))
    each = each.dropDuplicates(["doc_id", "h", "kind", "at"])   # repeated rows
    upto = Window.partitionBy("doc_id", "h", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    each = each.withColumn("end", end)
    return each.select("doc_id", "h", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "found", "before")


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of an array of (start, rank, kind, end), in that order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
