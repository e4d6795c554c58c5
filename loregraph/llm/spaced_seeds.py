"""Benchmark decontamination by spaced-seed hashing.

Masks choose some words of a window and ignore the others. All masked windows of the benchmark
and of the documents meet in a join of hashes; each hit names a diagonal (document position minus
item position). The words along the diagonal are then compared: over the part of the item that
the document overlaps, words may differ, and a document is contaminated by an item if in some
stretch of at least ``RUN`` words (or in the whole item, if shorter) at most one of ``SPAN`` places
differs, wherever they are. A stretch begins and ends with an equal word, or where the item or the
document does.

The masks lose nothing: a stretch of at least ``RUN`` words holds one of ``RUN`` to 2 ``RUN`` - 1
words that is as dense, and wherever a quarter of its places lie, one of the two masks fits between
them somewhere. So it is for whole items of ``SHORT`` words or more, but those of 5 and 8 words
have masks of three words instead of four. Items of fewer than ``SHORT`` words, which must agree as
a whole, are sought by all their words together. Hits are more than contaminated documents, so a hit
only counts if the places around it that such a stretch can reach agree often enough.

Cases: null or empty texts and items have no words and match nothing; repeated rows get the same
result each; an item with a null id is sought like others; equal items are found each; with an
empty benchmark nothing is found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import texts_of
from loregraph.llm.native_text import BLOCK, keyed_texts, same, with_words
from loregraph.operators.scale import hint_if_small
from loregraph.session import materialize

# Masks: 1 is a word that must agree, 0 one that is ignored.
LONG, SHORT = 12, 5
LONG_MASKS = ("11101", "100111")
SHORT_MASKS = ("1101", "10011")        # of items of 5 and 8 words
RUN = LONG
SPAN = 4                              # one of so many places may differ
BEFORE, AFTER = 2 * RUN - 5, 2 * RUN - 2   # places a stretch of less than 2 RUN reaches around the start of a mask of 4 or more


def _words(texts: DataFrame) -> DataFrame:
    """``words``: the words of a text alone, without empty pieces."""
    rows = with_words(keyed_texts(texts))
    return rows.withColumn("words", F.slice("pieces", F.col("skip") + 1, F.col("n_words"))).drop("pieces", "skip")


def _masked(words: Column, at: Column, mask: str) -> Column:
    chosen = [F.get(words, at + i) for i, c in enumerate(mask) if c == "1"]
    return F.xxhash64(F.lit(mask), *chosen)


def _seeds(rows: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """Hashes of all masked windows: the columns of ``rows`` but words, ``at`` and ``seed``, and the words'
    hashes around the window, ``block``, in which it starts at ``place``.

    Texts are cut into blocks before places are exploded, so the work is linear in a text."""
    kept = [c for c in rows.columns if c != "words"]
    hashed = rows.withColumn("words", F.transform("words", lambda w: F.hash(w)))
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(BLOCK))
    cut = F.transform(starts, lambda s: F.struct(s.alias("base"), F.least(s, F.lit(BEFORE)).alias("left"), F.slice(
        "words", s - F.least(s, F.lit(BEFORE)) + 1, F.least(s, F.lit(BEFORE)) + F.lit(BLOCK + AFTER)).alias("block")))
    parts = hashed.filter(F.size("words") > 0).select(*kept, F.explode(cut).alias("_part")).select(*kept, "_part.base", "_part.left", "_part.block")
    inside = F.sequence(F.lit(0), F.least(F.lit(BLOCK), F.col("n_words") - F.col("base")) - 1)
    windows = parts.select(*kept, "base", "left", "block", F.explode(inside).alias("_i"))
    windows = windows.select(*kept, "block", (F.col("base") + F.col("_i")).alias("at"), (F.col("left") + F.col("_i")).alias("place"))
    hashes = [F.when(F.col("at") + len(m) <= F.col("n_words"), _masked(F.col("block"), F.col("place"), m)) for m in masks]
    seed = hashes[0] if len(hashes) == 1 else F.explode(F.array(*hashes))
    return windows.select(*kept, "at", "block", "place", seed.alias("seed")).filter(F.col("seed").isNotNull())


def _item_masks(n: int) -> tuple[str, ...]:
    return SHORT_MASKS if n in (5, 8) else LONG_MASKS if n >= SHORT else ("1" * n,)


def seed_hits(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct ``doc_id, h, item_id, item_h, diagonal`` of equal masked windows.

    ``texts``, ``items``: with ``words`` and ``n_words``. The item seeds are broadcast if they are
    shown to be small; else the seeds of both sides are shuffled by hash, with the hashes of the words
    around them. Hits with too few equal places around them are dropped where they arise."""
    size = F.least("n_words", F.lit(LONG)).alias("size")
    sizes = sorted(r["size"] for r in items.select(size).distinct().collect() if r["size"])
    if not sizes:
        return None
    by_masks = {}
    for n in sizes:
        by_masks.setdefault(_item_masks(n), []).append(n)
    own = None
    for masks, chosen in sorted(by_masks.items()):
        part = _seeds(items.filter(F.least("n_words", F.lit(LONG)).isin(chosen)), masks)
        own = part if own is None else own.unionByName(part)
    first = F.greatest(F.lit(0), F.col("place") - BEFORE)
    own = own.select("item_id", "item_h", F.col("n_words").alias("item_words"), F.col("at").alias("item_at"), "seed",
                     F.slice("block", first + 1, F.lit(BEFORE + AFTER + 1)).alias("around"), (F.col("place") - first).alias("middle"))
    theirs = _seeds(texts.select("doc_id", "h", "n_words", "words"), tuple(sorted({m for masks in by_masks for m in masks})))
    asked = hint_if_small(own)
    if asked is own:
        first = F.greatest(F.lit(0), F.col("place") - BEFORE)
        theirs = theirs.select("doc_id", "h", "seed", "at", F.slice("block", first + 1, F.lit(BEFORE + AFTER + 1)).alias("block"), (F.col("place") - first).alias("place"))
    equal = F.filter(F.sequence(F.lit(-BEFORE), F.lit(AFTER)), lambda k: F.get("block", F.col("place") + k) == F.get("around", F.col("middle") + k))
    least = F.least(F.lit(RUN), "item_words")
    hits = theirs.join(asked, "seed").filter(F.size(equal) >= least - F.floor(least / SPAN))
    return hits.select("doc_id", "h", "item_id", "item_h", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _best_window(flags: Column, least: Column) -> Column:
    """(n_equal, first, end) of the best window of ``flags`` (1 for equal places, 0 for differing ones): of all
    windows of at least ``least`` places that begin and end with an equal place or at an end of ``flags`` and
    of which at most one place in SPAN differs, that with most equal places, then the first; differing places
    at its ends are cut as far as ``least`` allows. Null if there is none.

    A window grows over equal places until it meets a differing one, so only windows between two
    differing places (or ends) x_i and x_j count. They are dense enough if x_j - SPAN j >= x_i - SPAN i - (SPAN - 1);
    for each j the smallest such i is sought by bisection in the prefix minima of x_i - SPAN i."""

    def bounds(own: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.get(own, i) == 0)
        return _let(F.concat(F.array(F.lit(-1)), places, F.array(F.size(own))), lambda xs: F.transform(xs, lambda x, k: F.struct(
            x.alias("x"), k.alias("k"), (x - F.lit(SPAN) * k).alias("q"), F.coalesce(F.get(xs, k - 1) + 1 != x, F.lit(False)).alias("ends"),
            F.coalesce(F.get(xs, k + 1) - 1 != x, F.lit(False)).alias("begins"))))

    def windows(own: Column, ends: Column, starts: Column, steps: Column) -> Column:
        minima = F.aggregate(steps, F.transform(starts, lambda b: b["q"]), lambda low, p: F.transform(low, lambda v, k: F.least(v, F.get(low, k - p))))

        def first(low: Column, most: Column) -> Column:
            none = F.when(F.get(low, F.lit(0)) > most, F.lit(0)).otherwise(F.lit(-1))
            return F.aggregate(F.reverse(steps), none, lambda at, p: F.when(F.get(low, at + p) > most, at + p).otherwise(at)) + 1

        return _let(minima, lambda low: F.transform(ends, lambda b: _let(F.get(starts, first(low, b["q"] + F.lit(SPAN - 1))), lambda a: F.struct(
            (b["x"] - b["k"] - a["x"] + a["k"]).alias("n_equal"), (-(a["x"] + 1)).alias("begin"), b["x"].alias("end")))))

    def cut(own: Column, w: Column) -> Column:
        def ends_of(inside: Column) -> Column:
            spare = F.size(inside) - least
            return _let(F.least(spare, F.array_position(F.reverse(inside), 1).cast("int") - 1), lambda last: F.struct(
                w["n_equal"].alias("n_equal"), (F.least(spare - last, F.array_position(inside, 1).cast("int") - 1) - w["begin"]).alias("first"),
                (w["end"] - last).alias("end")))

        return F.when(w.isNotNull(), _let(F.slice(own, F.lit(1) - w["begin"], w["end"] + w["begin"]), ends_of))

    def best(own: Column, all_bounds: Column) -> Column:
        starts = F.filter(all_bounds, lambda b: (b["x"] < F.size(own)) & ((b["k"] == 0) | b["begins"]))
        ends = F.filter(all_bounds, lambda b: (b["k"] > 0) & ((b["x"] == F.size(own)) | b["ends"]))
        steps = F.filter(F.array(*[F.lit(1 << i) for i in range(30)]), lambda p: p < F.size(all_bounds))
        found = _let(starts, lambda s: _let(steps, lambda p: windows(own, ends, s, p)))
        return _let(F.array_max(F.filter(found, lambda w: (w["end"] + w["begin"] >= least) & (w["n_equal"] > 0))), lambda w: cut(own, w))

    return _let(flags, lambda own: _let(bounds(own), lambda all_bounds: best(own, all_bounds)))


def contaminated(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, h, item_id, item_words, first_word, end_word, n_equal, coverage``: the best window of each
    document (with ``h``, the hash of its text) and item that overlap, words from 0."""
    texts = _words(texts_of(docs))
    items = benchmark.select(F.col(f"`{item_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).distinct()
    items = _words(items).filter("n_words > 0").select(F.col("doc_id").alias("item_id"), F.col("h").alias("item_h"), "n_words", "words")
    hits = seed_hits(texts, items)
    if hits is None:
        hits = texts.select("doc_id", "h").join(items.select("item_id", "item_h"), F.lit(False)).withColumn("diagonal", F.lit(0))
    hits = materialize(hits)
    asked = items.select(F.col("item_id").alias("_item"), F.col("item_h").alias("_item_h"), F.col("n_words").alias("item_words"), F.col("words").alias("theirs"))
    pairs = hits.join(hint_if_small(asked), F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_h") == F.col("_item_h")))
    marked = hits.select("doc_id", "h").distinct()
    rows = texts.select("doc_id", "h", "n_words", "words").alias("t").join(hint_if_small(marked).alias("k"), same(["doc_id", "h"], "t", "k"), "left_semi")
    both = rows.dropDuplicates(["doc_id", "h"]).alias("t").join(pairs.alias("p"), same(["doc_id", "h"], "t", "p"))
    low, high = F.greatest(F.lit(0), F.col("diagonal")), F.least(F.col("t.n_words"), F.col("diagonal") + F.col("item_words"))
    flags = F.transform(F.sequence(low, high - 1), lambda i: (F.get("words", i) == F.get("theirs", (i - F.col("diagonal")).cast("int"))).cast("int"))
    both = both.withColumn("low", low).filter(high - low >= F.least(F.lit(RUN), "item_words"))
    both = both.select("t.doc_id", "t.h", "item_id", "item_h", "item_words", "low", _best_window(flags, F.least(F.lit(RUN), "item_words")).alias("s"))
    begin, end = -(F.col("low") + F.col("s.first")), F.col("low") + F.col("s.end")
    best = both.groupBy("doc_id", "h", "item_id", "item_h", "item_words").agg(F.max(F.when(F.col("s").isNotNull(), F.struct(
        F.col("s.n_equal").alias("n_equal"), begin.alias("begin"), end.alias("end")))).alias("b"))
    best = best.filter(F.col("b").isNotNull() & ((F.col("item_words") >= SHORT) | (F.col("b.n_equal") == F.col("item_words"))))
    return best.select(
        "doc_id", "h", "item_id", "item_words", (-F.col("b.begin")).alias("first_word"), F.col("b.end").alias("end_word"),
        F.col("b.n_equal").alias("n_equal"), (F.col("b.n_equal") / F.col("item_words")).alias("coverage"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a passage of a benchmark item."""
    found = materialize(contaminated(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct())
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_h"))
    return keyed.join(hint_if_small(found), own, "left_anti").drop("_key")
