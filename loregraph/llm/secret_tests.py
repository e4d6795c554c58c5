"""Secret scans: fixed patterns, and a battery of randomness tests on everything that looks like a token.

Candidates are runs of ``LEAST`` or more token characters. Each gets the narrowest encoding that
holds it, and three tests against symbols drawn at random from that alphabet: chi-squared
uniformity, runs above and below the middle of the alphabet, and serial correlation of neighbours.
The smallest of the three p-values, times three, is the candidate's randomness.

What ordinary text looks like to these tests at a given length is measured, not assumed: all letters
and digits of every document, without what is between them, are cut into decoys of the least lengths
of the length classes in turn, so that each is part of one decoy. The share of a class's decoys that have an encoding and at
least some randomness is the p-value of a token under the hypothesis that it is ordinary. A step-up
rule then controls false discoveries: a class's threshold for an encoding is the lowest randomness
at which the ordinary tokens to be expected, that share of the class's different tokens, are at most
``RATE`` of the different tokens that pass. So the null doesn't depend on how many long words there
are, tokens without a digit are tested like others (in alphabets of letters), and where letters in
one case are too few to be told from words, as at 20 characters, none is reported. The counts grow
with classes, encodings and bins, never with the documents.

Cases: null and empty texts have no spans; repeated rows get the same result each; a random token
that overlaps a span of a pattern isn't added; rows without doc_id are scanned like others; where all
texts are too short for decoys the tests alone decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregraph.llm.common import texts_of
from loregraph.llm.native_text import joined_spans, keyed_texts, pattern_matches, same
from loregraph.operators.scale import hint_if_small
from loregraph.session import materialize

KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1),
    "access": (r"AKIA[A-Z0-9]+", 0),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", 0),
    "random": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", 0),
}
ENCODINGS = (   # name, pattern, symbols in order; the narrowest that holds a token is taken
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("letters", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("letters_upper", "^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("letters_mixed", "^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("alphanumeric", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="),
)
LEAST = 20
RANDOM = 0.001     # randomness below which a token is not random at any length
RATE = 0.05
BINS = 80
CLASSES = (20, 23, 32, 46, 64)     # least lengths of the length classes
MASK = "[secret]"


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic curve (within 0.0002 of it)."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value bound to a variable: inside it, lambdas don't evaluate it per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_randomness(rows: DataFrame, token: str = "found", rough: bool = False) -> DataFrame:
    """Add ``encoding, p_uniform, p_runs, p_serial, randomness`` of a column of tokens.

    ``rough``: where the first test puts the randomness in a bin beyond that of ``RANDOM``, the others, which
    could only lower it, are left out and get the least value there is."""
    name = F.lit(ENCODINGS[-1][0])
    for label, pattern, _ in reversed(ENCODINGS[:-1]):
        name = F.when(F.col(token).rlike(pattern), F.lit(label)).otherwise(name)
    rows = rows.withColumn("encoding", name)

    def by_encoding(of) -> Column:
        out = of(ENCODINGS[-1][2])
        for label, _, own in reversed(ENCODINGS[:-1]):
            out = F.when(F.col("encoding") == label, of(own)).otherwise(out)
        return out

    rows = rows.withColumn("_a", by_encoding(lambda own: F.lit(float(len(own))))).withColumn("_n", F.length(token).cast("double"))
    zero, n, a = F.lit(0.0), F.col("_n"), F.col("_a")

    def total(values: Column) -> Column:
        return F.aggregate(values, zero, lambda x, y: x + y)

    def p_of(z: Column, sides: int) -> Column:
        return F.coalesce(F.least(F.lit(1.0), F.lit(float(sides)) * _tail(z)), zero)

    rows = rows.withColumn("_chars", F.filter(F.split(token, ""), lambda c: c != ""))
    # a symbol is counted by the length that its removal takes off: a step per symbol, not per pair of characters
    often = F.transform(F.array_distinct("_chars"), lambda c: F.length(token) - F.length(F.replace(F.col(token), c, F.lit(""))))
    rows = rows.withColumn("_often", often).withColumn("_squares", F.aggregate("_often", F.lit(0), lambda x, y: x + y * y).cast("double"))
    df = a - 1
    chi = F.greatest(zero, a / n * F.col("_squares") - n)
    wide = F.lit(2.0) / (F.lit(9.0) * df)
    rows = rows.withColumn("p_uniform", p_of((F.pow(chi / df, F.lit(1 / 3)) - (F.lit(1.0) - wide)) / F.sqrt(wide), 1))
    open_ = _bin(F.lit(3.0) * F.col("p_uniform")) <= _bin(F.lit(RANDOM)) if rough else F.lit(True)
    # which symbols are of the upper half of the alphabet: the length without others, and the number of runs, need no list of symbols
    halves = by_encoding(lambda own: F.translate(token, own, "".join("01"[2 * i >= len(own)] for i in range(len(own)))))
    rows = rows.withColumn("_b", F.when(open_, halves))
    rows = rows.withColumn("_h", F.length(F.regexp_replace("_b", "[^1]+", "")).cast("double"))
    runs = F.length(F.regexp_replace("_b", "1+|[^1]+", "x")).cast("double")
    mean_runs = F.lit(2.0) * F.col("_h") * (n - F.col("_h")) / n + 1
    spread = F.sqrt(F.greatest(zero, (mean_runs - 1) * (mean_runs - 2) / (n - 1)))
    rows = rows.withColumn("p_runs", p_of(F.when(spread > 0, F.abs(runs - mean_runs) / spread), 2))
    numbers = _once(by_encoding(F.lit), lambda own: F.transform("_chars", lambda c: F.instr(own, c).cast("double") - 1))
    rows = rows.withColumn("_v", F.when(F.col("_b").isNotNull(), numbers))
    rows = rows.withColumn("_m", total(F.col("_v")) / n).withColumn("_c", _once(F.col("_m"), lambda m: F.transform("_v", lambda x: x - m)))
    around = total(F.transform("_c", lambda x: x * x))
    beside = total(F.zip_with(F.slice("_c", F.lit(1), F.size("_c") - 1), F.slice("_c", F.lit(2), F.size("_c") - 1), lambda x, y: x * y))
    rows = rows.withColumn("p_serial", p_of(F.when(around > 0, F.abs(beside / around) * F.sqrt(n)), 2))
    least = F.least("p_uniform", "p_runs", "p_serial")
    rows = rows.withColumn("randomness", F.least(F.lit(1.0), F.lit(3.0) * least))
    return rows.drop("_a", "_n", "_chars", "_often", "_squares", "_b", "_h", "_v", "_m", "_c")


def _bin(randomness: Column) -> Column:
    """Quarter decades from 0 (random) up."""
    return F.least(F.lit(BINS), F.floor(F.lit(-4.0) * F.log10(F.greatest(randomness, F.lit(1e-30))))).cast("int")


def _graded(rows: DataFrame, rough: bool = False) -> DataFrame:
    """Tokens ``found`` with ``length_class, encoding, bin``; ``rough``: bins beyond that of ``RANDOM``, which no
    threshold reaches, are not told apart."""
    size = sum((F.when(F.length("found") >= n, 1).otherwise(0) for n in CLASSES), F.lit(0))
    return with_randomness(rows, rough=rough).withColumn("bin", _bin(F.col("randomness"))).withColumn("length_class", size)


def decoys(texts: DataFrame) -> DataFrame:
    """``found``: the whole of every text of ``texts`` (``text, h``) in the shape of tokens, a token per length
    class in turn; only what is left at its end, too short for the next, is in none. In every other text,
    by its hash, words begin with a capital, as in identifiers."""
    shaped = F.when(F.pmod(F.shiftright("h", 32), F.lit(2)) == 0, F.initcap("text")).otherwise(F.col("text"))
    squeezed = F.array_join(F.regexp_extract_all(shaped, F.lit("[A-Za-z0-9]+"), F.lit(0)), "")      # faster than removing the others
    rows = texts.select(F.explode(F.regexp_extract_all(squeezed, F.lit(f".{{1,{sum(CLASSES)}}}"), F.lit(0))).alias("piece"))
    cuts = [F.substring("piece", sum(CLASSES[:k]) + 1, n) for k, n in enumerate(CLASSES)]
    whole = [F.when(F.length(c) == n, c) for c, n in zip(cuts, CLASSES)]
    return rows.select(F.explode(F.array_compact(F.array(*whole))).alias("found"))


def thresholds(tokens: DataFrame, ordinary: DataFrame) -> DataFrame:
    """``length_class, encoding, last_bin``: up to which bin tokens pass. A row per class and encoding.

    ``tokens`` are counted once however often they occur; ``ordinary`` are the decoys."""
    key = ["length_class", "encoding"]
    none = F.lit(0).cast("long")
    counts = tokens.groupBy(*key, "bin").agg(F.count_distinct("found").alias("n")).select(*key, "bin", "n", none.alias("d")).unionByName(
        ordinary.groupBy(*key, "bin").agg(F.count("*").alias("d")).select(*key, "bin", none.alias("n"), "d"))
    counts = counts.groupBy(*key, "bin").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    upto = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("length_class")
    counts = counts.select(*key, "bin", *(F.sum(c).over(w).alias(c + a) for c in "nd" for w, a in ((upto, "_passed"), (whole, "_all"))))
    expected = F.when(F.col("d_all") > 0, F.col("n_all") * F.col("d_passed") / F.col("d_all")).otherwise(0)
    good = (expected <= F.lit(RATE) * F.col("n_passed")) & (F.col("bin") <= _bin(F.lit(RANDOM)))
    return counts.filter(good).groupBy(*key).agg(F.max("bin").alias("last_bin"))


def random_tokens(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the token candidates in ``found``, those that pass for random among ``texts`` (``text, h``)."""
    tested = _graded(found)
    passed = tested.join(F.broadcast(thresholds(tested, _graded(decoys(texts), rough=True))), ["length_class", "encoding"])
    return passed.filter("bin <= last_bin").select("doc_id", "h", "kind", "start", "end")


def secret_spans(texts: DataFrame) -> DataFrame:
    """``doc_id, h, base, spans`` of texts (doc_id, text, h) with any: arrays of (start, rank, kind, end)."""
    found = materialize(pattern_matches(texts, PATTERNS))
    size = F.when(F.col("kind") == "assign", F.length("found") >= 6).when(F.col("kind") == "access", F.length("found") >= 20).otherwise(True)
    base = found.filter((F.col("kind") != "random") & size).select("doc_id", "h", "kind", "start", "end")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    each = base.unionByName(random_tokens(found.filter("kind = 'random'"), texts)).withColumn("s", F.struct("start", rank.alias("rank"), "kind", "end"))
    own = each.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("s")).alias("s"))
    own = own.withColumn("base", F.filter("s", lambda s: s["kind"] != "random"))
    free = F.filter("s", lambda s: (s["kind"] != "random") | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    return own.select("doc_id", "h", "base", free.alias("spans"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """A row per document: counts per pattern, digest of their spans, and all spans."""
    texts = keyed_texts(texts_of(docs))
    found = secret_spans(texts)
    rows = texts.select("doc_id", "h").alias("t").join(found.alias("f"), same(["doc_id", "h"], "t", "f"), "left")

    def count(kind: str) -> Column:
        own = F.size(F.filter("base", lambda s: s["kind"] == kind))
        return F.when(F.col("base").isNull(), F.lit(0)).otherwise(own).cast("long").alias(f"n_{kind}")

    return rows.select(
        F.col("t.doc_id").cast("long").alias("doc_id"), *map(count, KINDS[:3]),
        F.sha2(F.coalesce(joined_spans(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(joined_spans(F.col("spans")), F.lit("")).alias("spans"))


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a fixed mark; its other columns stay as they are.

    Spans are broadcast to the documents if shown to be small; otherwise both are shuffled."""
    columns = docs.columns
    texts = keyed_texts(texts_of(docs, text_col=text))
    found = materialize(secret_spans(texts).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("spans").alias("_spans")))
    rows = docs.withColumn("_key", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    rows = rows.join(hint_if_small(found), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_h")), "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def put(a: Column, s: Column) -> Column:
        between = F.substring(F.col(f"`{text}`"), a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int"))
        return F.struct(F.greatest(a["at"], s["end"]).cast("long").alias("at"),
                        F.when(s["start"] >= a["at"], F.concat(a["out"], between, F.lit(MASK))).otherwise(a["out"]).alias("out"))

    done = F.aggregate("_spans", start, put, lambda a: F.concat(a["out"], F.substring(F.col(f"`{text}`"), a["at"].cast("int") + 1, F.length(F.col(f"`{text}`")))))
    masked = F.when(F.col("_spans").isNull(), F.col(f"`{text}`")).otherwise(done)
    return rows.withColumn(text, masked).select(*[F.col(f"`{c}`") for c in columns])
