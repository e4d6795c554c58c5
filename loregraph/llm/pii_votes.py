"""Personal data by weak supervision.

Fixed patterns find base spans, and wider ones candidates (account numbers, telephone numbers
without a plus, social security and bank account numbers). Six labelers vote on every span, for,
against or not at all: shape, checksum (Luhn's, or modulo 97 for bank accounts), gazetteer, words
ahead that name such data, words ahead that name something else, and variety of the digits.
Expectation maximisation over the counts of vote patterns estimates each pattern's probability and
each labeler's reliability, per kind and drawn towards that over all kinds; with these as soft
labels a naive Bayes classifier over features of the spans (kind with length, shape, word ahead,
checksum, gazetteer) is counted, and decides which candidates are added. Base spans always stay.

A gazetteer is a table of (kind, entry): top domains, issuers, country and area codes, countries of
bank accounts with their lengths. The built-in one is made from ranges; a fuller one can be passed.

Only counts reach the driver: at most kinds * 3^6 vote patterns. The classifier's table has at most
kinds * (lengths + shapes + hashed words + votes) rows and is broadcast, as is the gazetteer if it
is the built-in one or shown to be small.

Cases: null and empty texts have no spans; repeated rows get the same result each; a candidate
that overlaps a base span is added only if it covers it (the digits of a bank account may pass
Luhn's test by chance); without any span the classifier is empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm.common import texts_of
from loregraph.llm.native_text import joined_spans, keyed_texts, pattern_matches, same
from loregraph.operators.scale import hint_if_small
from loregraph.session import materialize

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "tel", "ssn", "iban")
KINDS = BASE + ADDED
# Starts and possessive repeats keep a scan linear; the matches are those of the plain patterns.
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0),
    "card": (r"[0-9](?:[\x20-]?[0-9]){11,}+", 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0),
    "tel": (r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-]\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", 0),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])", 0),
}
# Top domains, ranges of leading digits, countries of bank accounts with their lengths.
TOP_DOMAINS = ("com org net edu gov mil int info biz name pro io co ai app dev eu uk de fr es it nl ch at be se no dk fi pl pt gr ie cz sk hu ro bg "
               "hr si rs lt lv ee lu li is ua ru by tr il us ca mx au nz jp cn kr tw hk sg in id my th vn ph pk br ar cl pe ve za ng ke eg ma").split()
ISSUERS = ("2200-2204 2221-2720 3000-3059 3095 3400-3499 3528-3589 3600-3699 3700-3799 3800-3999 4000-4999 5018 5020 5038 5100-5599 5893 6011 6200-6299 "
           "6304 6440-6599 6759 6761-6763").split()
COUNTRY_CODES = ("1 7 20 27 30-34 36 39-41 43-49 51-58 60-66 81 82 84 86 90-95 98 211-213 216 218 220-269 290 291 297-299 350-359 370-383 385-387 389 "
                 "420 421 423 500-509 590-599 670 672-683 685-692 850 852 853 855 856 880 886 960-968 970-977 992-996 998").split()
ACCOUNTS = ("AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 "
            "GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 "
            "NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()
SAMPLE_NUMBERS = ("078-05-1120", "219-09-9999", "457-55-5462", "123-45-6789")   # numbers of leaflets and examples
RESERVED_IP = r"^(?:0|10|127|255|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."
COUNTRY_CODE = r"^(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
NAMES_DATA = r"(?i)\b(?:e-?mail|mail|contact|write|phone|tel|telephone|call|mobile|fax|card|visa|account|acct|iban|ssn|social security|ip|address|from)\b\W*$"
NAMES_OTHER = r"(?i)(?:\b(?:version|ver|v|order|ref|isbn|issn|invoice|serial|item|page|no|number of|sha|hash|id|\d+)\b\W*|[$€£#=/])$"
CONTEXT = 24
VOTERS = ("shape", "checksum", "gazetteer", "named", "otherwise", "variety")
LENGTHS, WORDS = 32, 1024
ROUNDS = 40
SHRINK = 30.0   # spans that a kind must have before its own reliabilities weigh as much as the common ones
ACCEPT = 0.5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def candidates(texts: DataFrame) -> DataFrame:
    """Base spans and candidates: ``doc_id, h, kind, start, end, found, before``."""
    rows = pattern_matches(texts, PATTERNS, CONTEXT).withColumn("n", F.length(_digits(F.col("found"))))
    part = lambda p: F.regexp_replace(p, "^0+", "")
    small = F.forall(F.split("found", r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    n, kind = F.col("n"), F.col("kind")
    card = n.between(12, 19)
    # luhn_check takes digits only, and only where their number is right
    luhn = F.when(card, F.call_function("luhn_check", _digits(F.col("found")))).otherwise(False)
    rows = rows.withColumn("kind", F.when((kind == "card") & ~luhn & card, F.lit("account")).otherwise(kind))
    kept = F.when(kind == "ip", small).when(kind == "card", luhn).when(kind == "phone", n.between(9, 15)).otherwise(True)
    return rows.filter(kept)


def _vote(yes: Column, no: Column) -> Column:
    """1 for, 0 against, 2 no vote."""
    return F.when(yes, 1).when(no, 0).otherwise(2)


def gazetteer(spark: SparkSession) -> DataFrame:
    """The built-in ``kind, entry``: what :func:`entry_of` gives for known values. A few thousand rows."""
    whole = [("email", d) for d in TOP_DOMAINS] + [("iban", a) for a in ACCOUNTS]
    ranges = [(kind, *(r.split("-") * 2)[:2]) for kind, own in (("card", ISSUERS), ("account", ISSUERS), ("phone", COUNTRY_CODES)) for r in own]
    numbers = spark.createDataFrame(ranges, "kind string, low string, high string").select(
        "kind", F.explode(F.sequence(F.col("low").cast("int"), F.col("high").cast("int")).cast("array<string>")).alias("entry"))
    # area codes: first digit 2 to 9, second not 9, not ending in 11, not kept for expansion (37, 96)
    code = F.col("id").cast("string")
    areas = spark.range(200, 1000).filter(~code.rlike("^(?:.9|.11|37|96)")).select(F.lit("tel").alias("kind"), code.alias("entry"))
    return spark.createDataFrame(whole, "kind string, entry string").unionByName(numbers).unionByName(areas)


def entry_of(kind: Column, found: Column) -> Column:
    """What a span is looked up by in the gazetteer; null for kinds without one."""
    digits = _digits(found)
    return (F.when(kind == "email", F.lower(F.regexp_extract(found, r"\.([A-Za-z0-9-]+)$", 1))).when(kind.isin("card", "account"), F.substring(digits, 1, 4))
            .when(kind == "phone", F.regexp_extract(digits, COUNTRY_CODE, 1)).when(kind == "tel", F.substring(digits, 1, 3))
            .when(kind == "iban", F.concat(F.substring(found, 1, 2), F.length(found).cast("string"))))


def remainder_97(account: Column) -> Column:
    """A bank account number modulo 97, letters counting from 10 and the first four characters last; 1 if it is right."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    each = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), value)
    return F.aggregate(each, F.lit(0), lambda rest, v: (rest * F.when(v > 9, 100).otherwise(10) + v) % 97)


def with_votes(spans: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Add a column for each labeler, and ``votes``, all of them as one string. ``known``: another gazetteer.

    The words ahead always vote: without a vote for or against by their absence, a labeler that only
    ever votes one way would look alike for true and false spans."""
    kind, found, digits = F.col("kind"), F.col("found"), _digits(F.col("found"))
    numeric = kind.isin("card", "account")
    shape = (F.when(kind == "email", found.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,24}$"))
             .when(kind == "ip", ~found.rlike(r"(?:^|\.)0[0-9]")).when(numeric, found.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"))
             .when(kind == "phone", F.length(digits) >= 10).when(kind == "tel", ~F.substring(digits, 4, 3).rlike("^(?:0|.11)"))
             .when(kind == "ssn", ~found.rlike(r"^(?:000|666|9[0-9]{2})-|-00-|-0000$")).otherwise(F.length(found).between(15, 34)))
    luhn = F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)
    right = F.when(kind == "iban", remainder_97(found) == 1).when(numeric, luhn)
    named, other = F.col("before").rlike(NAMES_DATA), F.col("before").rlike(NAMES_OTHER)
    variety = F.size(F.array_distinct(F.split(digits, "")))
    spark = spans.sparkSession
    table = F.broadcast(gazetteer(spark)) if known is None else hint_if_small(known.select("kind", "entry").distinct())
    rows = spans.withColumn("entry", entry_of(kind, found)).join(table.withColumn("_known", F.lit(True)), ["kind", "entry"], "left")
    listed = (F.when(kind == "ip", ~found.rlike(RESERVED_IP)).when(kind == "ssn", F.when(found.isin(*SAMPLE_NUMBERS), False))
              .when(F.col("entry").isNotNull(), F.col("_known").isNotNull()))
    rows = rows.withColumn("shape", _vote(shape, ~shape)).withColumn("checksum", _vote(right, ~right))
    rows = rows.withColumn("gazetteer", _vote(listed, ~listed)).withColumn("named", _vote(named, ~named)).drop("entry", "_known")
    rows = rows.withColumn("otherwise", _vote(~other, other)).withColumn("variety", _vote((kind != "email") & (variety >= 4), (kind != "email") & (variety < 4)))
    return rows.withColumn("votes", F.concat(*[F.col(v).cast("string") for v in VOTERS]))


Reliability = dict[tuple[str, str], tuple[float, float]]


def maximise(counts: list[tuple[str, str, int]], rounds: int = ROUNDS) -> tuple[dict[tuple[str, str], float], Reliability]:
    """Probability of each (kind, votes), and each (kind, labeler)'s chance of voting for true and false spans.

    A labeler that doesn't vote says nothing; a kind has a share of true spans of its own. A kind's
    reliabilities are drawn towards those over all kinds by ``SHRINK`` spans."""
    share = {kind: 0.5 for kind, _, _ in counts}
    sure = {(kind, k): (0.8, 0.3) for kind in share for k in range(len(VOTERS))}
    chance: dict[tuple[str, str], float] = {}
    for _ in range(rounds if counts else 0):
        for kind, votes, _ in counts:
            odds = math.log(share[kind] / (1 - share[kind]))
            for k, v in enumerate(votes):
                hit, false = sure[kind, k]
                odds += math.log(hit / false) if v == "1" else math.log((1 - hit) / (1 - false)) if v == "0" else 0.0
            chance[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for k in range(len(VOTERS)):
            seen = {kind: [[0.0, 0.0], [0.0, 0.0]] for kind in share}   # votes for and against, of true and of false spans
            for kind, votes, n in counts:
                if votes[k] != "2":
                    p, against = chance[kind, votes], int(votes[k] == "0")
                    seen[kind][0][against] += n * p
                    seen[kind][1][against] += n * (1 - p)
            common = []
            for truth, prior in enumerate(((8.0, 2.0), (3.0, 7.0))):   # a prior of ten spans: labelers are better than chance
                yes, no = (prior[i] + sum(own[truth][i] for own in seen.values()) for i in (0, 1))
                common.append(yes / (yes + no))
            for kind, own in seen.items():
                sure[kind, k] = tuple((yes + SHRINK * c) / (yes + no + SHRINK) for (yes, no), c in zip(own, common))
        for kind in share:
            own = [(chance[kind, votes], n) for of, votes, n in counts if of == kind]
            share[kind] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
    return chance, {(kind, VOTERS[k]): pair for (kind, k), pair in sure.items()}


def _features(spans: DataFrame) -> DataFrame:
    """Add ``features``: kind with length, with shape (digits, letters and signs in a row), with the word ahead, and with
    the votes by checksum and gazetteer, which tell spans of one shape apart."""
    shape = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace("found", "[0-9]+", "9"), "[A-Za-z]+", "a"), r"([^9a])\1+", "$1"), 1, 12)
    word = F.pmod(F.xxhash64(F.lower(F.regexp_extract("before", r"(\w*)\W*$", 1))), F.lit(WORDS))
    shapes = F.pmod(F.xxhash64(shape), F.lit(WORDS))
    parts = [("length", F.least(F.lit(LENGTHS), F.length("found"))), ("shape", shapes), ("word", word), ("checksum", F.col("checksum")), ("gazetteer", F.col("gazetteer"))]
    return spans.withColumn("features", F.array(*[F.concat_ws(":", "kind", F.lit(name), value.cast("string")) for name, value in parts]))


def classify(spans: DataFrame) -> DataFrame:
    """Add ``probability`` of the classifier to spans with votes; one pass for the counts of votes,
    one for those of features, and the decision."""
    spark = spans.sparkSession
    counts = [(r["kind"], r["votes"], r["n"]) for r in spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()]
    chance, _ = maximise(sorted(counts))
    table = spark.createDataFrame([(k, v, p) for (k, v), p in chance.items()], "kind string, votes string, p double")
    soft = _features(spans).join(F.broadcast(table), ["kind", "votes"])
    each = soft.select("kind", "p", F.explode("features").alias("feature"))
    weights = each.groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(F.lit(1.0) - F.col("p")).alias("no"), F.first("kind").alias("kind"))
    totals = soft.groupBy("kind").agg(F.sum("p").alias("all_yes"), F.sum(F.lit(1.0) - F.col("p")).alias("all_no"))
    weights = weights.join(F.broadcast(totals), "kind")
    odds = F.log((F.col("yes") + 0.5) / (F.col("all_yes") + 1)) - F.log((F.col("no") + 0.5) / (F.col("all_no") + 1))
    weights = materialize(weights.select("feature", odds.alias("odds"), F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1)).alias("prior")))
    keys = ["doc_id", "h", "kind", "start", "end"]
    scored = soft.select(*keys, F.explode("features").alias("feature")).join(F.broadcast(weights), "feature")
    total = scored.groupBy(*keys).agg((F.sum("odds") + F.first("prior")).alias("odds"))
    return total.select(*keys, (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), "odds"))))).alias("probability"))


def _cuts(b: Column, s: Column) -> Column:
    """Whether two spans share a place and ``s`` doesn't cover all of ``b``."""
    return (b["start"] < s["end"]) & (b["end"] > s["start"]) & ~((s["start"] <= b["start"]) & (s["end"] >= b["end"]))


def pii_spans(texts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, h, base, spans`` of texts (doc_id, text, h) with any: arrays of (start, rank, kind, end)."""
    voted = materialize(with_votes(candidates(texts), known))
    judged = classify(voted)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    kept = judged.filter(F.col("kind").isin(*BASE) | (F.col("probability") >= ACCEPT))
    own = kept.withColumn("s", F.struct("start", rank.alias("rank"), "kind", "end")).groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("s")).alias("s"))
    own = own.withColumn("base", F.filter("s", lambda s: s["rank"] <= len(BASE)))
    free = F.filter("s", lambda s: (s["rank"] <= len(BASE)) | ~F.exists("base", lambda b: _cuts(b, s)))
    return own.select("doc_id", "h", "base", free.alias("spans"))


def scan_pii(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A row per document: counts of base spans per kind, digest of them, and all spans.

    ``known``: a gazetteer (kind, entry) instead of the built-in one."""
    texts = keyed_texts(texts_of(docs))
    rows = texts.select("doc_id", "h").alias("t").join(pii_spans(texts, known).alias("f"), same(["doc_id", "h"], "t", "f"), "left")

    def count(kind: str) -> Column:
        own = F.size(F.filter("base", lambda s: s["kind"] == kind))
        return F.when(F.col("base").isNull(), F.lit(0)).otherwise(own).cast("long").alias(f"n_{kind}")

    return rows.select(
        F.col("t.doc_id").cast("long").alias("doc_id"), *map(count, BASE), F.sha2(F.coalesce(joined_spans(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(joined_spans(F.col("spans")), F.lit("")).alias("spans"))
