"""Top-k retrieval by BM25 for many queries at once, exact, without scoring every document.

Documents of a group fall into blocks of about ``BLOCK_DOCS``. For every term that some query asks
for, a table holds the largest contribution it makes in each block, and thereby a bound on what any
document of the block can score for a query. The documents that are best by a query's rarest terms
are scored in full; the k-th best of them is a threshold that the result cannot fall below. Terms that
together cannot reach it are left out at first: only documents with one of the other terms, in
blocks whose bound reaches the threshold, are scored, and the left-out terms are looked up for
those that still can reach it. So words found in nearly every document cost a row per block, not
one per document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregraph.functions import text
from loregraph.operators.scale import by_bytes, hint_if_small, is_small, of_groups, spread, top_n
from loregraph.session import materialize

K1, B = 1.2, 0.75
SCORE_DIGITS = 6   # scores are ranked rounded, so that float noise cannot reorder ties
BLOCK_DOCS = 16
TRIED = 5          # documents that are scored for the threshold, per document asked for
LEAD = 20          # postings of the rarest terms that are read for the threshold, per document asked for
PAIRS = 1 << 20    # postings times queries that ask for them, per task that scores
READ = 4 << 20     # bytes of files with the documents, per task that counts terms
MARGIN = 1e-5      # thresholds are lowered by more than rounding and float noise can make

DOC = ["group_id", "doc_id"]
ASKED = ["query_id", "group_id"]
HIT = ["query_id", "group_id", "doc_id"]
# "This document exists". Tokens are letters and digits, so none begins like a mark; a document has
# one of several, lest they meet in one task.
MARK, MARKS = "\x00", 64


def is_mark() -> Column:
    return F.col("term").startswith(MARK)


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms per query."""
    return queries.select(*ASKED, F.explode(F.array_distinct(text.tokens("text"))).alias("term")).distinct()


def matched_terms(docs: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """(group_id, doc_id, h, dl, term) of tokens some query asks for and a mark per row, partitioned by
    document; ``h`` is the hash of the text.

    One pass over the text: the semi-join drops all other tokens before the only shuffle."""
    groups = terms.select("group_id").distinct()
    marks = groups.select("group_id", F.explode(F.array(*[F.lit(f"{MARK}{i}") for i in range(MARKS)])).alias("term"))
    wanted = terms.select("group_id", "term").distinct().unionByName(marks)
    # Not spread by the key of the repartition below, which would then be dropped.
    cut = spread(docs.select(*DOC, "text"), "doc_id").select(*DOC, F.xxhash64("text").alias("h"), text.tokens("text").alias("tokens"))
    own = F.concat(F.lit(MARK), F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)).cast("string"))
    each = cut.select(*DOC, "h", F.size("tokens").alias("dl"), F.explode(F.concat(F.array(own), F.col("tokens"))).alias("term"))
    found = each.join(F.broadcast(wanted) if small else wanted, ["group_id", "term"], "left_semi")
    return by_bytes(found, docs, READ, *DOC)


def postings(docs: DataFrame, terms: DataFrame, small: bool | None = None) -> DataFrame:
    """(group_id, doc_id, dl, term, tf), with the mark of each document.

    A document that is stored more than once counts once; of different texts under one id, that with
    the smallest hash. All of it happens within the partition of the document."""
    found = matched_terms(docs, terms, is_small(terms) if small is None else small)
    counts = found.groupBy(*DOC, "h", "dl", "term").agg(F.count("*").alias("n"))
    one = counts.filter(is_mark()).groupBy(*DOC).agg(F.min(F.struct("h", "n")).alias("one"))
    # As a filter, the equality would become a key of the join, and all counts would be shuffled again by it.
    own = counts.join(one, DOC).withColumn("tf", F.when(F.col("h") == F.col("one.h"), (F.col("n") / F.col("one.n")).cast("long")))
    return own.filter("tf IS NOT NULL").select(*DOC, "dl", "term", "tf")


def part() -> Column:
    """Contribution of a posting (``tf, dl``) to the score of a query with ``idf`` and ``average`` length."""
    return F.col("idf") * unit(F.col("average"))


def unit(average: Column) -> Column:
    length = F.lit(1 - B) + F.lit(B) * F.col("dl") / average
    return F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * length)


def block_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id"), blocks).cast("long")


def in_tasks(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows`` by ``keys``, in a task for every ``PAIRS`` of ``n``, and no fewer than there are cores."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // PAIRS)), *keys)


WEIGHT = ["query_id", "group_id", "term", "idf", "average", "n_blocks"]


@dataclass
class Index:
    """What the queries need of the documents, staged, so that Spark knows the sizes and broadcasts what
    is small. ``postings``: group_id, doc_id, dl, term, tf; ``blocks``: group_id, term, block, top (largest
    contribution without its weight), n; ``terms``: ``WEIGHT``, df, most (largest contribution); ``n``: number of
    postings."""

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    n: int

    def asked_for(self, terms: DataFrame) -> DataFrame:
        """``postings`` with the queries whose ``terms`` (``WEIGHT``, df, and what else they carry) they hold.

        The postings are dealt by document over as many tasks as the pairs to be made need, which the
        terms tell, so a task makes a bounded number of them. As terms shown to be few are broadcast, all
        pairs of a document are made in one task, and scores by document need no further shuffle."""
        return self.dealt(self.postings, terms).join(hint_if_small(terms.drop("df")), ["group_id", "term"])

    def dealt(self, rows: DataFrame, terms: DataFrame, *keys: str) -> DataFrame:
        """``rows`` by ``keys`` (by document, if none), in tasks of ``PAIRS`` postings that ``terms`` ask for, or fewer.
        Few terms, too, read all postings: a task reads no more than ``PAIRS`` of them."""
        pairs = terms.agg(F.sum("df").alias("n")).first().n or 0
        return in_tasks(rows, max(pairs, self.n), *(keys or DOC))

    def scores(self, terms: DataFrame | None = None) -> DataFrame:
        """Score of every document with a term of a query (of ``terms``, if given)."""
        found = self.asked_for((self.terms if terms is None else terms).select(*WEIGHT, "df"))
        return found.groupBy(*HIT).agg(F.sum(part()).alias("score"))

    def complete(self, pairs: DataFrame, terms: DataFrame) -> DataFrame:
        """What ``terms`` add to the score of ``pairs`` (query_id, group_id, doc_id): (.., score), where there is any.

        Only pairs and postings are shuffled, by document, not the terms of each pair."""
        held = self.dealt(self.postings, terms).join(self.dealt(pairs.select(*HIT), terms), DOC)
        sought = hint_if_small(terms.select(*WEIGHT))
        return held.join(sought, [*ASKED, "term"]).groupBy(*HIT).agg(F.sum(part()).alias("score"))

    def thresholds(self, k: int) -> DataFrame:
        """(query_id, group_id, least): what the k-th best score at least is, where there are k: that of the
        documents that are best by the rarest terms, scored with all terms."""
        before = Window.partitionBy(*ASKED).orderBy(F.desc("most"), "term").rowsBetween(Window.unboundedPreceding, -1)
        lead = self.terms.withColumn("before", F.coalesce(F.sum("df").over(before), F.lit(0))).filter(F.col("before") < LEAD * k)
        best = top_n(self.scores(lead), ASKED, [F.desc("score"), F.asc("doc_id")], TRIED * k, "rank")
        tried = self.complete(best, self.terms).groupBy(*ASKED).agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
        return tried.filter(F.size("s") >= k).select(*ASKED, (F.get("s", F.lit(k - 1)) - MARGIN).alias("least"))

    def candidates(self, k: int) -> DataFrame:
        """(query_id, group_id, doc_id, score) of all documents that can be among the k best: exact scores."""
        terms = self.terms.join(self.thresholds(k), ASKED, "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        upto = Window.partitionBy(*ASKED).orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        terms = materialize(terms.withColumn("late", F.sum("most").over(upto) < F.col("least")))
        bound = F.col("idf") * F.col("top")
        # By block: a task holds few blocks for every query, instead of all blocks of the queries that share a term.
        held = self.dealt(self.blocks, terms, "group_id", "block").join(hint_if_small(terms), ["group_id", "term"])
        met = held.groupBy(*ASKED, "block").agg(
            F.sum(bound).alias("bound"), F.sum(F.when(F.col("late"), bound).otherwise(0.0)).alias("rest"),
            F.max(~F.col("late")).alias("early"), F.max("least").alias("least"))
        met = met.filter("early AND bound >= least").select(*ASKED, "block", "rest", "least")
        first = terms.filter("NOT late").select(*WEIGHT, "df")
        early = self.asked_for(first).withColumn("block", block_of(F.col("n_blocks")))
        early = self.dealt(early, first, *ASKED, "block")
        some = early.join(met, [*ASKED, "block"]).groupBy(*HIT, "block").agg(   # a document is in one block
            F.sum(part()).alias("score"), F.max("rest").alias("rest"), F.max("least").alias("least"))
        some = materialize(some.filter("score + rest >= least").select(*HIT, "score"))
        more = self.complete(some, terms.filter("late")).withColumnRenamed("score", "more")
        return some.join(more, HIT, "left").select(*HIT, (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def block_tops(own: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """``Index.blocks`` of at most ``n`` postings, made by block in tasks of ``PAIRS`` of them, or fewer.

    A shuffled join with ``stats`` would leave the postings dealt by group, which the grouping then keeps: one
    task for a large group. So they are dealt by block whichever join is made."""
    placed = own.join(hint_if_small(stats), "group_id").select(
        "group_id", "term", block_of(F.col("n_blocks")).alias("block"), unit(F.col("average")).alias("top"))
    tops = in_tasks(placed, n, "group_id", "block").groupBy("group_id", "term", "block")
    return tops.agg(F.max("top").alias("top"), F.count("*").alias("n"))


def index(docs: DataFrame, queries: DataFrame) -> Index:
    """Read the documents of the queries' groups once. ``docs`` has (group_id, doc_id, text), ``queries``
    (query_id, group_id, text); a query may ask several groups. Statistics are those of the group."""
    terms = query_terms(queries)
    tf = materialize(postings(of_groups(docs, queries), terms))
    stats = materialize(tf.filter(is_mark()).groupBy("group_id").agg(
        F.count("*").alias("n"), F.avg("dl").alias("average"), F.ceil(F.count("*") / F.lit(BLOCK_DOCS)).alias("n_blocks")))
    own = tf.filter(~is_mark())
    n = own.count()
    blocks = materialize(block_tops(own, stats, n))
    by_term = blocks.groupBy("group_id", "term").agg(F.max("top").alias("top"), F.sum("n").alias("df"))
    weights = by_term.join(stats, "group_id").join(terms, ["group_id", "term"])
    weights = weights.withColumn("idf", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return Index(own, blocks, materialize(weights.select(*WEIGHT, "df", (F.col("idf") * F.col("top")).alias("most"))), n)


def ranked(scores: DataFrame, k: int, decimals: int = SCORE_DIGITS) -> DataFrame:
    rounded = scores.withColumn("score", F.round("score", decimals))
    return top_n(rounded, ASKED, [F.desc("score"), F.asc("doc_id")], k, "rank")


def bm25(docs: DataFrame, queries: DataFrame, k: int, decimals: int = SCORE_DIGITS) -> DataFrame:
    """Top ``k`` documents of each query's group: (query_id, group_id, doc_id, score, rank)."""
    return ranked(index(docs, queries).candidates(k), k, decimals)
