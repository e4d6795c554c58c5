"""Top-k retrieval by vectors (cosine) and rank fusion, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loregraph.operators import lexical
from loregraph.operators.lexical import ASKED, DOC, HIT, SCORE_DIGITS, bm25  # noqa: F401 - the other half of retrieval
from loregraph.operators.scale import first_wins, hint_if_small, is_small, of_groups, top_n
from loregraph.session import materialize

RRF_OFFSET = 60
FUSED_DIGITS = 10
QUERY_BLOCK = 4096
SCORE_CELLS = 4 << 20  # largest score matrix a task holds


def one_per_id(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the smallest of those that repeat. Only the keys are shuffled, and rows whose key repeats."""
    twice = materialize(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys))
    if not twice.limit(1).count():
        return rows
    twice = hint_if_small(twice)
    rest = [c for c in rows.columns if c not in keys]
    repeated = first_wins(rows.join(twice, keys, "left_semi").select(*keys, *rest), keys, rest)
    return rows.join(twice, keys, "left_anti").select(*keys, *rest).unionByName(repeated)


def cosine(docs: DataFrame, queries: DataFrame, k: int, decimals: int = SCORE_DIGITS) -> DataFrame:
    """Exact top ``k`` by cosine in each query's group: (query_id, group_id, doc_id, score, rank).

    ``docs`` has (group_id, doc_id, embedding), ``queries`` (query_id, group_id, embedding), with
    ids of any type. A vector only meets queries of its own length (see ``other_lengths``). Queries
    shown to be few are broadcast: every task multiplies its Arrow batches with them and keeps its
    own best ``k`` per query, so neither pairs nor documents are shuffled. More queries meet the
    documents in a grid of blocks, each cell multiplied by one task. A document that is stored more
    than once counts once.
    """
    return _nearest(*_vectors(docs, queries), k, decimals)


def _nearest(docs: DataFrame, asked: DataFrame, k: int, decimals: int = SCORE_DIGITS) -> DataFrame:
    best = _over_all(docs, asked, _best_kept(docs, asked, k, decimals))
    return top_n(best, ASKED, [F.desc("score"), F.asc("doc_id")], k, "rank")


def _vectors(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    docs = of_groups(docs, queries).select(*DOC, "embedding").filter("embedding IS NOT NULL")
    asked = queries.select(*ASKED, "embedding").filter("embedding IS NOT NULL").dropDuplicates(ASKED)
    return one_per_id(docs, DOC), materialize(asked)


def other_lengths(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Vectors that no query of their group can meet, because none has their length."""
    lengths = queries.filter("embedding IS NOT NULL").select("group_id", F.size("embedding").alias("_length")).distinct()
    here = docs.join(lengths.select("group_id").distinct(), "group_id", "left_semi")
    return here.withColumn("_length", F.size("embedding")).join(lengths, ["group_id", "_length"], "left_anti").drop("_length")


class _Kit(NamedTuple):
    """How a task scores documents: ``schema`` of its rows; ``columns`` of a query; ``arranged``, queries by
    group and length; ``meet`` adds a batch of documents to what is kept; ``result`` turns that into rows.

    The functions are defined within others, so that tasks need numpy and Arrow but not this package."""

    schema: str
    columns: list[str]
    arranged: Callable
    meet: Callable
    result: Callable


def _kinds(docs: DataFrame, queries: DataFrame) -> tuple[list, str]:
    """Arrow types of query_id, group_id, doc_id, and the begin of a schema of them."""
    fields = [queries.schema["query_id"], *(docs.schema[c] for c in DOC)]
    return [to_arrow_type(f.dataType) for f in fields], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)


def _matrices(decimals: int, step_cells: int):
    """The parts of a kit that all scoring shares."""

    def unit_rows(matrix):
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

    def arranged(rows):
        """Queries (id, group, vector, more ..) by group and length: ids, matrix, lists of the rest."""
        by_kind = {}
        for query, group, vector, *more in rows:
            by_kind.setdefault((group, len(vector)), []).append((query, vector, *more))
        out = {}
        for kind, own in by_kind.items():
            ids, vectors, *more = zip(*own)
            out[kind] = (list(ids), unit_rows(np.array(vectors, dtype=np.float64)), *more)
        return out

    def scored(queries, groups, ids, vectors):
        """(kind, scores, ids) of the documents of a batch that some queries can meet, in bounded pieces."""
        coded = groups.dictionary_encode()
        codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        names = {name: code for code, name in enumerate(coded.dictionary.to_pylist())}
        labels = ids.to_numpy(zero_copy_only=False)
        for kind, own in queries.items():
            group, length = kind
            if group not in names:
                continue
            rows = np.flatnonzero((codes == names[group]) & (lengths == length))
            step = max(1, step_cells // len(own[1]))
            for start in range(0, len(rows), step):
                some = rows[start:start + step]
                flat = vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
                units = unit_rows(flat.astype(np.float64).reshape(len(some), length))
                yield kind, np.round(own[1] @ units.T, decimals), labels[some]

    return arranged, scored


def _best_kept(docs: DataFrame, queries: DataFrame, k: int, decimals: int) -> _Kit:
    """Rows (query_id, group_id, doc_id, score): a task's best ``k`` per query."""
    types, kinds = _kinds(docs, queries)
    types = [*types, pa.float64()]
    arranged, scored = _matrices(decimals, SCORE_CELLS)

    def meet(queries, kept, groups, ids, vectors):
        for kind, scores, labels in scored(queries, groups, ids, vectors):
            found = np.broadcast_to(labels, scores.shape)
            if kind in kept:
                scores, found = np.hstack([kept[kind][0], scores]), np.hstack([kept[kind][1], found])
            order = np.lexsort((found, -scores), axis=1)[:, :k]
            kept[kind] = (np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1))

    def result(queries, kept):
        for kind, (scores, found) in kept.items():
            size = scores.shape[1]
            columns = [[q for q in queries[kind][0] for _ in range(size)], [kind[0]] * scores.size, found.ravel().tolist(), scores.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["query_id", "group_id", "doc_id", "score"])

    return _Kit(f"{kinds}, score double", ["query_id", "group_id", "embedding"], arranged, meet, result)


def _counted_before(docs: DataFrame, queries: DataFrame, decimals: int) -> _Kit:
    """Rows (query_id, group_id, doc_id, n): for each of a query's ``ids`` with ``scores``, how many documents
    of a task come before it."""
    types, kinds = _kinds(docs, queries)
    types = [*types, pa.int64()]
    arranged, scored = _matrices(decimals, SCORE_CELLS)

    def meet(queries, kept, groups, ids, vectors):
        for kind, scores, labels in scored(queries, groups, ids, vectors):
            counts = kept.setdefault(kind, [np.zeros(len(w), np.int64) for w in queries[kind][2]])
            for row, wanted, names, count in zip(scores, *queries[kind][2:], counts):
                ordered = np.sort(row)
                low, high = np.searchsorted(ordered, wanted), np.searchsorted(ordered, wanted, "right")
                count += len(row) - high
                for j in np.flatnonzero(high > low):
                    count[j] += int((labels[row == wanted[j]] < names[j]).sum())

    def result(queries, kept):
        for kind, counts in kept.items():
            ids, _, _, names = queries[kind]
            columns = [[q for q, c in zip(ids, counts) for _ in c], [kind[0]] * sum(map(len, counts)), [d for own in names for d in own], np.concatenate(counts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["query_id", "group_id", "doc_id", "n"])

    return _Kit(f"{kinds}, n long", ["query_id", "group_id", "embedding", "scores", "ids"], arranged, meet, result)


def _over_all(docs: DataFrame, queries: DataFrame, kit: _Kit) -> DataFrame:
    """Every document meets every query of its group; few queries are broadcast, many go to a grid."""
    few = is_small(queries.select("query_id", "group_id", "embedding"), max_rows=QUERY_BLOCK)
    return _broadcast_queries(docs, queries, kit) if few else _grid(docs, queries, kit)


def _broadcast_queries(docs: DataFrame, queries: DataFrame, kit: _Kit) -> DataFrame:
    """Within every task; ``queries`` were shown to be few."""
    _, columns, arranged, meet, result = kit
    shared = docs.sparkSession.sparkContext.broadcast(arranged(tuple(r[c] for c in columns) for r in queries.collect()))

    def over_task(batches):
        kept = {}
        for batch in batches:
            meet(shared.value, kept, batch.column("group_id"), batch.column("doc_id"), batch.column("embedding"))
        yield from result(shared.value, kept)

    return docs.mapInArrow(over_task, kit.schema)


def _grid(docs: DataFrame, queries: DataFrame, kit: _Kit) -> DataFrame:
    """Within every cell of (query block, document block), queries first in each.

    Blocks are dealt by hash, so a hot group has many cells; a cell holds one block of queries and
    reads its documents batch by batch."""
    schema, columns, arranged, meet, result = kit
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = -(-queries.count() // QUERY_BLOCK)
    more = columns[3:]

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def block(key, n):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def none_of(frame, column):
        return F.lit(None).cast(frame.schema[column].dataType).alias(column)

    asked = queries.select("group_id", block("query_id", blocks).alias("one"), every(parts).alias("two"), F.lit(0).alias("kind"),
                           "query_id", none_of(docs, "doc_id"), "embedding", *more)
    given = docs.select("group_id", every(blocks).alias("one"), block("doc_id", parts).alias("two"), F.lit(1).alias("kind"),
                        none_of(queries, "query_id"), "doc_id", "embedding", *(none_of(queries, c) for c in more))
    cells = asked.unionByName(given).repartition("one", "two").sortWithinPartitions("one", "two", "kind")

    def over_cells(batches):
        cell, rows, queries_here, kept = None, [], None, {}
        for batch in batches:
            ones, twos, kinds = (batch.column(c).to_numpy() for c in ("one", "two", "kind"))
            edges = np.flatnonzero((np.diff(ones) != 0) | (np.diff(twos) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *edges], [*edges, len(ones)]):
                part, here = batch.slice(start, end - start), (ones[start], twos[start])
                if here != cell:
                    yield from result(queries_here or {}, kept)
                    cell, rows, queries_here, kept = here, [], None, {}
                if kinds[start] == 0:
                    rows += zip(*(part.column(c).to_pylist() for c in columns))
                    continue
                if queries_here is None:
                    queries_here = arranged(rows)
                meet(queries_here, kept, part.column("group_id"), part.column("doc_id"), part.column("embedding"))
        yield from result(queries_here or {}, kept)

    return cells.mapInArrow(over_cells, schema)


def _pair_scores(pairs: DataFrame, decimals: int = SCORE_DIGITS) -> DataFrame:
    """(query_id, group_id, doc_id, score) of pairs (with ``embedding`` and ``_asked``) of equal length."""
    types, kinds = _kinds(pairs, pairs)
    types = [*types, pa.float64()]

    def unit(vector):
        norm = np.linalg.norm(vector)
        return vector / norm if norm > 0 else vector

    def score(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in HIT]
            both = zip(*(batch.column(c).to_pylist() for c in ("embedding", "_asked")))
            scores = [round(float(np.round(unit(np.array(a, float)) @ unit(np.array(b, float)), decimals)), decimals) for a, b in both]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, scores], types)], names=[*HIT, "score"])

    alike = pairs.filter(F.size("embedding") == F.size("_asked")).select(*HIT, "embedding", "_asked")
    return alike.mapInArrow(score, f"{kinds}, score double")


def _reciprocal(rank: Column) -> Column:
    return F.lit(1.0) / (F.lit(RRF_OFFSET) + rank)


def fuse(lists: list[DataFrame], k: int, decimals: int = FUSED_DIGITS) -> DataFrame:
    """Reciprocal rank fusion of ranked lists as they are; a document counts once per list, with its
    best rank. Ties go to the lower document id."""
    parts = [one.groupBy(*HIT).agg(_reciprocal(F.min("rank")).alias("part")) for one in lists]
    ranked = parts[0]
    for other in parts[1:]:
        ranked = ranked.unionByName(other)
    fused = ranked.groupBy(*HIT).agg(F.round(F.sum("part"), decimals).alias("score"))
    return top_n(fused, ASKED, [F.desc("score"), F.asc("doc_id")], k, "rank")


def ranks_of(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, group_id, doc_id, rank) of ``wanted`` documents in the list of all ``scores``, those that
    are in it: one more than the documents that come before. Scores are not sorted, but counted
    between the few wanted ones, map-side."""
    named = materialize(scores.join(wanted, HIT).select(*ASKED, F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("d")).alias("at")))
    places = materialize(named.groupBy(*ASKED).agg(F.sort_array(F.collect_list("at")).alias("places")))
    own = F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("d"))
    # how many of the wanted ones are not behind this document, by bisection
    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(24, -1, -1)]), lambda p: p <= F.size("places"))
    ahead = F.aggregate(steps, F.lit(0), lambda at, p: F.when((at + p <= F.size("places")) & (F.get("places", at + p - 1) <= own), at + p).otherwise(at))
    counts = scores.join(places, ASKED).groupBy(*ASKED, ahead.alias("ahead")).agg(F.count("*").alias("n"))
    each = places.select(*ASKED, F.posexplode("places").alias("place", "at"))
    before = each.join(counts.filter("ahead >= 0"), ASKED).filter("ahead <= place").groupBy(*ASKED, "at.d").agg(F.sum("n").alias("n"))
    found = each.select(*ASKED, F.col("at.d").alias("doc_id")).join(before.withColumnRenamed("d", "doc_id"), HIT, "left")
    return found.select(*HIT, (F.coalesce("n", F.lit(0)) + 1).alias("rank"))


def fuse_whole(docs: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int, decimals: int = FUSED_DIGITS) -> DataFrame:
    """Fusion of the whole lexical and the whole vector list of each query: (query_id, group_id, doc_id, score, rank).

    Only the heads of the lists are ranked. With 2 (RRF_OFFSET + k) places of each, a document in
    neither cannot reach the k-th best, for the first k of a list alone exceed it. Of the documents
    seen, a missing rank adds at most that of the next place; those whose bound reaches the k-th best
    sum of known parts are looked up in the whole other list, by counting what is before them."""
    depth = 2 * (RRF_OFFSET + k)
    own = lexical.index(docs, queries)
    words = own.scores().withColumn("score", F.round("score", SCORE_DIGITS))
    near, asked = _vectors(vectors, query_vectors)
    lists = {"a": materialize(lexical.ranked(own.candidates(depth), depth)), "b": materialize(_nearest(near, asked, depth))}
    seen = lists["a"].select(*HIT, F.col("rank").alias("a")).join(lists["b"].select(*HIT, F.col("rank").alias("b")), HIT, "full")
    for name, frame in lists.items():
        full = frame.filter(F.col("rank") == depth).select(*ASKED, F.lit(True).alias(f"more_{name}"))
        seen = seen.join(full, ASKED, "left")
    known = sum((F.coalesce(_reciprocal(F.col(c)), F.lit(0.0)) for c in "ab"), F.lit(0.0))
    unknown = [F.col(c).isNull() & F.coalesce(F.col(f"more_{c}"), F.lit(False)) for c in "ab"]
    bound = known + sum((F.when(u, _reciprocal(F.lit(depth + 1))).otherwise(0.0) for u in unknown), F.lit(0.0))
    seen = seen.select(*HIT, "a", "b", known.alias("known"), bound.alias("bound"), *(u.alias(f"open_{c}") for u, c in zip(unknown, "ab")))
    order = Window.partitionBy(*ASKED).orderBy(F.desc("known"))     # at most twice the depth
    least = F.max(F.when(F.col("place") == k, F.col("known"))).over(Window.partitionBy(*ASKED))
    seen = seen.withColumn("place", F.row_number().over(order)).withColumn("least", F.coalesce(least, F.lit(0.0)))
    seen = materialize(seen.filter(F.col("bound") >= F.col("least") - 10.0 ** -decimals))
    parts = [seen.select(*HIT, F.col(c).alias("rank")).filter("rank IS NOT NULL") for c in "ab"]
    open_a, open_b = (seen.filter(f"open_{c}").select(*HIT) for c in "ab")
    if open_a.limit(1).count():
        parts.append(ranks_of(words, open_a))
    if open_b.limit(1).count():
        parts.append(_vector_ranks(near, asked, open_b))
    ranked = parts[0]
    for other in parts[1:]:
        ranked = ranked.unionByName(other)
    fused = ranked.groupBy(*HIT).agg(F.round(F.sum(_reciprocal(F.col("rank"))), decimals).alias("score"))
    return top_n(fused, ASKED, [F.desc("score"), F.asc("doc_id")], k, "rank")


def _vector_ranks(docs: DataFrame, queries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, group_id, doc_id, rank) of ``wanted`` documents in the whole list of their query.

    The wanted documents are scored first; then every task counts, batch by batch, how many documents
    come before each."""
    asked = queries.join(wanted.select(*ASKED).distinct(), ASKED, "left_semi")
    near = docs.join(hint_if_small(wanted.select(*DOC).distinct()), DOC, "left_semi")
    pairs = near.join(wanted, DOC).join(asked.withColumnRenamed("embedding", "_asked"), ASKED)
    own = _pair_scores(pairs)
    places = own.groupBy(*ASKED).agg(F.sort_array(F.collect_list(F.struct("score", "doc_id"))).alias("w"))
    asked = materialize(asked.join(places, ASKED).select(*ASKED, "embedding", F.col("w.score").alias("scores"), F.col("w.doc_id").alias("ids")))
    counted = _over_all(docs, asked, _counted_before(docs, asked, SCORE_DIGITS))
    return counted.groupBy(*HIT).agg((F.sum("n") + 1).alias("rank"))


