"""Jaccard self-join on word n-grams with Bayesian pruning of candidates.

1. Every text becomes the set of its 5-word shingles (64-bit hashes), a 128-bit key of that set
   and 32 band keys of 5 minimum hashes each. Texts with one key are a class; a copied text goes
   on as one representative (its row with the smallest doc_id) with its number of members.
2. Classes that share a band key are candidates of each other: a bucket. A pair belongs to the first
   band it shares, so a bucket whose classes all share an earlier band has no pair of its own and
   is dropped, which most buckets of near copies are.
3. A bucket is cut into blocks by hash; a cell is a pair of blocks. Within a cell the pairs that
   belong to it compare their minimum hashes 32 at a time and are dropped once the posterior
   probability that their similarity reaches the threshold, given the matches so far and a uniform
   prior, is below ``TOLERANCE``. What is left is verified exactly on the sets. Cells give a row per
   member: its number of links and the smallest class it is connected to there; pairs are never
   written, and pairs that share no band are never compared.
4. Groups are the components of those rows, named by their smallest representative.

A pair at similarity 0.8 shares no band with probability 3e-6, and more similar ones less.

Cases: words are runs without ASCII white space, compared as they are; a text of fewer than five
words is one shingle of all of them; a text without words (or null) links to nothing and is a
class of its own; repeated rows are members of one class and link to each other; a null doc_id
takes part, and is only a class id if there is no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import MIX, mix64, small_batches, text_groups, texts_of
from loregraph.llm.components import components
from loregraph.operators.scale import hint_if_small
from loregraph.session import materialize

WORDS = 5
NUMERATOR, DENOMINATOR = 4, 5        # similarity of 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEP = 32
TOLERANCE = 1e-6
BLOCK = 256
_factors = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * MIX).astype(np.uint32)
FACTORS, SHIFTS = _factors[:HASHES] | np.uint32(1), _factors[HASHES:]
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * MIX)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SIGNATURES = "doc_id long, h long, k1 long, k2 long, bands array<long>"


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    codes = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    space = SPACE[codes]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not begin.size:
        return [np.empty(0, np.uint64)] * len(texts)
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    lengths = end - begin
    index = np.flatnonzero(~space)
    place = np.arange(index.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    weights = mix64(np.arange(1, int(lengths.max()) + 1, dtype=np.uint64) * MIX) | np.uint64(1)
    words = mix64(np.add.reduceat(BYTE_VALUES[codes[index]] * weights[place], np.cumsum(lengths) - lengths))
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    edges = np.searchsorted(begin, np.append(starts, codes.size)).tolist()
    out = []
    for a, b in zip(edges, edges[1:]):
        own = words[a:b]
        n = min(WORDS, b - a)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        sums = np.full(b - a - n + 1, n, np.uint64)
        for k in range(n):
            sums = mix64(sums * MIX + own[k:b - a - n + 1 + k])
        out.append(np.unique(sums))
    return out


def minimum_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """``HASHES`` minimum hashes of each set, none of which is empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    words = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(words * FACTORS[k] + SHIFTS[k], first)
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit key of each set: two sums over differently mixed hashes."""
    keys = np.empty((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        keys[i] = mix64(s ^ MIX).sum(), mix64(s * MIX + np.uint64(1)).sum() + np.uint64(len(s))
    return mix64(keys).view(np.int64)


def least_matches() -> list[int]:
    """Per step, the fewest matching hashes at which a pair is kept.

    After m hashes with s matches the similarity has the posterior Beta(s + 1, m - s + 1), whose
    chance of at least t is that of at most s successes in m + 1 trials of chance t."""
    t, out = NUMERATOR / DENOMINATOR, []
    for m in range(STEP, HASHES + 1, STEP):
        chance, s = 0.0, -1
        while chance < TOLERANCE:
            s += 1
            chance += math.comb(m + 1, s) * t ** s * (1 - t) ** (m + 1 - s)
        out.append(s)
    return out


LEAST = least_matches()


def own_pairs(hashes: np.ndarray, blocks: np.ndarray, one: int, two: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell whose first shared band is ``band``; all its members share that."""
    if one == two:
        left, right = np.triu_indices(len(hashes), 1)
    else:
        left, right = (x.ravel() for x in np.meshgrid(np.flatnonzero(blocks == one), np.flatnonzero(blocks == two)))
    for k in range(band):
        values, key = np.unique(hashes[:, k * ROWS:(k + 1) * ROWS], axis=0, return_inverse=True)
        if len(values) < len(hashes):
            apart = key[left] != key[right]
            left, right = left[apart], right[apart]
    return left, right


def linked_pairs(sets: list[np.ndarray], hashes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (left[i], right[i]) of non-empty sets, those with Jaccard 0.8 or more."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    small, large = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    fits = small * DENOMINATOR >= large * NUMERATOR
    left, right = left[fits], right[fits]
    if not left.size:
        return left, right
    matches = np.zeros(left.size, np.int64)
    for step, least in enumerate(LEAST):
        part = hashes[:, step * STEP:(step + 1) * STEP]
        matches += (part[left] == part[right]).sum(1)
        kept = matches >= least
        left, right, matches = left[kept], right[kept], matches[kept]
    if not left.size:
        return left, right
    used = np.unique(np.concatenate([left, right]))
    row = np.full(len(sets), -1)
    row[used] = np.arange(used.size)
    values, place, seen = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    shared = seen > 1                       # hashes of one set alone are in no intersection
    column = np.cumsum(shared) - 1
    rows = np.repeat(np.arange(used.size), sizes[used])
    inside = shared[place]
    width = -(-max(1, int(shared.sum())) // 64) * 8
    bits = np.zeros((used.size, width), np.uint8)
    at = column[place[inside]]
    np.bitwise_or.at(bits, (rows[inside], at >> 3), (1 << (at & 7)).astype(np.uint8))
    bits = bits.view(np.uint64)
    common = np.empty(left.size, np.int64)
    step = max(1, (1 << 22) // bits.shape[1])
    for a in range(0, left.size, step):
        both = bits[row[left[a:a + step]]] & bits[row[right[a:a + step]]]
        common[a:a + step] = np.bitwise_count(both).sum(1)
    # common / union >= 4 / 5
    good = common * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (sizes[left] + sizes[right])
    return left[good], right[good]


def signatures(docs: DataFrame) -> DataFrame:
    """Hash, set key and band keys of every whole text; null keys for a text without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_groups(batches):
            sets = shingle_sets(texts)
            full = np.array([len(s) > 0 for s in sets])
            some = [s for s in sets if len(s)]
            keys, bands = np.zeros((len(texts), 2), np.int64), [None] * len(texts)
            if some:
                keys[full] = set_keys(some)
                wide = minimum_hashes(some).astype(np.uint64).reshape(len(some), BANDS, ROWS)
                band = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(some), 1))
                for k in range(ROWS):
                    band = mix64(band * MIX + wide[:, :, k])
                for i, row in zip(np.flatnonzero(full), band.view(np.int64)):
                    bands[i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("h"), pa.array(keys[:, 0], pa.int64(), mask=~full),
                 pa.array(keys[:, 1], pa.int64(), mask=~full), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "h", "k1", "k2", "bands"])

    return small_batches(texts_of(docs)).withColumn("h", F.xxhash64("text")).mapInArrow(sign, SIGNATURES)


CELL = ["band", "one", "two"]
REP = ["none", "id", "h"]             # of a class: its row with the smallest doc_id, none if that is null


def _cells(rows: DataFrame) -> DataFrame:
    """Links of the members of each cell: ``k1, k2, n_links, none, id, h`` per member of a link, the last
    three being the smallest representative it is connected to in the cell."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_links", pa.int64()), ("none", pa.bool_()), ("id", pa.int64()), ("h", pa.int64())])

    def compare(cell: tuple, members: list[tuple]) -> Iterator[pa.RecordBatch]:
        (_, one, two), band = cell, members[0][-2]
        # by representative, so that the smallest index is the smallest of them
        members = sorted(members, key=lambda m: m[4:7])
        sets = shingle_sets([m[-1] for m in members])
        hashes = minimum_hashes(sets)
        left, right = own_pairs(hashes, np.array([m[2] for m in members]), one, two, band)
        left, right = linked_pairs(sets, hashes, left, right)
        if not left.size:
            return
        weight = np.array([m[3] for m in members])
        links = np.bincount(left, weight[right], len(members)) + np.bincount(right, weight[left], len(members))
        root, before = np.arange(len(members)), None
        while before is None or (before != root).any():
            before = root.copy()
            low = np.minimum(root[left], root[right])
            np.minimum.at(root, left, low)
            np.minimum.at(root, right, low)
        at = np.flatnonzero(links)
        tops = [members[i] for i in root[at]]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([members[i][k] for i in at], pa.int64()) for k in (0, 1)), pa.array(links[at].astype(np.int64)),
             pa.array([t[4] for t in tops]), *(pa.array([t[k] for t in tops], pa.int64()) for k in (5, 6))], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, members = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (*CELL, "k1", "k2", "block", "members", *REP, "pos", "text"))
            for band, one, two, *member in zip(*columns):
                if (band, one, two) != cell:
                    if len(members) > 1:
                        yield from compare(cell, members)
                    cell, members = (band, one, two), []
                members.append(tuple(member))
        if len(members) > 1:
            yield from compare(cell, members)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *CELL).sortWithinPartitions(*CELL)
    return dealt.mapInArrow(walk, "k1 long, k2 long, n_links long, none boolean, id long, h long")


def own_buckets(classes: DataFrame) -> DataFrame:
    """``k1, k2, buckets`` of classes that share a band: an array of (band key, its place, classes in it) for
    the buckets that may have pairs of their own."""
    banded = classes.select("k1", "k2", F.posexplode("bands").alias("pos", "band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    live = banded.join(shared, "band").groupBy("k1", "k2").agg(F.collect_list(F.struct("band", "pos", "n")).alias("buckets"))
    live = materialize(live.join(classes.select("k1", "k2", "bands"), ["k1", "k2"]))
    each = live.select("k1", "bands", F.explode("buckets").alias("b")).select("k1", "bands", "b.band", "b.pos")
    lead = each.groupBy("band").agg(F.min_by("bands", "k1").alias("lead"))
    # bands ahead of this one in which a class agrees with its bucket's lead
    agrees = F.expr("if(pos = 0, 0L, aggregate(sequence(0, pos - 1), 0L, (bits, j) -> bits | if(bands[j] = lead[j], shiftleft(1L, j), 0L)))")
    ahead = each.join(lead, "band").groupBy("band").agg(F.bit_and(agrees).alias("ahead"))
    kept = ahead.filter("ahead = 0").select("band")
    each = live.select("k1", "k2", F.explode("buckets").alias("b")).select("k1", "k2", F.col("b.band").alias("band"), "b.pos", "b.n")
    return each.join(kept, "band").groupBy("k1", "k2").agg(F.collect_list(F.struct("band", "pos", "n")).alias("buckets"))


def row_key() -> list[Column]:
    """``REP`` of a row of ``doc_id, h``, without a null."""
    return [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("h")]


def _id_of(rep: str) -> Column:
    return F.when(F.col(rep).isNull(), F.col("doc_id")).when(~F.col(f"{rep}.none"), F.col(f"{rep}.id"))


def joined_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, h, class_id, n_links, group_id, keeper`` of every document; ``h`` is the hash of its text,
    ``keeper`` the smallest row (none, id, h) of its group, null where nothing is linked to it."""
    signed = materialize(signatures(docs))
    keyed = signed.filter(F.col("k1").isNotNull())
    rep = F.min(F.struct(*row_key())).alias("rep")
    classes = materialize(keyed.groupBy("k1", "k2").agg(rep, F.count("*").alias("members"), F.first("bands").alias("bands")))
    # cells: pairs of blocks of a bucket. A representative's text is fetched once, by its row, and goes to its cells
    wanted = own_buckets(classes).join(classes.drop("bands"), ["k1", "k2"])
    wanted = materialize(wanted.select("k1", "k2", "members", "rep.*", "buckets"))
    texts = texts_of(docs).withColumn("h", F.xxhash64("text")).select(*row_key(), "text")
    texts = texts.join(hint_if_small(wanted.select(*REP)), REP, "left_semi").groupBy(*REP).agg(F.first("text").alias("text"))
    found = texts.join(wanted, REP)
    each = found.select("k1", "k2", "members", *REP, "text", F.explode("buckets").alias("b"))
    blocks = F.ceil(F.col("b.n") / F.lit(BLOCK)).cast("int")
    each = each.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("k1", "k2"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = each.select(F.col("b.band").alias("band"), F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
                        "k1", "k2", "block", "members", *REP, F.col("b.pos").alias("pos"), "text")
    links = materialize(_cells(cells).join(classes.select("k1", "k2", "rep"), ["k1", "k2"]))
    groups = components(links.select(F.col("rep").alias("u"), F.struct(*REP).alias("v")))
    counted = links.groupBy("k1", "k2").agg(F.sum("n_links").alias("links"), F.first("rep").alias("u")).join(groups, "u", "left")
    linked = classes.drop("bands").join(counted.select("k1", "k2", "links", "component"), ["k1", "k2"], "left")
    linked = materialize(linked.select("k1", "k2", "members", "links", "rep", F.coalesce("component", "rep").alias("keeper")))
    rows = signed.select("doc_id", "h", "k1", "k2").join(linked, ["k1", "k2"], "left")
    n_links = F.coalesce("members", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))
    return rows.select(
        "doc_id", "h", _id_of("rep").alias("class_id"), n_links.alias("n_links"), _id_of("keeper").alias("group_id"),
        F.when(n_links > 0, F.col("keeper")).alias("keeper"))


def ngram_join(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links, group_id`` of every document.

    ``class_id``: smallest doc_id with the same shingle set; ``n_links``: other documents of
    similarity 0.8 or more; ``group_id``: smallest doc_id it is connected to by links."""
    return joined_rows(docs).drop("h", "keeper")


def without_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked documents: the one with the smallest doc_id, of
    several with the smallest hash of their text, of repeated rows any one."""
    rows = joined_rows(docs).filter("keeper IS NOT NULL")
    stays = F.struct(*row_key()) == F.col("keeper")
    each = rows.groupBy("doc_id", "h").agg(F.max(stays).alias("stays"), F.count("*").alias("n"))
    each = materialize(each.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "stays", "n"))
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_h"))
    left = keyed.join(hint_if_small(each.filter("NOT stays OR n > 1").select("_id", "_h")), same, "left_anti")
    repeated = keyed.join(hint_if_small(each.filter("stays AND n > 1").select("_id", "_h")), same, "left_semi").dropDuplicates(["doc_id", "_key"])
    return left.unionByName(repeated).drop("_key")
