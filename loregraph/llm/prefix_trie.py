"""Prefix trie of conversations with counts per node, by minimal perfect hash tables.

A node is a distinct sequence of first turns. Its digest is a pair of sums of turn hashes, each times
the power of an odd base for its place, so the digests of all prefixes are running sums: they are
taken range by range of the ordered turns, and a conversation that spans ranges, however long, is
put together from one sum per range. The steps:

1. turns in ranges of (conversation, turn), running sums within each range;
2. occurrences: a row per conversation and depth, with the digests of the prefix and of its parent;
3. distinct digests with their counts, reduced map-side: the nodes;
4. shards: whole subtrees of at most ``SHARD`` occurrences. A node above that is heavy, as all its
   ancestors are; a shard is what hangs below a heavy node (or the root) by one light child;
5. per shard a minimal perfect hash gives each digest a slot of flat arrays. The digest stored in a
   slot is compared with the one looked up, so a foreign digest is never taken for a node. Counts
   are scattered into the arrays and added up through the array of parents' slots, deepest first;
6. the heavy nodes are one more shard, whose leaves are the sums of the shards below. Were there
   more than ``TOP`` of them, they are summed by pointer doubling instead, in joins.

Digests have 128 bits; different prefixes are taken to differ in them.

Cases: a null role or text is empty; a row without conv_id belongs to no conversation and is left
out; turns of one conversation with the same number (null comes first) go by role, then by a hash
of the text, and repeated rows are turns each; an empty table has no node, not even a root; a
conversation without turns after rebuilding is a member of the root alone; of other columns none is
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import MIX, mix64
from loregraph.operators.scale import hint_if_small
from loregraph.session import materialize

SHARD = 1 << 14
TOP = 1 << 18
AT_ONCE = 1 << 16
CHUNK = 2048            # conversation ids that are joined before one task hashes a node's members
HEAD = 8                # most turns that a conversation takes from another
BASES = np.array([0x9E3779B97F4A7C15 * 4 + 3 & (1 << 64) - 1, 0xC2B2AE3D27D4EB4F * 8 + 5 & (1 << 64) - 1], np.uint64)
INVERSES = np.array([pow(int(b), -1, 1 << 64) for b in BASES], np.uint64)
TABLE = pa.schema([(c, pa.int64()) for c in (
    "k1", "k2", "p1", "p2", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "inside")])
ROW = ", ".join(f"{f.name} long" for f in TABLE)
NODE = [c for c in TABLE.names if c not in ("p1", "p2", "inside")]


def powers(base: np.uint64, exponents: np.ndarray) -> np.ndarray:
    """``base ** exponents`` modulo 2^64; for negative ones of the inverse."""
    out = np.ones(exponents.size, np.uint64)
    square, left = np.where(exponents < 0, INVERSES[BASES.tolist().index(int(base))], base), np.abs(exponents)
    while left.any():
        out = np.where(left & 1, out * square, out)
        square, left = square * square, left >> 1
    return out


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def sums_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [column(batch, c).astype(np.int64).view(np.uint64) for c in ("a", "b")]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``part, conv_id, place, a, b, sa, sb, bytes``: turns in ranges, with their place in their
    conversation and range, hashes, and the sums up to them within conversation and range."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(text, F.lit(1), role).alias("b"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "a", "b"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "a", "b", "bytes")
    schema = pa.schema([(c, pa.int64()) for c in ("part", "conv_id", "place", "a", "b", "sa", "sb", "bytes")])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, sums = None, 0, np.zeros(2, np.uint64)      # of the conversation the batch before ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = column(batch, "conv_id")
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            which = np.repeat(np.arange(starts.size), np.diff(np.append(starts, conv.size)))
            place = np.arange(conv.size) - starts[which] + 1
            goes_on = (which == 0) & (conv[0] == last if last is not None else False)
            place = place + seen * goes_on
            out = []
            for k, t in enumerate(sums_of(batch)):
                total = np.cumsum(t * powers(BASES[k], place))
                before = np.concatenate([[np.uint64(0)], total])[starts]
                out.append(total - before[which] + sums[k] * goes_on.astype(np.uint64))
            last, seen, sums = conv[-1], int(place[-1]), np.array([out[0][-1], out[1][-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("conv_id"), pa.array(place), batch.column("a"), batch.column("b"),
                 *(pa.array(o.view(np.int64)) for o in out), batch.column("bytes")], schema=schema)

    return dealt.mapInArrow(add_up, ", ".join(f"{c} long" for c in schema.names))


def range_offsets(turns: DataFrame) -> DataFrame:
    """``conv_id, part, turns_before, ba, bb``: of conversations that span ranges, what lies in the ranges before.
    At most two rows per range, so the driver holds them."""
    pieces = turns.groupBy("conv_id", "part").agg(F.max("place").alias("n"), F.max_by(F.struct("sa", "sb"), "place").alias("s"))
    spanning = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "s.sa", "s.sb"))).alias("pieces"))
    rows = []
    for r in spanning.filter(F.size("pieces") > 1).collect():
        before, sums = 0, [0, 0]
        for p in r.pieces:
            rows.append((r.conv_id, p.part, before, *(s - (1 << 64) if s >> 63 else s for s in sums)))
            sums = [(s + pow(int(base), before, 1 << 64) * x) % (1 << 64) for s, base, x in zip(sums, BASES, (p.sa, p.sb))]
            before += p.n
    return turns.sparkSession.createDataFrame(rows, "conv_id long, part long, turns_before long, ba long, bb long")


def head_rows(info: DataFrame) -> DataFrame:
    """Occurrences of the turns that conversations take from others, and a row of depth 0 for each."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, n, h, own, base in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n", "h", "own", "base"))):
                taken = (base or [])[:h]
                shift = len(taken) - h                       # of the own turns from the (h + 1)th on
                size = len(taken) + max(0, n - h)
                before, sums = [0, 0], [[0, 0]]
                for t in taken:
                    sums.append([(s + v * pow(int(b), t["place"], 1 << 64)) % (1 << 64) for s, v, b in zip(sums[-1], (t["a"], t["b"]), BASES)])
                for t in own[:h]:
                    before = [(s + v * pow(int(b), t["place"], 1 << 64)) % (1 << 64) for s, v, b in zip(before, (t["a"], t["b"]), BASES)]
                own_sums = [(s - x * pow(int(b), shift, 1 << 64)) % (1 << 64) for s, x, b in zip(sums[-1], before, BASES)]
                out.append((conv, 0, *own_sums, 0, 0, shift, size, 0))
                for d, t in enumerate(taken, 1):
                    out.append((conv, d, *sums[d], *sums[d - 1], t["bytes"], size, int(d == size)))
            flat = np.array([[x & (1 << 64) - 1 for x in r] for r in out], np.uint64).reshape(-1, 9).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, k]) for k in range(9)], names=["conv_id", "d", "k1", "k2", "p1", "p2", "bytes", "size", "ends"])

    return info.mapInArrow(unfold, "conv_id long, d long, k1 long, k2 long, p1 long, p2 long, bytes long, size long, ends long")


def tail_rows(turns: DataFrame) -> DataFrame:
    """Occurrences of a conversation's own turns behind the taken ones. Sums of the own turns from their
    first on become those of the rebuilt conversation by a factor and a summand."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, local, shift = (column(batch, c).astype(np.int64) for c in ("turns_before", "place", "shift"))
            d = before + local + shift
            keys, parents = [], []
            for k, t in enumerate(sums_of(batch)):
                s, b, c = (column(batch, n + "ab"[k]).astype(np.int64).view(np.uint64) for n in ("s", "b", "c"))
                own = b + powers(BASES[k], before) * s
                own = powers(BASES[k], shift) * own + c
                keys.append(own.view(np.int64))
                parents.append((own - t * powers(BASES[k], d)).view(np.int64))
            size = column(batch, "size")
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *map(pa.array, (d, *keys, *parents)), batch.column("bytes"), batch.column("size"), pa.array((d == size).astype(np.int64))],
                names=["conv_id", "d", "k1", "k2", "p1", "p2", "bytes", "size", "ends"])

    return turns.mapInArrow(unfold, "conv_id long, d long, k1 long, k2 long, p1 long, p2 long, bytes long, size long, ends long")


def occurrences(conversations: DataFrame, siblings: int = 5, heads: int = HEAD + 1) -> DataFrame:
    """``conv_id, d, k1, k2, p1, p2, bytes, size, ends`` per rebuilt conversation and depth from 0 on: digests of
    the prefix and of its parent, bytes of its last text, depth of the whole, and whether it ends here.

    Conversation c is rebuilt from the first crc32(c) % ``heads`` turns of conversation
    c - c % ``siblings`` and its own turns behind as many."""
    turns = materialize(ordered_turns(conversations))
    placed = turns.join(F.broadcast(range_offsets(turns)), ["conv_id", "part"], "left").fillna(0, ["turns_before", "ba", "bb"])
    place = F.col("turns_before") + F.col("place")
    first = F.when(place <= heads - 1, F.struct(place.alias("place"), "a", "b", "bytes"))
    own = materialize(placed.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(first)).alias("own")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    whose = own.withColumn("h", h).withColumn("b", F.col("conv_id") - F.col("conv_id") % siblings)
    base = own.filter(F.col("conv_id") % siblings == 0).select(F.col("conv_id").alias("b"), F.col("own").alias("base"))
    heads_of = materialize(head_rows(whose.join(base, "b", "left").select("conv_id", "n", "h", "own", "base")))
    # the row of depth 0 also carries the summands of the own turns, and their shift as its bytes
    facts = heads_of.filter("d = 0").select("conv_id", F.col("k1").alias("ca"), F.col("k2").alias("cb"), F.col("bytes").alias("shift"), "size")
    tails = tail_rows(placed.withColumn("h", h).filter(place > F.col("h")).drop("h", "part").join(facts, "conv_id"))
    zero, none = F.lit(0).cast("long"), F.col("d") == 0
    taken = heads_of.select("conv_id", "d", *(F.when(none, zero).otherwise(F.col(c)).alias(c) for c in ("k1", "k2")), "p1", "p2",
                            F.when(none, zero).otherwise(F.col("bytes")).alias("bytes"), "size",
                            F.when(none, (F.col("size") == 0).cast("long")).otherwise(F.col("ends")).alias("ends"))
    return taken.unionByName(tails)


class SlotTable:
    """Minimal perfect hash of distinct pairs of words: each level gives slots to the keys that are
    alone in their place, and passes the others on."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        self.levels: list[tuple[np.ndarray, int]] = []
        n, left, given = k1.size, np.arange(k1.size), 0
        self.slot = np.empty(n, np.int64)
        while left.size:
            at = self._place(k1[left], k2[left], len(self.levels), width := max(16, left.size * 3 // 2))
            alone = np.bincount(at, minlength=width) == 1
            ranks = np.where(alone, np.cumsum(alone) - 1 + given, -1)
            self.levels.append((ranks, width))
            self.slot[left] = ranks[at]
            left, given = left[ranks[at] < 0], given + int(alone.sum())
        self.k1, self.k2 = np.empty(n, np.int64), np.empty(n, np.int64)
        self.k1[self.slot], self.k2[self.slot] = k1, k2

    @staticmethod
    def _place(k1: np.ndarray, k2: np.ndarray, level: int, width: int) -> np.ndarray:
        salt = np.uint64(int(MIX) * (level + 1) % (1 << 64))
        mixed = mix64(mix64(k1.view(np.uint64) + salt) ^ k2.view(np.uint64))
        return (mixed % np.uint64(width)).astype(np.int64)

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 for one that isn't in the table."""
        out, left = np.full(k1.size, -1), np.arange(k1.size)
        for level, (ranks, width) in enumerate(self.levels):
            got = ranks[self._place(k1[left], k2[left], level, width)]
            out[left] = got
            left = left[got < 0]
        known = out >= 0
        known[known] = (self.k1[out[known]] == k1[known]) & (self.k2[out[known]] == k2[known])
        return np.where(known, out, -1)


def add_up_shard(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows of ``TABLE`` for the nodes of one or several shards. ``children, leaves, saved``: what hangs below
    a node outside of them."""
    table = SlotTable(rows["k1"], rows["k2"])
    flat = {}
    for name, values in rows.items():
        flat[name] = np.empty_like(values)
        flat[name][table.slot] = values
    parent = table.find(flat["p1"], flat["p2"])
    parent[flat["depth"] == 0] = -1                     # the root's own digest stands for its parent's
    inside = parent >= 0
    children = flat["children"] + np.bincount(parent[inside], minlength=parent.size)
    leaves = flat["leaves"] + (children == 0)
    saved = flat["saved"] + (flat["n_convs"] - 1) * flat["bytes"]
    order = np.argsort(-flat["depth"], kind="stable")
    order = order[inside[order]]
    for level in np.split(order, np.flatnonzero(np.diff(flat["depth"][order])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    above = pa.array(np.where(inside, flat["conv_id"][parent], 0), mask=~inside)
    return pa.RecordBatch.from_arrays(
        [*(pa.array(flat[c]) for c in ("k1", "k2", "p1", "p2", "depth", "conv_id")), above, pa.array(flat["n_convs"]),
         pa.array(children), pa.array(leaves), pa.array(saved), pa.array(inside.astype(np.int64))], schema=TABLE)


INPUT = ("shard", "k1", "k2", "p1", "p2", "depth", "conv_id", "n_convs", "bytes", "children", "leaves", "saved")


def add_up_shards(rows: DataFrame) -> DataFrame:
    """``rows`` (of ``INPUT``) are partitioned and sorted by shard; whole shards are taken together up to ``AT_ONCE``."""
    limit = AT_ONCE

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([column(batch, c) for c in INPUT]))
            size += batch.num_rows
            if size >= limit:
                block = np.concatenate(held, axis=1)
                ends = np.flatnonzero(block[0, 1:] != block[0, :-1]) + 1
                cut = int(ends[-1]) if ends.size else 0
                if cut:
                    yield add_up_shard(dict(zip(INPUT, block[:, :cut])))
                held, size = [block[:, cut:]], block.shape[1] - cut
        if size:
            yield add_up_shard(dict(zip(INPUT, np.concatenate(held, axis=1))))

    return rows.select(*(F.col(c).cast("long").alias(c) for c in INPUT)).mapInArrow(walk, ROW)


def double_up(rows: DataFrame) -> DataFrame:
    """The same sums for a forest of any size and depth, in joins: after k rounds a node has the sums of
    what is less than 2^k below it, and points to its ancestor 2^k above."""
    key, ancestor = ["k1", "k2"], ["q1", "q2"]
    real = F.col("depth") > 0
    own = rows.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("more"))
    now = rows.join(own, [*key, "depth"], "left").withColumn("n_children", F.col("children") + F.coalesce("more", F.lit(0)))
    now = now.withColumn("n_leaves", F.col("leaves") + (F.col("n_children") == 0).cast("long"))
    now = now.withColumn("saved_tokens", F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes"))
    keys = rows.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("pd"))
    now = now.join(keys, (now.p1 == keys.p1) & (now.p2 == keys.p2) & real, "left").drop(keys.p1).drop(keys.p2)
    now = now.withColumn("inside", F.col("pd").isNotNull().cast("long")).select(
        *[f.name for f in TABLE], *(F.when(F.col("pd").isNotNull(), F.col(p)).alias(q) for p, q in zip(("p1", "p2"), ancestor)))
    now = materialize(now)
    while now.filter("q1 IS NOT NULL").limit(1).count():
        below = now.filter("q1 IS NOT NULL").groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(
            F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        above = now.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("q1").alias("n1"), F.col("q2").alias("n2"))
        now = now.join(below, key, "left").join(above, ancestor, "left")
        now = materialize(now.select(
            *(c.name for c in TABLE if c.name not in ("n_leaves", "saved_tokens")),
            (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
            F.col("n1").alias("q1"), F.col("n2").alias("q2")))
    return now.select(*[f.name for f in TABLE])


def members_digest(ending: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of ``k1, k2, conv_id``: hash of the ids of each key, ascending, joined by commas.

    Ids are joined per key and range of ids first. What is left of a key passes through one task as
    a stream, which a single hash asks for, but holds nothing of it."""
    joined = ending.groupBy("k1", "k2", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    joined = joined.select("k1", "k2", "chunk", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    parts = int(ending.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = joined.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "chunk").drop("chunk")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if (k1, k2) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            yield rows_of(done)
        if key is not None:
            yield rows_of([(*key, state.hexdigest())])

    def rows_of(done: list[tuple]) -> pa.RecordBatch:
        k1, k2, sha = zip(*done) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sha, pa.string())], names=["k1", "k2", "ends_sha256"])

    return dealt.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def trie_nodes(found: DataFrame) -> DataFrame:
    """Columns ``NODE`` and ``ends_sha256`` of every node of ``found``, which has the columns of ``occurrences``."""
    found = materialize(found)
    below = F.col("size") - F.col("d") + 1
    nodes = found.groupBy("k1", "k2").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("d").alias("depth"), F.min("bytes").alias("bytes"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.sum(below).alias("weight"))
    nodes = materialize(nodes)
    top = nodes.filter((F.col("weight") > SHARD) | (F.col("depth") == 0))
    light = nodes.filter((F.col("weight") <= SHARD) & (F.col("depth") > 0))
    # a node's shard is the first light prefix of its smallest member
    heavy = hint_if_small(top.select("k1", "k2"))
    shards = found.join(heavy, ["k1", "k2"], "left_anti").groupBy("conv_id").agg(F.min_by("k1", "d").alias("shard"))
    none = [F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")]
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = light.join(shards, "conv_id").select("shard", "k1", "k2", "p1", "p2", "depth", "conv_id", "n_convs", "bytes", *none)
    below = materialize(add_up_shards(dealt.repartition(parts, "shard").sortWithinPartitions("shard")))
    hung = below.filter("inside = 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    above = top.join(hung, ["k1", "k2"], "left").fillna(0, ["children", "leaves", "saved"]).withColumn("shard", F.lit(0).cast("long"))
    if above.limit(TOP + 1).count() <= TOP:
        above = materialize(add_up_shards(above.coalesce(1)))
    else:
        above = materialize(double_up(materialize(above)))
    parents = above.filter("depth > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("_above"))
    first = above.filter("depth = 0").select("conv_id").first()
    root = F.lit(first.conv_id if first else None).cast("long")
    below = below.join(hint_if_small(parents), ["p1", "p2"], "left")
    named = F.coalesce("parent_conv_id", "_above", F.when(F.col("depth") == 1, root)).alias("parent_conv_id")
    below = below.select(*(named if c == "parent_conv_id" else c for c in NODE))
    digests = members_digest(found.filter("ends = 1").select("k1", "k2", "conv_id"))
    rows = below.unionByName(above.select(*NODE)).join(digests, ["k1", "k2"], "left")
    return rows.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``."""
    return trie_nodes(occurrences(conversations)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
