import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loregraph.llm import prefix_trie as trie


def plain_trie(rows, text_hash):
    """Prefixes as tuples, in dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in own.items():
        own[c] = [t[2:] for t in sorted(turns, key=lambda t: (*t[:3], text_hash[t[2:]]))]
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built = own.get(base, [])[:h] + turns[h:]
        for d in range(len(built) + 1):
            nodes.setdefault(tuple(built[:d]), []).append((c, d == len(built)))
    children, leaves, saved = ({p: 0 for p in nodes} for _ in range(3))
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda m: hashlib.sha256(",".join(str(c) for c, end in sorted(m) if end).encode()).hexdigest()
    return sorted((min(m)[0], len(p), min(nodes[p[:-1]])[0] if p else None, len(m), children[p], leaves[p], saved[p], sha(m)) for p, m in nodes.items())


def check(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, k1 long, depth long").repartition(parts)
    hashes = docs.select(F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t")).distinct()
    text_hash = {(h.r, h.t): (h.a, h.b) for h in hashes.select("r", "t", F.xxhash64("r", "t").alias("a"), F.xxhash64("t", F.lit(1), "r").alias("b")).collect()}
    got = [tuple(r) for r in trie.conversation_trie(docs).collect()]
    assert sorted(got, key=str) == sorted(plain_trie(rows, text_hash), key=str)
    return got


def conversations(rng, n, longest, words):
    rows = []
    for c in rng.sample(range(3 * n), n):
        size = rng.randint(1, longest)
        rows += [(c, t, "user" if t % 2 else "assistant", rng.choice(words)) for t in range(size)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard,top", [(1 << 14, 1 << 18), (6, 1 << 18), (6, 4)])
def test_against_dictionaries(spark, monkeypatch, shard, top):
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "TOP", top)
    monkeypatch.setattr(trie, "AT_ONCE", 50)
    monkeypatch.setattr(trie, "CHUNK", 16)
    check(spark, conversations(random.Random(6), 60, 12, ["a", "b", "é 漢"]))


def test_one_conversation_over_all_ranges(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD", 40)
    rng = random.Random(7)
    rows = [(c, t, "user", rng.choice("xyz")) for c, n in ((10, 400), (12, 390), (3, 4), (11, 6), (13, 1)) for t in range(n)]
    got = check(spark, rows, 5)
    assert max(r[1] for r in got) >= 388


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (5, None, None, None), (5, None, None, None), (5, 2, "", ""), (5, 2, "a", "z"), (5, 2, "a", "y"), (6, 1, "a", "z"),
            (-7, 1, "user", "x" * 100_000), (-5, 1, "user", "q"), (-5, 3, "user", "q"), (10**12, 0, "user", None), (10**12 + 1, 0, "user", "")]
    check(spark, rows)
    assert trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")).collect() == []


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    k1, k2 = rng.integers(-2**62, 2**62, (2, 5000))
    k1[:2500] = k1[0]                                  # half of the keys differ in one word alone
    table = trie.SlotTable(k1, k2)
    assert sorted(table.slot) == list(range(5000)) and (table.find(k1, k2) == table.slot).all()
    assert (table.find(k1, k2 + 1) == -1).all() and trie.SlotTable(k1[:0], k2[:0]).find(k1[:3], k2[:3]).tolist() == [-1] * 3
