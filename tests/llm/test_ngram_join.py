import itertools
import random

import numpy as np

from loregraph.llm import ngram_join as join
from loregraph.llm.components import components


def plain_shingles(text):
    words = (text or "").split()
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(" ".join(words[i:i + n]) for i in range(len(words) - n + 1))


def plain_rows(rows):
    """Every pair of rows compared."""
    sets = [plain_shingles(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    out = []
    for i, (d, _) in enumerate(rows):
        klass = least([e for (e, _), s in zip(rows, sets) if s == sets[i]]) if sets[i] else d
        out.append((d, klass, links[i], least([e for (e, _), r in zip(rows, root) if r == root[i]])))
    return out


def plain_join(rows):
    return sorted(map(str, plain_rows(rows)))


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_against_all_pairs(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(n)] for n in (60, 90, 200, 30)]
    rows = []
    for k, words in enumerate(base):
        for _ in range(25):
            changed = list(words)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = word()
            rows.append((len(rows), " ".join(changed) + ("\n" if k % 2 else "")))
    rows += [(len(rows) + i, " ".join(word() for _ in range(40))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(join.ngram_join(docs)) == plain_join(rows)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(join, "BLOCK", 8)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        changed = list(words)
        changed[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(changed)))
    assert got(join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_join(rows)


def test_pairs_of_a_chain_meet_once(spark):
    """Neighbours share bands, the whole chain doesn't: what is compared are the pairs that share one."""
    rng = random.Random(13)
    words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    texts = [" ".join(words[5 * i:5 * i + 100]) for i in range(300)]
    sets = join.shingle_sets(texts)
    hashes = join.minimum_hashes(sets)
    keys = [{hashes[i, k * join.ROWS:(k + 1) * join.ROWS].tobytes() for k in [k]}.pop() for i in range(300) for k in range(join.BANDS)]
    keys = [keys[i * join.BANDS:(i + 1) * join.BANDS] for i in range(300)]
    sharing = {(i, j) for i, j in itertools.combinations(range(300), 2) if any(a == b for a, b in zip(keys[i], keys[j]))}
    seen = []
    for band in range(join.BANDS):
        for key in {k[band] for k in keys}:
            inside = np.array([i for i in range(300) if keys[i][band] == key])
            left, right = join.own_pairs(hashes[inside], np.zeros(inside.size), 0, 0, band)
            seen += list(zip(inside[left].tolist(), inside[right].tolist()))
    assert len(seen) == len(set(seen)) == len(sharing) < 300 * 299 / 2 / 10 and set(seen) == sharing
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert got(join.ngram_join(docs)) == plain_join(list(enumerate(texts)))


def test_buckets_without_pairs_of_their_own_are_dropped(spark):
    bands = [(1, [1, 10, 20]), (2, [1, 10, 21]), (3, [1, 11, 20]), (4, [2, 11, 22])]
    rows = spark.createDataFrame([(k, k, b) for k, b in bands], "k1 long, k2 long, bands array<long>")
    got = {r.k1: sorted(tuple(b) for b in r.buckets) for r in join.own_buckets(rows).collect()}
    assert got == {1: [(1, 0, 3)], 2: [(1, 0, 3)], 3: [(1, 0, 3), (11, 1, 2)], 4: [(11, 1, 2)]}


def test_many_texts_under_one_id(spark):
    rng = random.Random(14)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for d in (7, None):
        for i in range(25):
            changed = list(base)
            changed[rng.randrange(120)] = f"x{i}"
            rows.append((d, " ".join(changed)))
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(join.ngram_join(docs)) == plain_join(rows)
    assert len(join.without_near_duplicates(docs).collect()) == 1


def test_odd_rows(odd_docs, no_docs):
    rows = [(d.doc_id, d.text) for d in odd_docs.collect()]
    assert got(join.ngram_join(odd_docs)) == plain_join(rows)
    assert join.ngram_join(no_docs).collect() == []
    left = join.without_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    # 2, both 3s, 9 and the near one of 12 go
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 4, 5, None, None, 6, 7, 8, 10, 11, 12]))
    assert join.without_near_duplicates(no_docs).collect() == []


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")] * 3 + [(2, "")] * 2, "doc_id long, text string")
    assert sorted(r.doc_id for r in join.without_near_duplicates(docs).collect()) == [1, 2, 2]


def test_pruning_is_safe_and_useful():
    """Pairs at the threshold survive every step but for the stated chance; unlike pairs don't."""
    rng = np.random.default_rng(4)
    at, unlike = (rng.random((20_000, join.HASHES)) < p for p in (0.8, 0.4))
    for step, least in enumerate(join.LEAST):
        upto = (step + 1) * join.STEP
        assert (at[:, :upto].sum(1) < least).sum() <= 1
    assert (unlike[:, :64].sum(1) < join.LEAST[1]).mean() > 0.9


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7), (200, 201)]
    rows = components(spark.createDataFrame(chain, "u long, v long")).collect()
    assert {r.u: r.component for r in rows} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
