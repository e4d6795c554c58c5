import random
from itertools import combinations

from loregraph.llm import spaced_seeds as seeds

rng = random.Random(6)


def word():
    return "".join(rng.choice("abcdefghij") for _ in range(6))


def found(spark, docs, items):
    frame = spark.createDataFrame(docs, "doc_id long, text string, h string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    return {(r.doc_id, r.item_id): r for r in seeds.contaminated(frame, bench).collect()}


def test_copies_substitutions_and_parts(spark):
    item = [word() for _ in range(40)]
    short, tiny = [word() for _ in range(7)], [word() for _ in range(3)]
    around = lambda words: " ".join([word() for _ in range(30)] + words + [word() for _ in range(30)])
    changed = [word() if i % 9 == 4 else w for i, w in enumerate(item)]
    docs = [(0, around(item)), (1, around([w.upper() + "," for w in item])), (2, around(changed)), (3, around(item[10:24])), (4, around(item[10:19])),
            (5, around([])), (6, around(short)), (7, around(short[:3] + [word()] + short[4:])), (8, around(short[:4])), (9, around(tiny)),
            (10, " ".join(tiny)), (11, around(rng.sample(item, 40))), (12, around(item + item))]
    got = found(spark, [(*d, "x", "y") for d in docs], [(1, " ".join(item), "z"), (2, " ".join(short), "z"), (3, " ".join(tiny), None), (4, None, None), (5, "!!", None)])
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 1), (6, 2), (7, 2), (9, 3), (10, 3), (12, 1)}
    one = got[0, 1]
    assert (one.first_word, one.end_word, one.n_equal, one.coverage) == (30, 70, 40, 1.0)
    assert got[2, 1].n_equal == sum(a == b for a, b in zip(item, changed))
    assert (got[3, 1].first_word, got[3, 1].end_word, got[3, 1].n_equal) == (30, 44, 14)


def test_odd_rows(spark, odd_docs, no_docs):
    first = odd_docs.filter("doc_id = 1").first().text
    bench = spark.createDataFrame([(None, first[50:300]), (2, first), (2, first), (3, ""), (4, "one two")], "item_id long, text string")
    got = seeds.contaminated(odd_docs, bench)
    pairs = sorted(map(str, ((r.doc_id, r.item_id) for r in got.collect())))
    assert pairs == sorted(map(str, [(i, j) for i in (1, 2, 3, 12) for j in (None, 2)] + [(8, 4), (9, 4)]))
    left = seeds.without_leaks(odd_docs, bench)
    assert left.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [4, 5, None, None, 6, 7, 10, 11, 12]))
    assert seeds.contaminated(no_docs, bench).collect() == [] and seeds.contaminated(odd_docs, bench.limit(0)).collect() == []
    assert seeds.without_leaks(odd_docs, bench.limit(0)).count() == odd_docs.count()


def test_without_a_broadcast(spark, odd_docs, monkeypatch):
    first = odd_docs.filter("doc_id = 1").first().text
    bench = spark.createDataFrame([(1, first)], "item_id long, text string")
    want = sorted(map(str, seeds.contaminated(odd_docs, bench).collect()))
    monkeypatch.setattr(seeds, "hint_if_small", lambda df: df)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, seeds.contaminated(odd_docs, bench).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def best_by_force(item, words):
    """Most equal words of any window of the stated size and density, over all diagonals; 0 if there is none."""
    least, best = min(len(item), seeds.RUN), 0
    for d in range(1 - len(item), len(words)):
        low, high = max(0, d), min(len(words), d + len(item))
        upto = [0]
        for i in range(low, high):
            upto.append(upto[-1] + (words[i] == item[i - d]))
        for a in range(high - low):
            for b in range(a + least, high - low + 1):
                n = upto[b] - upto[a]
                ends = (a == 0 or upto[a + 1] > upto[a]) and (b == high - low or upto[b] > upto[b - 1])
                if ends and 4 * n >= 3 * (b - a) and (len(item) >= seeds.SHORT or n == b - a):
                    best = max(best, n)
    return best


def compared(spark, item_of, changes):
    """Each item in a document of its own with the words at some places replaced; against brute force."""
    docs, items, want = [], [], {}
    for k, (size, places) in enumerate(zip(item_of, changes)):
        item = [word() for _ in range(size)]
        text = [word() for _ in range(4)] + [word() if i in places else w for i, w in enumerate(item)] + [word() for _ in range(4)]
        docs.append((k, " ".join(text), "x", "y"))
        items.append((k, " ".join(item), "z"))
        n = best_by_force(item, text)
        want |= {(k, k): n} if n else {}
    got = found(spark, docs, items)
    assert {k: r.n_equal for k, r in got.items()} == want
    for (k, _), r in got.items():
        own, text = items[k][1].split(), docs[k][1].split()
        assert r.end_word - r.first_word >= min(len(own), seeds.RUN) and 4 * r.n_equal >= 3 * (r.end_word - r.first_word)
        assert sum(text[i] == own[i - 4] for i in range(r.first_word, r.end_word)) == r.n_equal
    return got


def test_differing_words_at_any_place_of_the_stretch(spark):
    sizes, changes = [], []
    for size, places in [(12, [{i} for i in range(1, 11)]), (15, [{2, 14}, {0, 14}, {0, 1}, {13, 14}]), (11, [{0}, {10}]), (6, [{0}, {5}]), (40, [{0, 2, 20, 21, 39}])]:
        sizes += [size] * len(places)
        changes += places
    assert len(compared(spark, sizes, changes)) == len(sizes)


def test_masks_lose_nothing():
    def hit(n, places, masks):
        return any(all(a + i not in places for i, c in enumerate(m) if c == "1") for m in masks for a in range(n - len(m) + 1))

    for n in range(seeds.SHORT, 2 * seeds.RUN):
        assert all("0" in m for m in seeds._item_masks(n))
        assert all(hit(n, places, seeds._item_masks(n)) for places in combinations(range(n), n // seeds.SPAN))


def test_recall_against_brute_force(spark):
    sizes, changes = [], []
    for size in (4, 5, 7, 8, 11, 12, 15, 20, 30, 58):
        for period in (4, 5, 6, 7):
            sizes += [size] * period
            changes += [set(range(i, size, period)) for i in range(period)]
        for rate in (0.1, 0.2, 0.25, 0.3):
            sizes += [size] * 6
            changes += [set(rng.sample(range(size), int(size * rate))) for _ in range(6)]
    sizes += [12, 12, 90]
    changes += [{0}, {11}, {i for i in range(90) if not 60 <= i < 75} | {63, 70}]
    got = compared(spark, sizes, changes)
    assert len(sizes) > len(got) > 200 and (len(sizes) - 1, len(sizes) - 1) in got
