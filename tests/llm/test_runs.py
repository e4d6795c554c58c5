import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from loregraph.llm import periodic_runs as runs


def plain_runs(words, least=12):
    """Every period, every stretch of places that agree with the one a period later."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    dropped = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


def plain_words(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0D]+", text or "") if w]
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def plain_digests(doc_id, text):
    words = plain_words(doc_id, text)
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(plain_collapsed(words, found)))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def samples():
    rng = random.Random(2)
    out = ["", "a", "aa", "a" * 11, "a" * 12, "a" * 500, "ab" * 200, "abc" * 4, fibonacci(700), ("ab" * 9 + "c") * 12, "a" * 40 + "b" + "a" * 40]
    out += ["".join(rng.choice("abcd"[:k]) for _ in range(rng.randint(1, 300))) for k in (1, 2, 2, 2, 3, 4) for _ in range(6)]
    for _ in range(20):
        piece = "".join(rng.choice("abc") for _ in range(rng.randint(1, 25)))
        out.append(piece * rng.randint(1, 9) + piece[:rng.randint(0, len(piece))] + "".join(rng.choice("abc") for _ in range(30)) + piece * 2)
    return out


def test_agreement():
    rng = np.random.default_rng(1)
    for text in samples()[5:]:
        symbols = np.array([1000, *map(ord, text), 1001])
        levels = runs.grammar(symbols)
        i, j = rng.integers(1, len(text) + 1, (2, 200))
        i, j = i[i != j], j[i != j]
        if not i.size:
            continue
        for forward in (True, False):
            got = runs.agreement(levels, i, j, forward)
            for x, y, k in zip(i.tolist(), j.tolist(), got.tolist()):
                way, n = 1 if forward else -1, 0
                while symbols[x + way * n] == symbols[y + way * n]:
                    n += 1
                assert n == k


@pytest.mark.parametrize("at_once", [1 << 18, 7])
def test_against_all_periods(monkeypatch, at_once):
    monkeypatch.setattr(runs, "QUERIES_AT_ONCE", at_once)
    texts = [" ".join(t) for t in samples()]
    sizes, found, collapsed = runs.text_runs(texts)
    for text, n, own, rest in zip(texts, sizes, found, collapsed):
        words = text.split()
        assert n == len(words) and own == plain_runs(words), text[:60]
        assert rest == plain_collapsed(words, own)
    for text in texts[:12]:
        assert runs.text_runs([text], 2)[1] == [plain_runs(text.split(), 2)]
    assert runs.text_runs([]) == ([], [], [])


def test_levels_are_few():
    rng = np.random.default_rng(3)
    for symbols in (np.zeros(50_000, int), rng.integers(0, 2, 50_000), np.tile(np.arange(40), 1250)):
        levels = runs.grammar(np.concatenate([[100], symbols, [101]]))
        assert len(levels) < 90 and all(a.symbol.size > b.symbol.size for a, b in zip(levels, levels[1:]))


def test_query_rows(spark):
    from loregraph.llm.periodic_runs import periodic_runs, run_digests, with_repeats

    rng = random.Random(4)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:25] + [3, -5, 10**15]
    rows = [(i, " ".join(rng.choice("abcdefghijklm") for _ in range(rng.choice([0, 1, 5, 20, 150])))) for i in ids]
    rows += [(ids[0], " \t\n"), (ids[1], None), (ids[2], "one"), (3, "x\x1cy\x85z\x0b\x0cx   x\x1cy\x85z x " * 9)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n long, w string").repartition(3)
    got = sorted(tuple(r) for r in run_digests(periodic_runs(with_repeats(docs))).collect())
    assert got == sorted(plain_digests(*r) for r in rows)
    assert any(r[1] for r in got)


def test_odd_rows(odd_docs, no_docs):
    found = runs.run_digests(runs.periodic_runs(runs.with_repeats(odd_docs))).collect()
    wanted = [plain_digests(d.doc_id, d.text) for d in odd_docs.collect() if d.doc_id != 7]
    assert sorted(str(tuple(r)) for r in found if r.doc_id != 7) == sorted(map(str, wanted)) and len(found) == len(wanted) + 1
    assert runs.periodic_runs(no_docs).collect() == []
