import hashlib

from loregraph.llm import lz_fingerprint as lz


def plain_phrases(data):
    """Phrases by definition: the shortest string not seen yet."""
    seen, start, ends = set(), 0, []
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            ends.append(end)
            start = end
    return ends + [len(data)] * (start < len(data))


def test_phrases():
    for text in ("", "a", "aaaaaaaa", "abababababa", "the cat the cat the hat é é é"):
        ends = []
        lz.parse_all(text.encode(), {}, 0, ends)
        assert ends == plain_phrases(text.encode())


def test_likeness_orders_texts():
    text = "some words that are repeated in this text, some words that are not, and many more words here " * 3
    same, near, far = lz.fingerprints([text, text[:-20] + "other ends altogether", "0123456789 ?? !! zzzz QQQQ " * 9])
    assert lz.likeness(same, lz.fingerprints([text])[0]) == 1
    assert 0.5 < lz.likeness(same, near) < 1
    assert lz.likeness(same, far) < 0.1
    empty = lz.fingerprints([""])[0]
    assert lz.likeness(empty, empty) == 1 and lz.likeness(empty, same) == 0


def check(rows, docs):
    """Against whole texts in the order of ids."""
    prints = {t: p for t, p in zip(docs, lz.fingerprints(docs))}
    for row, text, following in zip(rows, docs, docs[1:] + docs[:1]):
        edited = lz.edited_text(text, following)
        other = lz.fingerprints([edited])[0]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (row.fingerprint, row.edited_fingerprint) == (prints[text], other)
        assert row.near_edited == lz.likeness(prints[text], other) and row.near_next == lz.likeness(prints[text], prints[following])


def test_documents_in_order(spark):
    texts = ["", "ab" * 30, "long " * 4000, "short", "é" * 99, "ab" * 30, "last one"]
    docs = spark.createDataFrame([(100 - 7 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(lz.fingerprint_documents(docs).collect(), key=lambda r: r.doc_id)
    check(rows, texts[::-1])


def test_odd_rows(odd_docs, no_docs):
    assert lz.fingerprint_documents(no_docs).collect() == []
    rows = lz.fingerprint_documents(odd_docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd_docs.collect())
    one = odd_docs.filter("doc_id = 1")
    check(lz.fingerprint_documents(one).collect(), [one.first().text])


def test_batches_do_not_matter(odd_docs, monkeypatch):
    whole = sorted(map(str, lz.fingerprint_documents(odd_docs.filter("doc_id < 12")).collect()))
    again = sorted(map(str, lz.fingerprint_documents(odd_docs.filter("doc_id < 12").repartition(7)).collect()))
    assert whole == again
