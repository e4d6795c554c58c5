"""Lempel-Ziv phrase fingerprints of documents and of their edited texts.

A text's UTF-8 bytes are parsed into LZ78 phrases: each is the shortest string at its place
that is not in the dictionary yet, and joins it. The set of phrase hashes is reduced to
``SIGNATURE`` minimum hashes; the share of equal ones estimates the Jaccard likeness of two
phrase sets, which is high for texts that would compress each other well.

The phrases that end before an edit are the same in both texts, so the edited text is parsed
from the phrase that reaches it only.

Cases: a null text is empty; the empty set has the fingerprint of all ones, so two empty texts
have likeness 1 and an empty and another 0; equal texts have equal fingerprints; of documents
with one doc_id the next is decided by a hash of the text; a null doc_id comes first; a single
document is followed by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import BATCH_CHARS, MIX, mix64, small_batches, texts_of
from loregraph.llm.ranges import range_buckets

SIGNATURE = 128
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
_seeds = mix64((np.arange(1, 2 * SIGNATURE + 1, dtype=np.uint64) * MIX)).astype(np.uint32)
FACTORS, SHIFTS = _seeds[:SIGNATURE] | np.uint32(1), _seeds[SIGNATURE:]
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * MIX)
EMPTY = np.uint32(0xFFFFFFFF)


def parse(data: bytes, trie: dict[int, int], start: int, ends: list[int]) -> None:
    """Append the ends of the phrases that begin at ``start`` and are complete within ``data``.

    ``trie`` is the dictionary: node + byte leads to a node; nodes are numbered in steps of 256."""
    get, append, fresh, node = trie.get, ends.append, 256 * (len(trie) + 1), 0
    for end, byte in enumerate(data[start:], start + 1):
        edge = node + byte
        node = get(edge, 0)
        if not node:
            trie[edge] = fresh
            fresh += 256
            append(end)


def parse_all(data: bytes, trie: dict[int, int], start: int, ends: list[int]) -> None:
    """The same up to the end of ``data``, whose last phrase may be one that is known."""
    parse(data, trie, start, ends)
    if len(data) > (ends[-1] if ends else start):
        ends.append(len(data))


class _Group:
    """Phrases of several texts, hashed together; ``parts`` are the phrases of one signature."""

    def __init__(self):
        self.data, self.ends, self.counts, self.size = [], [], [], 0

    def add(self, data: bytes, start: int, ends: list[int]) -> int:
        shift = self.size - start
        self.ends.append(np.array(ends, np.int64) + shift)
        self.data.append(data[start:ends[-1]] if ends else b"")
        self.size += len(self.data[-1])
        self.counts.append(len(ends))
        return len(self.counts) - 1

    def minima(self) -> np.ndarray:
        counts = np.array(self.counts)
        out = np.full((len(counts), SIGNATURE), EMPTY, np.uint32)
        if not self.size:
            return out
        data = np.frombuffer(b"".join(self.data), np.uint8)
        ends = np.concatenate(self.ends)
        starts = np.concatenate([[0], ends[:-1]])
        place = np.arange(len(data)) - np.repeat(starts, ends - starts)
        weights = mix64(np.arange(1, int(place.max()) + 2, dtype=np.uint64) * MIX) | np.uint64(1)
        hashes = mix64(np.add.reduceat(BYTE_VALUES[data] * weights[place], starts))
        words = (hashes >> np.uint64(32)).astype(np.uint32)
        filled = np.flatnonzero(counts)
        first = (np.cumsum(counts) - counts)[filled]
        for k in range(SIGNATURE):
            out[filled, k] = np.minimum.reduceat(words * FACTORS[k] + SHIFTS[k], first)
        return out


def _short(minima: np.ndarray) -> np.ndarray:
    """Sixteen bits of each minimum; all ones for the empty set."""
    bits = ((minima * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    bits[(minima == EMPTY).all(1)] = 0xFFFF
    return bits


def edited_text(text: str, following: str) -> str:
    """``text`` with its last floor(n/4) characters replaced by the first as many of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of whole texts."""
    group = _Group()
    for text in texts:
        data, ends = text.encode(), []
        parse_all(data, {}, 0, ends)
        group.add(data, 0, ends)
    return [row.astype(">u2").tobytes().hex() for row in _short(group.minima())] if texts else []


def likeness(one: str, other: str) -> float:
    """Share of equal minimum hashes of two fingerprints."""
    a, b = (np.frombuffer(bytes.fromhex(x), ">u2") for x in (one, other))
    return float((a == b).mean())


def _compare(ids: list, texts: list[str]) -> list[tuple]:
    """Result rows of all but the last text, each followed by the next."""
    group, own, changed, shas = _Group(), [], [], []
    for i, text in enumerate(texts):
        data, ends, trie = text.encode(), [], {}
        if i + 1 == len(texts):  # only looked at as the next one
            parse_all(data, trie, 0, ends)
            own.append((group.add(data, 0, ends),) * 2)
            break
        edited = edited_text(text, texts[i + 1]).encode()
        parse(text[:len(text) - len(text) // 4].encode(), trie, 0, ends)
        shared, fork, rest = group.add(data, 0, ends), ends[-1] if ends else 0, []
        parse_all(edited, trie.copy(), fork, rest)
        changed.append((shared, group.add(edited, fork, rest)))
        rest = []
        parse_all(data, trie, fork, rest)
        own.append((shared, group.add(data, fork, rest)))
        shas.append(hashlib.sha256(edited).hexdigest())
    minima = group.minima()
    own_bits = _short(np.minimum(*(minima[list(x)] for x in zip(*own))))
    bits = _short(np.minimum(*(minima[list(x)] for x in zip(*changed))))
    return [(ids[i], len(texts[i]), shas[i], own_bits[i].astype(">u2").tobytes().hex(),
             bits[i].astype(">u2").tobytes().hex(), float((own_bits[i] == bits[i]).mean()),
             float((own_bits[i] == own_bits[i + 1]).mean())) for i in range(len(shas))]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in order; the last row of each bucket is the first document of the next."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])
    ids, texts, size, bucket, closed = [], [], 0, None, False

    def rows() -> Iterator[pa.RecordBatch]:
        if len(texts) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*_compare(ids, texts)), schema)], schema=schema)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "guest"))
        for doc_id, text, of, guest in zip(*columns):
            if of != bucket:
                yield from rows()
                ids, texts, size, bucket, closed = [], [], 0, of, False
            if closed:
                continue
            closed = bool(guest)
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size > BATCH_CHARS and len(texts) > 1:
                yield from rows()
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    yield from rows()


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and its edited text, in the order of ``doc_id``.

    The texts are shuffled once, into ranges of ids; the first document of each range also goes
    to the range before it (the very first one to the last), so that no range needs another."""
    rows = range_buckets(small_batches(texts_of(docs)), ["doc_id"], F.xxhash64("text"))
    return rows.mapInArrow(_walk, SCHEMA)
