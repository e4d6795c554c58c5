"""Byte-level BPE encoding and decoding by segment trees.

Each piece of a text (a match of the tokenizer's pattern) starts as single bytes. A segment
tree over the byte positions holds, at every node, the smallest (rank, position) of the
mergeable pairs below it, so the root is the leftmost pair of the lowest rank. A merge
changes three leaves (the pair itself, its right and its left neighbour) and the nodes above
them. Many short pieces are merged side by side in numpy, one merge each per round; a long
piece has a tree of its own.

Cases: a null or empty text has no ids and decodes to no bytes; every string encodes (a lone
byte is a token) and decodes to exactly its UTF-8 bytes; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loregraph.llm.common import small_batches, text_groups, texts_of

NONE = np.int64(1) << np.int64(60)
SHIFT = 32
LONG = 128          # bytes from which a piece has a tree of its own
SIDE_BY_SIDE = 1 << 18   # tree leaves merged together
REMEMBERED = 100_000     # pieces whose ids a Python worker keeps
PIECES = 1 << 16    # pieces of one text that are handled at once
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class SegmentBpe:
    """Encoder and decoder for one table of ranks; a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = max(ranks.values()) + 1
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.width + right] = rank
        bits = max(4, int(4 * len(self.pairs)).bit_length())
        self.down = np.uint64(64 - bits)
        self.slots = np.full((1 << bits) + 64, -1, np.int64)
        self.slot_ranks = np.full((1 << bits) + 64, NONE, np.int64)
        places = self._places(np.fromiter(self.pairs, np.int64, len(self.pairs)))
        for place, (key, rank) in zip(places.tolist(), self.pairs.items()):
            while self.slots[place] >= 0:
                place += 1
            self.slots[place], self.slot_ranks[place] = key, rank
        self.memory: dict[str, str] = {}        # piece: its ids
        self.run_bytes: dict[str, bytes] = {}   # ids of a piece: the bytes they decode to

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.down).astype(np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they don't merge."""
        keys = left * self.width + right
        place = self._places(keys)
        found = self.slots[place]
        ranks = np.where(found == keys, self.slot_ranks[place], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while open_.size:
            place[open_] += 1
            found = self.slots[place[open_]]
            hit = found == keys[open_]
            ranks[open_[hit]] = self.slot_ranks[place[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return ranks

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece by a segment tree of its own."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, pairs, width, none = len(piece), self.pairs, self.width, int(NONE)
        size = 1 << max(1, (n - 1).bit_length())
        ids = [int(self.byte_ids[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = pairs.get(ids[i] * width + ids[i + 1])
            if rank is not None:
                tree[size + i] = rank << SHIFT | i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = size + leaf
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        def pair(i: int, j: int) -> int:
            rank = pairs.get(ids[i] * width + ids[j])
            return none if rank is None else rank << SHIFT | i

        while tree[1] < none:
            at, rank = tree[1] & ((1 << SHIFT) - 1), tree[1] >> SHIFT
            gone = after[at]
            follows = after[gone]
            ids[at], after[at] = rank, follows
            put(gone, none)
            if follows < n:
                before[follows] = at
                put(at, pair(at, follows))
            else:
                put(at, none)
            if before[at] >= 0:
                put(before[at], pair(before[at], at))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of many pieces; those of like length are merged side by side."""
        out: list[list[int]] = [[]] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = [rank]
            elif len(piece) > LONG:
                out[i] = self.encode_piece(piece)
            else:
                by_size.setdefault(max(1, (len(piece) - 1).bit_length()), []).append(i)
        for bits, members in by_size.items():
            step = max(1, SIDE_BY_SIDE >> bits)
            for start in range(0, len(members), step):
                some = members[start:start + step]
                for i, ids in zip(some, self._side_by_side([pieces[i] for i in some], 1 << bits)):
                    out[i] = ids
        return out

    def _side_by_side(self, pieces: list[bytes], size: int) -> list[list[int]]:
        rows = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, rows)
        wide = size + 1
        columns = np.arange(wide)
        inside = columns[None, :] < lengths[:, None]
        ids = np.zeros((rows, wide), np.int64)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(columns + 1, (rows, 1))
        before = np.tile(columns - 1, (rows, 1))
        tree = np.full((rows, 2 * size), NONE, np.int64)
        ranks = self._pair_ranks(ids[:, :size].ravel(), ids[:, 1:].ravel()).reshape(rows, size)
        ok = inside[:, 1:] & (ranks < NONE)
        tree[:, size:][ok] = (ranks << SHIFT | columns[:size])[ok]
        node = size
        while node > 1:
            tree[:, node // 2:node] = np.minimum(tree[:, node:2 * node:2], tree[:, node + 1:2 * node:2])
            node //= 2
        flat_ids, flat_after, flat_before, flat = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        live = np.flatnonzero(tree[:, 1] < NONE)
        levels = size.bit_length() - 1
        while live.size:
            root = flat[live * (2 * size) + 1]
            at, rank = root & ((1 << SHIFT) - 1), root >> SHIFT
            base, top, n = live * wide, live * (2 * size), lengths[live]
            gone = flat_after[base + at]
            follows = flat_after[base + gone]
            flat_ids[base + at] = rank
            flat_after[base + at] = follows
            flat_before[base + np.minimum(follows, size)] = at
            prior = flat_before[base + at]
            flat[top + size + gone] = NONE
            right = np.where(follows < n, self._pair_ranks(rank, flat_ids[base + np.minimum(follows, size)]), NONE)
            flat[top + size + at] = np.where(right < NONE, right << SHIFT | at, NONE)
            has = prior >= 0
            left = np.full(live.size, NONE)
            if has.any():
                left[has] = self._pair_ranks(flat_ids[(base + prior)[has]], rank[has])
            prior = np.where(has, prior, at)
            flat[top + size + prior] = np.where(
                has, np.where(left < NONE, left << SHIFT | prior, NONE), flat[top + size + at])
            a, g, p = at + size, gone + size, prior + size
            for _ in range(levels):
                a, g, p = a >> 1, g >> 1, p >> 1
                for leaf in (g, a, p):
                    child = top + 2 * leaf
                    flat[top + leaf] = np.minimum(flat[child], flat[child + 1])
            live = live[flat[top + 1] < NONE]
        kept = np.zeros((rows, wide), bool)
        place = np.zeros(rows, np.int64)
        left_rows = np.arange(rows)
        while left_rows.size:  # walk all chains of live positions together
            kept[left_rows, place[left_rows]] = True
            place[left_rows] = after[left_rows, place[left_rows]]
            left_rows = left_rows[place[left_rows] < lengths[left_rows]]
        values, ends = ids[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [values[i:j] for i, j in zip([0, *ends], ends)]

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces not seen before."""
        fresh = [piece for piece in pieces if piece not in self.memory]
        if len(self.memory) + len(fresh) > REMEMBERED:
            self.memory.clear()
            self.run_bytes.clear()
            fresh = list(pieces)
        for piece, ids in zip(fresh, self.encode_pieces([p.encode() for p in fresh])):
            run = ",".join(map(str, ids))
            self.memory[piece] = run
            self.run_bytes[run] = self.decode(ids)

    def pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= 16 * PIECES:
            yield self.pattern.findall(text)
            return
        matches = self.pattern.finditer(text)
        while some := [m.group() for m in islice(matches, PIECES)]:
            yield some

    def encode(self, text: str) -> list[int]:
        """All ids of a text."""
        out: list[int] = []
        for some in self.pieces(text):
            for ids in self.encode_pieces([p.encode() for p in some]):
                out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def digests(self, text: str, cut: list[str] | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of their decimals joined by commas and of the bytes they decode to.

        ``cut``: the pieces of a text that is not long, already learned."""
        n, ids_sha, bytes_sha = 0, hashlib.sha256(), hashlib.sha256()
        for some in [cut] if cut is not None else self.pieces(text):
            if cut is None:
                self.learn(set(some))
            if not some:
                continue
            runs = list(map(self.memory.__getitem__, some))
            ids = ",".join(runs)
            ids_sha.update((("," if n else "") + ids).encode())
            n += ids.count(",") + 1
            bytes_sha.update(b"".join(map(self.run_bytes.__getitem__, runs)))
        return n, ids_sha.hexdigest(), bytes_sha.hexdigest()


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> SegmentBpe:
    """One coder per Python worker, with what it remembers."""
    return SegmentBpe(load_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids of every whole text and of the bytes they decode to, a row per document.

    ``path``: ranks file, at the same place on every machine; ``pattern``: how texts are cut
    into pieces. No shuffle: each row is independent, and a worker keeps only a bounded memory
    of pieces it has encoded."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch, texts in text_groups(batches):
            cuts = [next(own.pieces(t)) if len(t) <= 16 * PIECES else None for t in texts]
            fresh: set[str] = set()
            fresh.update(*[c for c in cuts if c is not None])
            own.learn(fresh)
            rows = [own.digests(t, c) for t, c in zip(texts, cuts)]
            n, ids, decoded = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(texts_of(docs)).mapInArrow(encode, SCHEMA)


def tokenized_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``token_ids array<int>`` of every whole text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch, texts in text_groups(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([own.encode(t) for t in texts], pa.list_(pa.int32()))],
                names=["doc_id", "token_ids"])

    return small_batches(texts_of(docs)).mapInArrow(encode, "doc_id long, token_ids array<int>")


def decoded_documents(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``bytes binary`` of rows with ``token_ids``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            rows = [own.decode(ids or []) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "token_ids").mapInArrow(decode, "doc_id long, bytes binary")
