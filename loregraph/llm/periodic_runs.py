"""Maximal periodic runs of words, found by recompression.

1. The words of many texts, with a unique mark before, between and after them, are one sequence of
   symbols. It is compressed in rounds: blocks of one symbol become (symbol, count), then pairs
   whose first symbol falls in one half of the symbols and whose second falls in the other become
   new symbols. Equal stretches are cut alike but for their ends, so the levels form a run-length
   grammar of logarithmic height; they end once no symbol occurs twice.
2. How far two places agree, to the right or to the left, is read off the grammar: climb while the
   symbols above agree, descend where they differ, and step over equal symbols (a whole block at
   once), a bounded number per level. All queries of a group of texts climb side by side.
3. A run of period q and length 2 q or more holds two neighbouring places of the grid 0, q, 2 q, ..
   Grid neighbours with equal words are candidates, n/1 + n/2 + n/3 + .. at most; the run is their
   agreement in both directions. The same stretch found with multiples of its period counts once,
   with the smallest.

A text is one row and its runs are found by one task, in memory linear in the text; texts are taken
in groups of about 512 KB, or alone. Nothing is shuffled.

Cases: words are runs without ASCII white space, compared as they are; a null, empty or blank text
has no words and no runs; repeated rows and null doc_ids come back as they are; of a null doc_id no
check sum exists, so ``with_repeats`` leaves its text alone; other columns are left behind.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import MIX, mix64, small_batches, text_groups, texts_of

LEAST_LENGTH = 12
QUERIES_AT_ONCE = 1 << 18
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


@dataclass
class Level:
    """A sequence of symbols, and how the next level groups them."""

    symbol: np.ndarray
    first: np.ndarray | None = None     # per symbol above, its first one here; then the length of this level
    above: np.ndarray | None = None     # per symbol, the one above that holds it
    rest: np.ndarray | None = None      # where blocks are grouped: symbols from here to the end of the block,
    past: np.ndarray | None = None      # and from its begin to here


def _group(level: Level, starts: np.ndarray) -> None:
    """``starts``: where the symbols of the next level begin."""
    head = np.zeros(level.symbol.size, np.int32)
    head[starts[1:]] = 1
    level.above = np.cumsum(head, dtype=np.int32)
    level.first = np.append(starts, level.symbol.size).astype(np.int32)


def _blocks(level: Level, fresh: int) -> tuple[np.ndarray, int] | None:
    """Symbols of the next level, with every block of one symbol replaced, and the next free name."""
    s = level.symbol
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    if starts.size == s.size:
        return None
    _group(level, starts)
    place = np.arange(s.size, dtype=np.int32)
    level.past = place - level.first[level.above] + np.int32(1)
    level.rest = level.first[level.above + 1] - place
    counts = np.diff(level.first)
    out, many = s[starts].copy(), np.flatnonzero(counts > 1)
    names, which = np.unique((out[many] << 32) | counts[many], return_inverse=True)
    out[many] = fresh + which
    return out, fresh + names.size


def _pairs(level: Level, fresh: int, salt: int) -> tuple[np.ndarray, int]:
    """The same for pairs of a left and a right symbol. Neighbours differ, so some salt parts two of them."""
    s = level.symbol
    while True:
        right = (mix64(s.astype(np.uint64) * MIX + np.uint64(salt)) & np.uint64(1)).astype(bool)
        one, other = ~right[:-1] & right[1:], right[:-1] & ~right[1:]
        at = np.flatnonzero(one if one.sum() >= other.sum() else other)
        if at.size:
            break
        salt += 1 << 20
    inside = np.ones(s.size, bool)
    inside[at + 1] = False
    starts = np.flatnonzero(inside)
    _group(level, starts)
    names, which = np.unique((s[at] << 32) | s[at + 1], return_inverse=True)
    out = s[starts].copy()
    out[level.above[at]] = fresh + which
    return out, fresh + names.size


def grammar(symbols: np.ndarray) -> list[Level]:
    """Levels over ``symbols``, whose first and last occur nowhere else."""
    fresh, levels = int(symbols.max()) + 1, [Level(symbols.astype(np.int64))]
    while True:
        low = levels[-1]
        if np.bincount(low.symbol).max() == 1:
            return levels
        made = _blocks(low, fresh)
        if made is None:
            made = _pairs(low, fresh, len(levels))
        levels.append(Level(made[0]))
        fresh = made[1]


def agreement(levels: list[Level], left: np.ndarray, right: np.ndarray, forward: bool) -> np.ndarray:
    """How many symbols agree from the places ``left`` and ``right``, which differ, onwards (or backwards)."""
    way = 1 if forward else -1

    def step(level: Level, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        span = level.rest if forward else level.past
        by = way if span is None else way * np.minimum(span[x], span[y])
        return x + by, y + by

    def at_edge(level: Level, x: np.ndarray) -> np.ndarray:
        """Whether the symbol above begins (going backwards: ends) here."""
        up = level.above[x]
        return level.first[up] == x if forward else level.first[up + 1] - 1 == x

    who, x, y = np.arange(left.size), left.astype(np.int32), right.astype(np.int32)
    stopped = []                         # per level, the queries that go no higher
    for low, high in zip(levels, levels[1:]):
        ended = []
        while True:
            edge = at_edge(low, x) & at_edge(low, y)
            same = low.symbol[x] == low.symbol[y]
            leave = ~edge & ~same
            if leave.any():
                ended.append((who[leave], x[leave], y[leave]))
                who, x, y, edge = who[~leave], x[~leave], y[~leave], edge[~leave]
            if edge.all():
                break
            nx, ny = step(low, x, y)
            x, y = np.where(edge, x, nx), np.where(edge, y, ny)
        ux, uy = low.above[x], low.above[y]
        same = high.symbol[ux] == high.symbol[uy]
        ended.append((who[~same], x[~same], y[~same]))
        stopped.append(tuple(np.concatenate(parts) for parts in zip(*ended)))
        who, x, y = who[same], ux[same], uy[same]
    # no symbol of the last level occurs twice, so nothing is left there
    who, x, y = (np.empty(0, np.int32),) * 3
    for low, ended in zip(reversed(levels[:-1]), reversed(stopped)):
        x, y = (low.first[x], low.first[y]) if forward else (low.first[x + 1] - 1, low.first[y + 1] - 1)
        who, x, y = (np.concatenate(parts) for parts in zip((who, x, y), ended))
        while True:
            same = low.symbol[x] == low.symbol[y]
            if not same.any():
                break
            nx, ny = step(low, x, y)
            x, y = np.where(same, nx, x), np.where(same, ny, y)
    out = np.zeros(left.size, np.int64)
    out[who] = way * (x - left[who])
    return out


def _distinct(starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its smallest period, by start, then period."""
    order = np.lexsort((periods, ends, starts))
    starts, ends, periods = starts[order], ends[order], periods[order]
    new = np.ones(starts.size, bool)
    new[1:] = (starts[1:] != starts[:-1]) | (ends[1:] != ends[:-1])
    starts, ends, periods = starts[new], ends[new], periods[new]
    order = np.lexsort((periods, starts))
    return starts[order], ends[order], periods[order]


def runs_of(symbols: np.ndarray, longest: int, least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs of ``symbols``, which begin and end with unique ones and have
    at most ``longest`` symbols between unique ones."""
    levels, n = None, symbols.size
    found = tuple(np.empty(0, np.int64) for _ in range(3))
    places, periods, waiting = [], [], 0
    for q in range(1, longest // 2 + 1):
        grid = symbols[::q]
        at = np.flatnonzero(grid[1:] == grid[:-1]) * q
        if at.size and max(q, least - q) > 1:      # one word that agrees is no run
            at = at[(symbols[at + 1] == symbols[np.minimum(at + q + 1, n - 1)]) | (symbols[at - 1] == symbols[at + q - 1])]
        if at.size:
            places.append(at)
            periods.append(np.full(at.size, q))
            waiting += at.size
        if waiting < QUERIES_AT_ONCE and (q < longest // 2 or not waiting):
            continue
        levels = levels or grammar(symbols)
        i, p = np.concatenate(places), np.concatenate(periods)
        places, periods, waiting = [], [], 0
        for a in range(0, i.size, QUERIES_AT_ONCE):
            x, y = i[a:a + QUERIES_AT_ONCE], p[a:a + QUERIES_AT_ONCE]
            ends = x + agreement(levels, x, x + y, True) + y
            starts = x - agreement(levels, x - 1, x + y - 1, False)
            kept = ends - starts >= np.maximum(least, 2 * y)
            found = _distinct(*(np.concatenate(parts) for parts in zip(found, (starts[kept], ends[kept], y[kept]))))
    return found


def text_runs(texts: list[str], least: int = LEAST_LENGTH) -> tuple[list[int], list[list[tuple[int, int, int]]], list[str]]:
    """Of each text the number of words, its runs (start, length, period), and its words without the
    repeated parts of runs, joined by spaces."""
    words = [t.encode().split() for t in texts]      # of bytes, at ASCII white space alone
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    names: dict[bytes, int] = defaultdict(count().__next__)
    first = np.cumsum(sizes + 1) - sizes              # each text's first word, behind its mark
    total = int(sizes.sum()) + len(texts) + 1
    marks = np.concatenate([first - 1, [total - 1]])
    symbols = np.empty(total, np.int64)
    inside = np.ones(total, bool)
    inside[marks] = False
    symbols[inside] = np.fromiter(map(names.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    symbols[marks] = len(names) + np.arange(marks.size)
    starts, ends, periods = runs_of(symbols, int(sizes.max(initial=0)), least)
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts + periods, 1)
    np.add.at(change, ends, -1)
    kept = np.cumsum(change) == 0
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, e, q, k in zip(starts.tolist(), ends.tolist(), periods.tolist(), (np.searchsorted(first, starts, "right") - 1).tolist()):
        runs[k].append((s - int(first[k]), e - s, q))
    collapsed = []
    for own, mine, a in zip(words, runs, first.tolist()):
        some = compress(own, kept[a:a + len(own)].tolist()) if mine else own
        collapsed.append(b" ".join(some).decode())
    return sizes.tolist(), runs, collapsed


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every whole text.

    ``runs``: start, length and period of each maximal stretch of words with smallest period q and
    length at least ``least`` and 2 q, by start, then period. ``collapsed``: the words that no run
    holds after its first q, joined by spaces."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_groups(batches):
            sizes, runs, collapsed = text_runs(texts, least)
            flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
            offsets = np.cumsum([0, *map(len, runs)])
            each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each), pa.array(collapsed, pa.string())], schema=schema)

    return small_batches(texts_of(docs)).mapInArrow(scan, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with planted repetitions: where the check sum h of the id is a multiple of 10, the
    words from number a = g % n on are the p words from a, over and over, with g = h // 10 and
    p = 1 + (n - a) // (3 + g % 8)."""
    rows = texts_of(docs).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    planted = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    rows = rows.withColumn("w", F.when(planted, words)).withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    text = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """What the registered query returns of ``periodic_runs``."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("b.length"), -F.col("b.q")
    return rows.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
