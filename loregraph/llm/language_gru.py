"""Language by a bidirectional gated recurrent network over bytes.

A forward and a backward network with gated recurrent units read windows of a text's UTF-8
bytes; at every position both states together give a distribution over the languages, and a
document's probabilities are the mean over all its positions. Both networks are trained in
numpy by backpropagation through time with Adam.

Fixed bound: at most ``SAMPLE`` documents per language, ``CUTS`` passages of each, are learned
from: those with the smallest hashes of doc_id and text among all rows that aren't held out. All
languages are learned; with many of them the documents of each are fewer, so that about ``TOTAL``
are learned from, but not below ``FEWEST``. Every text is read whole, in windows of at most
``WINDOW`` bytes, so memory doesn't depend on its length.

Cases: a text that is null, empty or has no Unicode letter is ``und`` with score 0; with no
learnable row every text is; null languages aren't learned from, nor one whose documents have no
letter; a repeated row is learned from once; languages are in alphabetical order and the first wins
a tie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.llm.common import held_out, small_batches, text_groups, texts_of

HIDDEN = 8
WINDOW = 256
SIDE_BY_SIDE = 1024
SAMPLE = 600
CUTS = 3
CUT_CHARS = 96
TOTAL, FEWEST = 40_000, 40
STEPS, BATCH, TRAIN_BYTES, RATE = 240, 128, 64, 0.02
WORDLIKE = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether there is a letter in the sense of Unicode: numbers such as ½ or ² are like words, but none."""
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by the hyperbolic tangent."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


@dataclass
class Network:
    """Weights by name: for each direction d, the byte tables ``z_d r_d n_d`` (256 x H), the state
    matrices ``Uz_d Ur_d Un_d`` (H x H); then ``out`` (2H x L) and ``bias`` (L)."""

    weights: dict[str, np.ndarray]
    languages: list[str]

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            for g in "zrn":
                w[f"{g}_{d}"] = rng.normal(0, 0.3, (256, HIDDEN)).astype(np.float32)
                w[f"U{g}_{d}"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, HIDDEN)).astype(np.float32)
        w["out"] = rng.normal(0, 0.3, (2 * HIDDEN, len(languages))).astype(np.float32)
        w["bias"] = np.zeros(len(languages), np.float32)
        return cls(w, languages)

    def states(self, codes: np.ndarray, lengths: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States (T x B x H) of direction ``d`` over ``codes`` (T x B); the backward one starts at
        each window's own end. ``trace`` gets what the gradients need, in the order of the steps."""
        steps, width = codes.shape
        w = self.weights
        tables, mats = [w[f"{g}_{d}"] for g in "zrn"], [w[f"U{g}_{d}"] for g in "zrn"]
        out = np.empty((steps, width, HIDDEN), np.float32)
        h = np.zeros((width, HIDDEN), np.float32)
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        ragged = d == "b" and bool((lengths < steps).any())
        for t in order:
            byte = codes[t]
            z = _sigmoid(h @ mats[0] + tables[0].take(byte, 0))
            r = _sigmoid(h @ mats[1] + tables[1].take(byte, 0))
            a = h @ mats[2]
            n = r * a
            n += tables[2].take(byte, 0)
            np.tanh(n, out=n)
            if trace is not None:
                trace.append((t, h, z, r, a, n))
            h = h - n
            h *= z
            h += n
            if ragged:
                h *= (t < lengths)[:, None]
            out[t] = h
        return out

    def positions(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities (T x B x L) of every position."""
        forward, backward = self.states(codes, lengths, "f"), self.states(codes, lengths, "b")
        scores = forward @ self.weights["out"][:HIDDEN]
        scores += backward @ self.weights["out"][HIDDEN:]
        scores += self.weights["bias"]
        np.exp(np.minimum(scores, 60, out=scores), out=scores)
        scores /= scores.sum(2, keepdims=True)
        return scores

    def gradients(self, codes: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions with their window's language, and its gradients."""
        w, traces = self.weights, {"f": [], "b": []}
        both = np.concatenate([self.states(codes, lengths, d, traces[d]) for d in "fb"], axis=2)
        scores = both @ w["out"] + w["bias"]
        scores -= scores.max(2, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(2, keepdims=True)
        real = (np.arange(codes.shape[0])[:, None] < lengths[None, :])
        share = real / real.sum()
        rows = np.arange(codes.shape[1])
        loss = -float((np.log(p[:, rows, target] + 1e-9) * share).sum())
        p[:, rows, target] -= 1
        p *= share[:, :, None].astype(np.float32)
        flat = p.reshape(-1, p.shape[2])
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        grads["out"] = both.reshape(-1, 2 * HIDDEN).T @ flat
        grads["bias"] = flat.sum(0)
        into = p @ w["out"].T
        for d, part in (("f", into[:, :, :HIDDEN]), ("b", into[:, :, HIDDEN:])):
            carried = np.zeros(part.shape[1:], np.float32)
            for t, h, z, r, a, n in reversed(traces[d]):
                dh = part[t] + carried
                if d == "b":
                    dh *= (t < lengths)[:, None]
                dz = dh * (h - n) * z * (1 - z)
                dn = dh * (1 - z) * (1 - n * n)
                da, dr = dn * r, dn * a * r * (1 - r)
                for gate, local, inner in (("z", dz, dz), ("r", dr, dr), ("n", dn, da)):
                    np.add.at(grads[f"{gate}_{d}"], codes[t], local)
                    grads[f"U{gate}_{d}"] += h.T @ inner
                carried = dh * z + dz @ w[f"Uz_{d}"].T + dr @ w[f"Ur_{d}"].T + da @ w[f"Un_{d}"].T
        return loss, grads

    def label(self, texts: list[str]) -> np.ndarray:
        """Mean probabilities of each text's positions; zeros for an empty text."""
        data = [t.encode() for t in texts]
        sums = np.zeros((len(data), len(self.languages)))
        rows, starts, sizes, offset = [], [], [], 0
        for i, text in enumerate(data):
            n = -(-len(text) // WINDOW)
            edges = [offset + len(text) * k // n for k in range(n + 1)] if n else []
            rows += [i] * n
            starts += edges[:-1]
            sizes += [b - a for a, b in zip(edges, edges[1:])]
            offset += len(text)
        if not rows:
            return sums
        codes = np.frombuffer(b"".join(data), np.uint8)
        rows, starts, sizes = np.array(rows), np.array(starts), np.array(sizes)
        order = np.argsort(-sizes, kind="stable")
        width = max(16, SIDE_BY_SIDE * 2 * HIDDEN // max(2 * HIDDEN, len(self.languages)))
        for at in range(0, len(order), width):
            some = order[at:at + width]
            length = sizes[some]
            place = np.minimum(starts[some][None, :] + np.arange(length.max())[:, None], len(codes) - 1)
            p = self.positions(codes[place], length)
            p *= (np.arange(len(p))[:, None] < length[None, :])[:, :, None]
            np.add.at(sums, rows[some], p.sum(0))
        return sums / np.maximum(sums.sum(1, keepdims=True), 1e-9)


def train(passages: list[bytes], target: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """A network trained with Adam on random windows, languages in equal parts."""
    net, rng = Network.fresh(languages, seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    by_language = [np.flatnonzero(target == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        wanted = rng.integers(0, len(languages), BATCH)
        chosen = [passages[rng.choice(by_language[k])] for k in wanted]
        begin = [rng.integers(0, max(1, len(c) - TRAIN_BYTES + 1)) for c in chosen]
        chosen = [c[b:b + TRAIN_BYTES] for c, b in zip(chosen, begin)]
        lengths = np.array(list(map(len, chosen)))
        codes = np.zeros((TRAIN_BYTES, BATCH), np.uint8)
        for i, c in enumerate(chosen):
            codes[:len(c), i] = np.frombuffer(c, np.uint8)
        _, grads = net.gradients(codes, lengths, wanted)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            net.weights[k] -= (rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Learn from rows that aren't held out and have a language; None if there is none."""
    rows = texts_of(docs).select("doc_id", "text").withColumn("lang", F.lit(None)) if "lang" not in docs.columns else \
        docs.select("doc_id", F.col("text"), "lang")
    usable = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 4, 2))
    usable = usable.withColumn("key", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"))
    n_languages = counts.count()
    if not n_languages:
        return None
    sample = min(sample, max(FEWEST, TOTAL // n_languages))
    # a share of each language by hash, more than wanted; of those the smallest hashes
    share = F.least(F.lit(1.0), F.lit(1.5 * sample + 40) / F.col("n")).alias("share")
    cuts = [F.substring("text", (F.length("text") * F.lit(k / CUTS)).cast("int") + 1, F.lit(CUT_CHARS)).alias(f"c{k}") for k in range(CUTS)]
    drawn = usable.join(F.broadcast(counts.select("lang", share)), "lang").filter(F.col("key") < F.col("share") * F.lit(float(1 << 40)))
    drawn = drawn.select("lang", "key", *cuts).dropDuplicates(["lang", "key"])
    order = Window.partitionBy("lang").orderBy("key")
    few = drawn.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample).drop("key", "place").collect()
    pairs = sorted((c.encode(), r["lang"]) for r in few for c in r[1:] if c and has_letter(c))
    languages = sorted({lang for _, lang in pairs})
    if not languages:
        return None
    place = {lang: k for k, lang in enumerate(languages)}
    return train([c for c, _ in pairs], np.array([place[lang] for _, lang in pairs]), languages, max(STEPS, 10 * len(languages)))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text."""
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = net.value
        for batch, texts in text_groups(batches):
            has = np.array([has_letter(t) for t in texts])
            if own is None:
                has[:] = False
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            else:
                p = own.label([t if h else "" for t, h in zip(texts, has)])
                best, score = p.argmax(1), p.max(1)
            names = [own.languages[k] if h else UNKNOWN for k, h in zip(best, has)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(has, np.minimum(score, 1.0), 0.0))],
                names=["doc_id", "held_out", "lang_pred", "score"])

    rows = small_batches(texts_of(docs)).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", held_out("doc_id", 4, 2))
    return rows.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")
