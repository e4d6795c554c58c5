"""Quality by nearest labelled neighbours in a latent semantic space.

Terms of a text are its bytes, hashed byte pairs and a few shape terms (share of repeated words,
of stuttered words, of capitals, of symbols, word length). Their logarithmic counts, weighted by inverse document
frequency over all documents, are projected on the leading singular vectors of a labelled
sample. That sample's vectors are broadcast; every document takes its exact cosine with all of
them, block by block, and its ``NEIGHBOURS`` nearest ones vote with weights by similarity.

Fixed bounds: ``SAMPLE`` labelled rows at most are learned from (the smallest hashes of doc_id),
so the broadcast is ``SAMPLE * RANK`` floats at any corpus size. Everything else reads all rows.

Cases: labels that are null or whose document is missing aren't learned from; with no label at
all every score is 0.5; a null or empty text has no terms and scores the share of good labels;
repeated labels vote each; ties among neighbours go to the earlier sample row.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import held_out, small_batches, text_groups, texts_of

PAIRS = 1024
SHAPES = 6
LEVELS = 8
TERMS = 256 + PAIRS + SHAPES * LEVELS
RANK = 48
SAMPLE = 6000
NEIGHBOURS = 24
SHARPNESS = 8
THRESHOLD = 0.3
BLOCK = 256
SHAPE_WEIGHT = 2.0


def shape_levels(text: str) -> list[int]:
    """Levels 0 to LEVELS - 1 of six traits; a text without words has none."""
    words = text.split()
    n = len(words)
    if not n:
        return []
    letters = sum(map(len, words))
    flat = "".join(words)
    capitals = sum(map(flat.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = sum(map(flat.count, "#$%&*!|<>=+~^"))
    lines = text.split("\n")
    traits = (
        1 - len(set(words)) / n if n > 20 else 0.0,
        min(1.0, 2 * sum(map(operator.eq, words, words[1:])) / n),
        min(1.0, capitals / letters),
        min(1.0, 2 * symbols / letters),
        min(1.0, letters / n / 16),
        1 - len(set(lines)) / len(lines),
    )
    return [min(LEVELS - 1, int(t * LEVELS)) for t in traits]


def term_counts(texts: list[str]) -> np.ndarray:
    """Counts of all terms, a row per text."""
    data = [t.encode() for t in texts]
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    codes = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(data)), lengths)
    out = np.zeros((len(data), TERMS), np.float32)
    if codes.size:
        out[:, :256] = np.bincount(row * 256 + codes, minlength=256 * len(data)).reshape(-1, 256)
        pair = ((codes[:-1] * 256 + codes[1:]) * 40503 >> 5) % PAIRS
        inside = row[:-1] == row[1:]
        out[:, 256:256 + PAIRS] = np.bincount(
            (row[:-1] * PAIRS + pair)[inside], minlength=PAIRS * len(data)).reshape(-1, PAIRS)
    for i, text in enumerate(texts):
        for trait, level in enumerate(shape_levels(text)):
            out[i, 256 + PAIRS + trait * LEVELS + level] = 1
    return out


def _small_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch, texts in text_groups(batches):
        for start in range(0, len(texts), BLOCK):
            yield batch.slice(start, BLOCK), texts[start:start + BLOCK]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(TERMS + 1, np.int64), 0
        for _, some in _small_groups(batches):
            seen[:TERMS] += (term_counts(some) > 0).sum(0)
            rows += len(some)
        seen[TERMS] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(seen)], names=["term", "n"])

    sums = texts.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(TERMS + 1, np.int64)
    for r in sums.collect():
        out[r.term] = r.n
    return out[:TERMS], int(out[TERMS])


@dataclass
class Model:
    """What a task needs: term weights, basis of the space, labelled vectors with their labels."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        rows = np.log1p(counts) * self.idf
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
        shapes = counts[:, 256 + PAIRS:] * np.float32(SHAPE_WEIGHT / SHAPES ** 0.5)
        rows[:, 256 + PAIRS:] = shapes
        return rows

    def project(self, counts: np.ndarray) -> np.ndarray:
        rows = self.weigh(counts) @ self.basis
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str]) -> np.ndarray:
        """Weighted share of good labels among the nearest neighbours of each text."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        counts = term_counts(texts)
        cosines = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        # rows beyond the k-th that tie with it give way to the earlier ones
        least = np.take_along_axis(cosines, near, 1).min(1, keepdims=True)
        tied = np.flatnonzero((cosines >= least).sum(1) > k)
        for i in tied:
            near[i] = np.lexsort((np.arange(cosines.shape[1]), -cosines[i]))[:k]
        weights = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(np.float64) ** SHARPNESS
        scores = (weights * self.labels[near]).sum(1) / weights.sum(1)
        scores[counts.sum(1) == 0] = self.labels.mean()
        return np.clip(scores, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` rows of ``labels`` (doc_id, quality) whose crc32 isn't held out."""
    texts = small_batches(texts_of(docs))
    found, n = document_frequencies(texts)
    idf = (np.log((1 + n) / (1 + found)) + 1).astype(np.float32)
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    usable = usable.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id", 5, 0))
    few = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = texts.join(F.broadcast(few), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text", "quality").limit(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in _small_groups(batches):
            counts = [zlib.compress(row.tobytes(), 1) for row in term_counts(some).astype(np.float32)]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(counts, pa.binary())], names=["quality", "counts"])

    # packed, a few MB; on the driver one array of the sample, worked on in blocks
    got = rows.select("quality", "text").mapInArrow(count, "quality int, counts binary").collect()
    model = Model(idf, np.zeros((TERMS, RANK), np.float32), np.zeros((0, RANK), np.float32), np.array([r.quality for r in got], np.float64))
    if got:
        packed = [bytes(r.counts) for r in got]
        del got

        def blocks() -> Iterator[np.ndarray]:
            for start in range(0, len(packed), BLOCK):
                yield np.array([np.frombuffer(zlib.decompress(x), np.float32) for x in packed[start:start + BLOCK]])

        square = np.zeros((TERMS, TERMS))
        for counts in blocks():
            weighed = model.weigh(counts).astype(np.float64)
            square += weighed.T @ weighed
        _, vectors = np.linalg.eigh(square)
        model.basis = vectors[:, ::-1][:, :RANK].astype(np.float32)
        model.vectors = np.concatenate([model.project(counts) for counts in blocks()])
    return model


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in _small_groups(batches):
            scores = model.value.score(some)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores),
                 pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = small_batches(texts_of(docs)).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", held_out("doc_id", 5, 0))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def accepted_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose predicted label is 1."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = batch.column(text).fill_null("")
            own = pa.RecordBatch.from_arrays([filled], names=["text"])
            good = [model.value.score(some) >= THRESHOLD for _, some in _small_groups(iter([own]))]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(keep, docs.schema)
