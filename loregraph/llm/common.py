"""What the operators of this package share: choosing columns, batches of texts, text as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_CHARS = 1 << 19
BATCH_ROWS = 1000
MIX = np.uint64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id`` and ``text`` alone; a null text is empty. Further columns, whatever
    their names, are left behind before any operator adds its own."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``; false for a null id."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(parts) == F.lit(part), F.lit(False))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session now sends few rows at a time to Python: a text may be long, and both the
    JVM and the Python worker hold a whole batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def text_groups(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = BATCH_CHARS
                ) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows with about ``chars`` bytes of text together (a longer text is alone), so that
    what a task holds at once doesn't depend on how long texts are."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        start, seen = 0, 0
        for i, size in enumerate([*sizes, chars + 1]):
            if i > start and seen + size > chars:
                part = batch.slice(start, i - start)
                yield part, part.column(text).to_pylist()
                start, seen = i, 0
            seen += size


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64-bit words over all of them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
