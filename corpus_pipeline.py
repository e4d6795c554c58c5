"""A training corpus from ``documents``: quality, near duplicates, benchmark leaks, secrets, tokens.

Each stage reads all that its predecessor kept. All but the last return the columns of documents:

- quality: documents scored below the classifier's threshold go;
- near_duplicates: of each group connected by 5-word shingle similarity of 0.8 one row stays, that
  with the smallest doc_id, then the smallest hash of its text;
- decontamination: documents with a passage of a benchmark item go;
- secrets: spans found to be secrets are replaced by a mark in the text, and n_chars follows;
- tokens: token counts and digests of the ids and of the bytes they decode to.

Decisions are taken for rows, by doc_id and text together: a doc_id that repeats with another text,
or that is null, doesn't take other rows with it. Null texts are empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm.common import read_table
from loregraph.llm.ngram_join import without_near_duplicates
from loregraph.llm.quality_neighbours import accepted_documents
from loregraph.llm.secret_tests import mask_secrets
from loregraph.llm.segment_bpe import encode_documents
from loregraph.llm.spaced_seeds import without_leaks
from loregraph.session import new_folder

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, str(public_tokenizers.path(TOKENIZER)), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secrets", secrets), ("tokens", tokens),
]
ORACLE_SQL = None   # the classifier can't be stated in SQL; tested against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
