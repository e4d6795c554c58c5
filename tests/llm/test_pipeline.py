"""The pipeline against plain versions of its decisions, stage by stage."""

import hashlib
import re

import public_tokenizers
import tiktoken
from plain import SECRETS
from test_ngram_join import plain_rows, plain_shingles

import corpus_pipeline
from loregraph.llm import quality_neighbours, secret_tests, segment_bpe


def ids_of(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["quality"](spark, docs, sf_dir).cache()
    assert kept.columns == docs.columns
    good = quality_neighbours.score_documents(docs, labels).filter("predicted = 1")
    assert ids_of(kept) == ids_of(good) and 0 < kept.count() < docs.count()

    single = stage["near_duplicates"](spark, kept, sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    groups = plain_rows(rows)
    assert single.columns == docs.columns and ids_of(single) == sorted(d for d, _, _, group in groups if d == group)

    clean = stage["decontamination"](spark, single, sf_dir).cache()
    items = [plain_shingles(" ".join(re.findall(r"\w+", r.text.lower()))) for r in bench.collect()]
    leaks = {r.doc_id for r in single.collect() if any(len(i & plain_shingles(" ".join(re.findall(r"\w+", r.text.lower())))) >= 8 for i in items)}
    assert ids_of(clean) == sorted(set(ids_of(single)) - leaks)

    masked = stage["secrets"](spark, clean, sf_dir).cache()
    before, after = ({r.doc_id: r for r in x.collect()} for x in (clean, masked))
    assert masked.columns == docs.columns and before.keys() == after.keys()
    for i, row in after.items():
        assert row.n_chars == len(row.text)
        assert not any(good(m) for _, p, good in SECRETS for m in re.finditer(p, row.text))
        own = [m for _, p, good in SECRETS for m in re.finditer(p, before[i].text) if good(m)]
        assert (secret_tests.MASK in row.text) if own else (row.text == before[i].text or secret_tests.MASK in row.text)

    tokens = {r.doc_id: r for r in stage["tokens"](spark, masked, sf_dir).collect()}
    ranks = segment_bpe.load_ranks(str(public_tokenizers.path(corpus_pipeline.TOKENIZER)))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert tokens.keys() == after.keys()
    for i, row in tokens.items():
        own = library.encode_ordinary(after[i].text)
        assert (row.n_tokens, row.ids_sha256) == (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())

    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == tokens


def test_odd_rows(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, docs, sf_dir)
            assert df.count() <= docs.count()
            assert name == "tokens" or df.columns == docs.columns
