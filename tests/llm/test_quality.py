import numpy as np

from loregraph.llm import quality_neighbours as quality


def test_scores_are_those_of_all_neighbours(spark, sf_dir):
    """Against a loop over every pair, and on rows that weren't learned from."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = quality.score_documents(docs, labels).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    for _, row in rows.head(40).iterrows():
        own = model.project(quality.term_counts([row.text]))[0]
        near = sorted(((float(own @ v), -i) for i, v in enumerate(model.vectors)), reverse=True)[:quality.NEIGHBOURS]
        weights = np.array([max(c, 1e-6) for c, _ in near]) ** quality.SHARPNESS
        assert abs(row.score - (weights * model.labels[[-i for _, i in near]]).sum() / weights.sum()) < 1e-3


def test_held_out_accuracy(spark, sf_dir):
    """On the next larger tables: the smallest have 19 labels that are held out."""
    larger = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.score_documents(docs, labels).filter("held_out").join(labels, "doc_id").toPandas()
    assert len(judged) > 50 and (judged.predicted == judged.quality).mean() > 0.93


def test_document_frequencies_cover_all_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found, n = quality.document_frequencies(docs.repartition(5))
    texts = [r.text for r in docs.collect()]
    assert n == len(texts) and (found == (quality.term_counts(texts) > 0).sum(0)).all()


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (7, None), (99, 1), (None, 0), (8, 0), (8, 1)], "doc_id long, quality int")
    rows = quality.score_documents(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.score_documents(no_docs, labels).collect() == []
    assert {r.score for r in quality.score_documents(odd_docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.accepted_documents(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in rows)


def test_held_out_labels_are_not_learned(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    hidden = labels.filter(quality.held_out("doc_id", 5, 0))
    turned = labels.join(hidden.select("doc_id"), "doc_id", "left_anti").unionByName(hidden.selectExpr("doc_id", "1 - quality AS quality", "toxic"))
    one, two = (sorted(map(str, quality.score_documents(docs, x).collect())) for x in (labels, turned))
    assert one == two
