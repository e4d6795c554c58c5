import math

import numpy as np
from pyspark.sql import functions as F

from loregraph.llm import language_gru as gru


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = gru.Network.fresh(["a", "b", "c"], seed=2)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    codes, lengths, target = rng.integers(97, 101, (6, 4)).astype(np.uint8), np.array([6, 3, 5, 1]), np.array([0, 1, 2, 1])
    _, grads = net.gradients(codes, lengths, target)
    for name, weight in net.weights.items():
        at = tuple(97 if s == 256 else 0 for s in weight.shape)
        before, step = weight[at], 1e-3
        weight[at] = before + step
        up, _ = net.gradients(codes, lengths, target)
        weight[at] = before - step
        down, _ = net.gradients(codes, lengths, target)
        weight[at] = before
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3, name


def test_windows_do_not_mix_and_padding_does_not_count():
    net = gru.Network.fresh(["a", "b"], seed=3)
    texts = ["abc", "", "x" * 700, "é" * 300, "hello there"]
    together = net.label(texts)
    alone = np.concatenate([net.label([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    assert (together[1] == 0).all() and np.allclose(together[[0, 2, 3, 4]].sum(1), 1)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = gru.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.9
    assert rows.score.between(0, 1).all()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = gru.identify(odd_docs, sample=5).collect()
    assert len(rows) == odd_docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (4, 5)} == {"und"}
    assert all(r.lang_pred in ("aa", "bb", "und") and 0 <= r.score <= 1 for r in rows)
    assert gru.identify(no_docs).collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert gru.identify(unlabelled).first().lang_pred == "und"


def plain_label(net, text):
    """One text, one byte at a time, one number at a time."""
    w = {k: v.tolist() for k, v in net.weights.items()}
    data, size = text.encode(), gru.HIDDEN
    n = -(-len(data) // gru.WINDOW)
    sig = lambda x: 1 / (1 + math.exp(-x))
    total = [0.0] * len(net.languages)
    for k in range(n):
        part = data[len(data) * k // n:len(data) * (k + 1) // n]
        states = {}
        for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            h, states[d] = [0.0] * size, {}
            for t in order:
                into = {g: [sum(h[i] * w[f"U{g}_{d}"][i][j] for i in range(size)) for j in range(size)] for g in "zrn"}
                z = [sig(into["z"][j] + w[f"z_{d}"][part[t]][j]) for j in range(size)]
                r = [sig(into["r"][j] + w[f"r_{d}"][part[t]][j]) for j in range(size)]
                c = [math.tanh(r[j] * into["n"][j] + w[f"n_{d}"][part[t]][j]) for j in range(size)]
                h = states[d][t] = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(size)]
        for t in range(len(part)):
            both = states["f"][t] + states["b"][t]
            scores = [math.exp(sum(both[i] * w["out"][i][k] for i in range(2 * size)) + w["bias"][k]) for k in range(len(total))]
            total = [a + s / sum(scores) for a, s in zip(total, scores)]
    return [a / sum(total) for a in total]


def test_against_a_plain_network(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = gru.fit(docs, 30)
    texts = [r.text for r in docs.filter("n_chars < 700").limit(8).collect()] + ["x", "é", "Die Katze " * 60]
    for text, got in zip(texts, net.label(texts)):
        assert np.allclose(got, plain_label(net, text), atol=1e-4)


def test_what_is_learned_from(spark, sf_dir):
    """Languages of held-out rows, repeated rows and the order of rows change nothing; every language is learned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    kept = gru.held_out("doc_id", 4, 2)
    other = docs.withColumn("lang", F.when(kept, F.lit("zz")).otherwise(F.col("lang")))
    one = gru.fit(docs, 20)
    for rows in (other, docs.unionByName(docs.filter("doc_id < 40")).repartition(5, "text")):
        two = gru.fit(rows, 20)
        assert one.languages == two.languages and all((one.weights[k] == two.weights[k]).all() for k in one.weights)
    many = docs.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 40))
    assert gru.fit(many, 2).languages == sorted(r.lang for r in many.filter(~kept & (F.col("text") != "")).select("lang").distinct().collect())


def test_letters():
    assert [gru.has_letter(t) for t in ("", "½ ² ① 12 _", "½a", "é", "漢", "٣", "ª")] == [False, False, True, True, True, False, True]
