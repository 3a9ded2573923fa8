import zlib

import numpy as np
import pyarrow as pa

from gristmill.llm import quality as Q
from gristmill.llm import queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = {r.doc_id: r for r in queries.op6_quality(spark, SF).collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    test = [i for i in truth if found[i].held_out]
    assert np.mean([found[i].predicted == truth[i] for i in test]) > 0.95
    high, low = ([found[i].score for i in test if truth[i] == q] for q in (1, 0))
    assert np.mean([h > x for h in high for x in low]) > 0.98


def test_nothing_is_learned_from_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = (Q.fit(docs, x) for x in (labels, turned))
    assert all(np.array_equal(x, y) for x, y in zip(a.parts, b.parts, strict=True))


def test_statistics_by_hand():
    x = dict(zip(Q.NAMES, Q.features(pa.array(["Ab AB!! x\nx", None, ""]))[0].tolist(), strict=True))
    assert x["log_words"] == np.float32(np.log1p(4)) and x["log_lines"] == np.float32(np.log1p(2))
    assert x["distinct_words"] == 0.75 and x["upper_words"] == 0.0 and x["mark_end_words"] == 0.25
    assert not Q.features(pa.array([None, ""], pa.string())).any()


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "text", 0.5), (2, "", 0.5), (3, "word " * 50_000, 0.5), (3, "word", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.fit(docs, none)
    assert model == 0.8
    assert Q.score(docs, model).count() == 5
    some = spark.createDataFrame([(i, 1) for i in range(6)] + [(3, None)], "doc_id long, quality int")
    assert Q.score(docs, Q.fit(docs, some)).count() == 5
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert Q.score(empty, Q.fit(empty, some)).collect() == []


def plain_network(positive, unlabelled, prior, hidden, epochs, batch, rate, decay, seed):
    """The training again, on lists, one example after the other, with losses by definition."""
    import math

    rng, d = np.random.default_rng(seed), len(positive[0])
    both = positive + unlabelled
    centre = [sum(r[j] for r in both) / len(both) for j in range(d)]
    scale = [math.sqrt(sum((r[j] - centre[j]) ** 2 for r in both) / len(both)) + 1e-3 for j in range(d)]
    cut = lambda v: max(-6.0, min(6.0, v))
    std = lambda rows: [[cut((r[j] - centre[j]) / scale[j]) for j in range(d)] for r in rows]
    x_p, x_u = std(positive), std(unlabelled)
    w1 = rng.normal(0, 1 / np.sqrt(d), (d, hidden)).tolist()
    b1 = [0.0] * hidden
    w2 = rng.normal(0, 1 / np.sqrt(hidden), hidden).tolist()
    b2 = 0.0
    flat = lambda w1, b1, w2, b2: [v for r in w1 for v in r] + b1 + w2 + [b2]
    m, v, step = [0.0] * len(flat(w1, b1, w2, b2)), [0.0] * len(flat(w1, b1, w2, b2)), 0
    for _ in range(epochs):
        order_u, order_p = rng.permutation(len(x_u)).tolist(), rng.permutation(len(x_p)).tolist()
        for k in range(max(1, -(-len(x_u) // batch))):
            us = [x_u[i] for i in order_u[k * batch : (k + 1) * batch]]
            ps = [x_p[order_p[i % len(x_p)]] for i in range(k * batch, k * batch + min(batch, len(x_p)))]
            g1, gb1, g2, gb2 = [[0.0] * hidden for _ in range(d)], [0.0] * hidden, [0.0] * hidden, 0.0
            out = []
            for x in ps + us:
                h = [math.tanh(sum(x[j] * w1[j][i] for j in range(d)) + b1[i]) for i in range(hidden)]
                out.append((x, h, sum(h[i] * w2[i] for i in range(hidden)) + b2))
            minus = [math.log1p(math.exp(-abs(z))) + max(z, 0) for _, _, z in out]
            part = sum(minus[len(ps) :]) / len(us) - prior * sum(minus[: len(ps)]) / len(ps)
            for n, (x, h, z) in enumerate(out):
                s = 1 / (1 + math.exp(-z))
                if n < len(ps):
                    g = -prior * s / len(ps) if part >= 0 else prior * s / len(ps)
                    g += prior * (s - 1) / len(ps) if part >= 0 else 0
                else:
                    g = s / len(us) if part >= 0 else -s / len(us)
                gb2 += g
                for i in range(hidden):
                    g2[i] += g * h[i]
                    back = g * w2[i] * (1 - h[i] ** 2)
                    gb1[i] += back
                    for j in range(d):
                        g1[j][i] += back * x[j]
            for i in range(hidden):
                g2[i] += decay * w2[i]
                for j in range(d):
                    g1[j][i] += decay * w1[j][i]
            step += 1
            new = flat(w1, b1, w2, b2)
            for n, grad in enumerate(flat(g1, gb1, g2, gb2)):
                m[n], v[n] = 0.9 * m[n] + 0.1 * grad, 0.999 * v[n] + 0.001 * grad * grad
                new[n] -= rate * (m[n] / (1 - 0.9**step)) / (math.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
            w1 = [new[j * hidden : (j + 1) * hidden] for j in range(d)]
            b1, w2, b2 = new[d * hidden : (d + 1) * hidden], new[(d + 1) * hidden : (d + 2) * hidden], new[-1]
    return lambda r: sum(math.tanh(sum(cut((r[j] - centre[j]) / scale[j]) * w1[j][i] for j in range(d)) + b1[i]) * w2[i] for i in range(hidden)) + b2


def test_training_is_that_of_plain_lists():
    rng = np.random.default_rng(3)
    for prior in (0.3, 0.9):  # with the larger prior the part in the maximum turns negative
        positive, unlabelled = rng.normal(1, 1, (9, 4)), np.concatenate([rng.normal(1, 1, (8, 4)), rng.normal(-1, 1, (13, 4))])
        made = dict(hidden=3, epochs=12, batch=8, rate=0.05, decay=1e-3, seed=5)
        net = Q.train(positive, unlabelled, prior, **made)
        plain = plain_network(positive.tolist(), unlabelled.tolist(), prior, **made)
        assert np.allclose(net.logits(unlabelled), [plain(r) for r in unlabelled.tolist()], atol=1e-6)


def test_query_agrees_with_scores_one_by_one(spark):
    """The query's scores against the network applied to each text alone, on a sample drawn again by hand."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    marks = {r.doc_id: r.quality for r in labels.collect() if not held(r.doc_id)}
    row = lambda i: Q.features(pa.array([texts[i]], pa.string()))[0]
    pick = lambda f: sorted((row(i) for i in texts if f(i)), key=lambda x: x.tolist())
    prior = min(0.95, max(0.05, (sum(marks.values()) + 0.8) / (len(marks) + 1)))
    labelled = {r.doc_id for r in labels.collect()}
    positive, negative, free = (pick(f) for f in (lambda i: marks.get(i) == 1, lambda i: marks.get(i) == 0, lambda i: i not in labelled and not held(i)))
    net = Q.calibrate(Q.train(np.array(positive), np.array(free), prior), np.array(negative + positive), np.array([0] * len(negative) + [1] * len(positive)))
    found = {r.doc_id: r for r in queries.op6_quality(spark, SF).collect()}
    assert found.keys() == texts.keys()
    assert all(abs(found[i].score - net.scores(row(i)[None, :])[0]) < 1e-6 for i in texts)


def test_accepted_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "text", 0.5), (3, "word", 0.5), (3, "word", 0.5)], "doc_id long, text string, score double")
    assert Q.keep_accepted(docs, 0.8).count() == 4 and Q.keep_accepted(docs, 0.1).count() == 0
    assert Q.keep_accepted(docs.limit(0), 0.8).collect() == [] and Q.keep_accepted(docs, 0.8).columns == docs.columns
