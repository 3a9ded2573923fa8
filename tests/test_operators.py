import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import chunking, judge, stats, store, training, vector


def test_metrics_of_ranks(spark):
    df = spark.createDataFrame([(1,), (3,), (None,), (7,), (12,)], "rank int").select(*judge.metrics(F.col("rank")))
    r = df.agg(*[F.avg(m).alias(m) for m in judge.METRICS]).first()
    assert r.r5 == pytest.approx(0.4) and r.mrr10 == pytest.approx(0.2952, abs=1e-3) and r.ndcg10 == pytest.approx(0.3667, abs=1e-3)


def _eval(spark, alternatives=(), partial=()):
    docs = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "id long, embedding array<float>")
    asked = spark.createDataFrame([(11, [0.1, 0.9, 0.5, 0.0]), (12, [0.0, 0.0, 0.9, 0.4])], "qid long, embedding array<float>")
    ranked = vector.batch_knn(asked, docs, 4)
    pairs = lambda x: spark.createDataFrame(list(x), "qid long, id long")
    keys = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B"), (3, "C")], "id long, key string")
    out = judge.per_question(ranked, pairs([(11, 0), (12, 3)]), pairs(alternatives), pairs([(12, 2)]), pairs(partial), keys)
    return {r.qid: r for r in out.collect()}


def test_judgements(spark):
    found = _eval(spark)
    assert [(found[q].doc_rank, found[q].article_rank) for q in (11, 12)] == [(3, 1), (1, 1)]
    assert _eval(spark, [(11, 2)])[11].multi_rank == 2
    assert _eval(spark, [(11, 2)], [(11, 1)])[11].multi_rank == 1 and _eval(spark, [(11, 2)], [(11, 1)])[11].doc_rank == 3


def test_paired_runs(spark):
    base = [(i, 1 if i < 10 else None) for i in range(20)]
    other = [(i, 1 if i < 16 else None) for i in range(20)]
    a, b = (spark.createDataFrame(x, "qid long, doc_rank int") for x in (base, other))
    r = stats.paired_summary(judge.compare(a, b)).first()
    assert (r.base, r.other, r.delta, r.fixed, r.broken) == (0.5, 0.8, 0.3, 6, 0) and r.mcnemar_p == pytest.approx(2 / 2**6, abs=1e-6)
    low, high = stats.bootstrap_interval(judge.compare(a, b), 400).first()
    assert 0.05 < low < 0.3 < high < 0.6
    with pytest.raises(ValueError):
        judge.compare(a, b.filter("qid > 3"))


def test_mcnemar_of_many_and_none(spark):
    df = spark.createDataFrame([(0, 0), (448, 77), (3000, 2900), (1, 0)], "f long, b long").select("f", "b", stats.mcnemar(F.col("f"), F.col("b")).alias("p"))
    for r in df.collect():
        m = r.f + r.b
        exact = min(1.0, float(2 * sum(math.comb(m, i) for i in range(min(r.f, r.b) + 1)) / 2**m)) if m else 1.0
        assert r.p == pytest.approx(exact, rel=1e-6, abs=1e-12)


def test_predicates(spark):
    df = spark.createDataFrame([("a", "tax", "2030-01-01"), ("b", "tax", None), ("c", "youth", "2020-01-01")], "id string, theme string, effective_date string")
    ids = lambda where: sorted(r.id for r in df.filter(vector.predicate(where)).collect())
    assert ids({"theme": "tax"}) == ["a", "b"] and ids({"effective_date": ("<=", "2026-09-29")}) == ["b", "c"] and ids({"theme": ["youth", "x"]}) == ["c"] and ids(None) == ["a", "b", "c"]
    for bad in ({"other": 1}, {"theme": []}, {"theme": ("~", 1)}):
        with pytest.raises(ValueError):
            vector.predicate(bad)


def test_quantized_scores_are_near(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(40, 64)))]
    df = spark.createDataFrame([*rows, (99, [0.0] * 64)], "id long, v array<double>").select("id", "v", vector.quantize(F.col("v")).alias("q"))
    for r in df.collect():
        back = np.array(r.q.codes) * r.q.scale
        assert np.abs(back - np.array(r.v)).max() < 0.01 and (r.id != 99 or r.q.scale == 1.0)


def test_batch_knn_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<float>")
    found = vector.batch_knn(df.withColumnRenamed("id", "qid"), df, 5, block=7).toPandas()
    scores = np.round(v.astype(float) @ v.astype(float).T, 6)
    np.fill_diagonal(scores, -np.inf)
    for q in range(60):
        expected = sorted(range(60), key=lambda i: (-scores[q, i], i))[:5]
        assert found[found.qid == q].sort_values("rank")["id"].tolist() == expected


def test_blocks_of_questions_and_rows_meet_over_many_partitions(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<float>")
    scores = np.round(v.astype(float) @ v.astype(float).T, 6)
    np.fill_diagonal(scores, -np.inf)
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    try:  # as with large blocks, which are not brought together into one partition
        for n, value in zip(names, ("false", "7"), strict=True):
            spark.conf.set(n, value)
        found = vector.batch_knn(df.withColumnRenamed("id", "qid"), df, 5, block=11).toPandas()
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.set(n, value)
    for q in range(90):
        assert found[found.qid == q].sort_values("rank")["id"].tolist() == sorted(range(90), key=lambda i: (-scores[q, i], i))[:5]


@pytest.mark.parametrize("cells", [vector._Best.CELLS, 64])
def test_the_best_rows_among_copies_and_odd_vectors(cells):
    rng = np.random.default_rng(3)
    v = np.tile(rng.normal(size=(30, 4)).astype(np.float32), (4, 1))  # every vector four times
    v[5], v[17] = np.nan, np.inf
    ids = rng.permutation(len(v))
    q = np.concatenate([v[:12], v[:1]])  # two queries of one id
    best = vector._Best(pa.array(np.concatenate([ids[:12], ids[:1]])), q, 6, True, 3)
    best.CELLS = cells
    for first in range(0, len(v), 50):
        best.add(pa.array(ids[first : first + 50]), v[first : first + 50])
    assert len(best.query) == 6 * 12  # none of the query that is no number
    for n in set(range(13)) - {5}:
        scores = {int(i): round(float(q[n].astype(float) @ x.astype(float)), 3) for i, x in zip(ids, v, strict=True) if np.isfinite(x).all() and i != ids[n % 12]}
        assert sorted(best.id.to_numpy()[best.query == n]) == sorted(sorted(scores, key=lambda i: (-scores[i], i))[:6])


@pytest.mark.parametrize("seed", range(3))
def test_splits_keep_laws_whole(spark, seed):
    rng = random.Random(seed)
    counts = spark.createDataFrame([(f"t{i % 4}", f"law{i}", rng.randrange(1, 30)) for i in range(30)], "theme string, law string, n long")
    rows = training.split_by_group(counts, seed=seed).collect()
    assert len(rows) == len({r.law for r in rows}) == 30 and {r.split for r in rows} == {"train", "dev", "test"}


def test_integrity_and_triplets(spark):
    corpus = spark.createDataFrame([(i,) for i in range(6)], "id long")
    asked = spark.createDataFrame([(1, 0, [1, 2, 9, 0, 2, 3], [3]), (2, 9, [1], None), (3, 4, None, None), (4, 5, [], [])], "qid long, positive_id long, negatives array<long>, related array<long>")
    found = {r.qid: (r.negatives, r.dropped) for r in training.filter_questions(asked, corpus).collect()}
    assert found == {1: ([1, 2], 4), 3: ([], 0), 4: ([], 0)}
    rows = training.triplets(training.filter_questions(asked, corpus), 3).orderBy("i").collect()
    assert [(r.qid, r.negative_id) for r in rows] == [(1, 1), (1, 2), (1, 1)]


def test_margins_of_a_batch(spark):
    m = [[0.9, 0.2, 0.5, 0.1], [0.3, 0.4, 0.2, 0.6]]
    df = spark.createDataFrame([(0, i, j, s) for i, r in enumerate(m) for j, s in enumerate(r)], "batch int, i int, j int, score double")
    r = training.in_batch_loss(df).first()
    expected = np.mean([np.log(np.exp(20 * np.array(x)).sum()) - 20 * x[i] for i, x in enumerate(m)])
    assert r.margin == pytest.approx(-0.2) and r.loss == pytest.approx(expected)


def test_text_functions(spark):
    df = spark.createDataFrame([("주휴 알바", "주휴일", "see [1, 2] and [3] or [x]")], "a string, b string, c string")
    r = df.select(
        T.containment(T.grams(T.squeeze_for_grams(F.col("a")), 2), T.grams(T.squeeze_for_grams(F.col("b")), 2)).alias("o"),
        T.citations(F.col("c")).alias("n"),
        T.snippet(F.repeat("a", 60)).alias("s"),
        T.paragraph_number(F.lit("③")).alias("p3"),
        T.paragraph_number(F.lit("㉑")).alias("p21"),
        T.paragraph_number(F.lit("<7>")).alias("p7"),
        T.context_header(F.lit("L"), F.lit(""), F.lit("t"), F.lit("x")).alias("h"),
        T.model_input("gemma", F.lit(""), F.lit("x")).alias("m"),
    ).first()
    assert r.o == pytest.approx(1 / 3) and r.n == [1, 2, 3] and len(r.s) == 120 and (r.p3, r.p21, r.p7) == (3, 21, 7)
    assert r.h == "[L] t\nx" and r.m == "title: none | text: x"


LAW = """---
제목: 시험법
공포일자: 2020-01-01
시행일자: '2021-01-01'
---
# 시험법

## 제1장 총칙

##### 제1조 (목적)

① **이 법**은 시험을 목적으로 한다. <개정 2020. 1. 1.>

② 삭제 <2019. 1. 1.>
1\\. 첫째

##### 제2조 (삭제)

삭제

## 제2장 보칙

##### 제3조의2 (벌칙)

내용이다.

## 부칙

##### 제1조 (시행일)

없다.
"""


def test_statutes_and_pieces(spark):
    files = spark.createDataFrame([("a.md", LAW)], "path string, value string")
    rows = chunking.parse_statutes(files).orderBy("pos").collect()
    assert [(r.law_name, r.chapter, r.article_no, r.article_title, r.effective_date) for r in rows] == [("시험법", "제1장 총칙", "제1조", "목적", "2021-01-01"), ("시험법", "제1장 총칙", "제2조", "삭제", "2021-01-01"), ("시험법", "제2장 보칙", "제3조의2", "벌칙", "2021-01-01")]
    assert rows[0].text.startswith("① 이 법은 시험을 목적으로 한다.") and "개정" not in rows[0].text and "1. 첫째" in rows[0].text
    long = "lead\n① " + "a" * 50 + "\n" + "b" * 60 + "\n② " + "c" * 10
    pieces = chunking.split_articles(spark.createDataFrame([("x", long), ("y", "short")], "id string, text string"), 80).orderBy("id").collect()
    assert [(p.id, p.parent_id, p.paragraph) for p in pieces] == [("x_제1항", "x", "제1항"), ("x_제2항", "x", "제2항"), ("y", "y", "")]
    assert "\n".join(p.text for p in pieces[:2]) == long


def test_store_and_versions(spark):
    log = spark.createDataFrame([("a", 1, 0, False, "n"), ("a", 2, 0, True, "n"), ("b", 1, 0, False, "n"), ("c", 1, 0, False, "gone")], "id string, ts int, seq int, deleted boolean, book string")
    books = spark.createDataFrame([("n",)], "id string")
    assert [r.id for r in store.current(log, parents=books, parent="book").collect()] == ["b"]
    files = spark.createDataFrame([("f", "1"), ("g", "2")], "name string, sha string")
    versions = spark.createDataFrame([("v10", "1"), ("v2", "1"), ("v3", "2")], "version string, sha string")
    assert {r.name: r.version for r in store.match_versions(files, versions).collect()} == {"f": "v2", "g": "v3"}
