"""Ids as text, the type of the readers' own schemas, in every operator of training rows and search."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import store, training, vector
from gristmill.sources import files

QUESTIONS = "qid string, positive_id string, related array<string>, negatives array<string>"


def _corpus(spark, ids):
    return spark.createDataFrame([(i, f"text of {i}") for i in ids], "id string, text string")


def test_integrity(spark):
    asked = spark.createDataFrame([("q1", "a", ["r"], ["b", "r", "a", "gone", "b", "c"]), ("q2", "gone", None, ["b"]), ("q3", "b", None, None)], QUESTIONS)
    found = training.filter_questions(asked, _corpus(spark, ["a", "b", "c", "r"]))
    assert sorted(map(tuple, found.collect())) == [("q1", "a", ["b", "c"], 4), ("q3", "b", [], 0)]
    assert tuple(training.integrity_counts(asked, found).first()) == (1, 4)


def test_heldout_negatives(spark):
    train = spark.createDataFrame([("q1", ["a1", "b1", "c1"]), ("q2", ["a2"]), ("q3", []), ("q4", None)], "qid string, negatives array<string>")
    keys = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("b1", "b"), ("c1", "c")], "id string, key string")
    held = spark.createDataFrame([("a2",)], "positive_id string")
    found = training.drop_heldout_negatives(train, held, keys)
    assert sorted(map(tuple, found.collect())) == [("q1", ["b1", "c1"], 1), ("q2", [], 1), ("q3", [], 0), ("q4", [], 0)]
    assert tuple(training.heldout_counts(found).first()) == (4, 2, 1)
    for bad_train, bad_held in ((train.limit(0).union(spark.createDataFrame([("q", ["zz"])], train.schema)), held), (train, spark.createDataFrame([("zz",)], held.schema))):
        with pytest.raises(ValueError, match="zz"):
            training.drop_heldout_negatives(bad_train, bad_held, keys)


def test_triplets_negatives_and_replacement(spark):
    asked = spark.createDataFrame([("q1", "p1", ["x", "y"]), ("q2", "p2", [])], "qid string, positive_id string, negatives array<string>")
    assert [(r.qid, r.negative_id) for r in training.triplets(asked, 3).orderBy("i").collect()] == [("q1", "x"), ("q1", "y"), ("q1", "x")]
    candidates = spark.createDataFrame([("q1", "n1", 1, 0.97), ("q1", "n2", 2, 0.5), ("q1", "n3", 3, 0.96), ("q2", "n4", 12, 0.1)], "qid string, id string, rank int, ratio double")
    assert {(r.qid, r.n, r.id, r.reason) for r in training.pick_negatives(candidates, keep=2).collect()} == {("q1", 0, "n2", "top"), ("q1", 1, "n2", "repeat"), ("q2", 0, "n4", "fill"), ("q2", 1, "n4", "repeat")}
    verdicts = spark.createDataFrame([("q1", "n1", "full"), ("q1", "n3", "no")], "qid string, id string, verdict string")
    mined = training.settle_negatives(candidates, verdicts)
    rows = {r.qid: r for r in mined.collect()}
    assert rows["q1"].negatives == ["n2", "n3", "n2"] and rows["q1"].alternatives == ["n1"]
    more = training.replace_negatives(asked.select("qid", "positive_id"), mined).collect()
    assert sorted((r.qid, r.n, r.positive_id) for r in more) == [("q1", 0, "p1"), ("q1", 1, "n1"), ("q2", 0, "p2")]
    assert {r.id for r in training.judge_input(candidates).collect()} == {"n1", "n3"}


@pytest.mark.parametrize("block", [4096, 7])
def test_search(spark, block):
    rng = np.random.default_rng(1)
    vectors = {f"v{i}": np.round(rng.normal(size=5), 1).tolist() for i in range(60)} | {"null": None}
    corpus = spark.createDataFrame(list(vectors.items()), "id string, embedding array<float>").repartition(5)
    asked = corpus.filter(F.col("id").isin("v3", "v11", "v12", "null") | (F.length("id") == 2)).withColumnRenamed("id", "qid")
    found = vector.batch_knn(asked, corpus, 6, block=block).collect()
    some = {i: np.float32(v).astype(float) for i, v in vectors.items() if v}
    for q in {r.qid for r in asked.collect()} - {"null"}:
        best = sorted((-round(float(some[q] @ v), 6), i) for i, v in some.items() if i != q)[:6]
        assert [(r.id, r.rank) for r in sorted((r for r in found if r.qid == q), key=lambda r: r.rank)] == [(i, n + 1) for n, (_, i) in enumerate(best)]
    assert len(found) == 6 * 12
    assert {r.id for r in vector.batch_knn(asked, corpus, 1, exclude_self=False, block=block).filter("qid = 'v3'").collect()} <= set(some)


def test_a_task_keeps_the_best_so_far(spark):
    import pyarrow as pa

    best = vector._Best(pa.array(["q"]), np.array([[1.0, 0.0]]), 2, False, 6)
    for first in range(0, 1000, 10):
        best.add(pa.array([f"{i:04}" for i in range(first, first + 10)]), np.array([[float(i // 3 % 7), 0.0] for i in range(first, first + 10)]))
        assert len(best.query) == 2
    assert best.rows().column("id").to_pylist() == ["0018", "0019"]


RECORDS = [("a", 1, {"query": "야간 \"수당\"\n", "ids": ["x", "y"], "score": 0.1, "none": None, "nested": {"b": [1, 2.5, None], "a": {"z": True}}}), ("a", 2, {"query": "é", "ids": [], "score": 1e22, "none": None, "nested": None}), ("b", 1, {"query": "", "ids": None, "score": -0.0, "none": None, "nested": {"b": [], "a": None}})]
RECORD = "folder string, n long, query string, ids array<string>, score double, none string, nested struct<b array<double>, a struct<z boolean>>"


def _rule(rows):
    return hashlib.sha256("\n".join(json.dumps(r, ensure_ascii=False, sort_keys=True) for r in rows).encode()).hexdigest()[:12]


def test_digests_of_questions_follow_the_rule(spark):
    def typed(folder, n, r):
        nested = r["nested"] and {"b": [None if x is None else float(x) for x in r["nested"]["b"]], "a": r["nested"]["a"]}
        return {"folder": folder, "n": n, **r, "nested": nested}

    rows = [typed(*r) for r in RECORDS]
    df = spark.createDataFrame(rows, RECORD).repartition(3)
    got = {r.folder: r.digest for r in store.questions_digest(df, ["folder"], "n").collect()}
    assert got == {f: _rule([r for r in rows if r["folder"] == f]) for f in "ab"}
    turned = store.questions_digest(df.withColumn("n", -F.col("n")), ["folder"], "n").filter("folder = 'a'").first().digest
    assert turned != got["a"]


def test_digests_of_raw_lines_leave_out_what_they_lack(spark):
    lines = [{"b": 1, "a": [None, 2.0, "é"]}, {"c": {"y": 1, "x": {}}}]
    df = spark.createDataFrame([("f", i, json.dumps(x)) for i, x in enumerate(lines)], "folder string, n int, raw string")
    assert store.questions_digest(df, ["folder"], "n", raw="raw").first().digest == _rule(lines)
    assert store.canonical_json(spark.createDataFrame([("{",), (None,)], "raw string"), raw="raw").filter("json is null").count() == 2


def test_a_long_list_is_streamed(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("g"), F.col("id").alias("n"), F.concat(F.lit("line "), F.col("id")).alias("line"))
    got = {r.g: r.sha for r in store.stream_digest(rows.repartition(8), ["g"], ["n"], F.col("line")).collect()}
    assert got == {g: hashlib.sha256("\n".join(f"line {i}" for i in range(g, 30_000, 3)).encode()).hexdigest() for g in range(3)}


def test_corpus_hash_knows_order_rows_and_columns(spark):
    docs = _corpus(spark, ["b", "a", "c"]).withColumn("line", F.monotonically_increasing_id())
    one = files.corpus_hash(docs, ["line"])
    assert one == files.corpus_hash(docs.repartition(3), ["line"])
    assert one != files.corpus_hash(docs, [F.desc("line")])
    plain = docs.drop("line")
    assert files.corpus_hash(plain) == files.corpus_hash(plain.orderBy("text").repartition(2)) != files.corpus_hash(plain.withColumn("text", F.lit(None).cast("string")))


def test_codes_and_parts_of_text_keys(spark):
    rows = spark.createDataFrame([("k3", "x"), ("k1", "y"), ("k2", None), ("k5", "y"), ("k4", None)], "key string, value string")
    assert {r.key: r.code for r in store.dictionary_codes(rows, "value", "key").collect()} == {"k1": 0, "k5": 0, "k2": 1, "k4": 1, "k3": 2}
    assert sorted((r.n, r.key) for r in training.every_nth(rows, "key", 2).collect()) == [(0, "k1"), (2, "k3"), (4, "k5")]


def test_names_like_others(spark):
    import difflib
    import random

    rng = random.Random(3)
    known = sorted({"".join(rng.choice("가나다라법령 시행규칙") for _ in range(rng.randint(1, 9))) for _ in range(400)}) + ["근로기준법", "근로기준법 시행령", "근로기준법 시행규칙"]
    asked = ["근로기준법", "근로기준", "근로기준볍", "법", "", "qq"] + ["".join(rng.choice("가나다라법령 시행규칙") for _ in range(5)) for _ in range(40)]
    got = {r.law: r.similar for r in store.suggest_names(spark.createDataFrame([(n,) for n in asked] + [(None,)], "law string"), spark.createDataFrame([(n,) for n in known] + [(None,)], "law string").repartition(4)).collect()}
    want = {}
    for name in set(asked) - set(known):
        similar = [n for n in known_sorted if name in n] if (known_sorted := sorted(set(known))) else []
        similar += difflib.get_close_matches(name, sorted(set(known)), n=3)
        want[name] = list(dict.fromkeys(similar[:5]))
    assert got == want


def test_articles_are_split_by_law(spark):
    import random

    rng = random.Random(5)
    rows = [(f"law{i % 7}" if i % 50 else None, f"law{i % 7}-{rng.randint(0, 5 + 10 * (i % 7))}") for i in range(3000)]
    found = training.split_by_article(spark.createDataFrame(rows, "law string, article string")).collect()
    assert sum(r.n for r in found) == 3000 and len({(r.law, r.article) for r in found}) == len(found)
    for law in {r.law for r in found}:
        own = [r for r in found if r.law == law]
        total, widest = sum(r.n for r in own), max(r.n for r in own)
        assert any(r.split == "train" for r in own)
        for split, share in (("test", 0.15), ("dev", 0.1)):
            assert abs(sum(r.n for r in own if r.split == split) - share * total) <= widest
    one = training.split_by_article(spark.createDataFrame([("a", "x")] * 5, "law string, article string")).collect()
    assert [r.split for r in one] == ["train"]
