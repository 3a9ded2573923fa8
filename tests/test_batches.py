"""Batches of one law: length, share, fill, no text twice; and the numbering in a total order that they rest on."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gristmill.operators import batches as B
from gristmill.operators import order as O


def _questions(spark, per_law, same_text=0):
    rows = [(f"{law}-{i}", law, f"q {law} {i}", "the same answer" if i < same_text else f"p {law} {i}", f"n {law} {i}") for law, n in per_law.items() for i in range(n)]
    return spark.createDataFrame(rows, "qid string, law string, anchor string, positive string, negative string")


TEXTS = ["anchor", "positive", "negative"]


def _check(questions, found, batch, same, dropped=0):
    """Every batch has no text twice and is full but for the last or where rows were left out."""
    texts = {r.qid: [r[c] for c in TEXTS if r[c] is not None] for r in questions.collect()}
    rows = found.collect()
    assert len({r.qid for r in rows}) == len(rows) == len(texts) - dropped
    by_batch = {}
    for r in rows:
        by_batch.setdefault(r.batch_no, []).append(r)
    assert set(by_batch) <= set(range(-(-len(texts) // batch)))
    for members in by_batch.values():
        assert len(members) <= batch
        seen = [t for r in members for t in set(texts[r.qid])]
        assert len(seen) == len(set(seen))
        own = [r.law for r in members if r.part == "same"]
        assert len(set(own)) <= 1 and len(own) <= same
    return by_batch


def test_all_of_one_law(spark):
    q = _questions(spark, {"a": 40, "b": 40})
    found = _check(q, B.law_batches(q, 8, 1.0, TEXTS, seed=1), 8, 8)
    assert sorted(map(len, found.values())) == [8] * 10
    assert all(len({r.law for r in rows}) == 1 for rows in found.values())


@pytest.mark.parametrize("ratio, same", [(0.5, 4), (0.01, 1)])
def test_share_of_one_law_and_fill(spark, ratio, same):
    q = _questions(spark, {"a": 160, "b": 80, "c": 40, "d": 8})
    found = _check(q, B.law_batches(q, 8, ratio, TEXTS, seed=2), 8, same)
    assert len(found) == 36 and set(map(len, found.values())) == {8}
    own = [Counter(r.law for r in rows if r.part == "same") for rows in found.values()]
    assert all(sum(c.values()) == same for c in own)
    assert Counter(law for c in own for law in c) == Counter(a=20, b=10, c=5, d=1)


def test_texts_that_repeat(spark):
    q = _questions(spark, {"a": 64, "b": 64}, same_text=5)
    _check(q, B.law_batches(q, 8, 0.5, TEXTS, seed=3), 8, 4)


def test_a_text_that_no_batch_has_room_for(spark):
    q = _questions(spark, {"a": 30, "b": 30}, same_text=15)  # 30 rows with it, 8 batches
    found = B.law_batches(q, 8, 0.5, TEXTS, seed=3)
    by_batch = _check(q, found, 8, 4, dropped=22)
    assert len(by_batch) == 8
    got = B.batch_statistics(found).first()
    assert (got.batches, got.rows) == (8, 38)


def test_without_a_law(spark):
    q = _questions(spark, {"a": 50, "b": 7}, same_text=4)
    found = _check(q, B.law_batches(q, 8, 0, TEXTS), 8, 0)
    assert sorted(map(len, found.values())) == [1] + [8] * 7


def test_short_batches_dropped(spark):
    q = _questions(spark, {"a": 21})
    assert sorted(Counter(r.batch_no for r in B.law_batches(q, 8, 1.0, TEXTS, drop_last=True).collect()).values()) == [8, 8]


def test_seed_and_epoch(spark):
    q = _questions(spark, {"a": 20, "b": 20})
    first, again, next_ = (sorted(map(tuple, B.law_batches(q, 4, 1.0, TEXTS, seed=7, epoch=e).collect())) for e in (0, 0, 1))
    assert first == again != next_


def test_nulls_repeats_and_no_rows(spark):
    q = _questions(spark, {"a": 9}).union(spark.createDataFrame([("x", None, None, None, None)] * 3, "qid string, law string, anchor string, positive string, negative string"))
    assert Counter(r.qid for r in B.law_batches(q, 4, 0.5, TEXTS).collect())["x"] == 3
    assert B.law_batches(q.limit(0), 4, 0.5, TEXTS).collect() == []
    with pytest.raises(ValueError, match="ratio"):
        B.law_batches(q, 4, 1.5, TEXTS)


def test_quotas_add_up(spark):
    q = _questions(spark, {f"law{i}": i for i in range(1, 40)})
    rows = B.batch_quotas(q, 97).collect()
    assert sum(r.quota for r in rows) == 97
    assert all(abs(r.quota - r.n * 97 / 780) < 1 for r in rows)


def test_order_over_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 40_000, 2).select(F.concat(F.lit("k"), F.col("id") * 7919 % 40_009).alias("key"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("grp"), (F.col("id") % 5).alias("size"))
        placed = O.ordinal(rows, "key")
        assert placed.select(F.spark_partition_id()).distinct().count() > 1
        got = sorted(map(tuple, placed.select("key", "n", "size", "grp").collect()))
        assert [n for _, n, _, _ in got] == list(range(20_000))
        sums = {r.key: r.before for r in O.running_sum(rows, F.col("size"), "key").collect()}
        before, seen, within = 0, Counter(), {r.key: r.n for r in O.ordinal_within(rows, "grp", "key").collect()}
        for key, _, size, grp in got:
            assert (sums[key], within[key]) == (before, seen[grp])
            before += size
            seen[grp] += 1
        equal = O.ordinal(rows.select(F.lit(None).cast("int").alias("same")), "same").collect()
        assert sorted(r.n for r in equal) == list(range(20_000))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_digest_of_a_sequence(spark):
    rows = spark.range(5000).withColumn("line", F.concat(F.lit("line "), F.col("id")))
    digest = lambda df, *by, fan=16: O.sequence_digest(df, F.col("line"), *by, fan=fan)
    whole = digest(rows, "id")
    assert whole == digest(rows.repartition(7), "id") == digest(rows.orderBy(F.desc("id")), "id")
    assert whole != digest(rows, F.desc("id"))
    assert whole != digest(rows.withColumn("line", F.when(F.col("id") == 4999, "other").otherwise(F.col("line"))), "id")
    assert len(digest(rows.limit(0), "id")) == 64
