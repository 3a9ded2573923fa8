import os

import pytest
from pyspark.sql import functions as F

from gristmill.sources.cache import EXPANSION, Cache, expand_queries, search_text

SCHEMA = "key string, value long"


def rows(cache):
    return sorted(map(tuple, cache.read().collect()))


def test_keys_occur_once(spark, tmp_path):
    cache = Cache(spark, f"file://{tmp_path}/cache", SCHEMA, ["key"])
    assert rows(cache) == []
    first = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), (None, 3)], SCHEMA)
    cache.append(first)
    assert rows(cache) == [("a", 1), ("b", 2)]
    cache.append(first)  # a repeated batch adds nothing
    cache.append(spark.createDataFrame([("a", 100), ("c", 4)], SCHEMA))
    assert rows(cache) == [("a", 1), ("b", 2), ("c", 4)]
    cache.compact()
    assert rows(cache) == [("a", 1), ("b", 2), ("c", 4)]
    assert len(os.listdir(tmp_path / "cache")) == 1
    cache.append(spark.createDataFrame([("b", 7), ("d", 5)], SCHEMA))
    assert rows(cache) == [("a", 1), ("b", 2), ("c", 4), ("d", 5)]


def test_unfinished_batches_and_two_writers(spark, tmp_path):
    cache = Cache(spark, f"file://{tmp_path}/cache", SCHEMA, ["key"])
    cache.append(spark.createDataFrame([("a", 1)], SCHEMA))
    killed = tmp_path / "cache" / cache._name("part")
    spark.createDataFrame([("x", 9)], SCHEMA).write.parquet(str(killed))
    os.remove(killed / "_SUCCESS")
    assert rows(cache) == [("a", 1)]
    spark.createDataFrame([("a", 2), ("e", 3)], SCHEMA).write.parquet(str(tmp_path / "cache" / cache._name("part")))  # written by another at the same time
    assert rows(cache) == [("a", 1), ("e", 3)]
    cache.compact()
    assert rows(cache) == [("a", 1), ("e", 3)]


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    cache = Cache(spark, f"file://{tmp_path}/cache", EXPANSION, ["llm", "query"])
    asked = spark.createDataFrame([("q1",), ("bad",)], "query string")

    def generate(query):
        if query == "bad":
            raise RuntimeError("no answer")
        return query, 1, 1

    with pytest.raises(Exception, match="no answer"):
        expand_queries(asked, cache, generate, "m")
    assert cache.read().count() == 0


def test_questions_are_asked_once_and_keep_their_order(spark, tmp_path):
    cache = Cache(spark, f"file://{tmp_path}/cache", EXPANSION, ["llm", "query"])
    log = tmp_path / "asked"
    log.mkdir()

    def generate(query):
        path = log / query
        path.write_text(path.read_text() + "+" if path.exists() else "+")
        return f"  more \n about {query} ", len(query), 2

    asked = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), (None, 3)], "query string, n long").repartition(3)
    found = expand_queries(asked, cache, generate, "m1", order_col="n").orderBy("n").collect()
    assert [(r.n, r.query, r.expansion, r.llm, r.input_tokens) for r in found] == [(0, "b", "more about b", "m1", 1), (1, "a", "more about a", "m1", 1)]
    more = asked.union(spark.createDataFrame([("c", 9)], asked.schema))
    found = expand_queries(more, cache, generate, "m1", order_col="n").orderBy("n")
    assert [r.query for r in found.collect()] == ["b", "a", "c"]
    assert {p.name: p.read_text() for p in log.iterdir()} == {"a": "+", "b": "+", "c": "+"}
    assert expand_queries(asked, cache, generate, "m2").count() == 2
    assert (log / "a").read_text() == "++"
    assert found.select(search_text(F.col("query"), F.col("expansion")).alias("t")).first().t == "b more about b"
