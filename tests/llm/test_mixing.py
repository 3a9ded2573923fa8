import hashlib
import re
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from gristmill.llm import mixing as M
from gristmill.llm import queries

SCHEMA = "doc_id long, text string, source string"


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """Share out by weight, cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = budget - sum(capped.values())
        total = sum(w[s] for s in free)
        now = {s: left * w[s] / total for s in free}
        over = [s for s in free if now[s] > epochs * sizes[s]]
        if not over:
            return capped | now
        capped |= {s: epochs * sizes[s] for s in over}


def brute(rows, seed="mix"):
    sized = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, n, s in sized:
        sizes[s] += n
    targets = brute_targets(sizes)
    out = []
    for s in sizes:
        left = int(targets[s])
        taken = defaultdict(int)
        mine = sorted((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i, n) for i, n, x in sized if x == s)
        for _ in range(2):
            for _, i, n in mine:
                taken[i] += min(n, left)
                left -= min(n, left)
        out += [(i, n, sizes[s], targets[s], taken[i]) for _, i, n in mine]
    return sorted(out)


def check(found, expected):
    found = sorted(map(tuple, found))
    assert [r[:3] + r[4:] for r in found] == [r[:3] + r[4:] for r in expected]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in expected])


def test_query_agrees_with_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in queries.documents(spark, sf).select("doc_id", "text", "source").collect()]
    check(queries.op3_mix(spark, sf).collect(), brute(rows))


def test_uneven_sources_and_nulls(spark):
    rows = [(i, "w " * (i % 17), ["é", "z", "Z", "", None, "hot", "hot", "hot"][i % 8]) for i in range(400)] + [(1000, None, "z"), (1001, "", "void"), (1002, "w " * 3000, "big")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", size int, epoch string")
    expected = brute(rows)
    check(M.mix_report(M.mix(df)).collect(), expected)
    for i, n, size, target, taken in expected:
        assert taken <= 2 * n and target <= 2 * size + 1e-6


def test_documents_of_a_part_come_in_mix_order_with_their_columns(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(i % 9)), "ab"[i % 2], 5) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA + ", n_chars long")
    out = M.mixed_documents(df)
    assert out.dtypes == df.dtypes
    found = out.collect()
    expected = {r[0]: r[4] for r in brute([r[:3] for r in rows])}
    got = defaultdict(int)
    for r in found:
        got[r.doc_id] += len(r.text.split())
        assert rows[r.doc_id][1].startswith(r.text)
    assert dict(got) == {i: n for i, n in expected.items() if n}
    services = sorted(M.mix(df).collect(), key=lambda r: r.position)
    assert [r.finish_time for r in services] == sorted(r.finish_time for r in services)
    inside = [r for r in services if r.taken]
    assert [r.position for r in inside] == [sum(x.taken for x in inside[:i]) for i in range(len(inside))]
    assert sorted((r.doc_id, r.taken) for r in inside) == sorted((r.doc_id, len(r.text.split())) for r in found)
    place = {}
    for r in inside:
        place.setdefault((r.doc_id, r.taken), []).append(r.position)
    for part in M.mixed_documents(df.repartition(4)).rdd.glom().collect():
        first = [place[r.doc_id, len(r.text.split())][0] for r in part]
        assert first == sorted(first) or any(len(x) > 1 for x in place.values())


def test_equal_rows_and_null_ids_are_served(spark):
    rows = [(7, "a b c", "s")] * 3 + [(None, "d e", "s"), (None, "f g h", None)]
    out = M.mixed_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    words = sum(len(t.split()) for _, t, _ in rows)
    assert sum(len(r.text.split()) for r in out) == int(brute_targets({"s": 11, None: 3})["s"]) + int(brute_targets({"s": 11, None: 3})[None])
    assert words < sum(len(r.text.split()) for r in out) <= 1.5 * words


def test_empty_table_and_no_words(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.mix_report(M.mix(empty)).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a"), (2, " ", "a")], SCHEMA)
    assert sorted(map(tuple, M.mix_report(M.mix(blank)).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_rows_that_differ_in_a_map_alone_are_both_served(spark, tmp_path):
    rows = [(1, "a b c d", "s", {"k": "x"}, [{"m": 1}]), (1, "a b c d", "s", {"k": "y"}, [{"m": 1}]), (2, "e f", "t", None, [{"m": 2}, None]), (2, "e f", "t", None, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", row_key map<string,string>, row array<map<string,int>>")
    df.write.parquet(str(tmp_path / "docs"))
    for docs in (df, spark.read.parquet(str(tmp_path / "docs"))):
        out = M.mixed_documents(docs)
        assert out.dtypes == df.dtypes
        found = out.collect()
        whole = [r for r in found if len(r.text.split()) == len({1: "a b c d", 2: "e f"}[r.doc_id].split())]
        assert {str(r.row_key) for r in whole if r.doc_id == 1} == {"{'k': 'x'}", "{'k': 'y'}"}
        assert {str(r.row) for r in whole if r.doc_id == 2} == {"[{'m': 2}, None]", "None"}


def test_rows_made_of_one_row_of_a_table_are_told_apart(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "s"), (2, "c d e", "s")], SCHEMA).write.parquet(str(tmp_path / "docs"))
    table = spark.read.parquet(str(tmp_path / "docs"))
    assert M._is_table(table.filter("doc_id > 0").select("doc_id", "text", "source"))
    twice = table.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert not M._is_table(twice) and not M._is_table(table.union(table)) and not M._is_table(table.filter(F.rand() < 2))
    assert sum(len(r.text.split()) for r in M.mixed_documents(twice).collect()) == 15
