import hashlib
import re

from gristmill.llm import queries
from gristmill.llm.substring_dedup import substring_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def brute(rows, window=13):
    """The same by definition: every window of every document, against all documents with smaller ids."""
    parts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    lowest = {}
    for i, w in parts:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            lowest[key] = min(lowest.get(key, i), i)
    out = []
    for i, w in parts:
        gone = set()
        for k in range(len(w) - window + 1):
            if lowest[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_query_agrees_with_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF).select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op7_substring_dedup(spark, SF).collect())) == brute(rows)


def test_small_cases_over_many_blocks(spark):
    a = " ".join(f"a{i}" for i in range(30))
    b = " ".join(f"b{i}" for i in range(20))
    rows = [(5, a), (3, f"x {a}\ty"), (9, f"{b}\n{a[:60]}"), (1, b), (7, None), (8, ""), (2, "one two"), (11, f"{a} {b}"), (12, b + " "), (13, "é" * 50 + " " + a)]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], SCHEMA + ", block string, bucket int")
    for block_bytes in (64, 1 << 20):
        found = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup(df, block_bytes=block_bytes).collect())
        assert found == brute(rows)


def test_rows_of_one_id_are_one_document_and_null_ids_come_first(spark):
    a = " ".join(f"a{i}" for i in range(15))
    df = spark.createDataFrame([(4, a), (4, a), (None, a)], SCHEMA)
    found = sorted(((r.doc_id, r.n_removed) for r in substring_dedup(df).collect()), key=str)
    assert found == [(4, 15), (4, 15), (None, 0)]


def test_factors_name_their_source(spark):
    a = " ".join(f"a{i}" for i in range(20))
    df = spark.createDataFrame([(1, a), (2, f"{a} end")], SCHEMA)
    spans = {r.doc_id: r.spans for r in substring_dedup(df).collect()}
    assert spans[1] == [] and [(s.first, s.words) for s in spans[2]] == [(0, 20)]


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
