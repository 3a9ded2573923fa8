"""Shared grams of all items and all documents against brute force."""

import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa

from gristmill.operators import overlap
from gristmill.plans import catalog

SF = "/root/testdata/sf0.001"


def grams(text, n):
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def six(a, b):
    return float((Decimal(a) / Decimal(b)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def nearest(items, docs, n, k):
    out = set()
    docs = [(d, grams(t or "", n)) for d, t in docs]
    for item, text in items:
        x = grams(text or "", n)
        best = sorted((-six(len(x & y), len(x | y)), d) for d, y in docs if x & y)[:k]
        out |= {(item, d, -s) for s, d in best}
    return out


def tables(spark, pattern):
    items = [(r.item_id, re.sub(pattern, "", r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    return items, [(r.doc_id, re.sub(pattern, "", r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_items_meet_all_documents(spark):
    """Documents and items far from each other's numbers, null and short texts, ties, blocks of two."""
    items = [(i, t) for i, t in enumerate(["abcdef", "한국어법률", "zz", None, "xyzxyz"] * 20)]
    docs = [(1000 + 7 * j, t) for j, t in enumerate(["abcdxx", "abcxyz", "국어법 률", "", None, "qqqq", "xyzx"] * 3)]
    i, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in overlap.nearest_by_jaccard(i, d, 3, 3).collect()} == nearest(items, docs, 3, 3)
    found = {(r.item_id, r.doc_id): (r.common, r.item_grams, r.doc_grams) for r in overlap.shared_grams(i, d, 3, item_block=2, doc_block=2).collect()}
    sets = [{k: grams(t or "", 3) for k, t in rows} for rows in (items, docs)]
    assert found == {(a, b): (len(x & y), len(x), len(y)) for a, x in sets[0].items() for b, y in sets[1].items() if x & y}


def test_queries_see_every_item(spark):
    items, docs = tables(spark, r"\s")
    found = {tuple(r) for r in catalog.QUERIES["gram_neighbours"](spark, SF).collect()}
    assert found == nearest(items, docs, 3, 3)
    assert {i for i, _, _ in found} == {i for i, _ in items}
    items, docs = tables(spark, r"[\W_]")
    sets = [{k: grams(t, 2) for k, t in rows} for rows in (items, docs)]
    assert {tuple(r) for r in catalog.QUERIES["gram_coverage"](spark, SF).collect()} == {(a, b, six(len(x & y), len(x))) for a, x in sets[0].items() for b, y in sets[1].items() if x & y}


def texts(seed, n, words):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def vocabulary(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def test_similar_pairs_and_nearest_of_text_keys(spark):
    words = vocabulary(1, 300)
    docs = [(f"d{i:03}", t) for i, t in enumerate(texts(2, 300, words))]
    rng = random.Random(3)
    items = [(f"i{i}", t[rng.randint(0, 20) :]) for i, (_, t) in enumerate(docs[:60])] + [("none", None), ("short", "ab")]
    i, d = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(docs, "doc_id string, text string").repartition(3)
    sets = [{k: grams(t or "", 3) for k, t in rows} for rows in (items, docs)]
    pairs = {(a, b, six(len(x & y), len(x | y))) for a, x in sets[0].items() for b, y in sets[1].items() if x & y}
    for least in (0.05, 0.3, 0.8):
        assert {tuple(r) for r in overlap.similar_sets(i, d, 3, least).collect()} == {p for p in pairs if p[2] >= least}
    for k in (1, 4):
        assert {tuple(r) for r in overlap.nearest_by_jaccard(i, d, 3, k).collect()} == nearest(items, docs, 3, k)


def test_candidates_follow_matches(monkeypatch):
    """Of many documents that share frequent grams with every item only those that may be similar are compared in full."""
    words = vocabulary(5, 5000)
    docs = texts(6, 3000, words)
    items = docs[:50]
    index = overlap.GramIndex(pa.array(range(50)), items, 3, least=500_000)
    for first in range(0, len(docs), overlap.CHUNK):
        index.add(pa.array(range(first, min(first + overlap.CHUNK, len(docs)))), docs[first : first + overlap.CHUNK])
    some = {(a, b) for a, b in zip(index.rows().column("item_id").to_pylist(), index.rows().column("doc_id").to_pylist(), strict=True)}
    sets = [grams(t, 3) for t in docs]
    assert some == {(a, b) for a in range(50) for b in range(3000) if sets[a] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    shared = sum(bool(sets[a] & sets[b]) for a in range(50) for b in range(3000))
    assert index.candidates < shared / 5


def test_overlap_of_pairs(spark):
    rows = [(1, "x", "abcd", "bcde"), (2, "y", "", "abc"), (3, "z", None, None), (4, "w", "abab", "ab")]
    found = overlap.pair_overlap(spark.createDataFrame(rows, "qid long, id string, a string, b string"), 2)
    assert {tuple(r) for r in found.collect()} == {(1, "x", 0.666667), (2, "y", 0.0), (3, "z", 0.0), (4, "w", 0.5)}


def test_query_overlap_takes_every_item_with_every_document(spark):
    sides = []
    for table, key in (("benchmark", "item_id"), ("documents", "doc_id")):
        texts = spark.read.parquet(f"{SF}/{table}.parquet").select(key, "text").collect()
        sides.append({r[0]: grams("".join(c for c in r.text or "" if c.isalnum()), 2) for r in texts})
    found = {(r["item_id"], r["doc_id"]): r["overlap"] for r in catalog.QUERIES["query_overlap"](spark, SF).collect()}
    pairs = {(a, b) for a, x in sides[0].items() for b, y in sides[1].items() if x & y}
    assert len(sides[0]) > 1 and found.keys() == pairs
    assert all(found[a, b] == six(len(sides[0][a] & sides[1][b]), len(sides[0][a])) for a, b in pairs)
