import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import near_dedup as N
from gristmill.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def bag(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def jaccard_p(x, y):
    """The definition: sum over shared elements of 1 / sum of the larger relative weights."""
    out = 0.0
    keys = x.keys() | y.keys()
    for i in x.keys() & y.keys():
        out += 1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys)
    return out


def brute(rows, least=0.8):
    bags = {i: bag(t) for i, t in rows}
    seqs = defaultdict(list)
    for i, t in rows:
        seqs[tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))].append(i)
    up = {i: i for i in bags}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def join(a, b):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)

    for ids in seqs.values():
        for b in ids[1:]:
            join(ids[0], b)
    where = defaultdict(list)
    for i, x in bags.items():
        for s in x:
            where[s].append(i)
    for a, b in sorted({(a, b) for ids in where.values() for a in ids for b in ids if a < b}):
        if root(a) != root(b) and jaccard_p(bags[a], bags[b]) >= least:
            join(a, b)
    return {i: root(i) for i in bags}


def test_similarity_is_the_definition():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 3, 5, 8, 13, 30, 60)]
    pairs = [(a, b) for a in texts for b in texts]
    row, _, x, y = N.aligned(*(N.weighted_shingles(pa.array([p[t] for p in pairs]), 5) for t in (0, 1)))
    found = N.prob_jaccard(row, x, y, len(pairs))
    assert found == pytest.approx([jaccard_p(bag(a), bag(b)) for a, b in pairs])


def test_registers_agree_as_often_as_the_similarity():
    rng = random.Random(2)
    base = [str(rng.randrange(40)) for _ in range(300)]
    for edits in (3, 12, 40):
        other = list(base)
        for _ in range(edits):
            other[rng.randrange(300)] = "x"
        texts = pa.array([" ".join(base), " ".join(other)])
        s = N.prob_minhash(*N.weighted_shingles(texts, 2), 2, 4000)
        assert np.mean(s[0] == s[1]) == pytest.approx(jaccard_p(bag(texts[0].as_py(), 2), bag(texts[1].as_py(), 2)), abs=0.04)


def test_query_agrees_with_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF).select("doc_id", "text").collect()]
    found = {r.doc_id: r.class_id for r in queries.op2_near_dedup(spark, SF).collect()}
    assert found == brute(rows)


def test_groups_chains_ties_and_empty_texts(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows, i = [], 0
    for c in range(40):  # a large group of near copies, all different
        t = list(base)
        t[rng.randrange(200)] = f"z{c}"
        rows.append((i := i + 1, " ".join(t)))
    chain = [f"c{j}" for j in range(300)]
    for c in range(6):  # each is near to the next only
        rows.append((i := i + 1, " ".join(chain[c * 12 : c * 12 + 200])))
    rows += [(100, "one two"), (101, " one\ttwo "), (102, ""), (103, None), (104, "alone in the world of words here"), (100, "one two")]
    df = spark.createDataFrame([(a, t, 1, "k") for a, t in rows], SCHEMA + ", class_id int, key string")
    found = N.near_dedup(df).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.class_id for r in found} == brute(rows)
    assert {r.copy_id for r in found if r.doc_id in (100, 101)} == {100}


def test_links_that_the_leader_does_not_see(spark):
    """Families of near copies around members that are far from the leader, of many lengths."""
    rng = random.Random(5)
    rows, i = [], 0
    base = [f"w{j}" for j in range(120)]
    for family in range(3):
        own = list(base)
        for j in range(family * 9):
            own[rng.randrange(120)] = f"f{family}_{j}"
        for c in range(6):
            t = list(own)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(3)] = [f"e{family}_{c}_{x}" for x in range(rng.randrange(3))]
            rows.append((i := i + 1, " ".join(t)))
    rng.shuffle(rows)
    rows = [(j, t) for j, (_, t) in enumerate(rows)]
    found = {r.doc_id: r.class_id for r in N.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == brute(rows)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, "other words in this text")], SCHEMA)
    assert sorted(((r.doc_id, r.class_id) for r in N.near_dedup(df).collect()), key=str) == [(7, 7), (None, 7), (None, None)]
    assert N.near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_merged_labels_are_those_of_all_links(spark):
    rng = random.Random(5)
    draw = lambda n: list({tuple(sorted(rng.sample(range(60), 2))) for _ in range(n)})
    first, more = draw(25), draw(20)
    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    labels = N.components(frame(first))
    rows = {tuple(r) for r in N.merge_labels(labels, frame(more)).collect()}
    assert rows == {tuple(r) for r in N.components(frame(first + more)).collect()}
    assert {tuple(r) for r in N.merge_labels(labels, frame([])).collect()} == {tuple(r) for r in labels.collect()}
