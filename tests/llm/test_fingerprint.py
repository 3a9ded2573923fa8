import hashlib

import numpy as np

from gristmill.llm import fingerprint as P
from gristmill.llm import queries, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def counts_by_hand(raw):
    out = [0] * P.BUCKETS
    for k in range(len(raw)):
        for t, (i, j) in enumerate(P.TRIPLETS):
            if k >= max(i, j):
                h = (raw[k] * 0x9E3779B1 + raw[k - i] * 0x85EBCA77 + raw[k - j] * 0xC2B2AE3D + (t + 1) * 0x27D4EB2F) & 0xFFFFFFFF
                h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                out[h >> 25] += 1
    return out


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        a, b, c = P._digests_of([t.encode(), edited.encode(), following.encode()])
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, P.likeness([a], [b])[0], P.likeness([a], [c])[0]))
    return sorted(out)


def test_bucket_counts():
    texts = [b"", b"ab", b"abc", b"hello hello \xc3\xa9", bytes(range(256)) * 3]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    found = P.bucket_counts(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert found.tolist() == [counts_by_hand(t) for t in texts]


def test_query_agrees_with_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF).select("doc_id", "text").collect()]
    found = sorted(map(tuple, queries.op1_fingerprint(spark, SF).collect()))
    assert found == brute(rows)
    edited, apart = np.mean([r[5] for r in found]), np.mean([r[6] for r in found])
    assert edited > apart + 0.1


def test_small_cases(spark):
    rows = [(1, None), (2, ""), (3, "ab"), (4, "same text here"), (5, "same text here"), (9, "x" * 300_000), (7, "é" * 10)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], SCHEMA + ", edge string")
    found = sorted(map(tuple, P.edited_fingerprints(df).collect()))
    assert found == brute(rows)
    prints = {r.doc_id: r.fingerprint for r in P.fingerprints(df).collect()}
    assert prints[4] == prints[5] and prints[1] == prints[2] and all(prints[r[0]] == r[3] for r in found)
    one = spark.createDataFrame([(1, "abc def")], SCHEMA)
    assert [r.near_next for r in P.edited_fingerprints(one).collect()] == [1.0]
    assert P.edited_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []


def test_likeness_is_bounded_and_symmetric():
    texts = [b"a" * 50, b"quite another text " * 9, bytes(range(256)), b""]
    prints = P._digests_of(texts)
    for a in prints:
        for b in prints:
            x, y = P.likeness([a], [b])[0], P.likeness([b], [a])[0]
            assert x == y and 0 <= x <= 1 and (x == 1) == (a == b)


def test_chunks_cover_everything():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c"]})
    assert [p.num_rows for p in words.chunks(batch, "text", 12)] == [2, 1, 2]
