import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from gristmill.llm import byte_pairs as B
from gristmill.llm import queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SPLIT = regex.compile(PATTERN).findall
ALPHABETS = ("abcdefghij thes in on éüß漢字日本 Привет 123 \n\t'..--==😀", "ab'l 　\x85\xa0\n", "abth", "the re 'll")


@pytest.fixture(scope="module")
def ranks():
    return B.Ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def texts(seed, n, size=150):
    rng = random.Random(seed)
    return ["".join(rng.choice(a) for _ in range(rng.randint(0, size))) for _ in range(n) for a in (rng.choice(ALPHABETS),)]


def encoded(ranks, rows):
    ids, counts = B._encoded(ranks, SPLIT, pa.array(rows))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_texts_as_the_library(ranks, library):
    rng = random.Random(2)
    rows = texts(1, 3000) + ["", "a" * 5000, "-" * 3000, "'ll" * 50, " " * 1000 + "x", "".join(map(chr, range(32, 3000)))]
    rows += [b"".join(rng.choice(ranks.bytes) for _ in range(5)).decode("utf-8", "replace") for _ in range(2000)]
    assert encoded(ranks, rows) == [library.encode_ordinary(t) for t in rows]


def test_small_memory_and_parts_change_nothing(library, monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 200)
    monkeypatch.setattr(B, "PAIRS", 64)
    monkeypatch.setattr(B, "MANY", 7)
    monkeypatch.setattr(B, "WIDE", 6)
    rows = texts(4, 300)
    assert encoded(B.Ranks(PATH), rows) == [library.encode_ordinary(t) for t in rows]


def test_hashes_that_meet(ranks, library, monkeypatch):
    monkeypatch.setattr(B.words, "span_hashes", lambda data, a, b: np.zeros(len(a), np.uint64))
    rows = texts(5, 50)
    assert encoded(ranks, rows) == [library.encode_ordinary(t) for t in rows]


def test_each_prefix_has_its_own_last_token(ranks, library):
    piece = " internationalisationsthe"
    for k, token in enumerate(ranks.table(piece.encode())[0], 1):
        assert token == library._encode_single_piece(piece[:k])[-1]


def test_a_vocabulary_whose_tokens_no_merges_make(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([bytes([i]) for i in range(256)] + [b"abc"])))
    with pytest.raises(ValueError, match="token 256"):
        B.Ranks(str(path))


def test_edits_and_appends(ranks):
    rng = random.Random(6)
    for text in texts(7, 3000):
        last = B._table_of(ranks, SPLIT, text)
        start = rng.choice([rng.randint(0, len(text)), len(text)])
        stop, new = min(len(text), start + rng.choice([0, 1, 30])), "".join(rng.choice("ab 'lté\n") for _ in range(rng.choice([0, 1, 9])))
        changed, table, _ = B._edited(ranks, SPLIT, text, last, start, stop, new)
        assert changed == text[:start] + new + text[stop:] and table == B._table_of(ranks, SPLIT, changed)


def test_an_append_to_a_long_piece_works_out_what_is_new(ranks):
    text = "".join(random.Random(8).choices("abcdefgh", k=3000))
    last = B._table_of(ranks, SPLIT, text)
    assert B._edited(ranks, SPLIT, text, last, 3000, 3000, "xyz")[2] == 3
    assert B._edited(ranks, SPLIT, text, last, 1500, 1501, "z")[2] < 200


ODD = [(1, None, "a"), (2, "", "b"), (None, "no id", "c"), (3, "twice", None), (3, "twice", None), (4, "long words " * 200_000, "d"), (5, "x" * 70_000, "e"), (6, "two\x00 �", "f")]


def test_odd_rows(spark, library):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, ids string").repartition(3)
    got = B.decode(B.encode(docs, PATH, PATTERN), PATH).collect()
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(((i, library.encode_ordinary(t or "")) for i, t, _ in ODD), key=key)
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t, _ in ODD)
    assert B.digests(B.encode(docs.limit(0), PATH, PATTERN), PATH).collect() == []


def test_broken_utf8_and_string_ids(spark, library):
    docs = spark.sql("SELECT 'k' AS name, cast(X'61FF20C3' AS string) AS body")
    assert B.encode(docs, PATH, PATTERN, "name", "body").first().ids == library.encode_ordinary("a� �")


def test_damaged_ids(spark):
    rows = spark.createDataFrame([(1, [97, None]), (2, [60000]), (3, [-1]), (4, None), (5, []), (6, [64])], "doc_id long, ids array<int>")
    vocabulary = B.Tokens(PATH)
    assert {r.doc_id for r in B.digests(rows, PATH).collect() if r.decoded_sha256 is None} == {1, 2, 3}
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in B.decode(rows, PATH).collect()} == {1: None, 2: None, 3: None, 4: b"", 5: b"", 6: vocabulary.bytes[64]}


def test_tables_in_spark(spark, library):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, ids string").filter("doc_id != 4")
    tables = B.prefix_tables(docs, PATH, PATTERN)
    assert sorted(r.ids for r in B.table_ids(tables, PATH).collect()) == sorted(library.encode_ordinary(t or "") for i, t, _ in ODD if i not in (4, None))
    edits = spark.createDataFrame([(5, 70_000, 70_000, "end"), (2, None, None, "new"), (6, -3, 2, None), (99, 0, 0, "x")], "doc_id long, start int, stop int, new string")
    done = {r.doc_id: r for r in B.edit_tables(tables, edits, PATH, PATTERN).collect()}
    assert {i: r.text for i, r in done.items()} == {5: "x" * 70_000 + "end", 2: "new", 6: "o\x00 �"}
    assert done[5].fresh == 3
    again = {r.doc_id: r.ids for r in B.table_ids(spark.createDataFrame(list(done.values())), PATH).collect()}
    assert again == {i: library.encode_ordinary(r.text) for i, r in done.items()}


def test_query_agrees_with_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    want = set()
    for r in queries.documents(spark, sf).collect():
        ids = library.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in queries.op12_byte_pairs(spark, sf).collect()} == want
