import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gristmill.llm import queries
from gristmill.llm import token_files as T
from gristmill.llm.shared import fresh_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


def brute(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("ids", [[0], [7] * 5000, [0, 2**32 - 1], [2**32 - 1], list(range(300)) + [4_000_000_000]])
def test_blocks_come_back(ids):
    ids = np.array(ids[:4096], np.uint32)
    assert T.unpack_blocks(b"xyz" + T.pack_blocks(ids[None, :])[0], [3])[0].tolist() == ids.tolist()


def test_outliers_are_exceptions():
    packed = T.pack_blocks(np.array([[5] * 99 + [1 << 30]], np.uint32))[0]
    assert T._HEAD.unpack_from(packed) == (5, 100, 1, 0)


def test_query_agrees_with_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op4_token_files(spark, sf).collect())) == brute(rows)


def test_edge_cases_and_ids(spark):
    rows = [(3, None), (1, ""), (2, "Hello, WORLD's <|endoftext|> x<|startoftext|>y İİ ΣΣ a\x1cb c\xa0d  e é ́f"), (6, "THE, end.. (x). don't, I'LL! 1999? a1; é. É, .;! A\u0301. H\u0331 h\u0331 I\u0307, <|ENDOFTEXT|>. It's:"), (5, "same"), (5, "same"), (None, "no id"), (9, "long " * 30_000), (-4, "\n\t ")]
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], SCHEMA + ", file string, first_id int")
    path = fresh_dir(spark, "tokens")
    files = T.write_token_files(df, path, PATH, block=64)
    found = T.read_token_files(spark, path, files, with_ids=True).collect()
    assert sorted((r[:4] for r in found), key=lambda r: r[1]) == brute(rows)
    assert {r.doc_id: r.ids for r in found}[5] == Tokenizer.from_file(PATH).encode("same").ids + [2]


def test_words_leave_the_cache():
    encoder = T.WordEncoder(PATH, keep=5)
    tokenizer = Tokenizer.from_file(PATH)
    for text in ("a b c d", "c d e f", "a a a", "g h i j k l m n", "a b"):
        ids, sizes = encoder.encode(pa.array([text, None, text]))
        one = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == one * 2 and sizes.tolist() == [len(one), 0, len(one)]


def test_words_of_letters_share_a_text(monkeypatch):
    encoder, seen = T.WordEncoder(PATH), []
    tokenizer = encoder.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return tokenizer.encode_batch_fast(texts, **more)

    encoder.tokenizer = Counted()
    words = [f"{a}{b}{c}{d}" for a in ("Zu", "é", "ÀÖ", "ß") for b in "bcdfgh" for c in ("eau", "ÿñ", "ion") for d in ("", "ly", "ÉÇ", "×x", "÷", "9a", "'s", "ŉ", "Σ")]
    ids, sizes = encoder.encode(pa.array(words))
    alone = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert ids.tolist() == sum(alone, []) and sizes.tolist() == [len(x) for x in alone] and len(seen) < len(words)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(T.words, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    text = "some words, of one hash: abcdefghi abcdefghj"
    assert T.WordEncoder(PATH).encode(pa.array([text]))[0].tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_many_files(spark):
    path = fresh_dir(spark, "tokens")
    df = spark.createDataFrame([(i, f"text number {i} " * 50) for i in range(60)], SCHEMA).repartition(3)
    files = T.write_token_files(df, path, PATH, file_bytes=1)
    found = sorted(tuple(r) for r in T.read_token_files(spark, path, files).collect())
    assert found == brute([(r.doc_id, r.text) for r in df.collect()])


def test_damaged_files_are_refused():
    with pytest.raises(ValueError):
        T.FileReader(b"GMPFOR01" + bytes(60))


def test_empty_table(spark):
    path = fresh_dir(spark, "tokens")
    files = T.write_token_files(spark.createDataFrame([], SCHEMA), path, PATH)
    assert files.collect() == [] and T.read_token_files(spark, path, files).collect() == []
