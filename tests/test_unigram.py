import itertools
import random
import unicodedata

from pyspark.sql import functions as F

from gristmill.operators import unigram as U
from gristmill.plans import catalog

PIECES = {"▁": (3, -2.0), "a": (4, -3.0), "b": (5, -3.5), "ab": (6, -4.0), "▁ab": (7, -4.5), "aba": (8, -6.5), "수당": (9, -5.0), "수": (10, -4.0), "당": (11, -4.5), "▁야간": (12, -3.0), "1": (13, -2.5)}


def brute(word):
    """The best score over all ways to cut a word into pieces and unknown characters."""
    miss, best = min(s for _, s in PIECES.values()) - 10, None
    for cuts in itertools.product([0, 1], repeat=max(len(word) - 1, 0)):
        parts, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[last:i])
                last = i
        parts.append(word[last:])
        if all(p in PIECES or len(p) == 1 for p in parts):
            score = sum(PIECES[p][1] if p in PIECES else miss for p in parts)
            best = score if best is None else max(best, score)
    return best


def test_words_against_all_segmentations():
    model, rng = U.Unigram(PIECES, 0), random.Random(4)
    by_id = {i: (p, s) for p, (i, s) in PIECES.items()}
    for _ in range(300):
        word = "▁" + "".join(rng.choice("abab수당x1") for _ in range(rng.randint(0, 8)))
        ids = model.word(word)
        miss = sum(c not in "▁ab수당1" for c in word)
        assert abs(sum(by_id[i][1] for i in ids if i) + miss * model.miss - brute(word)) < 1e-9
        assert "".join(by_id[i][0] if i else "x" for i in ids).replace("x", "") == word.replace("x", "")
        assert not any(a == b == 0 for a, b in itertools.pairwise(ids))


def test_texts(spark):
    vocabulary = spark.createDataFrame([(p, i, s) for p, (i, s) in PIECES.items()], "piece string, id int, score double")
    rows = [("k1", "ab\t야간\n\n수당"), ("k2", None), ("k3", "  ＡＢ ab\x07ab①"), ("k4", "ab " * 50_000), ("k5", "x" * 3000), ("k6", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    model, got = U.Unigram(PIECES, 0), {r.doc_id: r.ids for r in U.tokenize(docs, vocabulary, 0, begin=1, end=2).collect()}
    assert got["k1"] == [1, 7, 12, 3, 9, 2]
    assert got["k2"] == got["k6"] == [1, 3, 2]
    assert unicodedata.normalize("NFKC", "①") == "1" and got["k3"] == [1, *model.word("▁AB"), *model.word("▁abab1"), 2]
    assert len(got["k4"]) == 50_000 + 3 and got["k5"] == [1, 3, 0, 2]
    short = {r.doc_id: r.ids for r in U.tokenize(docs, vocabulary, 0, begin=1, end=2, most=4).collect()}
    assert short["k1"] == [1, 7, 12, 2]
    kept = U.kept_ids(vocabulary, U.tokenize(docs.filter("doc_id = 'k2'"), vocabulary, 0), special=[0, 1, 2])
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]
    few = U.kept_ids(vocabulary, U.tokenize(docs.filter("doc_id = 'k1'"), vocabulary, 0), special=[2], always=F.lit(False))
    assert sorted(r.id for r in few.collect()) == [2, 3, 7, 9, 12]


def test_query_against_a_plain_programme(spark):
    sf = "/root/testdata/sf0.001"
    vocabulary = {r.piece: (r.id, r.score) for r in catalog._vocabulary(spark).collect()}
    model = U.Unigram(vocabulary, 0)
    want = {r.doc_id: len(model.encode(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in catalog.QUERIES["unigram_tokens"](spark, sf).collect()} == want


def test_words_beyond_what_is_remembered_are_not_segmented_again(monkeypatch):
    model, rng = U.Unigram(PIECES, 0), random.Random(7)
    some = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(200_000)]
    calls, word = [], U.Unigram.word
    monkeypatch.setattr(U.Unigram, "word", lambda self, w: calls.append(w) or word(self, w))
    first = model.encode(" ".join(some))
    once = len(calls)
    assert model.encode(" ".join(some)) == first and len(calls) == once == len(set(some))
