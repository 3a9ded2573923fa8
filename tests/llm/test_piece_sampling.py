import math
import weakref
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from gristmill.llm import piece_sampling as S
from gristmill.llm import queries, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"
PIECES = S.Pieces(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def all_paths(text):
    """Every segmentation of a short text with its log probability, by definition."""
    raw = b" " + text.encode()
    by = {b: i for i, b in enumerate(PIECES.bytes) if b and not LIBRARY.is_byte(i)}

    def go(at):
        if at == len(raw):
            return [((), 0.0)]
        out = []
        for length in range(1, len(raw) - at + 1):
            if (i := by.get(raw[at : at + length])) is not None:
                out += [((i, *rest), PIECES.score[i] + s) for rest, s in go(at + length)]
        ch = raw[at:].decode("utf-8")[0].encode()
        if ch not in by:
            out += [((*(int(PIECES.of_byte[b]) for b in ch), *rest), PIECES.byte_score * len(ch) + s) for rest, s in go(at + len(ch))]
        return out

    paths = go(0)
    z = np.logaddexp.reduce([s for _, s in paths])
    return {p: s - z for p, s in paths}


def draw(texts, keys, k):
    sampler = S.Sampler(PIECES, pa.array(texts), words.mix(np.asarray(keys, np.uint64)), k, 1.0)
    paths, found, ends = sampler.run()
    out = [[] for _ in texts]
    for path, (alive, total, noise) in zip(paths, found, strict=True):
        flat, counts = sampler.ids(path)
        at = np.r_[0, np.cumsum(counts)]
        for d in np.flatnonzero(alive):
            out[d].append((tuple(flat[at[d] : at[d + 1]].tolist()), total[d] / S.UNIT, noise[d]))
    return out, ends


@pytest.mark.parametrize("text", ["ab", "the cat", "a\nb", "xé☃", "  a  "])
def test_samples_are_distinct_paths_with_their_probabilities(text):
    paths = all_paths(text)
    found, ends = draw([text] * 40, range(40), 6)
    for rows, end in zip(found, ends, strict=True):
        assert len({p for p, _, _ in rows}) == len(rows) == min(6, len(paths))
        assert all(s == pytest.approx(paths[p], abs=1e-6) for p, s, _ in rows)
        noises = [g for _, _, g in rows] + [end]
        assert noises == sorted(noises, reverse=True)


def test_all_paths_are_found_when_asked_for():
    paths = all_paths("abc")
    found, ends = draw(["abc"], [5], len(paths) + 3)
    assert {p for p, _, _ in found[0]} == set(paths) and ends[0] == -np.inf


def test_frequencies_follow_sampling_without_replacement():
    text, n = "to", 20_000
    paths = all_paths(text)
    found, _ = draw([text] * n, range(n), 2)
    first, second = Counter(r[0][0] for r in found), Counter(r[1][0] for r in found)
    expected = {b: sum(math.exp(paths[a]) * math.exp(paths[b]) / (1 - math.exp(paths[a])) for a in paths if a != b) for b in paths}
    for p in paths:
        assert first[p] / n == pytest.approx(math.exp(paths[p]), abs=0.02)
        assert second[p] / n == pytest.approx(expected[p], abs=0.02)


def test_inclusion_is_unbiased(spark):
    text, n = "to a", 4000
    paths = all_paths(text)
    df = spark.createDataFrame([(i, text) for i in range(n)], SCHEMA)
    rows = S.encode_samples(df, MODEL, samples=3).collect()
    share = sum(math.exp(r.log_prob) / r.inclusion for r in rows) / n
    assert share == pytest.approx(1, abs=0.03) and len(rows) == 3 * n and len(paths) > 3


def test_query_comes_back_and_reruns_agree(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.documents(spark, sf)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    import hashlib

    rows = queries.op9_pieces(spark, sf).collect()
    assert all(r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
    assert {r.doc_id for r in rows} == texts.keys()
    again = S.encode_samples(docs.repartition(7, "lang"), MODEL, samples=2).collect()
    known = {(r.doc_id, r.sample): r for r in rows}
    assert all(len(r.ids) == known[r.doc_id, r.sample].n_ids and r.log_prob == known[r.doc_id, r.sample].log_prob for r in again)
    assert all(LIBRARY.decode(r.ids) == texts[r.doc_id] for r in again)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "x" * 3000), (6, "日本語☃\x00é"), (7, "▁a b"), (None, "two words"), (8, "same"), (8, "same"), (9, "word " * 20_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA + ", ids int")
    found = S.decode_samples(S.encode_samples(df, MODEL, samples=3, seed=4), MODEL).collect()
    texts = {i: (t or "").replace("▁", " ") for i, t in rows}
    assert all(r.text == texts[r.doc_id] for r in found)
    assert [(r.ids, r.inclusion) for r in found if r.doc_id in (1, 2)] == [([], 1.0)] * 2
    assert {r.doc_id for r in found} == texts.keys()
    same = sorted((r.sample, tuple(r.ids)) for r in found if r.doc_id == 8)
    assert same[0] == same[1] and len(set(same)) == 3
    assert S.encode_samples(spark.createDataFrame([], SCHEMA), MODEL).collect() == []


def test_query_agrees_with_all_paths(spark, tmp_path):
    """The registered query on short texts, whose segmentations can all be listed."""
    texts = ["ab", "the cat", "a", "xé☃", "to a", "  a  ", "", None, "ab", "in it"] * 3
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op9_pieces(spark, str(tmp_path)).collect()
    ids = {(r.doc_id, r.sample): tuple(r.ids) for r in S.encode_samples(queries.documents(spark, str(tmp_path)), MODEL, samples=2).collect()}
    seen = Counter(r.doc_id for r in rows)
    for i, t in enumerate(texts):
        paths = all_paths(t) if t else {(): 0.0}
        own = [r for r in rows if r.doc_id == i]
        assert seen[i] == min(2, len(paths)) and len({ids[i, r.sample] for r in own}) == len(own)
        for r in own:
            path = ids[i, r.sample]
            assert r.n_ids == len(path) and r.log_prob == pytest.approx(paths[path], abs=1e-6)
            # A segmentation is among k draws without replacement at least as often as in one draw.
            assert math.exp(r.log_prob) - 1e-9 <= r.inclusion <= 1 + 1e-9


def test_a_chunk_is_freed_before_the_next_one_is_built(spark, monkeypatch):
    runs, built = [], []

    class Watched(S.Sampler):
        def __init__(self, *args):
            assert not any(earlier() for earlier in built)
            built.append(weakref.ref(self))
            super().__init__(*args)

    monkeypatch.setattr(S, "lean", lambda run: runs.append(run) or run)
    monkeypatch.setattr(S, "CHUNK_BYTES", 64)
    monkeypatch.setattr(S, "Sampler", Watched)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": ["some words of a text, of some length"] * 6})
    S.encode_samples(spark.createDataFrame([(1, "a")], "doc_id long, text string"), MODEL)
    assert sum(b.num_rows for b in runs[0](iter([batch]))) == 12 and len(built) == 6
