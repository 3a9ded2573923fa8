from collections import defaultdict

import corpus_pipeline
import public_tokenizers
import sentencepiece
from test_mixing import brute as brute_mix
from test_near_dedup import brute as brute_near

from gristmill.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_agree_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).filter("predicted = 1").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    last = {}
    for i in sorted(rows):
        last[rows[i].text] = i
    distinct = [(i, t) for t, i in last.items()]
    classes = brute_near(distinct)
    left = [i for i, _ in distinct if classes[i] == i]
    taken = {r[0]: r[4] for r in brute_mix([(i, rows[i].text, rows[i].source) for i in left])}
    steps = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps = stage(spark, steps, SF)
        assert steps.columns == docs.columns, name
    got = defaultdict(int)
    for r in steps.collect():
        got[r.doc_id] += len(r.text.split())
        assert rows[r.doc_id].text.startswith(r.text) or rows[r.doc_id].text.split()[: len(r.text.split())] == r.text.split()
    assert dict(got) == {i: n for i, n in taken.items() if n}


def test_run_ends_in_ids_of_its_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = corpus_pipeline.run(spark, SF).collect()
    assert found
    for r in found:
        text = library.decode(r.ids)
        assert texts[r.doc_id] == text or texts[r.doc_id].split()[: len(text.split())] == text.split()


ODD = [(1, None, "en", "a"), (2, "", "en", None), (None, "words of a text without an id here", "en", "a"), (3, "same text in two rows of one id", None, "b"), (3, "same text in two rows of one id", None, "b"), (4, "long " * 40_000, "fr", "b"), (5, "one two three four five six seven", "en", "a"), (6, "one two three four five six seven", "en", "a")]


def odd_tables(spark, folder, rows):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_nulls_repeats_and_long_texts(spark, tmp_path):
    odd_tables(spark, tmp_path, ODD)
    docs = steps = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps = stage(spark, steps, str(tmp_path))
        assert steps.columns == docs.columns
        left[name] = sorted((r.doc_id for r in steps.collect()), key=str)
    assert left["quality classifier"] == sorted((r[0] for r in ODD), key=str)  # without labels the prior accepts
    assert left["exact dedup"] == [2, 3, 4, 6, None] and left["near dedup"] == [2, 3, 4, 6, None]
    assert set(left["source mixing"]) <= {3, 4, 6, None}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2 * len(left["source mixing"])


def test_empty_table(spark, tmp_path):
    odd_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
