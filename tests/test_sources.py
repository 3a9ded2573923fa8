import json

import pytest

from gristmill.sources import files as S
from gristmill.streaming import ingest


def test_questions_and_labels_keep_their_order(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "b.jsonl").write_text(json.dumps({"query": "z", "positive_id": "1"}) + "\n\n")
    (tmp_path / "q" / "a.jsonl").write_text(json.dumps({"query": "x", "positive_id": "1"}) + "\n" + json.dumps({"query": "y", "positive_id": "2", "related_ids": ["3"]}))
    rows = S.load_questions(spark, str(tmp_path / "q")).orderBy("file", "line").collect()
    assert [r.query for r in rows] == ["x", "y", "z"] and rows[1].related_ids == ["3"]
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps({"qid": "a", "partial_ids": [str(i)]}) for i in range(3)))
    assert [r.partial_ids for r in S.load_labels(spark, str(tmp_path / "l.jsonl")).collect()] == [["2"]]


def test_index_is_built_once_and_guarded(spark, tmp_path):
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    docs = spark.createDataFrame([("a", "xx"), ("b", "y")], "id string, text string")
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        S.open_index(spark, path)
    assert S.build_index(docs, embed, path, "m") and not S.build_index(docs, embed, path, "m")
    assert {r.id: r.embedding for r in S.open_index(spark, path).collect()} == {"a": [2.0, 1.0], "b": [1.0, 1.0]}
    assert S.build_index(docs.filter("id = 'a'"), embed, path, "m") and S.build_index(docs, embed, path, "other")
    with pytest.raises(ValueError, match="duplicate"):
        S.build_index(docs.union(docs), embed, path, "m")


def test_corpus_and_splits(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "text": "t"}, {"id": "2", "title": "u"}]))
    corpus = S.load_corpus(spark, str(tmp_path / "c.json"))
    assert corpus.count() == 2 and corpus.filter("id = '2'").first().text is None
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    S.write_splits(df, str(tmp_path / "s"))
    assert [r.id for r in S.load_split(spark, str(tmp_path / "s"), "test").collect()] == [2] and S.load_split(spark, str(tmp_path / "s"), "dev").count() == 0


def test_streamed_documents_are_appended_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, ids in enumerate(([1, 2], [2, 3])):
        spark.createDataFrame([(i, f"t{i}") for i in ids], "id int, text string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id int, text string").parquet(source)
        ingest.append_documents(stream, out, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
