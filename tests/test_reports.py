import math
import os

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import stats, vector
from gristmill.plans import reports
from gristmill.sources import report


SF = "/root/testdata/sf0.001"


def _hits(rows):
    """variant, seed, law, base_hit, other_hit and the outcome."""
    outcome = {(0, 1): "fixed", (1, 0): "broken", (1, 1): "both_right", (0, 0): "both_wrong"}
    return [(*r, outcome[r[-2:]]) for r in rows]


SCHEMA = "variant string, seed int, law string, base_hit int, other_hit int, outcome string"


def _p(fixed, broken):
    m = fixed + broken
    return min(1.0, 2 * sum(math.comb(m, i) for i in range(min(fixed, broken) + 1)) / 2**m) if m else 1.0


def test_a_decision(spark):
    better = [("good", s, f"l{i % 4}", 0, 1) for s in (0, 1) for i in range(60)] + [("good", s, f"l{i % 4}", 1, 1) for s in (0, 1) for i in range(340)]
    mixed = [("mixed", s, "l0", 0, 1) for s in (0, 1) for _ in range(50)] + [("mixed", s, "l1", 1, 0) for s in (0, 1) for _ in range(30)] + [("mixed", s, "l2", 1, 1) for s in (0, 1) for _ in range(320)]
    small = [("small", s, "l0", 0, 1) for s in (0, 1) for _ in range(2)] + [("small", s, "l0", 1, 1) for s in (0, 1) for _ in range(398)]
    runs = spark.createDataFrame(_hits(better + mixed + small), SCHEMA)
    controls = spark.createDataFrame([(s, 1, 1 if i else s) for s in (0, 1) for i in range(200)], "seed int, base_hit int, other_hit int")
    heldout = spark.createDataFrame([("good", 0, 1), ("good", 1, 1), ("mixed", 1, 0)], "variant string, base_hit int, other_hit int")
    got = {r.variant: r for r in stats.decide(runs, controls, heldout).collect()}
    assert {v: (r.large, r.beyond_seeds, r.above_zero, r.significant, r.stable, r.general, r.accepted) for v, r in got.items()} == {
        "good": (True, True, True, True, True, True, True),
        "mixed": (True, True, True, False, False, False, False),
        "small": (False, False, got["small"].above_zero, False, True, False, False),
    }
    assert {r.seed_range for r in got.values()} == {0.005} and got["mixed"].worse_groups == 1
    raw = sorted([(_p(60, 0), "good"), (_p(50, 30), "mixed"), (_p(2, 0), "small")])
    top, want = 0.0, {}
    for i, (p, v) in enumerate(raw):
        top = max(top, round(p, 6) * (3 - i))
        want[v] = min(1.0, top)
    assert all(abs(got[v].p_adjusted - p) < 1e-5 for v, p in want.items())
    assert got["good"].low == pytest.approx(0.15 - 1.96 * math.sqrt(0.15 * 0.85 / 400), abs=0.012)


def test_intervals_by_group(spark):
    rows = spark.createDataFrame(_hits([("v", 0, "a", 0, 1)] * 50 + [("v", 0, "a", 1, 1)] * 50 + [("v", 0, "b", 1, 1)] * 10), SCHEMA)
    got = {r.law: r for r in stats.paired_with_interval(rows, ["law"]).collect()}
    assert got["a"].low < 0.5 == got["a"].delta < got["a"].high and (got["b"].low, got["b"].high) == (0.0, 0.0)
    whole = stats.paired_with_interval(rows).first()
    assert whole.n == 110 and whole.low < whole.delta < whole.high


def test_markdown_and_json(spark, tmp_path):
    table = spark.createDataFrame([("b", 2.0, None), ("a|x", 0.12345, "two\nlines"), (None, None, "z")], "name string, value double, note string")
    lines = report.markdown_rows(table, {"name": ("Name", None), "value": ("R@5", "%.3f"), "note": ("Note", None)}, F.asc_nulls_last("name"))
    want = ["| Name | R@5 | Note |", "|---|---|---|", "| a\\|x | 0.123 | two lines |", "| b | 2.000 | - |", "| - | - | z |"]
    assert [r.line for r in lines.orderBy("n").collect()] == want
    report.write_markdown(lines, f"file://{tmp_path}/table")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/table").collect()] == want
    report.write_json(table, f"file://{tmp_path}/json", F.asc_nulls_last("name"))
    first, = [f for f in os.listdir(tmp_path / "json") if f.endswith(".json")]
    assert (tmp_path / "json" / first).read_text().splitlines()[1] == '{"name":"b","value":2.0,"note":null}'


def test_checks_before_results(spark):
    corpus = spark.createDataFrame([("a",), ("b",)], "id string")
    asked = spark.createDataFrame([("q1", "a")], "qid string, positive_id string")
    report.check_evaluation(asked, corpus)
    with pytest.raises(ValueError, match="no questions"):
        report.check_evaluation(asked.limit(0), corpus)
    with pytest.raises(ValueError, match="1 right answers .* 'zz'"):
        report.check_evaluation(asked.union(spark.createDataFrame([("q2", "zz")], asked.schema)), corpus)
    counts = spark.createDataFrame([(2, 0)], "missing_positive long, dropped_negatives long")
    report.check_filtered(counts, asked)
    with pytest.raises(ValueError, match="2 questions"):
        report.check_filtered(counts, asked, strict=True)
    with pytest.raises(ValueError, match="no question is left"):
        report.check_filtered(counts, asked.limit(0))


def test_model_names(spark, tmp_path):
    assert report.model_key(spark, "some/hub-model") == "hub-model"
    folder = tmp_path / "tuned"
    folder.mkdir()
    for name, when in (("model.safetensors", 86_400), ("other.bin", 3_600), ("notes.txt", 10**9)):
        (folder / name).write_text("x")
        os.utime(folder / name, (when, when))
    assert report.model_key(spark, "base", f"file://{folder}") == "tuned-19700102000000"
    assert (T.profile_of("google/embeddinggemma-300m"), T.profile_of("/models/run/best"), T.profile_of("runs/best", exists=True)) == ("gemma", "e5", "e5")
    with pytest.raises(ValueError, match="no profile"):
        T.profile_of("other/model")


def _counted(spark, monkeypatch):
    """How many rows rankings give while queries run, and the rankings that were asked for: depth and, by columns, rows."""
    rows, asked, search = spark.sparkContext.accumulator(0), [], vector.batch_knn

    def counting(queries, corpus, k, **more):
        found = search(queries, corpus, k, **more)
        asked.append((k, found))

        def count(batches):
            for batch in batches:
                rows.add(batch.num_rows)
                yield batch

        return found.mapInArrow(count, found.schema)

    monkeypatch.setattr(vector, "batch_knn", counting)
    return rows, asked


def test_questions_are_ranked_once_for_judged_negatives(spark, monkeypatch):
    rows, asked = _counted(spark, monkeypatch)
    reports.replaced_negatives(spark, SF).collect()
    (depth, ranked), = asked
    assert rows.value == ranked.count() and depth == 30


def test_each_model_is_ranked_once_for_a_decision(spark, monkeypatch):
    rows, asked = _counted(spark, monkeypatch)
    got = {r.variant: r.accepted for r in reports.decision(spark, SF).collect()}
    assert rows.value == sum(ranked.count() for _, ranked in asked) and len(asked) == 3
    assert [k for k, _ in asked] == [3, 3, 3] and set(got) == {"32 dimensions", "64 dimensions"}
