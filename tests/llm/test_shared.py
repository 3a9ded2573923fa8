from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import near_dedup
from gristmill.llm.shared import lean, small_batches

MB = 1 << 20


def resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


kept = []


def freed(batches):
    """Small arrays of 200 MB that are freed, below one that is kept."""
    for batch in batches:
        arrays = [np.ones(8000) for _ in range(200 * MB // 64000)]
        kept.append(np.ones(8000))
        del arrays
        yield batch


@pytest.mark.skipif(not Path("/proc/self/statm").exists(), reason="reads Linux's figures")
def test_a_task_leaves_no_free_memory_with_its_worker():
    batch = pa.RecordBatch.from_arrays([pa.array([1.0])], ["n"])
    before = resident()
    assert list(lean(freed)(iter([batch]))) == [batch]
    assert resident() - before < 60 * MB


def test_steps_of_near_dedup_give_memory_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(near_dedup, "lean", lambda run: given.append(run) or lean(run))
    small_batches(spark)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words")], "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3} and len(given) >= 3
