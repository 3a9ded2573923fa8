import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gristmill.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, kept int"


def test_groups(spark):
    rows = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b" * 200_000), (6, "b" * 200_000), (7, "b" * 199_999 + "c"), (None, "a"), (None, "q"), (None, "q"), (8, "r"), (8, "r")]
    rows += [(100 + i, "hot copy") for i in range(500)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], SCHEMA)
    for keep, best in (("largest", max), ("smallest", min)):
        by = defaultdict(list)
        for i, t in rows:
            by[t or ""].append(i)
        found = E.exact_dedup(df, keep=keep).collect()
        assert len(found) == len(rows)
        for r in found:
            text = next(t for t in by if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
            ids = [i for i in by[text] if i is not None]
            assert r.group_size == len(by[text]) and r.keep_id == (best(ids) if ids else None)
        assert sum(r.kept for r in found) == len(by)


def test_normalised_and_kept_rows(spark):
    df = spark.createDataFrame([(1, "A", 0), (2, "a", 0), (3, "b", 0), (3, "b", 0), (None, "c", 0), (None, None, 0)], SCHEMA)
    assert {r.keep_id for r in E.exact_dedup(df, normalise=F.lower).collect()} == {2, 3, None}
    assert sorted(map(tuple, E.keep_distinct(df).collect()), key=str) == sorted([(1, "A", 0), (2, "a", 0), (3, "b", 0), (None, "c", 0), (None, None, 0)], key=str)


def test_empty_table_and_bad_argument(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert E.exact_dedup(df).collect() == [] and E.keep_distinct(df).collect() == []
    with pytest.raises(ValueError):
        E.exact_dedup(df, keep="any")
