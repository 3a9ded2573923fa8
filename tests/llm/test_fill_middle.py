import hashlib
import random
import re

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from gristmill.llm import fill_middle as M
from gristmill.llm import queries, words

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(i, text):
    """n, form, prefix_chars, middle_chars, output by the words of the definition."""
    text, digest = text or "", hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h, units = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)], UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 80
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_cuts_for_every_stride_and_scan():
    rng = random.Random(3)
    for _ in range(400):
        texts = ["".join(rng.choice("ab \n\té漢😀 　") for _ in range(rng.choice([0, 1, 2, 5, 30, 200]))) for _ in range(rng.randint(0, 5))]
        data, offsets = words.buffers(pa.array(texts, pa.string()))
        index = M.UnitIndex(data, offsets, stride=rng.choice([1, 2, 3, 7]), scan=rng.choice([1, 3, 16, 1000]))
        units = [UNIT.findall(t) for t in texts]
        assert index.counts().tolist() == [len(u) for u in units]
        for d, u in enumerate(units):
            for k in range(len(u) + 1):
                byte, chars = index.cut(d, k)
                before = "".join(u[:k])
                assert (byte - offsets[d], chars) == (len(before.encode()), len(before))


def test_the_index_is_sparse():
    data, offsets = words.buffers(pa.array(["word " * 100_000]))
    index = M.UnitIndex(data, offsets)
    assert len(index.unit) <= 100_001 // M.STRIDE + 2 and index.cut(0, 77_777) == (5 * 77_777 - 1, 5 * 77_777 - 1)


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab<PSM> \n漢") for _ in range(rng.randint(0, 60))), "x") for i in range(400)]
    rows += [(None, "no id here at all", "y"), (500, None, None), (501, "", ""), (7, "the same row", "z"), (7, "the same row", "z"), (502, " \t ", ""), (503, "long 漢字 " * 300_000, ""), (504, "<M> is in it", ""), (505, "x" * 100_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(5)
    got = M.fill_middle(docs).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(map(str, ((i, *brute(i, t)) for i, t, _ in rows)))
    assert sorted(r.back for r in got) == sorted(t or "" for _, t, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert M.fill_middle(docs.limit(0)).collect() == []


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.op13_fill_middle(spark, sf)
    found = db.sql(queries.ORACLE_SQL["op13_fill_middle"])
    assert sorted(df.columns) == sorted(found.columns)
    assert {tuple(r) for r in df.select(found.columns).collect()} == set(found.fetchall())
