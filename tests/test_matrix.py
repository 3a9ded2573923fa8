import pytest
from pyspark.sql import functions as F

from gristmill.sources import matrix


def test_round_trip_and_refusals(spark, tmp_path):
    rows = spark.range(230).select(F.concat(F.lit("k"), F.col("id") * 37 % 1000).alias("id"), F.array(*[F.col("id") / (j + 1) for j in range(3)]).cast("array<float>").alias("embedding"))
    path = f"file://{tmp_path}/m"
    assert matrix.export_matrix(rows.repartition(5), path, block=50) == 3
    parts = spark.read.parquet(f"{path}/manifest").orderBy("block").collect()
    assert [(r.first, r["rows"], r.dimensions) for r in parts] == [(0, 50, 3), (50, 50, 3), (100, 50, 3), (150, 50, 3), (200, 30, 3)]
    assert sum(len(r.data) for r in spark.read.parquet(f"{path}/blocks").collect()) == 230 * 3 * 4
    docs = rows.select("id", F.lit("text").alias("text"))
    back = matrix.read_matrix(spark, path, docs.repartition(3), block=50)
    want = {r.id: list(r.embedding) for r in rows.collect()}
    found = back.collect()
    assert {r.id: list(r.embedding) for r in found} == want
    assert [r.id for r in sorted(found, key=lambda r: r.n)] == sorted(want)
    for other in (docs.filter("id != 'k37'"), docs.union(docs.limit(1)), docs.withColumn("id", F.when(F.col("id") == "k0", "k00").otherwise(F.col("id")))):
        with pytest.raises(ValueError, match="does not belong"):
            matrix.read_matrix(spark, path, other, block=50)
    with pytest.raises(ValueError, match="does not belong"):
        matrix.read_matrix(spark, path, docs, F.desc("id"), block=50)


def test_what_is_no_matrix(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(list(rows), "id string, embedding array<float>")
    for bad, said in ((make(("a", [1.0]), ("b", None)), "1 vectors are missing"), (make(("a", [1.0]), ("b", [1.0, 2.0])), "1 to 2 dimensions"), (make(("a", [1.0]), ("a", [2.0])), "duplicate ids")):
        with pytest.raises(ValueError, match=said):
            matrix.export_matrix(bad, f"file://{tmp_path}/x")
    assert not (tmp_path / "x").exists()
