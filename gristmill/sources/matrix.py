"""Vectors as a matrix in binary blocks, row for row beside the documents that they belong to.

Rows are numbered in the order of ids (or another one); a block holds the float32 values of some neighbouring rows one after the other, and a
manifest says which rows, how many dimensions, and the digests of the block's values and of its ids. So a reader that has
the documents in their order can prove that row n of the matrix is theirs, block by block, before it uses any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.order import ordinal, settle

#: Rows of a block.
BLOCK = 1024


def _ids_digest() -> Column:
    """Of a group of numbered rows: the digest of their ids in order, a line each. A block's ids fit a row."""
    lines = F.array_sort(F.collect_list(F.struct("n", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"))))
    return F.sha2(F.array_join(F.transform(lines, lambda x: x["id"]), "\n"), 256)


def export_matrix(rows: DataFrame, path: str, *order: str | Column, block: int = BLOCK) -> int:
    """Write rows (id, embedding) as a matrix in the order given (of ids by default); returns the number of dimensions.

    ``path``/blocks has block and data (little-endian float32, row after row), ``path``/manifest block, first, rows, dimensions, values_sha256 and
    ids_sha256. Vectors that are null or of different lengths, and ids that occur twice, raise ValueError before anything is written.
    """
    found = rows.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.count(F.lit(1)).alias("n"), F.count("embedding").alias("there")).first()
    if found.there < found.n or found.low != found.high:
        raise ValueError(f"{found.n - found.there} vectors are missing; the others have {found.low} to {found.high} dimensions")
    if bad := rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(3).collect():
        raise ValueError(f"duplicate ids, such as {[r.id for r in bad]}")
    dimensions = found.high or 0
    placed = settle(ordinal(rows.select("id", "embedding"), *(order or ("id",)), name="n").withColumn("block", F.floor(F.col("n") / block)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts = None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(blocks), -1)
            for first, last in zip(*(np.r_[x] for x in (np.r_[0, np.flatnonzero(np.diff(blocks)) + 1], np.r_[np.flatnonzero(np.diff(blocks)) + 1, len(blocks)])), strict=True) if len(blocks) else ():
                if number is not None and number != blocks[first]:
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([b"".join(parts)], pa.binary())], ["block", "data"])
                    parts = []
                number = int(blocks[first])
                parts.append(values[first:last].tobytes())
        if number is not None:
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([b"".join(parts)], pa.binary())], ["block", "data"])

    dealt = placed.select("block", "n", "embedding").repartition("block").sortWithinPartitions("block", "n")
    dealt.select("block", "embedding").mapInArrow(pack, "block long, data binary").write.parquet(f"{path}/blocks")
    ids = placed.groupBy("block").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("rows"), _ids_digest().alias("ids_sha256"))
    values = rows.sparkSession.read.parquet(f"{path}/blocks").select("block", F.sha2("data", 256).alias("values_sha256"))
    ids.join(values, "block").select("block", "first", "rows", F.lit(dimensions).alias("dimensions"), "values_sha256", "ids_sha256").write.parquet(f"{path}/manifest")
    return dimensions


def read_matrix(spark: SparkSession, path: str, documents: DataFrame, *order: str | Column, block: int = BLOCK) -> DataFrame:
    """id, n, embedding: the matrix beside its documents (id, ...) in the order given.

    Blocks whose ids are others, or stand in another order, than when the matrix was written, damaged values, and too many or too
    few documents raise ValueError: rows would not belong together.
    """
    manifest, blocks = spark.read.parquet(f"{path}/manifest"), spark.read.parquet(f"{path}/blocks")
    placed = settle(ordinal(documents.select("id"), *(order or ("id",)), name="n").withColumn("block", F.floor(F.col("n") / block)))
    ours = placed.groupBy("block").agg(F.count(F.lit(1)).alias("_rows"), _ids_digest().alias("_ids"))
    values = blocks.select("block", F.sha2("data", 256).alias("_values"))
    both = manifest.join(ours, "block", "full_outer").join(values, "block", "full_outer")
    same = (F.col("rows") == F.col("_rows")) & (F.col("ids_sha256") == F.col("_ids")) & (F.col("values_sha256") == F.col("_values"))
    if bad := both.filter(~F.coalesce(same, F.lit(False))).orderBy("block").limit(3).collect():
        raise ValueError(f"the matrix in {path} does not belong to these documents in this order: blocks such as {[r.block for r in bad]}")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, dimensions, data in zip(*(batch.column(c).to_pylist() for c in ("first", "rows", "dimensions", "data")), strict=True):
                flat = pa.array(np.frombuffer(data, "<f4"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * dimensions, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + rows)), lists], ["n", "embedding"])

    vectors = blocks.join(manifest.select("block", "first", "rows", "dimensions"), "block").mapInArrow(unpack, "n long, embedding array<float>")
    return placed.select("id", "n").join(vectors, "n").select("id", "n", "embedding")
