"""Numbers and sums in a total order, without bringing all rows to one task.

Rows are range partitioned by the order, sorted within their ranges and written once as a table. A row's place is then the number of
rows in the files before its own and its index in its file, which the reader knows: nothing is shuffled again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='gristmill-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(rows: DataFrame) -> DataFrame:
    """The rows, computed once and written as a table in the shared folder; it goes when the driver's JVM ends."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(place)  # only what is there is noted for deletion
    store.deleteOnExit(place)
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _ranged(rows: DataFrame, by: tuple) -> DataFrame:
    """The rows with _part, the place of their range's file as (number, split), and _at, their index in it.

    Rows that the order holds equal stand in any order, so a key that many rows share doesn't fall to one task.
    """
    tie = f"_tie_{uuid.uuid4().hex}"
    dealt = rows.withColumn(tie, F.rand(17)).repartitionByRange(*by, tie).sortWithinPartitions(*by, tie).drop(tie)
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("long"), F.lit(0))
    return settle(dealt).select("*", F.struct(number(r"^part-(\d+)").alias("number"), number(r"-c(\d+)\.").alias("split")).alias("_part"), F.col("_metadata.row_index").alias("_at"))


def _before(parts: DataFrame, value: str) -> DataFrame:
    """_part, _before: the sum of a value over all earlier files. One row a file, as many as there are partitions."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.select("_part", F.coalesce(F.sum(value).over(earlier), F.lit(0)).cast("long").alias("_before")))


def ordinal(rows: DataFrame, *by: str | Column, name: str = "n") -> DataFrame:
    """The rows with ``name``, their place from 0 in the order of ``by``. Rows that are equal in it stand in any order, each once.

    An empty table stays empty. Nulls stand where the order puts them (first, by default).
    """
    ranged = _ranged(rows, by)
    before = _before(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_many")), "_many")
    return ranged.join(before, "_part").select(*rows.columns, (F.col("_before") + F.col("_at")).alias(name))


def running_sum(rows: DataFrame, value: Column, *by: str | Column, name: str = "before") -> DataFrame:
    """The rows with ``name``, the sum of a whole-number value over the rows before each in the order of ``by``; null counts as 0.

    A range's own sums are a window over its rows, a file of even size.
    """
    ranged = _ranged(rows.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0))), by)
    before = _before(ranged.groupBy("_part").agg(F.sum("_value").alias("_sum")), "_sum")
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_upto", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(before, "_part")
    return summed.select(*rows.columns, (F.col("_before") + F.col("_upto")).alias(name))


def ordinal_within(rows: DataFrame, group: str, *by: str | Column, name: str = "n") -> DataFrame:
    """The rows with ``name``, their place from 0 among those of their group; a group's rows may lie in many tasks. Nulls are a group."""
    placed = ordinal(rows, group, *by, name="_place")
    firsts = placed.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"))
    return placed.join(firsts, F.col(group).eqNullSafe(F.col("_group"))).select(*rows.columns, (F.col("_place") - F.col("_first")).alias(name))


def sequence_digest(rows: DataFrame, line: Column, *by: str | Column, fan: int = 4096) -> str:
    """A digest of the rows' lines in the order of ``by``, and of that order: a tree of SHA-256 digests over ``fan`` neighbours each.

    The same lines in another order have another digest; partitions do not matter. No row or task holds more than ``fan`` digests.
    ``by`` should be a total order. No rows: the digest of nothing.
    """
    if not by:
        raise ValueError("a sequence needs an order")
    level = ordinal(rows.withColumn("_d", F.sha2(F.coalesce(line.cast("string"), F.lit("")), 256)), *by, name="_n").select("_n", "_d")
    left = level.count()
    if not left:
        return rows.sparkSession.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
    while True:
        digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_d"))), lambda x: x["_d"]), "\n"), 256)
        level = level.groupBy(F.floor(F.col("_n") / fan).alias("_n")).agg(digest.alias("_d"))
        left = -(-left // fan)
        if left == 1:
            return level.first()["_d"]
