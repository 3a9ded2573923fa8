"""Readers and writers of corpora, questions, labels, splits, indexes and manifests."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from gristmill.operators.order import sequence_digest

CORPUS = "id string, title string, text string, category string, theme string, law_name string, law_type string, article_no string, article_title string, chapter string, promulgation_date string, effective_date string, source_url string, parent_id string, paragraph string"
QUESTION = "query string, positive_id string, hard_negative_ids array<string>, query_type string, answer string, related_ids array<string>"
LABEL = "qid string, alt_positive_ids array<string>, partial_ids array<string>"


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).option("multiLine", True).json(path)


def load_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of one or more files with their file and line, in whose order they stand; blank lines are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    return lines.filter(F.trim("raw") != "").select("file", "line", F.from_json("raw", schema).alias("r")).select("file", "line", "r.*")


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    return load_lines(spark, path, QUESTION)


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels, the last of each qid."""
    last = Window.partitionBy("qid").orderBy(F.desc("file"), F.desc("line"))
    return load_lines(spark, path, LABEL).withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("qid", "alt_positive_ids", "partial_ids")


def statute_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of one split; none, with a question's columns, where nothing was written."""
    if not exists(spark, path):
        return spark.createDataFrame([], QUESTION)
    return spark.read.parquet(path).filter(F.col("split") == name).drop("split")


def duplicate_ids(docs: DataFrame) -> DataFrame:
    return docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def corpus_hash(docs: DataFrame, order: list[str] | None = None) -> str:
    """A digest of a corpus, its rows' columns by name and their order: that of ``order``, or of ids and of rows of one id.

    A tree of digests over ranges of rows: no task holds more than a few thousand of them.
    """
    line = F.to_json(F.struct(*sorted(docs.columns)), {"ignoreNullFields": "false"})
    by = order or (["id"] if "id" in docs.columns else [])
    return sequence_digest(docs, line, *by, F.sha2(line, 256))[:16]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _manifest(spark: SparkSession, path: str):
    """The last row of an index's manifest, if there is one."""
    if not exists(spark, f"{path}/manifest"):
        return None
    return spark.read.schema("version long, folder string, model_key string, corpus_hash string").parquet(f"{path}/manifest").orderBy(F.desc("version")).first()


def build_index(docs: DataFrame, embed: Callable[[list[str]], list], path: str, model_key: str, batch: int = 64, order: list[str] | None = None) -> bool:
    """Embed documents (id, text, ...) into a Parquet index with a manifest; False if it is up to date: same model, rows and order of rows.

    Duplicate ids are refused before anything is embedded. Texts of like length are embedded together. Rows go to
    a new folder, and a row that names it is appended to the manifest last: a broken build leaves the index that was there.
    """
    bad = duplicate_ids(docs).orderBy("id").limit(3).collect()
    if bad:
        raise ValueError(f"{duplicate_ids(docs).count()} duplicate ids, such as {[r.id for r in bad]}")
    spark, digest = docs.sparkSession, corpus_hash(docs, order)
    have = _manifest(spark, path)
    if have and (have.model_key, have.corpus_hash) == (model_key, digest):
        return False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for first in range(0, len(df), batch):
                part = df.iloc[first : first + batch].copy()
                part["embedding"] = [list(map(float, v)) for v in embed(part["text"].fillna("").tolist())]
                yield part

    schema = StructType([*docs.schema.fields, StructField("embedding", ArrayType(FloatType()))])
    folder = f"docs-{uuid.uuid4().hex}"
    docs.sortWithinPartitions(F.length("text")).mapInPandas(run, schema).write.parquet(f"{path}/{folder}")
    row = [((have.version if have else 0) + 1, folder, model_key, digest)]
    spark.createDataFrame(row, "version long, folder string, model_key string, corpus_hash string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return True


def open_index(spark: SparkSession, path: str) -> DataFrame:
    have = _manifest(spark, path)
    if have is None:
        raise FileNotFoundError(f"no index in {path}; build one first")
    return spark.read.parquet(f"{path}/{have.folder}")
