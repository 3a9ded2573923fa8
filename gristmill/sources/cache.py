"""An append-only table with keys that occur once: answers that cost something are asked for once and kept.

Every append is a folder of its own. The folder's success mark, written last, makes its rows seen, so a run that is killed leaves nothing
behind, and one that is repeated asks only for what is missing. Readers keep the first row of a key, by batch, should two
writers have asked for it at once. Compaction writes all rows into one folder, which from then on stands for those before it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gristmill.operators.order import ordinal

EXPANSION = "query string, expansion string, llm string, input_tokens long, output_tokens long, latency_s double"


class Cache:
    """Rows of a schema, one for each value of ``keys``, in the folder ``path`` of any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema: StructType = spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._store = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self) -> list[str]:
        """Names of the folders that count, in order: the last compacted one and what has been appended since."""
        if not self._store.exists(self._path(self.path)):
            return []
        names = sorted(s.getPath().getName() for s in self._store.listStatus(self._path(self.path)))
        done = [n for n in names if "-" in n and self._store.exists(self._path(f"{self.path}/{n}/_SUCCESS"))]
        whole = [n for n in done if "-all-" in n]
        return done[done.index(whole[-1]) :] if whole else done

    def read(self) -> DataFrame:
        """All rows, the first of each key."""
        names = self._batches()
        if not names:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names])
        if len(names) == 1:
            return rows
        place = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
        first = Window.partitionBy(*self.keys).orderBy("_batch")
        return rows.withColumn("_batch", place).withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*self.schema.names)

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` (keys and more) whose keys the cache lacks, one for each. Null keys are none."""
        return wanted.dropna(subset=self.keys).dropDuplicates(self.keys).join(self.read().select(*self.keys), self.keys, "left_anti")

    def _name(self, kind: str) -> str:
        return f"{time.time_ns():020d}-{kind}-{uuid.uuid4().hex}"

    def append(self, rows: DataFrame) -> None:
        """Add rows whose keys the cache lacks; others change nothing."""
        self.missing(rows).select(*self.schema.names).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/{self._name('part')}")

    def compact(self) -> None:
        """Write all rows as one batch, then drop those that it stands for. Killed in between, it leaves only folders that no longer count."""
        names = self._batches()
        if len(names) < 2:
            return
        # The name sorts behind what it holds and before whatever is appended meanwhile.
        name = f"{names[-1].split('-')[0]}-z-all-{uuid.uuid4().hex}"
        self.read().write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/{name}")
        for old in names:
            self._store.delete(self._path(f"{self.path}/{old}"), True)


def search_text(query, expansion):
    """What is searched for: the question and then its expansion."""
    return F.trim(F.concat_ws(" ", query, expansion))


def expand_queries(queries: DataFrame, cache: Cache, generate: Callable[[str], tuple[str, int, int]], llm: str, query_col: str = "query", order_col: str | None = None) -> DataFrame:
    """query, expansion, llm, input_tokens, output_tokens, latency_s of each distinct question, n being its place in their first occurrences' order.

    ``cache`` has the schema EXPANSION and the keys llm and query. ``generate`` (text, input and output tokens for a question) runs in tasks, only for
    questions that the cache lacks for this model, and its answers are kept before anything is returned. White space in
    answers is squeezed. Without ``order_col`` the order is that of the questions.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query in batch["query"]:
                began = time.perf_counter()
                text, read, written = generate(query)
                rows.append((query, " ".join(text.split()), llm, read, written, time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["query", "expansion", "llm", "input_tokens", "output_tokens", "latency_s"])

    asked = queries.select(F.col(query_col).alias("query"), F.col(order_col or query_col).alias("_order")).dropna(subset=["query"]).groupBy("query").agg(F.min("_order").alias("_order"))
    missing = cache.missing(asked.select("query", F.lit(llm).alias("llm")))
    if not missing.isEmpty():
        cache.append(missing.select("query").mapInPandas(run, EXPANSION))
    found = cache.read().filter(F.col("llm") == llm)
    return ordinal(asked.join(found, "query"), "_order", "query", name="n").select("n", *found.columns)
