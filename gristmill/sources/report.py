"""Tables of results as Markdown, and the checks that come before results."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown_rows(table: DataFrame, columns: dict[str, tuple[str, str | None]], *order: str | Column) -> DataFrame:
    """n, line: a Markdown table of a result: a heading, a rule and a line a row in the order given.

    ``columns`` has for each column its heading and a printf format, or None for the value as text; what is missing is '-'. A bar in a value is
    escaped, a line end becomes a space. A result of groups is a few rows, which one task puts into order.
    """
    heading = "| " + " | ".join(title for title, _ in columns.values()) + " |"
    cells = []
    for name, (_, pattern) in columns.items():
        value = F.format_string(pattern, F.col(name)) if pattern else F.col(name).cast("string")
        cells.append(F.when(F.col(name).isNull(), "-").otherwise(F.regexp_replace(F.replace(value, F.lit("|"), F.lit("\\|")), r"\s*[\r\n]+\s*", " ")))
    lines = table.orderBy(*order).coalesce(1).select((F.monotonically_increasing_id() + 2).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    top = table.sparkSession.createDataFrame([(0, heading), (1, "|" + "---|" * len(columns))], "n long, line string")
    return top.union(lines)


def write_markdown(lines: DataFrame, path: str) -> None:
    """The lines (n, line) in order, as one text file in a folder."""
    lines.orderBy("n").coalesce(1).select("line").write.mode("overwrite").text(path)


def write_json(table: DataFrame, path: str, *order: str | Column) -> None:
    """A result as JSON lines in order, in one file of a folder; nulls are written."""
    table.orderBy(*order).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def check_evaluation(questions: DataFrame, corpus: DataFrame) -> None:
    """Raises ValueError if there is no question, or one whose right answer (positive_id) the corpus (id) lacks."""
    if questions.isEmpty():
        raise ValueError("there are no questions")
    gone = questions.join(corpus.select(F.col("id").alias("positive_id")), "positive_id", "left_anti")
    if some := gone.select("positive_id").limit(1).collect():
        raise ValueError(f"{gone.count()} right answers are not in the corpus, such as {some[0].positive_id!r}; filter the questions first")


def check_filtered(counts: DataFrame, kept: DataFrame, strict: bool = False) -> None:
    """Raises ValueError if filtering has left no question, or with ``strict`` if it has left out any (counts: missing_positive)."""
    if strict and (missing := counts.first()["missing_positive"]):
        raise ValueError(f"{missing} questions have a right answer that the corpus lacks")
    if kept.isEmpty():
        raise ValueError("no question is left; are questions and corpus of one version?")


def model_key(spark: SparkSession, name: str, checkpoint: str | None = None) -> str:
    """What an index calls its model: the last part of its name; of a checkpoint's folder its name and when its weights were last written (UTC)."""
    if checkpoint is None:
        return PurePosixPath(name).name
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    weights = [s.getModificationTime() for s in store.listStatus(place) if s.getPath().getName().endswith((".safetensors", ".bin"))]
    when = max(weights, default=store.getFileStatus(place).getModificationTime())
    return f"{place.getName()}-{datetime.fromtimestamp(when / 1000, UTC):%Y%m%d%H%M%S}"
