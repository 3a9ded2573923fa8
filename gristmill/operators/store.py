"""Notebook state and dataset versions as append-only tables."""

from __future__ import annotations

import difflib
import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gristmill.operators.order import ordinal, shared_folder


def latest(log: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key by ``order`` (a list of descending columns)."""
    place = Window.partitionBy(*key).orderBy(*order)
    return log.withColumn("_n", F.row_number().over(place)).filter("_n = 1").drop("_n")


def current(log: DataFrame, key: str = "id", order=("ts", "seq"), parents: DataFrame | None = None, parent: str | None = None) -> DataFrame:
    """Rows that are not deleted as of the last change; those whose parent (key) is gone go too."""
    rows = latest(log, [key], [F.desc(c) for c in order]).filter("not deleted")
    return rows if parents is None else rows.join(parents.select(F.col(key).alias(parent)), parent, "left_semi")


def history(messages: DataFrame, last: int = 6) -> DataFrame:
    """The last messages (conv_id, turn, role, text) of each conversation, in order."""
    place = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= last).drop("_n")


def diff_files(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """name, change between two file lists (name, sha): missing, added or changed."""
    both = ours.select("name", F.col("sha").alias("a")).join(theirs.select("name", F.col("sha").alias("b")), "name", "full_outer")
    change = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return both.select("name", change.alias("change")).filter("change is not null")


def match_versions(files: DataFrame, versions: DataFrame) -> DataFrame:
    """name, version: the earliest version (version, sha) that holds each file's content (name, sha)."""
    number = F.struct(F.length("version"), "version")
    return files.join(versions, "sha").groupBy("name").agg(F.min_by("version", number).alias("version"))


def missing_from_cache(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return rows.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def as_of(commits: DataFrame, at: str) -> DataFrame:
    """The last commit (name, ts, seq, ...) of each name up to a time."""
    return latest(commits.filter(F.col("ts") <= F.lit(at).cast("timestamp")), ["name"], [F.desc("ts"), F.desc("seq")])


def sum_digest(sha: Column) -> Column:
    """An aggregate digest that does not depend on order: the sum of the digests' first 48 bits, as text."""
    return F.sum(F.conv(F.substring(sha, 1, 12), 16, 10).cast("decimal(20,0)")).cast("string")


def stream_digest(rows: DataFrame, by: list[str], order: list, line: Column, between: str = "\n") -> DataFrame:
    """by, sha: the SHA-256 of each group's lines in order, ``between`` them; a null line counts as empty.

    That digest is made from left to right, so a group's lines pass through one task; they are sorted by Spark and streamed, and a task holds
    a batch of them and one unfinished digest, however long the group is. ``order.sequence_digest`` has a digest whose work spreads.
    """
    kinds = {n: rows.schema[n].dataType for n in by}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def finished() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[k.slice(0, 1) for k in key[1]], pa.array([digest.hexdigest()])], [*by, "sha"])

        for batch in batches:
            columns = [batch.column(n) for n in by]
            names = list(zip(*[c.to_pylist() for c in columns], strict=True)) if by else [()] * batch.num_rows
            for i, text in enumerate(batch.column("_line").cast(pa.binary()).to_pylist()):
                if key is None or key[0] != names[i]:
                    if key is not None:
                        yield finished()
                    key, digest = (names[i], [c.slice(i, 1) for c in columns]), hashlib.sha256()
                else:
                    digest.update(between.encode())
                digest.update(text)
        if key is not None:
            yield finished()

    keyed = rows.select(*by, *[(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)], F.coalesce(line, F.lit("")).alias("_line"))
    orders = [f"_o{i}" for i in range(len(order))]
    dealt = (keyed.repartition(*by) if by else keyed.coalesce(1)).sortWithinPartitions(*by, *orders)
    schema = StructType([*[StructField(n, t) for n, t in kinds.items()], StructField("sha", StringType())])
    return dealt.select(*by, "_line").mapInArrow(run, schema)


def folder_digest(files: DataFrame, by: list[str]) -> DataFrame:
    """by, sha: one digest of each folder's files (by, name, sha), from their lines in the order of names."""
    return stream_digest(files, by, ["name"], F.concat("name", F.lit(" "), "sha", F.lit("\n")), between="")


def _plain(value):
    """A value as JSON has it: maps as objects, what JSON lacks as text."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        # Arrow gives a map as pairs; lists of lists come as lists.
        return {str(k): _plain(v) for k, v in value} if value and all(isinstance(x, tuple) for x in value) else [_plain(x) for x in value]
    return value if value is None or isinstance(value, bool | int | float | str) else str(value)


def canonical_json(rows: DataFrame, names: list[str] | None = None, raw: str | None = None, out: str = "json") -> DataFrame:
    """The rows with ``out``: their columns (``names``, or all) as a line of JSON, keys sorted at every depth, ", " and ": " between, nothing escaped
    that needn't be.

    Lists, nulls, floats and nested values are written as Python's json writes them. ``raw`` names a column of JSON text to
    take instead: then a key that a record lacks stays away, which a column can only show as null. Text that is no JSON gives null.
    """
    names = names or rows.columns
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if raw is None:
                values = [{n: _plain(v) for n, v in row.items()} for row in batch.select(names).to_pylist()]
                lines = [json.dumps(v, ensure_ascii=False, sort_keys=True) for v in values]
            else:
                lines = [_canonical(text) for text in batch.column(raw).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(lines, pa.string())], [*kept, out])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, StringType())]))


def _canonical(text: str | None) -> str | None:
    try:
        return json.dumps(json.loads(text or ""), ensure_ascii=False, sort_keys=True)
    except ValueError:
        return None


def questions_digest(questions: DataFrame, by: list[str], order: str, raw: str | None = None) -> DataFrame:
    """by, digest: twelve characters of the digest of each list of questions in order, a line of canonical JSON each.

    The order column is a column like others unless ``raw`` names their JSON text.
    """
    lines = canonical_json(questions, raw=raw, out="_json")
    return stream_digest(lines, by, [order], F.col("_json")).select(*by, F.substring("sha", 1, 12).alias("digest"))


def check_names(asked: DataFrame, known: DataFrame) -> DataFrame:
    """law, status, similar: whether the laws that are asked for are known, and for others the known names that contain them.

    ``asked`` is a request's list of names: a few rows.
    """
    names = known.select(F.col("law").alias("_known")).distinct()
    near = names.join(F.broadcast(asked.select("law").distinct()), F.contains("_known", "law")).groupBy("law").agg(F.max(F.col("_known") == F.col("law")).alias("_there"), F.array_join(F.array_sort(F.collect_list("_known")), ",").alias("_names"))
    there = F.coalesce("_there", F.lit(False))
    return asked.join(near, "law", "left").select("law", F.when(there, "known").otherwise("unknown").alias("status"), F.when(~there, F.col("_names")).alias("similar"))


def suggest_names(asked: DataFrame, known: DataFrame, most: int = 5, close: int = 3, cutoff: float = 0.6) -> DataFrame:
    """law, similar: for each name asked for that is not known, up to ``most`` known ones: those that contain it, by name, and then the ``close``
    ones of largest similarity of at least ``cutoff``, each once.

    The similarity is twice the length of the longest matching blocks by the length of both names. It is worked out only for names whose lengths
    and numbers of equal characters allow the cutoff: bounds that are counted for all names of a batch at once. ``asked`` is a
    request's list of names, of which there may be ten thousand (else ValueError); the known ones may be any number. Nulls are no names.
    """
    names = [r.law for r in asked.select("law").dropna().distinct().limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("more than 10,000 names are asked for")
    spark, all_known = known.sparkSession, known.select(F.col("law").alias("_known")).dropna().distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_known").to_pylist()
            size = np.array([len(t) for t in texts], np.int64)
            points = np.concatenate([np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]) if texts else np.zeros(0, np.uint32)
            owner, out = np.repeat(np.arange(len(texts)), size), []
            for name in names:
                inside = [i for i, t in enumerate(texts) if name in t]
                # Characters that both have, each as often as the one that has it less often.
                common = np.zeros(len(texts), np.int64)
                for c, many in Counter(name).items():
                    common += np.minimum(np.bincount(owner[points == ord(c)], minlength=len(texts)), many)
                best: list[tuple[float, str]] = []
                for i in np.flatnonzero(2 * common >= cutoff * (size + len(name)) - 1e-9):
                    matcher = difflib.SequenceMatcher(None, texts[i], name)
                    if (ratio := matcher.ratio()) >= cutoff:
                        best.append((ratio, texts[i]))
                out += [(name, "", 0.0, texts[i]) for i in inside] + [(name, "close", r, t) for r, t in heapq.nlargest(close, best)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.string()), strict=True)], ["law", "_how", "_ratio", "_known"])

    found = all_known.mapInArrow(run, "law string, _how string, _ratio double, _known string")
    by_name, by_ratio = Window.partitionBy("law").orderBy("_known"), Window.partitionBy("law").orderBy(F.desc("_ratio"), F.desc("_known"))
    inside = found.filter("_how = ''").withColumn("_n", F.row_number().over(by_name)).filter(F.col("_n") <= most)
    near = found.filter("_how = 'close'").withColumn("_n", F.row_number().over(by_ratio)).filter(F.col("_n") <= close).withColumn("_n", F.col("_n") + most)
    lists = inside.union(near).groupBy("law").agg(F.array_sort(F.collect_list(F.struct("_n", "_known"))).alias("_s"))
    unknown = spark.createDataFrame([(n,) for n in names], "law string").join(all_known, F.col("law") == F.col("_known"), "left_anti")
    similar = F.coalesce(F.array_distinct(F.transform(F.slice("_s", 1, most), lambda x: x["_known"])), F.array().cast("array<string>"))
    return unknown.join(lists, "law", "left").select("law", similar.alias("similar"))


def dictionary_codes(rows: DataFrame, value: str, order: str) -> DataFrame:
    """The rows' order column and code: the place of their value among all values in the order in which they first occur. Null is a value."""
    firsts = rows.groupBy(F.col(value).alias("_value")).agg(F.min(order).alias("_first"))
    codes = ordinal(firsts, "_first", "_value", name="code")
    return rows.join(codes, F.col(value).eqNullSafe(F.col("_value"))).select(order, "code")


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """id: everything that can be reached from the start (id) over edges (a, b), each once.

    A round follows the edges of what the round before has found; lineage is cut each round.
    """
    shared_folder(edges.sparkSession)
    found = front = start.select("id").distinct()
    while True:
        front = edges.join(front, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct().join(found, "id", "left_anti").checkpoint()
        if front.isEmpty():
            return found
        found = found.union(front).checkpoint()
