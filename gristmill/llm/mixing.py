"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.shared import settle

#: What counts as a word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text column; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fair_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """``target`` words for each row of ``sizes`` (source, source_size; one row per source).

    Sources in code-point order, null last, take the weights in turn. The budget is ``share`` of all
    sizes. A target stops at ``epochs`` times its source's size and the excess goes to the others by
    weight. That is water filling: with the sources in the order in which they fill up (cap by
    weight), the level that the last ones reach follows from running sums, so no loop is needed. The
    windows see one row per source.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    whole = Window.partitionBy()
    rows = sizes.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * F.lit(float(epochs))).alias("_cap"), (F.sum("source_size").over(whole) * F.lit(float(share))).alias("_budget"))
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    earlier, here_on = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("_w").over(here_on)
    rows = rows.withColumn("_level", level)
    # Levels only fall once a source stays below its cap, so the highest such level is the final one.
    final = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(whole)
    return rows.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(final * F.col("_w"), F.col("_cap"))).alias("target"))


def _services(numbered: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, epochs: int, seed: str) -> DataFrame:
    """One row for each part of a service of a document, without its text: doc_id, source, epoch, size, source_size, target,
    words, finish_time, inside.

    Running sums do not gather a source in one place: leading digits of the shuffle's digest cut each source into shards of
    some ten thousand rows, a shard's offset comes from the shards' sums, and only a shard is sorted by one task.
    """
    digits = max(1, min(7, math.ceil(math.log(max(numbered.count(), 1) / 65_536 + 1, 16))))
    own = F.col("row")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(own[id_col].cast("string"), F.lit("null"))))
    sized = numbered.select(
        own[id_col].alias("doc_id"),
        F.coalesce(own[source_col].cast("string"), F.lit("")).alias("_source"),
        own[source_col].isNull().alias("_null"),
        word_count(own[text_col].cast("string")).alias("size"),
        digest.alias("_order"),
        F.substring(digest, 1, digits).alias("_shard"),
        _content(numbered).alias("_content"),
        F.col("row_key").alias("_key"),
    )
    shard = ["_source", "_null", "_shard"]
    sized = sized.repartition(*shard)
    shards = sized.groupBy(*shard).agg(F.sum("size").alias("_words"))
    of_source = Window.partitionBy("_source", "_null")
    before = of_source.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("_offset", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    sizes = shards.groupBy("_source", "_null").agg(F.sum("_words").alias("source_size"))
    sizes = sizes.select(F.when(~F.col("_null"), F.col("_source")).alias("source"), "source_size")
    targets = fair_targets(sizes, weights, share, epochs)
    targets = targets.select(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_null"), "source_size", "target", F.sum(F.floor("target")).over(Window.partitionBy()).alias("_budget"))
    shards = shards.drop("_words").join(targets, ["_source", "_null"])
    in_shard = Window.partitionBy(*shard).orderBy("_order", "doc_id", "size", "_content", "_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = sized.withColumn("_sum", F.sum("size").over(in_shard)).join(shards, shard)
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    # From the first to the last word served, counted in the source; the part before virtual time 1 and the part after it.
    end = F.col("_offset") + F.col("_sum") + (F.col("epoch") - 1) * F.col("source_size")
    start, goal = end - F.col("size"), F.floor("target")
    parts = F.array(
        F.struct((F.least(end, goal) - start).alias("words"), F.lit(True).alias("inside")),
        F.struct((end - F.greatest(start, goal)).alias("words"), F.lit(False).alias("inside")),
    )
    rows = rows.withColumn("_part", F.explode(F.when(F.col("size") > 0, F.filter(parts, lambda p: p["words"] > 0)).otherwise(F.slice(parts, 1, 1))))
    inside = F.col("_part.inside")
    return rows.select(
        "doc_id",
        F.when(~F.col("_null"), F.col("_source")).alias("source"),
        "epoch",
        "size",
        "source_size",
        "target",
        F.greatest(F.col("_part.words"), F.lit(0)).alias("words"),
        F.when(inside & (end > goal), 1.0).otherwise(end / F.nullif(F.col("target"), F.lit(0.0))).alias("finish_time"),
        inside.alias("inside"),
        "_budget",
        "_order",
        "_content",
        "_key",
    )


def _is_table(docs: DataFrame) -> bool:
    """Whether the rows are those of Parquet files, some of them perhaps, one row of the files for each: read again they are the same."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.deterministic():
        node = node.children().head()
    if node.nodeName() != "LogicalRelation":
        return False
    try:
        return docs.select("_metadata.file_path", "_metadata.row_index").schema is not None
    except AnalysisException:  # files of another kind
        return False


def _numbered(docs: DataFrame) -> DataFrame:
    """row_key, row: every row with its file (128 bits of the digest of the path) and its place in the file, which no other row has.

    What isn't a table of files is written as one first: else a row could have another number when its text is fetched.
    """
    docs = docs if _is_table(docs) else settle(docs)
    key = F.struct(F.unhex(F.md5("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("at"))
    return docs.select(key.alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _content(rows: DataFrame) -> Column:
    """A hash of whole rows, by which rows of one id are ordered alike in every run; maps, which have no hash, as JSON."""
    fields = rows.schema["row"].dataType.fields
    return F.xxhash64(*[F.to_json(F.struct(F.col("row")[f.name])) if "map<" in f.dataType.simpleString() else F.col("row")[f.name] for f in fields])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """One row for each part of a service of a document: doc_id, source, epoch, size, source_size, target, words,
    finish_time, position (its first word's place in the global order), taken, row_key.

    Each source is shuffled by a seeded digest of the document's id. A service's virtual finish time
    is the source's words served so far, this document included, divided by the source's target. Each source is served
    ``epochs`` times. All services are range-sorted by virtual finish time, a running sum of their words goes over the
    ranges, and the order is truncated at the total budget: what lies beyond it takes 0. The budget is the sum of the
    targets, rounded down each. Since they are all met at virtual time 1, the one document of a source that is
    being served then counts as two parts, of which the first finishes at 1: each source's words are its target rounded down,
    not up to a document more or less.

    What is shuffled and sorted holds no text; words are counted in one pass over the texts.

    Null text has size 0, and documents of size 0 take 0. Null sources are one source, the last. Null
    ids and repeated rows are ordered by their digest and are served one after the other. An empty
    table gives an empty result. Very long texts are counted as others. Other columns are ignored, whatever their names.
    Reruns agree.
    """
    return _mix(_numbered(docs), id_col, text_col, source_col, weights, share, epochs, seed)


def _mix(numbered: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    services = _services(numbered, id_col, text_col, source_col, weights, share, epochs, seed)
    by = ["finish_time", F.desc("inside"), "source", "_order", "doc_id", "epoch", "_content", "_key"]
    ranged = settle(services.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    ranges = ranged.groupBy("_range").agg(F.sum("words").alias("_words"))
    # One row for each range and one for each source: as few as there are partitions and sources.
    ranges = ranges.select("_range", F.coalesce(F.sum("_words").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    in_range = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_upto", F.sum("words").over(in_range)).join(F.broadcast(ranges), "_range")
    position = F.col("_before") + F.col("_upto") - F.col("words")
    taken = F.greatest(F.least(F.col("words"), F.col("_budget") - position), F.lit(0))
    return placed.select("doc_id", "source", "epoch", "size", "source_size", "target", "words", "finish_time", position.alias("position"), taken.alias("taken"), F.col("_key").alias("row_key"))


def mix_report(mixed: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, with the services of a document added up.

    Repeated rows of one id add up in size and in taken.
    """
    per = mixed.groupBy("doc_id", "source", "source_size", "target").agg(F.sum(F.when(F.col("epoch") == 1, F.col("words")).otherwise(F.lit(0))).alias("size"), F.sum("taken").alias("taken"))
    return per.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    A document that is served twice is there twice. The last one of a source is cut to the words that are
    taken of it (then joined by single spaces); n_chars, where there is one, follows. Repeated rows are rows like others, each served by itself; so are rows that differ in a map alone. Null and empty texts have no words and are not served; null ids and sources are
    served like others; an empty table gives an empty result; other columns are kept, whatever their names.

    Services are sorted and truncated without texts. Then texts are shuffled once, to meet their services: each part of the result is a
    random slice of the global order of virtual finish times, and in that order.
    """
    numbered = _numbered(docs)
    mixed = _mix(numbered, id_col, text_col, source_col, **parameters).filter("taken > 0").select("row_key", "position", "taken", "size")
    served = numbered.join(mixed, "row_key")
    text = F.col("row")[text_col].cast("string")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), 1, F.col("taken").cast("int")), " ")
    changed = {text_col: cut} | ({"n_chars": F.length(cut).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    whole = F.col("taken") == F.col("size")
    columns = [F.when(whole, F.col("row")[c]).otherwise(changed[c]).alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns]
    return served.sortWithinPartitions("position").select(*columns)
