"""Exact deduplication by content sort, in DataFrame operations only.

Sampled splitters range-partition the rows by content, an external sort inside each partition
places equal texts next to one another, and each row is compared in full with its neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.shared import settle

#: A text is hot if it has more than one in so many of all rows; there are fewer hot texts than that, so they may be broadcast.
HOT = 10_000
#: Copies that one task takes in any case.
FEW = 100
PLACE = ["_prefix", "_sha", "_salt"]


def _order(keep: str):
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be largest or smallest, not {keep!r}")
    return F.desc_nulls_last if keep == "largest" else F.asc_nulls_last


def _sorted(rows: DataFrame, text: Column, first, prefix: int) -> DataFrame:
    """``rows`` (doc_id and others) in the order of their content, with _sha, _salt (null but for hot texts) and _starts:
    whether a row's text differs from that of the row before it."""
    sha = F.unhex(F.sha2(text, 256))
    limit = max(rows.count() // HOT, FEW)
    hot = rows.groupBy(sha.alias("_sha")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select("_sha", F.ceil(F.col("_n") / limit).alias("_salts"))
    placed = rows.withColumns({"_prefix": F.substring(text, 1, prefix), "_sha": sha}).join(F.broadcast(hot), "_sha", "left")
    placed = placed.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), "_salts").cast("int")).drop("_salts")
    before = F.lag(text).over(Window.partitionBy(*PLACE).orderBy(text, first("doc_id")))
    return placed.repartitionByRange(*PLACE).withColumn("_starts", before.isNull() | (before != text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "largest", prefix: int = 32) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The sort key is the first ``prefix`` characters and the text's SHA-256, so the splitters that the sampler sends to the
    driver stay short whatever the texts' length. Which texts are equal is decided by comparing neighbours in
    full; the digest only brings them together. A text of more than one in ``HOT`` of all rows also has a
    salt, so its copies are many runs in many partitions; the first rows of these runs, one for each
    salt, are compared in full in the same way afterwards. Texts are shuffled once; what is written
    and joined after that holds no text but those of the hot runs' first rows.

    Null text counts as empty. Null ids lose to any other id; a group of null ids keeps one row.
    Repeated rows (equal id and text) are one group and one of them stays. An empty table gives an
    empty result. A very long text is compared by one task. Other columns of the input are ignored, whatever their names.

    ``normalise`` maps the text column to the text that is compared; without one, texts are compared
    as they are. ``keep`` is "largest" or "smallest".
    """
    first = _order(keep)
    text: Column = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), (normalise(text) if normalise else text).alias("_text"))
    text = F.col("_text")
    in_place = Window.partitionBy(*PLACE).orderBy(text, first("doc_id")).rowsBetween(Window.unboundedPreceding, 0)
    runs = _sorted(rows, text, first, prefix).withColumn("_run", F.sum(F.col("_starts").cast("int")).over(in_place))
    runs = runs.withColumn("_head", F.when(F.col("_starts") & F.col("_salt").isNotNull(), text)).drop("_text")
    run = Window.partitionBy(*PLACE, "_run")
    runs = runs.withColumns({"keep_id": F.max(F.when(F.col("_starts"), F.col("doc_id"))).over(run), "group_size": F.count(F.lit(1)).over(run)})
    runs = settle(runs.drop("_prefix"))
    heads = runs.filter("_salt is not null and _starts").select("_sha", "_salt", "_run", "_head", "keep_id", "group_size")
    by_text = Window.partitionBy("_sha").orderBy("_head", first("keep_id"))
    heads = heads.withColumn("_new", F.coalesce((F.lag("_head").over(by_text) != F.col("_head")).cast("int"), F.lit(1)))
    heads = heads.withColumn("_group", F.sum("_new").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("_sha", "_group")
    heads = heads.select("_sha", "_salt", "_run", (F.max if keep == "largest" else F.min)("keep_id").over(group).alias("keep_id"), F.sum("group_size").over(group).alias("group_size"))
    hot = runs.filter("_salt is not null").drop("keep_id", "group_size").join(F.broadcast(heads), ["_sha", "_salt", "_run"])
    columns = ["doc_id", "keep_id", "group_size", (F.col("_starts") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")]
    return runs.filter("_salt is null").select(*columns).union(hot.select(*columns))


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", prefix: int = 32) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns; of repeated rows one.

    The whole rows are sorted by content, in the one shuffle of the texts, and the first of each run goes on. Null, empty and
    very long texts, null ids and empty tables are treated as by ``exact_dedup``; other columns are kept as they
    are, whatever their names.
    """
    first = _order(keep)
    rows = docs.select(docs[id_col].alias("doc_id"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    text: Column = F.coalesce(F.col("_row")[text_col].cast("string"), F.lit(""))
    heads = settle(_sorted(rows, text, first, prefix).filter("_starts").select("doc_id", "_row", "_sha", "_salt"))
    before = F.lag(text).over(Window.partitionBy("_sha").orderBy(text, first("doc_id")))
    hot = heads.filter("_salt is not null").withColumn("_new", before.isNull() | (before != text)).filter("_new")
    return heads.filter("_salt is null").select("_row.*").union(hot.select("_row.*"))
