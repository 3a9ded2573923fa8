"""Retrieval judgements, metrics, reports and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.order import settle

METRICS = ("r1", "r5", "r10", "mrr10", "ndcg10")


def relevance_key(parent: Column, own: Column) -> Column:
    return F.coalesce(F.nullif(parent, F.lit("")), own)


def first_rank(ranked: DataFrame, relevant: DataFrame, key: str = "key") -> DataFrame:
    """qid, rank: place of the relevant key (qid, key) among the distinct keys of a ranking (qid, key, rank), each at its first place."""
    firsts = ranked.groupBy("qid", key).agg(F.min("rank").alias("first"))
    placed = firsts.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("first")))
    return placed.join(relevant, ["qid", key]).groupBy("qid").agg(F.min("place").alias("rank"))


def without(ranked: DataFrame, ignored: DataFrame) -> DataFrame:
    """The ranking without ignored rows (qid, id), ranked anew; nothing moves up from beyond its depth."""
    order = Window.partitionBy("qid").orderBy("rank")
    return ranked.join(ignored, ["qid", "id"], "left_anti").withColumn("rank", F.row_number().over(order))


def metrics(rank: Column) -> list[Column]:
    """Metrics of one rank; a miss (null) is 0 throughout."""
    hit = lambda k: F.when(rank <= k, 1.0).otherwise(0.0)
    return [
        hit(1).alias("r1"),
        hit(5).alias("r5"),
        hit(10).alias("r10"),
        F.when(rank <= 10, 1.0 / rank).otherwise(0.0).alias("mrr10"),
        F.when(rank <= 10, 1.0 / F.log2(rank + 1.0)).otherwise(0.0).alias("ndcg10"),
    ]


def per_question(ranked: DataFrame, positives: DataFrame, alternatives: DataFrame, ignored: DataFrame, partial: DataFrame, keys: DataFrame) -> DataFrame:
    """qid, doc_rank, article_rank, multi_rank of every question with a positive (qid, id).

    ``ignored`` rows leave all judgements, ``partial`` ones the multi-answer judgement; ``keys`` (id, key) names
    each row's article, and a row that it lacks is its own. A question's ranking fits a row: it has a depth. What is said of its
    rows is gathered once, and the three judgements are read off the one list.
    """
    bit = lambda df, n: df.select("qid", "id", F.lit(n).alias("_bit"))
    marks = bit(ignored, 1).union(bit(partial, 2)).union(bit(positives, 4)).union(bit(alternatives, 8)).groupBy("qid", "id").agg(F.bit_or("_bit").alias("_bits"))
    key = F.coalesce("key", F.col("id").cast("string"))
    wanted = positives.join(keys, "id", "left").groupBy("qid").agg(F.collect_set(key).alias("_wanted"))
    rows = ranked.select("qid", "id", "rank").join(marks, ["qid", "id"], "left").join(keys, "id", "left")
    rows = rows.select("qid", F.struct("rank", key.alias("key"), F.coalesce("_bits", F.lit(0)).alias("bits")).alias("_r")).filter(F.col("_r.bits").bitwiseAND(1) == 0)
    lists = rows.groupBy("qid").agg(F.array_sort(F.collect_list("_r")).alias("_s"))
    place = lambda found: F.nullif(F.array_position(found, True), F.lit(0)).cast("int")
    has = lambda x, bits: x["bits"].bitwiseAND(bits) > 0
    articles = F.transform(F.array_distinct(F.transform("_s", lambda x: x["key"])), lambda k: F.array_contains("_wanted", k))
    return wanted.join(lists, "qid", "left").select(
        "qid",
        place(F.transform("_s", lambda x: has(x, 4))).alias("doc_rank"),
        place(articles).alias("article_rank"),
        place(F.transform(F.filter("_s", lambda x: ~has(x, 2)), lambda x: has(x, 12))).alias("multi_rank"),
    )


def report(questions: DataFrame, groups=()) -> DataFrame:
    """judge, group_kind, grp, n and mean metrics: over all questions and by each group; missing groups are 'unknown'."""
    judged = questions.select("qid", *groups, F.explode(F.array(*[F.struct(F.lit(j).alias("judge"), F.col(f"{j}_rank").alias("rank")) for j in ("doc", "article", "multi")])).alias("j"))
    rows = judged.select("j.judge", *[F.coalesce(F.nullif(F.col(g).cast("string"), F.lit("")), F.lit("unknown")).alias(g) for g in groups], *metrics(F.col("j.rank")))
    kinds = F.array(F.struct(F.lit("all").alias("kind"), F.lit("all").alias("grp")), *[F.struct(F.lit(g).alias("kind"), F.col(g).alias("grp")) for g in groups])
    rows = rows.withColumn("g", F.explode(kinds))
    return rows.groupBy("judge", F.col("g.kind").alias("group_kind"), F.col("g.grp").alias("grp")).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def average_precision(ranked: DataFrame, relevant: DataFrame, k: int = 10, many: DataFrame | None = None) -> DataFrame:
    """qid, ap: average precision at k; relevant: (qid, id). ``many`` (qid, m) is how many are relevant where ``relevant`` has ranked ones only."""
    hits = ranked.filter(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    so_far = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    scored = hits.withColumn("p", F.when(F.col("hit") == 1, F.sum("hit").over(so_far) / F.col("rank")))
    many = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("m")) if many is None else many
    return many.join(scored.groupBy("qid").agg(F.sum("p").alias("s")), "qid", "left").select("qid", (F.coalesce("s", F.lit(0.0)) / F.least("m", F.lit(k))).alias("ap"))


def rank_bucket(rank: Column) -> Column:
    return F.when(rank <= 5, "1-5").when(rank <= 10, "6-10").when(rank <= 30, "11-30").when(rank <= 100, "31-100").otherwise("beyond")


def compare(base: DataFrame, other: DataFrame, judge: str = "doc", k: int = 5) -> DataFrame:
    """qid, base_hit, other_hit, outcome of two judged runs over the same questions; raises if these differ."""
    rank = f"{judge}_rank"
    hits = lambda df, n: df.select("qid", (F.coalesce(F.col(rank) <= k, F.lit(False))).cast("int").alias(n))
    both = settle(hits(base, "base_hit").join(hits(other, "other_hit"), "qid", "full_outer"))  # looked at, then used
    odd = both.agg(F.count("base_hit").alias("a"), F.count("other_hit").alias("b"), F.count(F.when(F.col("base_hit").isNotNull() & F.col("other_hit").isNotNull(), 1)).alias("c")).first()
    if not odd.a == odd.b == odd.c:
        raise ValueError(f"different questions: {odd.a}, {odd.b}, {odd.c} in both")
    outcome = F.when((F.col("base_hit") == 0) & (F.col("other_hit") == 1), "fixed").when((F.col("base_hit") == 1) & (F.col("other_hit") == 0), "broken").when(F.col("base_hit") == 1, "both_right").otherwise("both_wrong")
    return both.withColumn("outcome", outcome)


def relation(right: Column, wrong: Column) -> Column:
    """How a wrong answer relates to the right one (structs of article, law, kind, theme); missing values are equal to one another."""
    same = lambda name: right[name].eqNullSafe(wrong[name])
    return F.when(same("article"), "same_article").when(same("law") & same("kind"), "same_law_same_type").when(same("law"), "same_law_other_type").when(same("theme"), "other_law_same_theme").otherwise("other_law_other_theme")


# Fixed value: how a text names an article of its law.
NAMES_ARTICLE = r"법\s*(제\d+조(?:의\d+)?)"


def delegation(right: Column, wrong: Column, right_text: Column, right_no: Column, wrong_text: Column, wrong_no: Column) -> Column:
    """The same in six kinds: rules of one law but of different kinds are apart if one names the other's article."""
    names = lambda text, no: F.array_contains(F.regexp_extract_all(text, F.lit(NAMES_ARTICLE), 1), no)
    linked = names(right_text, wrong_no) | names(wrong_text, right_no)
    kind = relation(right, wrong)
    return (
        F.when(kind == "same_article", "same article")
        .when((kind == "same_law_other_type") & linked, "same law, delegated")
        .when(kind == "same_law_other_type", "same law, other kind")
        .when(kind == "same_law_same_type", "same law and kind")
        .when(kind == "other_law_same_theme", "same theme")
        .otherwise("other theme")
    )
