"""Rows for contrastive training: integrity, labels, negatives, triplets, splits, batches, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.order import ordinal, running_sum


def _or_empty(rows: DataFrame, name: str) -> Column:
    """A list column, null being an empty list of its own type."""
    return F.coalesce(F.col(name), F.array().cast(rows.schema[name].dataType))


def filter_questions(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """Questions (qid, positive_id, negatives, related) whose positive is in the corpus (id), with clean negatives.

    Negatives that the corpus lacks, that are related, that are the positive, or that repeat go; order stays.
    dropped counts them.
    """
    kept = questions.join(corpus.select(F.col("id").alias("positive_id")), "positive_id", "left_semi")
    rows = kept.select("qid", "positive_id", _or_empty(kept, "related").alias("related"), F.posexplode_outer("negatives").alias("pos", "neg"))
    there = rows.join(corpus.select(F.col("id").alias("neg"), F.lit(True).alias("there")), "neg", "left")
    ok = F.col("there") & (F.col("neg") != F.col("positive_id")) & ~F.array_contains("related", F.col("neg"))
    good = there.groupBy("qid", "positive_id").agg(F.count("pos").alias("n"), F.sort_array(F.collect_list(F.when(ok, F.struct("pos", "neg")))).alias("s"))
    clean = F.array_distinct(F.transform("s", lambda x: x["neg"]))
    return good.select("qid", "positive_id", clean.alias("negatives"), (F.col("n") - F.size(clean)).alias("dropped"))


def integrity_counts(questions: DataFrame, filtered: DataFrame) -> DataFrame:
    """missing_positive, dropped_negatives: what ``filter_questions`` has left out of the questions and of those that it kept."""
    kept = filtered.agg(F.count(F.lit(1)).alias("_kept"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped_negatives"))
    return questions.agg(F.count(F.lit(1)).alias("_all")).join(kept).select((F.col("_all") - F.col("_kept")).alias("missing_positive"), "dropped_negatives")


def drop_heldout_negatives(train: DataFrame, heldout: DataFrame, keys: DataFrame) -> DataFrame:
    """Training questions (qid, negatives) without negatives whose article (keys: id, key) is a held-out positive's (positive_id).

    An id without an article raises ValueError: the questions have not been filtered. dropped counts a question's negatives that went.
    """
    held = heldout.join(keys.withColumnRenamed("id", "positive_id"), "positive_id", "left")
    rows = train.select("qid", F.posexplode("negatives").alias("pos", "id")).join(keys, "id", "left")
    unknown = held.filter("key is null").select(F.col("positive_id").alias("id")).union(rows.filter("key is null").select("id"))
    if bad := unknown.distinct().limit(3).collect():
        raise ValueError(f"ids that the corpus lacks, such as {[r.id for r in bad]}")
    left = rows.join(held.select("key").distinct(), "key", "left_anti").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("s"))
    joined = train.select("qid", F.size(_or_empty(train, "negatives")).alias("_many")).join(left, "qid", "left")
    kept = F.coalesce(F.transform("s", lambda x: x["id"]), F.array().cast(train.schema["negatives"].dataType))
    return joined.select("qid", kept.alias("negatives"), (F.col("_many") - F.size(kept)).alias("dropped"))


def heldout_counts(dropped: DataFrame) -> DataFrame:
    """train_negatives, dropped_negatives, no_negative_questions (that had some) of what ``drop_heldout_negatives`` gives."""
    had = F.size("negatives") + F.col("dropped")
    emptied = ((F.size("negatives") == 0) & (F.col("dropped") > 0)).cast("long")
    return dropped.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in ((had, "train_negatives"), (F.col("dropped"), "dropped_negatives"), (emptied, "no_negative_questions"))])


def attach_labels(questions: DataFrame, labels: DataFrame, order: str) -> DataFrame:
    """Questions with their labels (qid, ...); of labels of one qid the last by ``order`` wins, unmatched rows stay."""
    last = Window.partitionBy("qid").orderBy(F.desc(order))
    return questions.join(labels.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", order), "qid", "left")


def triplets(questions: DataFrame, per_question: int = 1) -> DataFrame:
    """qid, positive_id, negative_id, i: as many rows as asked for, negatives in turn; questions without any go."""
    n = F.size("negatives")
    rows = questions.filter(n > 0).select("qid", "positive_id", "negatives", F.explode(F.sequence(F.lit(0), F.lit(per_question - 1))).alias("i"))
    return rows.select("qid", "positive_id", F.element_at("negatives", F.pmod(F.col("i"), F.size("negatives")).cast("int") + 1).alias("negative_id"), "i")


def pick_negatives(candidates: DataFrame, keep: int = 3, ceiling: float = 0.95) -> DataFrame:
    """qid, n, id, reason from candidates (qid, id, rank, ratio): ranks 1 to 10 first, then 11 to 30, then in turn again."""
    tier = F.when(F.col("rank") <= 10, 0).otherwise(1)
    good = candidates.filter((F.col("ratio") < ceiling) & (F.col("rank") <= 30)).withColumn("tier", tier)
    lists = good.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("tier", "rank", "id"))).alias("s"))
    rows = lists.select("qid", F.explode(F.sequence(F.lit(0), F.lit(keep - 1))).alias("n"), "s")
    one = F.element_at("s", F.pmod(F.col("n"), F.size("s")).cast("int") + 1)
    reason = F.when(F.col("n") >= F.size("s"), "repeat").when(one["tier"] == 0, "top").otherwise("fill")
    return rows.select("qid", "n", one["id"].alias("id"), reason.alias("reason"))


def hash_unit(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the key and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def split_by_group(counts: DataFrame, test: float = 0.2, dev: float = 0.1, seed: int = 42, least: int = 3) -> DataFrame:
    """law, split: whole laws to test, dev and train, stratified by theme (counts: theme, law, n; one row per law).

    Themes of fewer than ``least`` laws are one stratum. The laws of a stratum stand in hash order, each as wide as its questions; those
    whose middle lies before the share of test are test, and of the others those whose middle lies before the share of dev are
    dev. The last law of each step stays, and a share above 0 that no law falls into gets the smallest one if there
    are two or more. All of it is windows over one row per law.
    """
    laws = F.count(F.lit(1)).over(Window.partitionBy("theme"))
    rows = counts.select("law", "n", F.when(laws >= least, F.col("theme")).alias("_stratum"), hash_unit(F.col("law"), seed).alias("_u"))
    rows = rows.withColumn("_all", F.sum("n").over(Window.partitionBy("_stratum")))

    def deal(rows: DataFrame, share: float) -> DataFrame:
        whole = Window.partitionBy("_stratum")
        order = whole.orderBy("_u", "law")
        upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        inside = (upto - F.col("n") / 2 < F.col("_all") * share) & (F.lead("law").over(order).isNotNull())
        rows = rows.withColumns({"_in": inside, "_few": F.row_number().over(whole.orderBy("n", "law")) == 1, "_m": F.count(F.lit(1)).over(whole)})
        return rows.withColumn("_in", F.col("_in") | (~F.max("_in").over(whole) & F.col("_few") & (F.col("_m") > 1) & F.lit(share > 0)))

    first = deal(rows, test)
    second = deal(first.filter("not _in").drop("_in", "_few", "_m"), dev)
    return first.filter("_in").select("law", F.lit("test").alias("split")).union(second.select("law", F.when(F.col("_in"), "dev").otherwise("train").alias("split")))


def split_by_article(questions: DataFrame, article: str = "article", law: str = "law", test: float = 0.15, dev: float = 0.1, seed: int = 42) -> DataFrame:
    """law, article, n, split: whole articles to test, dev and train, every law by itself.

    A law's articles stand in hash order, each as wide as its questions n. Those whose middle lies before the share of test are test, those before
    that and the share of dev are dev, the others train; so each share is met but for half an article at either of its ends. A law's last article
    stays in train, and so does the only one of a law. Sums run over ranges of a total order, so a law of very many articles is spread over tasks.
    Nulls are a law and an article of their own.
    """
    rows = questions.groupBy(F.col(law).alias("law"), F.col(article).alias("article")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("_u", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("article").cast("string"), F.lit("")))))
    rows = running_sum(rows, F.col("n"), "law", "_u", "article", name="_before")
    laws = rows.groupBy(F.col("law").alias("_law")).agg(F.min("_before").alias("_first"), F.sum("n").alias("_all"), F.max_by("article", F.struct("_before", "_u")).alias("_last"))
    placed = rows.join(laws, F.col("law").eqNullSafe(F.col("_law")))
    middle = F.col("_before") - F.col("_first") + F.col("n") / 2
    split = F.when(F.col("article").eqNullSafe(F.col("_last")), "train").when(middle < F.col("_all") * test, "test").when(middle < F.col("_all") * (test + dev), "dev").otherwise("train")
    return placed.select("law", "article", "n", split.alias("split"))


def hash_split(key: Column, test: float = 0.15, dev: float = 0.1, seed: int = 42) -> Column:
    """A split by a hash of an article's key: no table of articles, the same at every size."""
    u = hash_unit(key, seed)
    return F.when(u < test, "test").when(u < test + dev, "dev").otherwise("train")


def in_batch_loss(scores: DataFrame, scale: float = 20.0) -> DataFrame:
    """batch, loss, margin from a score matrix in long form (batch, i, j, score): ranking loss and the least margin of the diagonal."""
    row = scores.groupBy("batch", "i").agg(
        F.max("score").alias("top"),
        F.max(F.when(F.col("i") == F.col("j"), F.col("score"))).alias("own"),
        F.max(F.when(F.col("i") != F.col("j"), F.col("score"))).alias("best"),
        F.log(F.sum(F.exp(F.col("score") * scale - scale))).alias("lse"),
    )
    return row.groupBy("batch").agg(F.avg(F.col("lse") + scale - F.col("own") * scale).alias("loss"), F.min(F.col("own") - F.col("best")).alias("margin"))


def split_summary(questions: DataFrame, article: str, law: str) -> DataFrame:
    """split, questions, articles, laws (sorted, joined by commas) of questions with a split; a split's laws fit a row."""
    laws = F.array_join(F.transform(F.array_sort(F.collect_set(law)), lambda x: x.cast("string")), ",")
    return questions.groupBy("split").agg(F.count(F.lit(1)).alias("questions"), F.count_distinct(article).alias("articles"), laws.alias("laws"))


def leak_rate(questions: DataFrame, article: str) -> DataFrame:
    """rate: the share of test questions whose article is also the answer of a training question."""
    seen = questions.filter("split = 'train'").select(article).distinct().withColumn("_seen", F.lit(1.0))
    return questions.filter("split = 'test'").join(seen, article, "left").agg(F.avg(F.coalesce("_seen", F.lit(0.0))).alias("rate"))


def question_problems(questions: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """A row (problem and the question's columns) for each rule that a question (text, kind, ...) breaks."""
    text = F.col("text")
    times = questions.groupBy("text").agg(F.count(F.lit(1)).alias("_times"))
    rules = {
        "empty": F.coalesce(F.trim(text), F.lit("")) == "",
        "role": ~F.col("kind").isin(*kinds),
        "names an article": text.rlike(r"제\d+조"),
        "length": ~F.length(text).between(5, 150),
        "repeated": F.col("_times") > 1,
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return questions.join(times, "text", "left").withColumn("problem", F.explode(broken)).drop("_times")


def check_questions(questions: DataFrame, corpus: DataFrame, kinds: tuple[str, ...], least: int = 5, most: int = 150) -> DataFrame:
    """problem, severity, file, qid: a row for each rule that a question of a file breaks.

    ``questions`` has file, law (the file's), qid, query, positive_id, negatives and query_type, ``corpus`` id (each once) and law. Errors: a field that is missing or empty; a type that
    is none of ``kinds``; a right answer or a negative that the corpus lacks; a right answer of another law than the file's; one that is among the
    negatives; a query that names an article; one that its file, or another file, has as well. A length beyond the bounds is a
    warning. Queries are compared with white space squeezed; missing ones repeat nothing.
    """
    said = F.nullif(F.trim(F.regexp_replace("query", r"\s+", " ")), F.lit(""))
    asked = questions.select("file", "law", "qid", "query", "positive_id", "query_type", _or_empty(questions, "negatives").alias("negatives"), said.alias("_said"))
    laws = corpus.select(F.col("id").alias("positive_id"), F.col("law").alias("_law"), F.lit(True).alias("_there"))
    gone = asked.select("file", "qid", F.explode("negatives").alias("id")).join(corpus.select("id"), "id", "left_anti").select("file", "qid").distinct().withColumn("_gone", F.lit(True))
    per_file = asked.filter("_said is not null").groupBy("_said", "file").agg(F.count(F.lit(1)).alias("_inside"))
    files = per_file.groupBy("_said").agg(F.count(F.lit(1)).alias("_files"))
    rows = asked.join(laws, "positive_id", "left").join(gone, ["file", "qid"], "left").join(per_file, ["_said", "file"], "left").join(files, "_said", "left")
    has_answer = F.coalesce(F.col("_there"), F.lit(False))
    missing = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    rules = {
        "missing field": missing("query") | missing("positive_id") | missing("query_type"),
        "type": ~missing("query_type") & ~F.col("query_type").isin(*kinds),
        "answer not in corpus": ~missing("positive_id") & ~has_answer,
        "negative not in corpus": F.col("_gone"),
        "answer of another law": has_answer & ~F.col("_law").eqNullSafe(F.col("law")),
        "answer among negatives": F.array_contains("negatives", F.col("positive_id")),
        "names an article": F.col("query").rlike(r"제\d+조"),
        "repeated in file": F.col("_inside") > 1,
        "repeated between files": F.col("_files") > 1,
        "length": F.col("_said").isNotNull() & ~F.length("_said").between(least, most),
    }
    broken = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return rows.select(F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("problem"), "file", "qid").select("problem", F.when(F.col("problem") == "length", "warning").otherwise("error").alias("severity"), "file", "qid")


def question_coverage(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """law, rows, answered, share: of each law's rows of the corpus (id, law) how many are a question's right answer (positive_id)."""
    answered = questions.select(F.col("positive_id").alias("id")).distinct().withColumn("_answered", F.lit(1))
    per = corpus.select("id", "law").join(answered, "id", "left").groupBy("law").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_answered"), F.lit(0)).alias("answered"))
    return per.select("law", "rows", "answered", (F.col("answered") / F.col("rows")).alias("share"))


def negatives_histogram(questions: DataFrame) -> DataFrame:
    """negatives, questions: how many questions have so many negatives; null lists have none."""
    return questions.groupBy(F.size(_or_empty(questions, "negatives")).alias("negatives")).agg(F.count(F.lit(1)).alias("questions"))


def keyword_counts(questions: DataFrame, least: int = 2) -> DataFrame:
    """word, questions: in how many queries each word occurs, of words of at least ``least`` characters. Words are runs of letters and numbers."""
    words = F.array_distinct(F.regexp_extract_all("query", F.lit(r"([\p{L}\p{N}]+)")))
    return questions.select(F.explode(words).alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("questions"))


def every_nth(rows: DataFrame, order: str, step: int) -> DataFrame:
    """Every ``step``-th row in ascending order of a column of any type, with n, its place from 0."""
    return ordinal(rows, order, name="n").filter(F.col("n") % step == 0)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows whose seeded hashes are smallest: a distributed top-n."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def judge_input(candidates: DataFrame, top: int = 3, ceiling: float = 0.95, seed: int = 0) -> DataFrame:
    """qid, n, id: candidates (qid, id, rank, ratio) among the first ``top`` that score like the positive, in an order that does not show their ranks."""
    odd = candidates.filter((F.col("rank") <= top) & (F.col("ratio") >= ceiling))
    order = Window.partitionBy("qid").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "qid", "id")), "id")
    return odd.select("qid", F.row_number().over(order).alias("n"), "id")


def train_pool(corpus: DataFrame, train: DataFrame) -> DataFrame:
    """The rows of the corpus (id, law) that negatives may come from: those of laws that training questions' right answers (positive_id) have."""
    laws = corpus.select("law", F.col("id").alias("positive_id")).join(train.select("positive_id"), "positive_id", "left_semi").select("law").distinct()
    return corpus.join(laws, "law", "left_semi")


def mining_candidates(ranked: DataFrame, own: DataFrame, depth: int = 30, digits: int = 4) -> DataFrame:
    """qid, id, rank, score, ratio: of rankings (qid, id, score) the ``depth`` best rows but the right answer (own: qid, positive_id, score), and their scores
    over the right answer's. Related rows stay."""
    rows = ranked.select("qid", "id", "score").join(own.select("qid", "positive_id", F.col("score").alias("_own")), "qid").filter("id != positive_id")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= depth).select("qid", "id", "rank", "score", F.round(F.col("score") / F.col("_own"), digits).alias("ratio"))


def judge_texts(picked: DataFrame, questions: DataFrame, corpus: DataFrame, answer_chars: int = 700, candidate_chars: int = 600) -> DataFrame:
    """qid, n, id, query, answer, candidate: what a judge reads of candidates (``judge_input``), texts (corpus: id, text) cut to so many characters."""
    text = corpus.select("id", "text")
    asked = questions.select("qid", "query", "positive_id").join(text.select(F.col("id").alias("positive_id"), F.substring("text", 1, answer_chars).alias("answer")), "positive_id", "left")
    return picked.join(text.select("id", F.substring("text", 1, candidate_chars).alias("candidate")), "id", "left").join(asked, "qid").select("qid", "n", "id", "query", "answer", "candidate")


def settle_negatives(candidates: DataFrame, verdicts: DataFrame, keep: int = 3, ceiling: float = 0.95) -> DataFrame:
    """qid, negatives, reasons, alternatives after judgement (verdicts: qid, id, verdict of no, full or partial).

    Of the first ``keep`` candidates those of low ratio and those judged no stay, in their order; then come others of low ratio, ranks up
    to 10 first, up to 30 then; what is missing repeats them in turn. Candidates judged full are further answers. ``reasons`` is
    top, fill or repeat. A candidate that needs a verdict and has none raises ValueError.
    """
    judged = candidates.filter(F.col("rank") <= 30).join(verdicts, ["qid", "id"], "left")
    doubtful = (F.col("rank") <= keep) & (F.col("ratio") >= ceiling)
    if (n := judged.filter(doubtful & F.col("verdict").isNull()).count()) > 0:
        raise ValueError(f"{n} candidates without a verdict")
    usable = (F.col("ratio") < ceiling) | (doubtful & (F.col("verdict") == "no"))
    tier = F.when(F.col("rank") <= keep, 0).when(F.col("rank") <= 10, 1).otherwise(2)
    rows = judged.groupBy("qid").agg(
        F.slice(F.array_sort(F.collect_list(F.when(usable, F.struct(tier.alias("t"), "rank", "id")))), 1, keep).alias("s"),
        F.transform(F.array_sort(F.collect_list(F.when(doubtful & (F.col("verdict") == "full"), F.struct("rank", "id")))), lambda x: x["id"]).alias("alternatives"),
    )
    turn = lambda f: F.when(F.size("s") > 0, F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), f)).otherwise(F.array())
    one = lambda n: F.element_at("s", F.pmod(n, F.size("s")).cast("int") + 1)
    reason = lambda n: F.when(n >= F.size("s"), "repeat").when(one(n)["t"] < 2, "top").otherwise("fill")
    return rows.select("qid", turn(lambda n: one(n)["id"]).alias("negatives"), turn(reason).alias("reasons"), "alternatives")


def replace_negatives(questions: DataFrame, mined: DataFrame) -> DataFrame:
    """Questions (qid, positive_id) with mined negatives, and a further row with these for each further answer; n orders a question's rows.

    A question without mined negatives raises ValueError.
    """
    if (n := questions.join(mined, "qid", "left_anti").count()) > 0:
        raise ValueError(f"{n} questions without mined negatives")
    answers = F.concat(F.array("positive_id"), _or_empty(mined, "alternatives"))
    return questions.join(mined, "qid").select("qid", F.posexplode(answers).alias("n", "positive_id"), "negatives")
