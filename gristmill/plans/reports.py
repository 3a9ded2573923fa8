"""Queries over rankings: lookups, relations of answers, comparisons and mined negatives, each with the SQL it is compared with.

The roles of ``embeddings`` are those of the catalog: ids divisible by 10 are questions, five neighbouring ids one article, equal
labels right answers. A row's law is its id modulo 9, its kind its id modulo 3 and its theme its label.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions.text import squeeze_for_grams
from gristmill.operators import judge, overlap, stats, training, vector
from gristmill.operators.order import ordinal, settle
from gristmill.plans import catalog as C
from gristmill.plans.registry import query
from gristmill.sources import report


@query("SELECT vec_id AS id, label, 0.0::DOUBLE AS score FROM embeddings WHERE vec_id IN (7, 123)")
def lookup(spark, sf):
    """Rows by id."""
    return C._corpus(spark, sf).filter(F.col("id").isin(7, 123)).select("id", "label", F.lit(0.0).alias("score"))


@query("SELECT vec_id AS id, vec_id // 5 AS article, CAST(row_number() OVER (PARTITION BY vec_id // 5 ORDER BY vec_id) AS INT) AS n FROM embeddings WHERE vec_id // 5 IN (SELECT vec_id // 5 FROM embeddings WHERE vec_id IN (12, 88))")
def article_of(spark, sf):
    """All pieces of the articles of some pieces, in order."""
    d = C._corpus(spark, sf).select("id", F.floor(F.col("id") / 5).alias("article"))
    asked = d.filter(F.col("id").isin(12, 88)).select("article").distinct()
    return d.join(F.broadcast(asked), "article", "left_semi").select("id", "article", F.row_number().over(Window.partitionBy("article").orderBy("id")).alias("n"))


@query(C._BASE + " SELECT q.qid, CAST((SELECT min(rank) FROM ranked r, pos p WHERE r.qid = q.qid AND p.qid = q.qid AND r.id // 5 = p.id // 5) AS INT) AS rank FROM q")
def rank_of_article(spark, sf):
    """The place of the first piece of the right article among the pieces, null beyond the depth."""
    key = F.floor(F.col("id") / 5)
    wanted = C._positives(spark, sf).select("qid", key.alias("key"))
    found = C._ranked(spark, sf).select("qid", key.alias("key"), "rank").join(wanted, ["qid", "key"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    return C._queries(spark, sf).select("qid").join(found, "qid", "left")


@query(C._BASE + """, kept AS (SELECT r.qid, r.id, score, row_number() OVER (PARTITION BY r.qid ORDER BY rank) AS rank FROM ranked r JOIN pos p ON r.qid = p.qid WHERE r.id % 7 <> 3 OR r.id = p.id)
    SELECT q.qid, CAST((SELECT rank FROM kept k, pos p WHERE k.qid = q.qid AND p.qid = q.qid AND k.id = p.id) AS INT) AS doc_rank, (SELECT string_agg(id || ':' || CAST(CAST(round(score * 10000) AS INT) AS VARCHAR), ',' ORDER BY rank) FROM kept k WHERE k.qid = q.qid AND rank <= 50) AS top50 FROM q""")
def topk_dump(spark, sf):
    """The rank of each answer without related rows, and the 50 best with their scores in ten-thousandths."""
    positives = C._positives(spark, sf)
    ranked = C._ranked(spark, sf)
    related = ranked.filter("id % 7 = 3").select("qid", "id").join(positives, ["qid", "id"], "left_anti")
    kept = judge.without(ranked, related)
    top = kept.filter("rank <= 50").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["id"], F.round(x["score"] * 10000).cast("int"))), ",")
    own = kept.join(positives, ["qid", "id"]).select("qid", F.col("rank").alias("doc_rank"))
    return C._queries(spark, sf).select("qid").join(own, "qid", "left").join(top.select("qid", text.alias("top50")), "qid", "left")


def _related(spark, sf):
    """The best wrong answer of every question beside its right one."""
    d = C._corpus(spark, sf).select("id", "label", F.floor(F.col("id") / 5).alias("article"), (F.col("id") % 4).alias("law"), (F.col("id") % 2).alias("kind"))
    wrong = C._ranked(spark, sf, 1).join(C._positives(spark, sf).withColumnRenamed("id", "pid"), "qid").filter("id != pid").select("qid", "pid", F.col("id").alias("wid"))
    side = lambda t: d.select(F.col("id").alias(f"{t}id"), F.struct("article", "law", "kind", F.col("label").alias("theme"), F.col("id").alias("no")).alias(t))
    return wrong.join(side("p"), "pid").join(side("w"), "wid")


_SIDES = """, rel AS (SELECT p.qid, p.id AS pid, r.id AS wid FROM pos p JOIN ranked r ON r.qid = p.qid AND r.rank = 1 AND r.id <> p.id),
    named AS (SELECT rel.*, pid // 5 = wid // 5 AS article, pid % 4 = wid % 4 AS law, pid % 2 = wid % 2 AS kind, a.label = b.label AS theme FROM rel JOIN d a ON a.id = pid JOIN d b ON b.id = wid)"""


@query(C._BASE + _SIDES + " SELECT CASE WHEN article THEN 'same_article' WHEN law AND kind THEN 'same_law_same_type' WHEN law THEN 'same_law_other_type' WHEN theme THEN 'other_law_same_theme' ELSE 'other_law_other_theme' END AS relation, count(*) AS n FROM named GROUP BY ALL")
def confusion_relations(spark, sf):
    """How the best wrong answers relate to the right ones."""
    rows = _related(spark, sf).select(judge.relation(F.col("p"), F.col("w")).alias("relation"))
    return rows.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query(C._BASE + _SIDES + r""", t AS (SELECT named.*, 'by law 제' || (pid % 50) || '조' AS pt, '시행령은 법 제' || (pid % 50) || '조와 법제3조의2' AS wt, '제' || (pid % 50) || '조' AS pn, '제' || (wid % 50) || '조' AS wn FROM named)
    SELECT qid, CASE WHEN article THEN 'same article' WHEN law AND NOT kind AND (list_contains(regexp_extract_all(pt, '법\s*(제\d+조(의\d+)?)', 1), wn) OR list_contains(regexp_extract_all(wt, '법\s*(제\d+조(의\d+)?)', 1), pn)) THEN 'same law, delegated' WHEN law AND NOT kind THEN 'same law, other kind' WHEN law THEN 'same law and kind' WHEN theme THEN 'same theme' ELSE 'other theme' END AS relation FROM t""")
def delegation_relations(spark, sf):
    """The same with delegations: one of the two names the other's article."""
    name = lambda c: F.concat(F.lit("제"), (F.col(c) % 50).cast("string"), F.lit("조"))
    rows = _related(spark, sf)
    of_p, of_w = F.concat(F.lit("by law "), name("pid")), F.concat(F.lit("시행령은 법 "), name("pid"), F.lit("와 법제3조의2"))
    return rows.select("qid", judge.delegation(F.col("p"), F.col("w"), of_p, name("pid"), of_w, name("wid")).alias("relation"))


@query(C._JUDGED + ", h AS (SELECT qid, CASE WHEN (SELECT min(rank) FROM half x JOIN pos p ON x.qid = p.qid AND x.id = p.id WHERE x.qid = q.qid) <= 5 THEN 1.0 ELSE 0.0 END AS r5, CASE WHEN (SELECT min(rank) FROM half x JOIN pos p ON x.qid = p.qid AND x.id = p.id WHERE x.qid = q.qid) <= 1 THEN 1.0 ELSE 0.0 END AS r1, label FROM q)".replace("half", "(SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(list_dot_product(q.e[1:16], d.e[1:16]), 6) AS score FROM q, d WHERE qid <> id) QUALIFY rank <= 100)") + ", m AS (SELECT qid, label, CASE WHEN r.rank <= 5 THEN 1.0 ELSE 0.0 END AS r5, CASE WHEN r.rank <= 1 THEN 1.0 ELSE 0.0 END AS r1 FROM q LEFT JOIN (SELECT r.qid, r.rank FROM ranked r JOIN pos p ON r.qid = p.qid AND r.id = p.id) r USING (qid)) SELECT h.label, round(avg(h.r1), 6) AS half_r1, round(avg(h.r5), 6) AS half_r5, round(avg(m.r1), 6) AS full_r1, round(avg(m.r5), 6) AS full_r5 FROM h JOIN m USING (qid) GROUP BY h.label")
def model_comparison(spark, sf):
    """Recall of two models side by side, by label."""
    positives, labels = C._positives(spark, sf), C._queries(spark, sf).select("qid", "label")

    def run(ranked, name):
        own = labels.join(ranked.join(positives, ["qid", "id"]).select("qid", "rank"), "qid", "left")
        return own.select("label", F.lit(name).alias("model"), *judge.metrics(F.col("rank"))[:2])

    rows = run(C._half(spark, sf), "half").union(run(C._ranked(spark, sf), "full"))
    return rows.groupBy("label").pivot("model", ["half", "full"]).agg(F.round(F.avg("r1"), 6).alias("r1"), F.round(F.avg("r5"), 6).alias("r5"))


@query(C._HITS + """ SELECT label, n, base, other, delta, fixed, broken FROM (SELECT label, count(*) AS n, round(avg(b), 6) AS base, round(avg(o), 6) AS other, round(avg(o) - avg(b), 6) AS delta, CAST(count(*) FILTER (b = 0 AND o = 1) AS BIGINT) AS fixed, CAST(count(*) FILTER (b = 1 AND o = 0) AS BIGINT) AS broken FROM hit GROUP BY label)""")
def paired_by_label(spark, sf):
    """The difference of two runs by label."""
    rows = C._compared(spark, sf).join(C._queries(spark, sf).select("qid", "label"), "qid")
    return stats.paired_summary(rows, ["label"]).drop("mcnemar_p")


@query(C._HITS + """, near AS (SELECT qid, max(score) AS best FROM ranked WHERE id % 3 <> 0 GROUP BY qid), clean AS (SELECT hit.* FROM hit LEFT JOIN near USING (qid) WHERE coalesce(best, 0) < 0.9)
    SELECT n, base, other, round(other - base, 6) AS delta FROM (SELECT count(*) AS n, round(avg(b), 6) AS base, round(avg(o), 6) AS other FROM clean)""")
def clean_subset_test(spark, sf):
    """The difference of two runs over the questions that are not near to a training row."""
    near = C._ranked(spark, sf).filter("id % 3 != 0").groupBy("qid").agg(F.max("score").alias("best"))
    clean = C._compared(spark, sf).join(near, "qid", "left").filter(F.coalesce("best", F.lit(0.0)) < 0.9)
    return stats.paired_summary(clean).select("n", "base", "other", "delta")


_OVERLAPS = r""", t AS (SELECT doc_id, list_transform(range(1, greatest(length(t) - 1, 0) + 1), lambda i: substr(t, i, 2)) AS g FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g') AS t FROM documents)),
    ov AS (SELECT qid, len(list_distinct(a.g)) AS m, len(list_intersect(list_distinct(a.g), b.g)) AS c FROM pos JOIN t a ON a.doc_id = qid JOIN t b ON b.doc_id = pos.id)"""


@query(C._HITS + _OVERLAPS + """, x AS (SELECT hit.*, ((2000000 * c + greatest(m, 1)) // (2 * greatest(m, 1))) / 1000000 AS v FROM hit JOIN ov USING (qid)), e AS (SELECT quantile_cont(v, 0.25) AS e1, quantile_cont(v, 0.5) AS e2, quantile_cont(v, 0.75) AS e3 FROM x)
    SELECT CASE WHEN v <= e1 THEN 1 WHEN v <= e2 THEN 2 WHEN v <= e3 THEN 3 ELSE 4 END AS bin, count(*) AS n, round(avg(b), 6) AS base, round(avg(o), 6) AS other FROM x, e GROUP BY ALL""")
def quartile_bins(spark, sf):
    """Hits of two runs by quartile of the share of a question's character pairs that its right answer has (texts of the documents of the same ids)."""
    texts = C._table(spark, sf, "documents").select("doc_id", squeeze_for_grams(F.coalesce("text", F.lit(""))).alias("text"))
    pairs = C._positives(spark, sf).join(texts.select(F.col("doc_id").alias("qid"), F.col("text").alias("a")), "qid").join(texts.select(F.col("doc_id").alias("id"), F.col("text").alias("b")), "id")
    rows = C._compared(spark, sf).join(overlap.pair_overlap(pairs, 2).select("qid", F.col("overlap").alias("v")), "qid")
    return stats.by_quartile(rows, "v").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("base_hit"), 6).alias("base"), F.round(F.avg("other_hit"), 6).alias("other"))


_PICKED = C._CANDS + """, good AS (SELECT qid, id, rank, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= 10 THEN 0 ELSE 1 END, rank) AS i FROM cand WHERE ratio < 0.95 AND rank <= 30), picked AS (SELECT * FROM good WHERE i <= 3)"""


@query(_PICKED + " SELECT CASE WHEN rank <= 5 THEN '1~5' WHEN rank <= 30 THEN '6~30' WHEN rank <= 50 THEN '31~50' ELSE '>50' END AS bucket, count(*) AS n FROM picked GROUP BY ALL")
def negative_ranks(spark, sf):
    """At which ranks mined negatives stand."""
    candidates = C._candidates(spark, sf)
    picked = training.pick_negatives(candidates).filter("reason != 'repeat'").join(candidates.select("qid", "id", "rank"), ["qid", "id"], "left")
    bucket = F.when(F.col("rank") <= 5, "1~5").when(F.col("rank") <= 30, "6~30").when(F.col("rank") <= 50, "31~50").otherwise(">50")
    return picked.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(C._CANDS + " SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY md5('0:' || qid || ':' || id), id) AS INT) AS n FROM cand WHERE rank <= 3 AND ratio >= 0.95")
def judge_input(spark, sf):
    """Candidates that score like the positive, for a judge."""
    return training.judge_input(C._candidates(spark, sf))


_POOL = C._BASE + """, laws AS (SELECT DISTINCT id % 9 AS law FROM pos WHERE qid % 30 = 0), pool AS (SELECT d.* FROM d WHERE id % 9 IN (SELECT law FROM laws)),
    scored AS (SELECT qid, pool.id, round(list_dot_product(q.e, pool.e), 6) AS score FROM q, pool WHERE qid <> pool.id),
    own AS (SELECT p.qid, p.id AS pid, round(list_dot_product(q.e, d.e), 6) AS own FROM pos p JOIN q ON q.qid = p.qid JOIN d ON d.id = p.id)"""


@query(_POOL + " SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank, score, round(score / own, 4) AS ratio FROM scored JOIN own USING (qid) WHERE id <> pid QUALIFY rank <= 30")
def pooled_candidates(spark, sf):
    """The thirty best wrong answers of each question among the rows of training laws (those of every third question's answer)."""
    d, q, positives = C._corpus(spark, sf), C._queries(spark, sf), C._positives(spark, sf).withColumnRenamed("id", "positive_id")
    pool = training.train_pool(d.withColumn("law", F.col("id") % 9), positives.filter("qid % 30 = 0"))
    own = positives.join(d.select(F.col("id").alias("positive_id"), F.col("embedding").alias("_e")), "positive_id").join(q.select("qid", "embedding"), "qid")
    own = own.select("qid", "positive_id", F.round(vector.dot(F.col("embedding"), F.col("_e")), 6).alias("score"))
    return training.mining_candidates(vector.batch_knn(q, pool, 31), own)


@query(C._CANDS + """, t AS (SELECT doc_id, text FROM documents), p AS (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY md5('0:' || qid || ':' || id), id) AS INT) AS n FROM cand WHERE rank <= 3 AND ratio >= 0.95)
    SELECT p.qid, n, p.id, substr(a.text, 1, 40) AS query, substr(b.text, 1, 700) AS answer, substr(c.text, 1, 600) AS candidate FROM p JOIN pos ON pos.qid = p.qid LEFT JOIN t a ON a.doc_id = p.qid LEFT JOIN t b ON b.doc_id = pos.id LEFT JOIN t c ON c.doc_id = p.id""")
def judge_texts(spark, sf):
    """What a judge reads: the question, its answer's text and the candidate's, cut."""
    texts = C._table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = C._positives(spark, sf).withColumnRenamed("id", "positive_id").join(texts.select(F.col("id").alias("qid"), F.substring("text", 1, 40).alias("query")), "qid", "left")
    return training.judge_texts(training.judge_input(C._candidates(spark, sf)), asked, texts)


_SETTLED = C._CANDS + """, v AS (SELECT *, rank <= 3 AND ratio >= 0.95 AS doubtful, CASE id % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'full' ELSE 'partial' END AS verdict FROM cand WHERE rank <= 30),
    u AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= 3 THEN 0 WHEN rank <= 10 THEN 1 ELSE 2 END, rank) AS i, rank FROM v WHERE ratio < 0.95 OR (doubtful AND verdict = 'no')),
    s AS (SELECT qid, id, i, rank, least(3, count(*) OVER (PARTITION BY qid)) AS m FROM u), t AS (SELECT qid, n, id, CASE WHEN n >= m THEN 'repeat' WHEN rank <= 10 THEN 'top' ELSE 'fill' END AS reason FROM s, (SELECT unnest([0, 1, 2]) AS n) WHERE i = n % m + 1),
    alts AS (SELECT qid, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS alts FROM v WHERE doubtful AND verdict = 'full' GROUP BY qid)"""


def _settled(spark, sf):
    candidates = settle(C._candidates(spark, sf))  # ranked once: verdicts, checks and lists all look at them
    verdict = F.when(F.col("id") % 3 == 0, "no").when(F.col("id") % 3 == 1, "full").otherwise("partial")
    return training.settle_negatives(candidates, candidates.filter("rank <= 3 and ratio >= 0.95").select("qid", "id", verdict.alias("verdict")))


@query(_SETTLED + " SELECT qid, coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY n) FROM t WHERE t.qid = c.qid), '') AS negatives, coalesce((SELECT string_agg(reason, ',' ORDER BY n) FROM t WHERE t.qid = c.qid), '') AS reasons, coalesce((SELECT alts FROM alts WHERE alts.qid = c.qid), '') AS alternatives FROM (SELECT DISTINCT qid FROM v) c")
def judged_negatives(spark, sf):
    """Negatives after judgement, and further answers that it found."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _settled(spark, sf).select("qid", text("negatives"), text("reasons"), text("alternatives"))


@query(_SETTLED + ", a AS (SELECT p.qid, p.id AS positive_id, 0 AS n FROM pos p UNION ALL SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) FROM v WHERE doubtful AND verdict = 'full') SELECT qid, CAST(n AS INT) AS n, positive_id, coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY n) FROM t WHERE t.qid = a.qid), '') AS negatives FROM a")
def replaced_negatives(spark, sf):
    """Training questions with judged negatives, and a row for each further answer."""
    questions = C._positives(spark, sf).select("qid", F.col("id").alias("positive_id"))
    return training.replace_negatives(questions, _settled(spark, sf)).select("qid", "n", "positive_id", F.array_join(F.col("negatives").cast("array<string>"), ",").alias("negatives"))


@query(C._CANDS + ", held AS (SELECT DISTINCT id // 5 AS a FROM d WHERE id % 20 = 0), good AS (SELECT qid, id, rank, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= 10 THEN 0 ELSE 1 END, rank) AS i FROM cand WHERE ratio < 0.95 AND rank <= 30 AND id // 5 NOT IN (SELECT a FROM held)) SELECT qid, id, CASE WHEN rank <= 10 THEN 'top' ELSE 'fill' END AS reason FROM good WHERE i = 1")
def article_negatives(spark, sf):
    """One negative a question, from articles that are not held out."""
    held = C._corpus(spark, sf).filter("id % 20 = 0").select(F.floor(F.col("id") / 5).alias("_a")).distinct()
    pool = C._candidates(spark, sf).withColumn("_a", F.floor(F.col("id") / 5)).join(held, "_a", "left_anti").drop("_a")
    return training.pick_negatives(pool, keep=1).select("qid", "id", "reason")


@query(C._BASE + " SELECT qid, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS top10 FROM ranked WHERE rank <= 10 GROUP BY qid")
def top_ids(spark, sf):
    """The ten best ids of each question."""
    top = C._ranked(spark, sf, 10).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("s"))
    return top.select("qid", F.array_join(F.transform("s", lambda x: x["id"].cast("string")), ",").alias("top10"))


@query(C._BASE + " SELECT qid, id, rank, payload FROM (SELECT qid, r.id, CAST(rank AS INT) AS rank, 'doc ' || r.id || ' label ' || d.label || ' score ' || CAST(CAST(round(score * 10000) AS INT) AS VARCHAR) AS payload FROM ranked r JOIN d ON d.id = r.id WHERE rank <= 3)")
def hit_payloads(spark, sf):
    """Hits as they are shown: scores to four places."""
    hits = C._ranked(spark, sf, 3).join(C._corpus(spark, sf).select("id", "label"), "id")
    return hits.select("qid", "id", "rank", F.concat_ws(" ", F.lit("doc"), "id", F.lit("label"), "label", F.lit("score"), F.round(F.col("score") * 10000).cast("int")).alias("payload"))


@query("WITH g AS (SELECT vec_id // 5 AS grp, min(vec_id) AS f, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS pieces FROM embeddings GROUP BY grp) SELECT CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS article, pieces FROM g")
def article_index(spark, sf):
    """Articles numbered by their first piece, with their pieces."""
    groups = C._corpus(spark, sf).groupBy(F.floor(F.col("id") / 5).alias("grp")).agg(F.min("id").alias("f"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("pieces"))
    return ordinal(groups, "f", name="article").select(F.col("article").cast("int").alias("article"), "pieces")


@query("WITH u AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label) SELECT label, CAST(i - 1 AS INT) AS i, round(x / greatest(norm, 1e-12), 6) AS x FROM m JOIN n USING (label)")
def mean_vectors(spark, sf):
    """The mean of each label's vectors, of length one."""
    parts = C._corpus(spark, sf).select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("label"))), F.lit(1e-12))
    return means.select("label", "i", F.round(F.col("x") / norm, 6).alias("x"))


@query(C._JUDGED + ", r AS (SELECT judge, " + C._MEANS + " FROM metric GROUP BY judge) SELECT judge || '.' || name AS name, value FROM r UNPIVOT (value FOR name IN (r1, r5, r10, mrr10, ndcg10))")
def flat_metrics(spark, sf):
    """Metrics under dotted names."""
    rows = judge.report(C._judged(spark, sf))
    pairs = F.explode(F.array(*[F.struct(F.concat("judge", F.lit(f".{m}")).alias("name"), F.col(m).alias("value")) for m in judge.METRICS]))
    return rows.select(pairs.alias("p")).select("p.name", "p.value")


@query(C._JUDGED + ", r AS (SELECT judge, label, " + C._MEANS + """ FROM metric GROUP BY judge, label), l AS (SELECT row_number() OVER (ORDER BY judge, label) + 1 AS n, '| ' || judge || ' | ' || label || ' | ' || format('{:.3f}', r5) || ' | ' || format('{:.3f}', mrr10) || ' |' AS line FROM r)
    SELECT CAST(n AS BIGINT) AS n, line FROM l UNION ALL VALUES (0, '| judgement | label | R@5 | MRR@10 |'), (1, '|---|---|---|---|')""")
def metrics_markdown(spark, sf):
    """Metrics by judgement and label as a table in Markdown."""
    rows = judge.report(C._judged(spark, sf), ["label"]).filter("group_kind = 'label'").withColumn("_label", F.col("grp").cast("int"))
    return report.markdown_rows(rows, {"judge": ("judgement", None), "grp": ("label", None), "r5": ("R@5", "%.3f"), "mrr10": ("MRR@10", "%.3f")}, "judge", "_label")


def _hit_ranks(spark, sf, n: int, k: int):
    """The rank of the first right answer of each question among the k best by a model of so many dimensions; null beyond them."""
    cut = lambda df: df.withColumn("embedding", F.slice("embedding", 1, n))
    ranked = vector.batch_knn(cut(C._queries(spark, sf)), cut(C._corpus(spark, sf)), k)
    return C._positives(spark, sf).select("qid").join(C._same(spark, sf, ranked).groupBy("qid").agg(F.min("rank").alias("doc_rank")), "qid", "left")


@query()
def decision(spark, sf):
    """Whether models of 32 and of 64 dimensions are better than one of 16 by all tests; questions are dealt to two seeds and to those nothing is chosen on."""
    k = 3  # a hit is a rank up to this: nothing beyond it is told apart
    base = settle(_hit_ranks(spark, sf, 16, k))  # once for both
    compared = [judge.compare(base, _hit_ranks(spark, sf, n, k), k=k).withColumn("variant", F.lit(f"{n} dimensions")) for n in (32, 64)]
    laws = C._queries(spark, sf).select("qid", F.col("label").alias("law"))
    rows = settle(compared[0].union(compared[1]).join(laws, "qid").withColumn("_part", F.floor(F.col("qid") / 10) % 3))
    runs = rows.filter("_part < 2").withColumn("seed", F.col("_part"))
    controls = runs.filter("variant = '32 dimensions'").select("seed", "base_hit", F.col("base_hit").alias("other_hit"))
    return stats.decide(runs, controls, rows.filter("_part = 2"))


@query(C._HITS + ", s AS (SELECT round(avg(o) - avg(b), 6) AS delta, count(*) FILTER (b = 0 AND o = 1) AS f, count(*) FILTER (b = 1 AND o = 0) AS k FROM hit), worst AS (SELECT min(d) AS d FROM (SELECT avg(o) - avg(b) AS d FROM hit GROUP BY label)) SELECT delta, delta >= 0.02 AS large, f > k AS better, coalesce(d >= 0, false) AS no_worse_label FROM s, worst")
def decision_gate(spark, sf):
    """Whether a difference is large enough and no label is worse."""
    rows = C._compared(spark, sf).join(C._queries(spark, sf).select("qid", "label"), "qid")
    return stats.gate(rows, "label")


_TOP10 = C._BASE + r""", top AS (SELECT qid, id FROM ranked WHERE rank <= 10), t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\s', '', 'g') AS t FROM documents),
    g AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(length(t) - 2, 0) + 1), lambda i: substr(t, i, 3))) AS g FROM t WHERE doc_id IN (SELECT qid FROM top UNION SELECT id FROM top)),
    p AS (SELECT qid, id, len(list_intersect(a.g, b.g)) AS c, len(a.g) + len(b.g) AS s FROM top JOIN g a ON a.doc_id = qid JOIN g b ON b.doc_id = id)"""


@query(_TOP10 + " SELECT qid, max((2000000 * c + greatest(s - c, 1)) // (2 * greatest(s - c, 1))) / 1000000 AS best FROM p GROUP BY qid")
def reranked_neighbours(spark, sf):
    """Of the ten nearest rows of each question, the largest share of character triples of their texts (documents of the same ids)."""
    texts = C._table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "").alias("text"))
    top = C._ranked(spark, sf, 10).select("qid", "id")
    pairs = top.join(texts.select(F.col("doc_id").alias("qid"), F.col("text").alias("a")), "qid").join(texts.select(F.col("doc_id").alias("id"), F.col("text").alias("b")), "id")
    return overlap.pair_jaccard(pairs, 3).groupBy("qid").agg(F.max("similarity").alias("best"))
