"""Queries over texts, files, questions and logs, each with the SQL it is compared with.

``documents`` are files of folder source and title lang, ``conversations`` questions and their records, ``events`` logs and commits.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import chunking, store, training
from gristmill.plans.registry import query


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    r"""WITH t AS (SELECT doc_id, regexp_replace(replace(replace('<16> ' || coalesce(text, '') || ' <개정 2018.3.20>' || chr(10) || '② 삭제 <2020. 1. 1.>' || chr(10) || '삭제 요청\. <img src="a">', '**', ''), '\.', '.'),
        '\s*<(개정|신설|\d{4}\.)[^>]*>|<img[^>]*>|</img>', '', 'g') AS t FROM documents)
    SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(trim(x), '^([①-⑳㉑-㉟]|\d+(의\d+)?\.|[가-하]\.)\s*삭제\s*$')), chr(10)), '^\s+|\s+$', '', 'g') AS text FROM t"""
)
def clean_texts(spark, sf):
    """Documents, dressed as statute text, without its marks."""
    dressed = F.concat(F.lit("**<16>** <16> "), F.coalesce("text", F.lit("")), F.lit(' <개정 2018.3.20>\n**②** 삭제 <2020. 1. 1.>\n삭제 요청\\. <img src="a">'))
    return _table(spark, sf, "documents").select("doc_id", T.clean_text(dressed).alias("text"))


@query(
    """SELECT doc_id, 'passage: ' || coalesce(source, '') || chr(10) || text AS e5, 'title: ' || CASE WHEN coalesce(source, '') = '' THEN 'none' ELSE source END || ' | text: ' || text AS gemma,
        'query: ' || substr(text, 1, 40) AS e5_query, 'task: search result | query: ' || substr(text, 1, 40) AS gemma_query FROM documents"""
)
def model_inputs(spark, sf):
    """Documents, their source being the title, and questions as two models want them."""
    d = _table(spark, sf, "documents").withColumn("title", F.coalesce("source", F.lit("")))
    names = {"e5": T.profile_of("intfloat/multilingual-e5-small"), "gemma": T.profile_of("google/embeddinggemma-300m")}
    inputs = [T.model_input(p, F.col("title"), F.col("text")).alias(n) for n, p in names.items()]
    return d.select("doc_id", *inputs, *[T.query_input(p, F.substring("text", 1, 40)).alias(f"{n}_query") for n, p in names.items()])


@query("SELECT source AS folder, lang AS title, lpad(CAST(n_chars AS VARCHAR), 8, '0') AS date, 'f' || doc_id AS name FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY lpad(CAST(n_chars AS VARCHAR), 8, '0') DESC, 'f' || doc_id) = 1")
def latest_file_of_title(spark, sf):
    """The latest file of each title of a folder."""
    d = _table(spark, sf, "documents")
    return chunking.latest_files(d.select(F.col("source").alias("folder"), F.col("lang").alias("title"), F.lpad(F.col("n_chars").cast("string"), 8, "0").alias("date"), F.concat(F.lit("f"), "doc_id").alias("name")))


@query("SELECT user_id AS name, arg_max(event_type, (ts, event_id)) AS content, max(ts) AS ts FROM events WHERE ts <= TIMESTAMP '2024-01-15 23:59:59' AND event_type <> 'error' GROUP BY user_id")
def snapshot_as_of(spark, sf):
    """What every name held at the end of a day."""
    commits = _table(spark, sf, "events").filter("event_type != 'error'").select(F.col("user_id").alias("name"), F.col("event_type").alias("content"), "ts", F.col("event_id").alias("seq"))
    return store.as_of(commits, "2024-01-15 23:59:59").select("name", "content", "ts")


@query("WITH p AS (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS before FROM documents) SELECT doc_id AS id, CAST(before // 40000 AS BIGINT) AS part FROM p")
def corpus_parts(spark, sf):
    """Documents in order, in parts of some 40,000 characters."""
    return chunking.parting(_table(spark, sf, "documents"), "doc_id", F.col("n_chars"))


_SPLIT = "WITH u AS (SELECT conv_id, turn, CAST('0x' || substr(md5('42:' || conv_id), 1, 8) AS BIGINT) / 4294967296.0 AS u, conv_id % 7 AS law FROM conversations WHERE role = 'user'), s AS (SELECT *, CASE WHEN u < 0.15 THEN 'test' WHEN u < 0.25 THEN 'dev' ELSE 'train' END AS split FROM u)"


def _split(spark, sf):
    asked = _table(spark, sf, "conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", (F.col("conv_id") % 7).alias("law"), training.hash_split(F.col("conv_id")).alias("split"))


@query(_SPLIT + " SELECT split, count(*) AS questions, count(DISTINCT conv_id) AS articles, array_to_string(list_sort(list(DISTINCT law)), ',') AS laws FROM s GROUP BY split")
def split_summary(spark, sf):
    """Questions, articles and laws of each split."""
    return training.split_summary(_split(spark, sf), "conv_id", "law")


@query(_SPLIT + ", r AS (SELECT *, CASE WHEN CAST('0x' || substr(md5('7:' || conv_id || '/' || turn), 1, 8) AS BIGINT) / 4294967296.0 < 0.25 THEN 'test' ELSE 'train' END AS other FROM s) SELECT round(avg(CASE WHEN conv_id IN (SELECT conv_id FROM s WHERE split = 'train') THEN 1.0 ELSE 0.0 END) FILTER (split = 'test'), 6) AS by_article, round(avg(CASE WHEN conv_id IN (SELECT conv_id FROM r WHERE other = 'train') THEN 1.0 ELSE 0.0 END) FILTER (other = 'test'), 6) AS by_question FROM r")
def leak_rate(spark, sf):
    """Share of test questions whose article is a training answer, for two ways to split."""
    rows = _split(spark, sf)
    other = rows.withColumn("split", F.when(training.hash_unit(F.concat_ws("/", "conv_id", "turn"), 7) < 0.25, "test").otherwise("train"))
    own, by_question = (training.leak_rate(x, "conv_id") for x in (rows, other))
    return own.select(F.round("rate", 6).alias("by_article"), F.lit(0).alias("_k")).join(by_question.select(F.round("rate", 6).alias("by_question"), F.lit(0).alias("_k")), "_k").drop("_k")


@query("WITH c AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT n, count(*) AS articles, CAST(sum(n) AS BIGINT) AS questions FROM c WHERE n > 1 GROUP BY n")
def shared_positives(spark, sf):
    """Answers that more than one question has, by how many."""
    per = _table(spark, sf, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return per.groupBy("n").agg(F.count(F.lit(1)).alias("articles"), F.sum("n").alias("questions"))


@query("WITH x AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT CAST(sum(n) AS DOUBLE) AS n, sum(n) FILTER (a = b) AS same FROM x), ra AS (SELECT a AS v, sum(n) AS m FROM x GROUP BY a), rb AS (SELECT b AS v, sum(n) AS m FROM x GROUP BY b), e AS (SELECT coalesce(sum(ra.m * rb.m), 0) AS s FROM ra JOIN rb USING (v)) SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS agreement, round((same / n - s / n / n) / (1 - s / n / n), 6) AS kappa FROM t, e")
def judge_agreement(spark, sf):
    """How far two judgements agree, and Cohen's kappa."""
    from gristmill.operators import stats

    return stats.agreement(_table(spark, sf, "labels"), "quality", "toxic").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query(r"SELECT source AS name, count(*) AS files, CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')))) AS BIGINT) AS rows_, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(CAST('0x' || substr(sha256(text), 1, 12) AS BIGINT)) AS VARCHAR) AS sha FROM documents GROUP BY source")
def dataset_manifest(spark, sf):
    """Files, lines, bytes and a digest of each source; the digest is a sum of the texts' and needs no order."""
    rows = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S")))
    return _table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("files"), F.sum(rows).alias("rows_"), F.sum(F.octet_length("text")).alias("bytes"), store.sum_digest(F.sha2("text", 256)).alias("sha"))


@query("SELECT lang, sha256(string_agg('f' || doc_id || ' ' || sha256(coalesce(text, '')) || chr(10), '' ORDER BY 'f' || doc_id)) AS sha FROM documents GROUP BY lang")
def folder_digests(spark, sf):
    """One digest of the files of each folder, by their names and the digests of their texts in order; a document is a file."""
    files = _table(spark, sf, "documents").select("lang", F.concat(F.lit("f"), "doc_id").alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return store.folder_digest(files, ["lang"])


@query("""SELECT conv_id, substr(sha256(string_agg('{"conv_id": ' || conv_id || ', "role": ' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ', "text": ' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ', "turn": ' || turn || '}', chr(10) ORDER BY turn)), 1, 12) AS digest FROM conversations GROUP BY conv_id""")
def questions_digests(spark, sf):
    """A short digest of each list of questions, as JSON with sorted keys, in their order."""
    return store.questions_digest(_table(spark, sf, "conversations"), ["conv_id"], "turn")


@query(r"""WITH q AS (SELECT conv_id, turn, text, role FROM conversations), e AS (
        SELECT 'empty' AS problem, conv_id, turn FROM q WHERE coalesce(trim(text), '') = ''
        UNION ALL SELECT 'role', conv_id, turn FROM q WHERE role NOT IN ('user', 'assistant')
        UNION ALL SELECT 'names an article', conv_id, turn FROM q WHERE regexp_matches(text, '제\d+조')
        UNION ALL SELECT 'length', conv_id, turn FROM q WHERE length(text) NOT BETWEEN 5 AND 150
        UNION ALL SELECT 'repeated', conv_id, turn FROM q WHERE text IN (SELECT text FROM q GROUP BY text HAVING count(*) > 1)
    ) SELECT problem, count(*) AS n, count(DISTINCT conv_id) AS files FROM e GROUP BY problem""")
def question_problems(spark, sf):
    """What is wrong with questions, by rule."""
    found = training.question_problems(_table(spark, sf, "conversations").select("conv_id", "turn", "text", F.col("role").alias("kind")), ("user", "assistant"))
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("files"))


_ASKED = r"""WITH q AS (SELECT conv_id % 5 AS file, conv_id % 3 AS law, conv_id * 100 + turn AS qid, text AS query, conv_id * 7 % 700 AS positive_id, CASE WHEN turn % 4 = 0 THEN [conv_id, conv_id + 430, conv_id * 7 % 700] ELSE [conv_id, conv_id + 430] END AS negatives, CASE WHEN turn % 5 = 4 THEN 'other' ELSE role END AS kind FROM conversations),
    c AS (SELECT vec_id AS id, vec_id % 3 AS law FROM embeddings)"""


def _asked(spark, sf):
    """Questions of files, one a turn, whose answers and negatives are rows of the embeddings or ids beyond them; and those rows with a law."""
    c = _table(spark, sf, "conversations")
    own, positive = F.col("conv_id"), F.col("conv_id") * 7 % 700
    two = F.array(own, own + 430)
    questions = c.select(
        (own % 5).alias("file"), (own % 3).alias("law"), (own * 100 + F.col("turn")).alias("qid"), F.col("text").alias("query"), positive.alias("positive_id"),
        F.when(F.col("turn") % 4 == 0, F.concat(two, F.array(positive))).otherwise(two).alias("negatives"), F.when(F.col("turn") % 5 == 4, "other").otherwise(F.col("role")).alias("query_type"),
    )
    return questions, _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).alias("law"))


@query(
    _ASKED
    + r""", s AS (SELECT *, nullif(trim(regexp_replace(query, '\s+', ' ', 'g')), '') AS said FROM q), i AS (SELECT said, file, count(*) AS n FROM s WHERE said IS NOT NULL GROUP BY ALL), f AS (SELECT said, count(*) AS n FROM i GROUP BY said), e AS (
        SELECT 'missing field' AS problem, qid FROM s WHERE said IS NULL OR kind IS NULL OR kind = ''
        UNION ALL SELECT 'type', qid FROM s WHERE kind <> '' AND kind NOT IN ('user', 'assistant')
        UNION ALL SELECT 'answer not in corpus', qid FROM s WHERE positive_id NOT IN (SELECT id FROM c)
        UNION ALL SELECT DISTINCT 'negative not in corpus', qid FROM (SELECT qid, unnest(negatives) AS id FROM s) WHERE id NOT IN (SELECT id FROM c)
        UNION ALL SELECT 'answer of another law', qid FROM s JOIN c ON id = positive_id WHERE s.law <> c.law
        UNION ALL SELECT 'answer among negatives', qid FROM s WHERE list_contains(negatives, positive_id)
        UNION ALL SELECT 'names an article', qid FROM s WHERE regexp_matches(query, '제\d+조')
        UNION ALL SELECT 'repeated in file', qid FROM s JOIN i USING (said, file) WHERE i.n > 1
        UNION ALL SELECT 'repeated between files', qid FROM s JOIN f USING (said) WHERE f.n > 1
        UNION ALL SELECT 'length', qid FROM s WHERE said IS NOT NULL AND length(said) NOT BETWEEN 5 AND 150
    ) SELECT problem, CASE WHEN problem = 'length' THEN 'warning' ELSE 'error' END AS severity, s.file, e.qid FROM e JOIN s USING (qid)"""
)
def checked_questions(spark, sf):
    """What is wrong with questions, one row a question and rule."""
    return training.check_questions(*_asked(spark, sf), ("user", "assistant"))


@query(_ASKED + " SELECT law, count(*) AS rows, count(*) FILTER (id IN (SELECT positive_id FROM q)) AS answered, round(count(*) FILTER (id IN (SELECT positive_id FROM q)) / CAST(count(*) AS DOUBLE), 6) AS share FROM c GROUP BY law")
def question_coverage(spark, sf):
    """How much of each law questions ask about."""
    return training.question_coverage(*_asked(spark, sf)).withColumn("share", F.round("share", 6))


@query(_ASKED + " SELECT CAST(len(negatives) AS INT) AS negatives, count(*) AS questions FROM q GROUP BY ALL")
def negatives_histogram(spark, sf):
    """How many negatives questions have."""
    return training.negatives_histogram(_asked(spark, sf)[0])


@query(_ASKED + r" SELECT word, count(*) AS questions FROM (SELECT unnest(list_distinct(regexp_extract_all(query, '[\p{L}\p{N}]+'))) AS word FROM q) WHERE length(word) >= 2 GROUP BY word")
def keyword_counts(spark, sf):
    """In how many questions each word occurs."""
    return training.keyword_counts(_asked(spark, sf)[0])


@query(r"""WITH q AS (SELECT role, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM conversations), t AS (SELECT count(*) AS n FROM q)
    SELECT role, count(*) AS questions, round(count(*) / (SELECT CAST(n AS DOUBLE) FROM t), 6) AS share, round(avg(w), 6) AS words, round(avg(CASE WHEN w IN (2, 3) THEN 1.0 ELSE 0.0 END), 6) AS short_share FROM q GROUP BY role""")
def question_statistics(spark, sf):
    """Types of questions, their share, words and share of those of two or three words."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    per = _table(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(words), 6).alias("words"), F.round(F.avg(F.when(words.isin(2, 3), 1.0).otherwise(0.0)), 6).alias("short_share"))
    share = F.round(F.col("questions") / F.sum("questions").over(Window.partitionBy()), 6)
    return per.select("role", "questions", share.alias("share"), "words", "short_share")


@query("SELECT CAST(n AS INT) AS n, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) WHERE n % 7 = 0")
def every_nth(spark, sf):
    """Every seventh document in order."""
    return training.every_nth(_table(spark, sf, "documents"), "doc_id", 7).select(F.col("n").cast("int").alias("n"), "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 25")
def seeded_sample(spark, sf):
    """Twenty-five documents by a seeded hash."""
    return training.seeded_sample(_table(spark, sf, "documents").select("doc_id"), "doc_id", 25, 3)


@query("SELECT law, CASE WHEN law IN (SELECT source FROM documents) THEN 'known' ELSE 'unknown' END AS status, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT source AS s FROM documents) WHERE contains(s, law) AND law NOT IN (SELECT source FROM documents)) AS similar FROM (VALUES ('src1'), ('src'), ('rc3'), ('nothing')) AS t(law)")
def law_names(spark, sf):
    """Names of laws that the corpus has, and for others those that contain them."""
    asked = spark.createDataFrame([("src1",), ("src",), ("rc3",), ("nothing",)], "law string")
    return store.check_names(asked, _table(spark, sf, "documents").select(F.col("source").alias("law")))


@query()
def suggested_names(spark, sf):
    """Known names like each of those that some of the texts' lines would be looked up by: sources with a letter too many, too few, or turned."""
    known = _table(spark, sf, "documents").select(F.concat_ws("-", "lang", "source").alias("law"))
    asked = known.distinct().select(F.explode(F.array(F.concat("law", F.lit("x")), F.expr("substr(law, 2)"), F.reverse("law"))).alias("law"))
    return store.suggest_names(asked, known).select("law", F.array_join("similar", ",").alias("similar"))


@query(
    """WITH a AS (SELECT source AS law, source || '/' || (doc_id // 200) AS article, count(*) AS n, md5('42:' || source || '/' || (doc_id // 200)) AS u FROM documents GROUP BY ALL),
    p AS (SELECT *, sum(n) OVER (PARTITION BY law ORDER BY u, article) - n / 2 AS middle, sum(n) OVER (PARTITION BY law) AS total, row_number() OVER (PARTITION BY law ORDER BY u DESC, article DESC) = 1 AS last FROM a)
    SELECT law, article, n, CASE WHEN last THEN 'train' WHEN middle < total * 0.15 THEN 'test' WHEN middle < total * 0.25 THEN 'dev' ELSE 'train' END AS split FROM p"""
)
def article_split(spark, sf):
    """Articles of each law dealt to test, dev and train by the shares of their questions."""
    rows = _table(spark, sf, "documents").filter("source is not null").select(F.col("source").alias("law"), F.concat_ws("/", "source", F.floor(F.col("doc_id") / 200)).alias("article"))
    return training.split_by_article(rows)


@query("WITH f AS (SELECT source, min(doc_id) AS f FROM documents GROUP BY source), o AS (SELECT source, dense_rank() OVER (ORDER BY f) - 1 AS code FROM f) SELECT doc_id, CAST(code AS INT) AS code FROM documents JOIN o USING (source)")
def dictionary_codes(spark, sf):
    """The source of each document as the place of its first occurrence among all sources."""
    return store.dictionary_codes(_table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id")


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INT), -1) AS k, coalesce(json_extract_string(props, '$.note'), 'none') AS note, event_type AS kind FROM events WHERE event_type <> 'error' AND coalesce(props, '') <> ''")
def normalised_records(spark, sf):
    """Records of different make with defaults; those without what is required are left out."""
    e = _table(spark, sf, "events").filter("event_type != 'error' and coalesce(props, '') != ''").withColumn("r", F.from_json("props", "k int, note string"))
    return e.select("event_id", F.coalesce("r.k", F.lit(-1)).alias("k"), F.coalesce("r.note", F.lit("none")).alias("note"), F.col("event_type").alias("kind"))


@query("SELECT event_id, ts, event_type FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) = 42")
def trace_lookup(spark, sf):
    """Log entries of one tag."""
    e = _table(spark, sf, "events")
    return e.filter(F.get_json_object("props", "$.k").cast("int") == 42).select("event_id", "ts", "event_type")


@query(r"SELECT doc_id, CAST(n AS INT) AS line, CAST(len(string_split(trim(line, '|'), '|')) AS INT) AS cells, trim(string_split(trim(line, '|'), '|')[1]) AS first FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents) WHERE regexp_matches(line, '\|.*\|')")
def table_rows(spark, sf):
    """Rows of tables in Markdown and their cells."""
    lines = _table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).filter(F.col("raw").rlike(r"\|.*\|"))
    cells = T.table_cells(F.col("raw"))
    return lines.select("doc_id", "line", F.size(cells).alias("cells"), cells[0].alias("first"))


@query(r"SELECT token, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+|[0-9]')) AS token FROM documents) GROUP BY token HAVING count(DISTINCT doc_id) > 20 OR regexp_matches(token, '^.$')")
def kept_vocabulary(spark, sf):
    """Tokens to keep: those of many documents, and all of one character."""
    tokens = _table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+|[0-9])")))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("documents")).filter((F.col("documents") > 20) | F.col("token").rlike("^.$"))


@query("WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role <> 'system') SELECT conv_id, turn, '[' || n || '] ' || role AS source FROM c")
def numbered_sources(spark, sf):
    """The sources of an answer, numbered from one."""
    rows = _table(spark, sf, "conversations").filter("role != 'system'")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("n", n).select("conv_id", "turn", F.concat(F.lit("["), "n", F.lit("] "), "role").alias("source"))


@query("SELECT event_type, round(avg(value), 6) AS mean_value, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k, count(*) AS calls FROM events GROUP BY event_type")
def cost_summary(spark, sf):
    """Mean costs of calls by kind."""
    return _table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 6).alias("mean_k"), F.count(F.lit(1)).alias("calls"))


@query("SELECT event_id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60) || ' min' WHEN s < 86400 THEN (s // 3600) || ' h' ELSE (s // 86400) || ' d' END AS age FROM (SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts)) AS BIGINT) AS s FROM events)")
def relative_times(spark, sf):
    """How long ago events were."""
    return _table(spark, sf, "events").select("event_id", T.relative_time(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("age"))


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 997 AS a, l_suppkey % 89 AS b FROM lineitem WHERE l_partkey % 997 > l_suppkey % 89), r(id) AS (SELECT CAST(88 AS BIGINT) UNION SELECT e.b FROM r JOIN e ON e.a = r.id) SELECT id FROM r"
)
def dependency_closure(spark, sf):
    """All that one thing depends on, directly or not."""
    edges = _table(spark, sf, "lineitem").select((F.col("l_partkey") % 997).alias("a"), (F.col("l_suppkey") % 89).alias("b")).filter("a > b").distinct()
    return store.closure(edges, spark.createDataFrame([(88,)], "id long"))
