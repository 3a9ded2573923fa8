"""Statute files to articles, articles to pieces, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import clean_text, paragraph_number, strip
from gristmill.operators.order import running_sum

# How statute files mark their parts.
PARAGRAPH_MARK = "(?:[①-⑳㉑-㉟]|<\\d+>)"
ITEM_MARK = r"(\d+(?:의\d+)?)\.\s"
ARTICLE_HEADING = r"^##### (제\d+조(?:의\d+)?)(?:\s*\((.+)\))?\s*$"
CHAPTER_HEADING = r"^## (제\d+장(?:의\d+)?.*?)(?:\s*<.*>)?\s*$"
SUPPLEMENT = "## 부칙"
REPEALED = r"^(삭제\s*<[^>]*>|.*이를 폐지한다\.?)$"
#: The most characters of a piece with its title.
MOST = 800


def _paragraphs(text: Column) -> Column:
    """Structs of label and body of a text's paragraphs; what leads them joins the first, and a text of one mark or none is one, without label."""
    parts = F.split(text, f"(?m)(?=^{PARAGRAPH_MARK})")
    marked = F.filter(parts, lambda p: p.rlike(f"^{PARAGRAPH_MARK}"))
    lead = F.when(parts[0].rlike(f"^{PARAGRAPH_MARK}"), F.lit("")).otherwise(parts[0])

    def named(p: Column, i: Column) -> Column:
        number = paragraph_number(F.regexp_extract(p, f"^{PARAGRAPH_MARK}", 0)).cast("string")
        return F.struct(F.concat(F.lit("제"), number, F.lit("항")).alias("label"), strip(F.when(i == 0, F.concat(lead, p)).otherwise(p)).alias("body"))

    return F.when(F.size(marked) >= 2, F.transform(marked, named)).otherwise(F.array(F.struct(F.lit("").alias("label"), text.alias("body"))))


def _packs(label: Column, body: Column, room: Column) -> Column:
    """Structs of label and body of packs of numbered items: consecutive ones as long as they fit into ``room``, each pack
    after the sentence that leads them all. A body of fewer than two items is one pack."""
    parts = F.split(body, f"(?m)(?=^{ITEM_MARK})")
    items = F.filter(parts, lambda p: p.rlike(f"^{ITEM_MARK}"))
    lead = F.when(parts[0].rlike(f"^{ITEM_MARK}"), F.lit("")).otherwise(strip(parts[0]))
    room = room - F.length(lead)
    empty = F.array().cast("array<string>")

    def add(state: Column, item: Column) -> Column:
        text = strip(item)
        fits = (F.size(state["pack"]) == 0) | (state["size"] + F.length(text) + 1 <= room)
        return F.struct(
            F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["pack"]))).alias("done"),
            F.when(fits, F.concat(state["pack"], F.array(text))).otherwise(F.array(text)).alias("pack"),
            (F.when(fits, state["size"]).otherwise(0) + F.length(text) + 1).alias("size"),
        )

    start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("pack"), F.lit(0).alias("size"))
    packs = F.aggregate(items, start, add, lambda s: F.concat(s["done"], F.array(s["pack"])))

    def named(pack: Column) -> Column:
        first, last = (F.regexp_extract(x, f"^{ITEM_MARK}", 1) for x in (pack[0], F.element_at(pack, -1)))
        name = F.concat(F.lit("제"), F.when(first == last, first).otherwise(F.concat(first, F.lit("~"), last)), F.lit("호"))
        return F.struct(strip(F.concat(label, F.lit(" "), name)).alias("label"), F.array_join(F.concat(F.when(lead != "", F.array(lead)).otherwise(empty), pack), "\n").alias("body"))

    return F.when(F.size(items) >= 2, F.transform(packs, named)).otherwise(F.array(F.struct(label.alias("label"), body.alias("body"))))


def split_articles(articles: DataFrame, most: int = MOST) -> DataFrame:
    """Pieces of articles (id, text and perhaps title): id, parent_id, paragraph, n, text.

    An article that fits with its title is one piece. Others are cut at paragraph marks, and paragraphs that do not fit into packs of
    numbered items; what has neither stays whole, however long. ``paragraph`` names a piece, as in 제3항, 제1~12호 or 제1항 제1~12호; it is
    empty for a whole article. A piece's id is its article's and that name. Null texts and titles count as empty.
    """
    title = F.length(F.coalesce(F.col("title").cast("string"), F.lit(""))) if "title" in articles.columns else F.lit(0)
    rows = articles.select(F.col("id").cast("string").alias("parent_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), title.alias("_title"))
    whole = F.array(F.struct(F.lit("").alias("label"), F.col("text").alias("body")))
    rows = rows.select("parent_id", "_title", F.posexplode(F.when(F.col("_title") + F.length("text") <= most, whole).otherwise(_paragraphs(F.col("text")))).alias("_i", "p"))
    head = F.col("_title") + F.length("p.label")
    fits = head + F.length("p.body") <= most
    rows = rows.select("parent_id", "_i", F.posexplode(F.when(fits, F.array("p")).otherwise(_packs(F.col("p.label"), F.col("p.body"), F.lit(most) - head))).alias("_j", "p"))
    named = F.when(F.col("p.label") != "", F.concat("parent_id", F.lit("_"), F.replace("p.label", F.lit(" "), F.lit("_")))).otherwise(F.col("parent_id"))
    return rows.select(named.alias("id"), "parent_id", F.col("p.label").alias("paragraph"), F.struct("_i", "_j").alias("n"), F.col("p.body").alias("text"))


def parse_statutes(files: DataFrame) -> DataFrame:
    """Articles of statute files (path, value: the whole text): path, pos, law_name, promulgation_date, effective_date, source_url, chapter, article_no,
    article_title, text.

    The front matter is between the first two lines of dashes; the articles end at the supplementary provisions. An article's lines
    are gathered by running counts of headings within its file. Articles whose body is empty, deleted, or repeals the law go.
    """
    front = F.split("value", r"(?m)^---\s*?\n", 3)
    field = lambda name: strip(F.regexp_extract(front[1], rf"(?m)^{name}:\s*['\"]?([^'\"\n]*)", 1))
    lines = files.select("path", field("제목").alias("law_name"), field("공포일자").alias("promulgation_date"), field("시행일자").alias("effective_date"), field("출처").alias("source_url"), F.posexplode(F.split(front[2], r"\r\n|\r|\n")).alias("pos", "line"))
    order = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({
        "_over": F.max(F.col("line").startswith(SUPPLEMENT)).over(order),
        "chapter": F.last(F.when(F.col("line").rlike(CHAPTER_HEADING), strip(F.regexp_extract("line", CHAPTER_HEADING, 1))), True).over(order),
        "_n": F.sum(F.col("line").rlike(ARTICLE_HEADING).cast("int")).over(order),
    }).filter("not _over and _n > 0")
    heading = F.col("line").rlike(ARTICLE_HEADING)
    body = F.when(~F.col("line").startswith("#") & (strip(F.col("line")) != ""), F.struct("pos", strip(F.col("line")).alias("line")))
    once = ("law_name", "promulgation_date", "effective_date", "source_url")
    found = lines.groupBy("path", "_n").agg(
        *[F.first(c).alias(c) for c in once],
        F.min("pos").alias("pos"),
        F.max(F.when(heading, F.struct("line", F.coalesce("chapter", F.lit("")).alias("chapter")))).alias("h"),
        F.array_sort(F.collect_list(body)).alias("body"),
    )
    raw = F.array_join(F.transform("body", lambda x: x["line"]), "\n")
    found = found.withColumn("_raw", raw).filter(~F.col("_raw").rlike(REPEALED))
    part = lambda g: strip(F.regexp_extract("h.line", ARTICLE_HEADING, g))
    return found.select("path", "pos", *once, F.col("h.chapter").alias("chapter"), part(1).alias("article_no"), part(2).alias("article_title"), clean_text(F.col("_raw")).alias("text")).filter("text != ''")


def latest_files(files: DataFrame) -> DataFrame:
    """Of files (folder, title, date, name, ...) of one folder and title the one of the latest date; of equal dates the first by name."""
    order = Window.partitionBy("folder", "title").orderBy(F.desc("date"), "name")
    return files.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def build_corpus(files: DataFrame, themes: DataFrame, most: int = MOST) -> DataFrame:
    """The corpus of statute files (path, value) in folders .../<law>/<kind>.md, for the laws of ``themes`` (category, theme).

    One row per piece: id, title, text, category, theme, law_name, law_type, article_no, article_title, chapter, promulgation_date, effective_date,
    source_url, parent_id, paragraph. Of several files of one law and title the latest counts. Duplicate ids raise ValueError.
    """
    placed = files.withColumns({"_folder": F.element_at(F.split("path", "/"), -2), "_name": F.element_at(F.split("path", "/"), -1)})
    articles = parse_statutes(placed.select("path", "value"))
    heads = articles.select("path", F.col("law_name").alias("title"), F.col("promulgation_date").alias("date")).distinct()
    kept = latest_files(heads.join(placed.select("path", F.col("_folder").alias("folder"), F.col("_name").alias("name")), "path"))
    articles = articles.join(kept.select("path", F.col("folder").alias("category"), "name"), "path").join(themes, "category")
    law_type = F.split(F.regexp_replace("name", r"\.md$", ""), r"\(")[0]
    heading = F.when(F.col("article_title") != "", F.concat("article_no", F.lit(" ("), "article_title", F.lit(")"))).otherwise(F.col("article_no"))
    articles = articles.withColumn("law_type", law_type).withColumns({"_title": F.concat("law_name", F.lit(" "), heading), "_id": F.concat_ws("_", "category", "law_type", "article_no")})
    pieces = split_articles(articles.select(F.col("_id").alias("id"), F.col("_title").alias("title"), "text"), most)
    rows = pieces.join(articles.drop("text").withColumnRenamed("_id", "parent_id"), "parent_id")
    title = F.when(F.col("paragraph") != "", F.concat("_title", F.lit(" "), "paragraph")).otherwise(F.col("_title"))
    out = rows.select("id", title.alias("title"), "text", "category", "theme", "law_name", "law_type", "article_no", "article_title", "chapter", "promulgation_date", "effective_date", "source_url", "parent_id", "paragraph")
    twice = out.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if bad := twice.orderBy("id").limit(5).collect():
        raise ValueError(f"{twice.count()} duplicate ids, such as {[r.id for r in bad]}")
    return out


def parting(docs: DataFrame, id_col: str, size: Column, most: int = 40_000) -> DataFrame:
    """id, part: documents in ascending order of ids of any type, cut where the running sum of ``size`` passes multiples of ``most``."""
    rows = running_sum(docs.select(F.col(id_col).alias("id"), size.cast("long").alias("_size")), F.col("_size"), "id", name="_before")
    return rows.select("id", F.floor(F.col("_before") / most).alias("part"))
