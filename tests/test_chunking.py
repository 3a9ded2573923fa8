"""Pieces of articles against a plain line-by-line reading."""

import re

from pyspark.sql import functions as F

from gristmill.functions.text import clean_text
from gristmill.operators import chunking
from gristmill.plans import catalog

SF = "/root/testdata/sf0.001"
MARKS = [chr(0x2460 + i) for i in range(20)] + [chr(0x3251 + i) for i in range(15)]


def number(line):
    if line[:1] in MARKS and line:
        return MARKS.index(line[0]) + 1
    m = re.match(r"<([0-9]+)>", line)
    return int(m.group(1)) if m else None


def items(body, room):
    lead, found = [], []
    for line in body.split("\n"):
        if m := re.match(r"(\d+(?:의\d+)?)\.(\s|$)", line):
            found.append((m.group(1), [line]))
        else:
            (found[-1][1] if found else lead).append(line)
    if len(found) < 2:
        return [("", body)]
    lead, out, held = "\n".join(lead).strip(), [], []
    found = [(k, "\n".join(x).strip()) for k, x in found]
    for k, x in found:
        if held and len(lead) + sum(len(y) + 1 for _, y in held) + len(x) + 1 > room:
            out.append(held)
            held = []
        held = [*held, (k, x)]
    return [("제" + (p[0][0] if len(p) == 1 else p[0][0] + "~" + p[-1][0]) + "호", "\n".join(([lead] if lead else []) + [x for _, x in p])) for p in [*out, held]]


def pieces(title, text, most=800):
    title, text = title or "", text or ""
    if len(title) + len(text) <= most:
        return [("", text)]
    lines, parts = text.split("\n"), []
    if sum(number(x) is not None for x in lines) < 2:
        return items(text, most - len(title))
    lead = []
    for x in lines:
        if (n := number(x)) is not None:
            parts.append((f"제{n}항", lead + [x] if not parts else [x]))
        elif parts:
            parts[-1][1].append(x)
        else:
            lead.append(x)
    out = []
    for label, own in parts:
        body, room = "\n".join(own).strip(), most - len(title) - len(label)
        out += [(label, body)] if len(body) <= room else [(f"{label} {k}".strip(), x) for k, x in items(body, room)]
    return out


def brute(rows, most=800):
    return {(f"{own}_{p.replace(' ', '_')}" if p else str(own), str(own), p, t) for own, title, text in rows for p, t in pieces(title, text, most)}


def rows_of(df):
    return {(r.id, r.parent_id, r.paragraph, r.text) for r in df.collect()}


def test_marks_items_headings(spark):
    many = "\n".join(f"{m} paragraph {i} of the law" for i, m in enumerate(MARKS))
    angle = "lead\n" + "\n".join(f"<{i}> text {'x' * 30}" for i in range(14, 19))
    listed = "② " + "a lead sentence:\n" + "\n".join(f"{i}. item {'y' * 20}\n가. below" for i in range(1, 9)) + "\n2의3. another"
    single = "① only " + "z" * 60 + "\n" + "w" * 60
    rows = [("many", "", many), ("angle", "t", angle), ("listed", "title", "① one\n" + listed), ("plain", None, listed[2:]), ("single", "", single), ("fits", "h" * 20, "v" * 80), ("over", "h" * 21, "v" * 40 + "\n" + "u" * 39), ("none", "", None)]
    df = spark.createDataFrame(rows, "id string, title string, text string")
    found = sorted(chunking.split_articles(df, 100).collect(), key=lambda r: (r.parent_id, r.n))
    assert {(r.id, r.parent_id, r.paragraph, r.text) for r in found} == brute(rows, 100)
    by = lambda k: [r for r in found if r.parent_id == k]
    assert [r.paragraph for r in by("many")] == [f"제{i}항" for i in range(1, 36)]
    assert [r.paragraph for r in by("angle")] == [f"제{i}항" for i in range(14, 19)] and by("angle")[0].text.startswith("lead\n")
    assert len(by("listed")) > 2 and all(r.text.startswith("② a lead sentence:") and r.paragraph.startswith("제2항 제") for r in by("listed")[1:])
    assert [r.paragraph for r in by("single")] == [""] and len(by("fits")) == len(by("over")) == 1
    assert chunking.split_articles(df.limit(0)).collect() == []


def test_marks_are_kept_by_cleaning(spark):
    text = "**①** one <2020.3.31>\n**<16>** <16> sixteen\n**<17>** seventeen\n㉑ 삭제\n② 삭제 <2008.3.21>\n2의3. 삭제\n③ 삭제 요청을 받은 자\nlast"
    assert spark.range(1).select(clean_text(F.lit(text)).alias("t")).first().t == "① one\n<16> sixteen\n<17> seventeen\n③ 삭제 요청을 받은 자\nlast"


def test_query_agrees_with_brute_force(spark):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(catalog.QUERIES["document_pieces"](spark, SF)) == brute(rows)


BODY = """## 제1장 총칙 <개정 2009.5.21>

##### 제1조 (목적)

이 법은 근로조건의 기준을 정한다. <개정 2018.6.12>

##### 제2조

삭제 <2008.3.21>

## 제2장의2 보칙

##### 제2조의2 (정의)

**①** "근로자"란 사람을 말한다.
  1\\. 첫째 <신설 2020.3.31>
2\\. 삭제 <2019. 1. 1.>
**<16>** <16> 본문 <img src="x"></img>
삭제 요청을 받은 자는 따라야 한다.

## 부칙

##### 제1조 (시행일)

이 법은 공포한 날부터 시행한다.
"""


def statute(title, date, body):
    return f"---\n제목: {title}\n공포일자: {date}\n시행일자: '{date}'\n출처: https://example.org/{title}\n---\n\n# {title}\n\n{body}"


def test_corpus_of_statute_files(spark):
    files = [
        ("/x/kr/테스트법/법률.md", statute("테스트법", "1997-03-13", "##### 제0조\n\n테스트법은 이를 폐지한다.\n\n##### 제9조\n\n남는 조\n")),
        ("/x/kr/테스트법/법률(법률).md", statute("테스트법", "2024-01-01", BODY)),
        ("/x/kr/테스트법/시행령.md", statute("테스트법 시행령", "2024-01-01", "##### 제3조 (의무)\n\n**①** 사용자는 임금을 지급한다.\n**②** 근로자는 성실히 일한다.\n")),
        ("/x/kr/남의법/법률.md", statute("남의법", "2024-01-01", BODY)),
    ]
    df = spark.createDataFrame(files, "path string, value string")
    themes = spark.createDataFrame([("테스트법", "youth"), ("없는법", "youth")], "category string, theme string")
    found = {r.id: r for r in chunking.build_corpus(df, themes).collect()}
    assert set(found) == {"테스트법_법률_제1조", "테스트법_법률_제2조의2", "테스트법_시행령_제3조"}
    short = {r.id: r for r in chunking.build_corpus(df, themes, 45).collect()}
    assert {"테스트법_시행령_제3조_제1항", "테스트법_시행령_제3조_제2항", "테스트법_법률_제2조의2_제16항"} < set(short)
    found |= {"테스트법_시행령_제3조_제2항": short["테스트법_시행령_제3조_제2항"]}
    one, two, part = (found[f"테스트법_{k}"] for k in ("법률_제1조", "법률_제2조의2", "시행령_제3조_제2항"))
    assert (one.title, one.text, one.chapter, one.theme, one.effective_date, one.source_url) == ("테스트법 제1조 (목적)", "이 법은 근로조건의 기준을 정한다.", "제1장 총칙", "youth", "2024-01-01", "https://example.org/테스트법")
    assert two.chapter == "제2장의2 보칙" and two.text == '① "근로자"란 사람을 말한다.\n1. 첫째\n<16> 본문 \n삭제 요청을 받은 자는 따라야 한다.'
    assert (part.title, part.text, part.parent_id, part.paragraph, part.law_type) == ("테스트법 시행령 제3조 (의무) 제2항", "② 근로자는 성실히 일한다.", "테스트법_시행령_제3조", "제2항", "시행령")


def test_duplicate_ids_are_refused(spark):
    import pytest

    body = "##### 제1조\n\n본문 하나\n\n##### 제1조\n\n본문 둘\n"
    df = spark.createDataFrame([("/kr/a/법률.md", statute("a", "2024-01-01", body))], "path string, value string")
    with pytest.raises(ValueError, match="duplicate"):
        chunking.build_corpus(df, spark.createDataFrame([("a", "t")], "category string, theme string"))
