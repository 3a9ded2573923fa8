import re

from gristmill.llm import licenses as L

SCHEMA = "doc_id long, text string, digest int, license_id int"


BODY = "act acts and are as claim claims disclaimer doctrine for grant grants has holder holders if in infringement interest interests is law laws license licenses licence licences may notice notices of on or owner owners permission protection resulting right rights shall statement statements status to treaties treaty which will with".split()


def notice(own):
    """Whether a line is a copyright notice, read word by word."""
    own = re.sub(r"^[^\w©(&]*", "", own.replace("_", " ")).replace("&copy;", "©")
    line = own.lower()
    if re.fullmatch(r"all\s+rights\s+reserved\W*", line) or line.startswith("©"):
        return True
    marks = re.match(r"((?:copyright|\(c\)|©)[ \t,:]*)+", line)
    if not marks:
        return False
    rest, n = line[marks.end() :], len(re.findall(r"copyright|\(c\)|©", marks.group()))
    if re.match(r"[\[<{(]?([12]\d{3}\b|y{2,4}\b|year\b)", rest) or n > 1:
        return True
    first = re.match(r"\w+", own[marks.end() :])
    name = bool(first) and first.group()[:1].isupper() and first.group()[1:2].islower() and first.group().lower() not in BODY
    return own.startswith("Copyright ") and (name or rest[:1] in tuple("[<{"))


def plain(text):
    """The canonical form, another way: line by line and word by word."""
    lines = [x for x in (text or "").split("\n") if not notice(x)]
    return " ".join(dict(L.SPELLINGS).get(w, w) for w in re.findall(r"[^\W_]+", "\n".join(lines).lower()))


def scan(spark, rows):
    return {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA)).collect()}


def test_whole_texts_match_whatever_their_dress(spark):
    mit = next(t for k, t in L.KNOWN if k == "MIT" and "hereby" in t)
    bsd = next(t for k, t in L.KNOWN if k == "BSD-3-Clause" and t.startswith("Redis"))
    rows = [
        (1, "Copyright (c) 1999 Some One\n\n" + mit.upper()),
        (2, "  © 2001, A\n(C) 2002 B\n" + mit.replace(" ", " \t").replace('"', "“")),
        (3, bsd.replace("1.", "1)").replace(",", ";")),
        (4, mit + " and more"),
        (5, "copyright holders keep this\n" + mit),
        (10, "Copyright Some One and Others\n" + mit),
        (6, "LICENSED under the Apache Licence, version 2.0!"),
        (7, None),
        (8, ""),
        (9, "x " * 50_000),
    ]
    found = scan(spark, rows)
    assert {i: r.license_id for i, r in found.items()} == {1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: None, 5: None, 10: "MIT", 6: "Apache-2.0", 7: None, 8: None, 9: None}
    assert found[7].digest == found[8].digest


def test_canonical_form_is_the_plain_one(spark):
    texts = ["A licence, Licence LICENCE; whilst", "Copyright 1\nkeep\n# copyright x\ncopyrighted stays", "Ünïcode—dash “q” fulfil\r\n(c) y", "__init__ a_b", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = [r.c for r in df.select("i", L.canonical(df.t).alias("c")).orderBy("i").collect()]
    assert found == [plain(t) for t in texts]


def test_notices_ties_and_empty_table(spark):
    text = "words\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT license"
    found = scan(spark, [(1, text), (1, text), (None, text), (2, "none")])
    assert found[1].notices == "CC-BY-NC-4.0,MIT" and found[None].notices == "" and found[2].notices == ""
    assert L.scan_licenses(spark.createDataFrame([(1, text, 0, 0)] * 2, SCHEMA)).count() == 2
    assert L.scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_agrees_with_brute_force(spark):
    from gristmill.llm import queries

    sf = "/root/testdata/sf0.01"
    known = {plain(t): k for k, t in reversed(L.KNOWN)}
    for r in queries.documents(spark, sf).select("doc_id", "text").join(queries.op10_licenses(spark, sf), "doc_id").collect():
        assert r.license_id == known.get(plain(r.text))
        assert r.notices == ",".join(sorted({known[p] for x in r.text.split("\n") if (p := plain(x)) in known}))


def test_whole_texts_headers_and_notices_of_the_table(spark):
    bsd = next(t for k, t in L.KNOWN if k == "BSD-3-Clause" and t.startswith("Redis"))
    read = lambda k: (L.TEXTS / f"{k}.txt").read_text(encoding="utf-8")
    ids = ("Apache-2.0", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-1.1", "MPL-2.0", "Unlicense")
    rows = [(k, read(k).upper()) for k in ids] + [(k, "\n\n".join(" ".join(x.split()) for x in re.split(r"\n\s*\n", read(k)))) for k in ids]
    rows += [
        ("BSD-3-Clause", "Copyright (c) 2001, A\nAll rights reserved.\n\n" + bsd),
        ("BSD-3-Clause", "Copyright (c) 2001, A\n * ALL RIGHTS RESERVED\n" + bsd),
        ("Apache-2.0", "Licensed under the Apache License 2.0"),
        ("GPL-3.0-only", "This program is licensed under the GNU GPL v3."),
        ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
        ("Apache-2.0", read("Apache-2.0").split("limitations under the License.")[0].split("[name of copyright owner]")[1] + "limitations under the License."),
        ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License\nalong with this program.  If not, see <https://www.gnu.org/licenses/>."),
        (None, read("Apache-2.0") + " and more"),
        (None, "All rights reserved to their owners"),
    ]
    found = scan(spark, [(i, t) for i, (_, t) in enumerate(rows)])
    assert [found[i].license_id for i in range(len(rows))] == [k for k, _ in rows]


def test_a_known_text_names_one_licence():
    forms = {}
    for k, t in L.KNOWN:
        assert forms.setdefault(plain(t), k) == k


def test_wrapping_does_not_hide_a_licence(spark):
    """Whole texts with every "copyright", "(c)" and "holder" at the start of a line, wherever that makes no notice of it."""
    rows, answers = [], []
    for k, t in {t: k for k, t in L.KNOWN if len(t) > 600 and "Gnomovision" not in t}.items():  # the advice on use has notices within lines
        k, t = t, k
        wrapped = re.sub(r"(?i)[ \t]+(copyright(?! *\(c\)| [12]\d{3}| ©| owner\])|\(c\)(?! *[12]\d{3}| *<year>))", r"\n\1", t)
        rows.append((len(rows), wrapped))
        answers.append(k)
    found = scan(spark, rows)
    assert len(rows) > 20 and [found[i].license_id for i in range(len(rows))] == answers


def test_clauses_that_say_the_opposite_are_told_apart(spark):
    keep, drop = ("(a) Text.\n(c) You must retain all notices.", "(a) Text.\n(c) You may remove all notices.")
    found = scan(spark, [(1, keep), (2, drop), (3, "Copyright (c) 2001 A\n" + keep), (4, "(c) 2001 A\n" + keep), (5, "Copyright [yyyy] [name]\n" + keep)])
    assert found[1].digest != found[2].digest and found[1].digest == found[3].digest == found[4].digest == found[5].digest
