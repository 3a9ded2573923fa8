"""Licence scans by canonical digest lookup, in DataFrame operations only.

A text is brought to a canonical form (case, punctuation, white space, copyright lines and
equivalent spellings do not count) and its digest is hash-joined to the digests of known licences.
"""

from __future__ import annotations

import functools
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, after the public guidelines for matching licence texts.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: (licence id, whole text) of the short licences, and notices in other words than those of ``NAMES``.
_SHORT = (
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_DISCLAIMER),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_DISCLAIMER),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_DISCLAIMER),
    ("BSD-2-Clause", _BSD_TWO + "\n\n" + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_TWO + "\n\n" + _BSD_END),
    ("BSD-3-Clause", _BSD_TWO + "\n" + _BSD_THIRD + "\n\n" + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_TWO + "\n" + _BSD_THIRD + "\n\n" + _BSD_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)

#: Whole texts, a file for each licence: <licence id>.txt.
TEXTS = Path(__file__).with_name("licence_texts")
#: What a file's text may end with before its advice on use.
_TERMS_END = re.compile(r"(?m)^\s*END OF TERMS AND CONDITIONS\s*$")

_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http{s}://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU_HEADER = """This {work} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation{version}

This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details.

You should have received a copy of the GNU {name}General Public License along with this {work}{end}"""
_FRANKLIN = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http{s}://mozilla.org/MPL/2.0/."""

def _versions(v: str) -> list[str]:
    """A GNU licence's version in words."""
    return [f"{x}{n}" for n in dict.fromkeys((v, v.removesuffix(".0"))) for x in (", version ", " version ", " v", " ")]


#: The names by which notices of one line call a licence.
NAMES = {
    "MIT": ("MIT License", "MIT", "MIT license (MIT)", "Expat License"),
    "ISC": ("ISC License", "ISC"),
    "0BSD": ("0BSD", "0BSD License", "BSD Zero Clause License", "Zero-Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2.0", "Apache License, Version 2.0 (Apache-2.0)"),
    "Unlicense": ("Unlicense", "Unlicense License"),
    "CC0-1.0": ("CC0 1.0", "CC0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"),
    "MPL-1.1": ("Mozilla Public License 1.1", "Mozilla Public License, version 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"),
} | {
    f"{short}-{v}-only": tuple(f"GNU {name}General Public License{x}" for name in names for x in _versions(v)) + tuple(f"{gnu}{short}{x}" for gnu in ("", "GNU ") for x in (*_versions(v), f"v{v[0]}" if v.endswith(".0") else f"v{v}", f"-{v}-only"))
    for short, names, versions in (("GPL", ("",), ("2.0", "3.0")), ("LGPL", ("Lesser ", "Library "), ("2.0", "2.1", "3.0")))
    for v in versions
} | {
    f"CC-{short}-4.0": tuple(x for t in (f"CC {short} 4.0", f"CC-{short}-4.0", f"Creative Commons {long} 4.0", f"Creative Commons {long} 4.0 International") for x in (t, t + " License"))
    for short, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
}
_VERBS = ("licensed", "released", "distributed", "published", "available", "made available")
_SUBJECTS = ("", *(f"This {x} is " for x in ("work", "software", "project", "program", "code", "file", "document", "text")))


def _notices():
    for own, names in NAMES.items():
        for name in {" ".join(re.findall(r"[^\W_]+", x.lower())): x for x in (*names, own)}.values():
            yield from ((own, f"{mark} {name}") for mark in ("License:", "SPDX-License-Identifier:"))
            yield from ((own, f"{subject}{verb} under {article}{name}.") for subject in _SUBJECTS for verb in _VERBS for article in ("", "the ", "a ", "the terms of the "))


def _headers():
    for s in ("", "s"):
        yield "Apache-2.0", _APACHE_HEADER.format(s=s)
        yield "MPL-2.0", _MPL_HEADER.format(s=s)
    for work in ("program", "library", "file", "software"):
        for short, name, v in (("GPL", "", "2.0"), ("GPL", "", "3.0"), ("LGPL", "Library ", "2.0"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3.0")):
            for mark in (";", ":"):
                for end in (".", _FRANKLIN, ". If not, see <http://www.gnu.org/licenses/>.", ". If not, see <https://www.gnu.org/licenses/>."):
                    for number in dict.fromkeys((v, v.removesuffix(".0"))):
                        form = functools.partial(_GNU_HEADER.format, work=work, mark=mark, name=name, end=end)
                        yield f"{short}-{v}-or-later", form(version=f"; either version {number} of the License, or (at your option) any later version.")
                        yield f"{short}-{v}-only", form(version=f", version {number} of the License.")
                        yield f"{short}-{v}-only", form(version=f"; version {number} of the License.")


def _whole():
    """The texts of the files, with and without the advice on use that follows the terms, as they are and with a line for each paragraph."""
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        end = _TERMS_END.search(text)
        for form in (text, text[: end.end()], text[: end.start()]) if end else (text,):
            yield path.stem, form
            yield path.stem, "\n\n".join(" ".join(x.split()) for x in re.split(r"\n\s*\n", form))


#: (licence id, whole text): whole texts, common header texts, and notices of one line.
KNOWN = tuple(dict.fromkeys((*_SHORT, *_whole(), *_headers(), *_notices())))

# Words after "copyright" that make a line part of a licence's body, not a notice.
BODY_WORDS = (
    "act", "acts", "and", "are", "as", "by law", "claim", "claims", "disclaimer", "doctrine", "for", "grant", "grants", "has", "holder", "holders", "if", "in", "infringement", "interest", "interests",
    "is", "law", "laws", "license", "licenses", "licence", "licences", "may", "notice", "notices", "of", "on", "or", "owner", "owners", "permission", "protection", "resulting", "right", "rights",
    "shall", "statement", "statements", "status", "to", "treaties", "treaty", "which", "will", "with",
)
_MARK = r"(?:copyright|\(c\)|©|&copy;)"
_YEAR = r"[\[<{(]?(?:[12][0-9]{3}\b|y{2,4}\b|year\b)"
#: A copyright notice takes a whole line: a mark, then a year or a placeholder; two marks; the sign; or "Copyright", so written, and
#: then a name, so written. A lone (c) before anything else is the third point of a list.
COPYRIGHT_LINE = (
    r"(?miu)^[^\p{L}\p{N}\n©(&]*(?:"
    rf"(?:{_MARK}[ \t,:]*)+{_YEAR}[^\n]*|copyright[ \t]*(?:\(c\)|©|&copy;)[^\n]*|\(c\)[ \t]*copyright\b[^\n]*|(?:©|&copy;)[^\n]*"
    rf"|(?-i:Copyright[ \t]*:?[ \t]+(?!(?i:{'|'.join(BODY_WORDS)})\b)(?:\p{{Lu}}\p{{Ll}}|[\[<{{])[^\n]*)"
    r"|all[ \t]+rights[ \t]+reserved[^\p{L}\p{N}\n]*)$"
)
_SPELT = r" (?:" + "|".join(a for a, _ in SPELLINGS) + ") "


def canonical(text: Column) -> Column:
    """Lower-case words of a text joined by single spaces, without lines that are a copyright notice
    or only reserve all rights, with one spelling for equivalent ones. Null counts as empty.

    A line that only happens to open with "copyright" or "(c)", as a line of a licence's body may after wrapping, stays."""
    words = F.lower(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), COPYRIGHT_LINE, " "))
    # Two spaces between words: each word then has both of its own when spellings are replaced.
    words = F.concat(F.lit(" "), F.regexp_replace(words, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    spelt = functools.reduce(lambda c, pair: F.replace(c, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), SPELLINGS, words)
    words = F.when(words.rlike(_SPELT), spelt).otherwise(words)
    return F.trim(F.replace(words, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """digest, license_id of the known texts: a fixed list, so its size is bounded and it may be broadcast."""
    table = spark.createDataFrame(list(known), "license_id string, text string")
    return table.select(digest(F.col("text")).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, license_id, digest, notices.

    ``license_id`` is the licence whose text the whole document is, else null; ``digest`` is the
    document's canonical digest; ``notices`` names, in order and joined by commas, the licences of
    which the document has a line that is as a whole a known text ("" if none).
    Null and empty texts have the digest of the empty text and match nothing. Equal texts give equal
    results; rows that share an id share its notices; rows with a null id have none. An empty table
    gives an empty result; other columns are ignored.

    By default the known digests are the fixed list above, and are hash-joined by broadcast. A table that
    is given (digest, license_id; one row per digest) may have any size: Spark chooses the join. Only the few lines that match are
    shuffled with the default, and no text. A very long text is one row of one task.
    """
    known = F.broadcast(known_digests(docs.sparkSession)) if known is None else known.select("digest", "license_id")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("_text"))
    whole = rows.select("doc_id", digest(F.col("_text")).alias("digest")).join(known, "digest", "left")
    lines = rows.filter(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.split("_text", "\n")).alias("_line")).select("doc_id", digest(F.col("_line")).alias("digest"))
    found = lines.join(known, "digest").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    return whole.join(found, "doc_id", "left").select("doc_id", "license_id", "digest", F.coalesce("notices", F.lit("")).alias("notices"))
