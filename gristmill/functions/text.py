"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What models want before a question and a document, and which models want what.
PROFILES = {
    "e5": ("query: {query}", "passage: {text}"),
    "gemma": ("task: search result | query: {query}", "title: {title} | text: {text}"),
}
MODELS = {"multilingual-e5-small": "e5", "embeddinggemma-300m": "gemma"}


def doc_text(title: Column, text: Column) -> Column:
    return F.concat(title, F.lit("\n"), text)


def model_input(profile: str, title: Column, text: Column) -> Column:
    """A document as the model's profile wants it; the title is 'none' where it is missing."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    if profile == "gemma":
        return F.concat(F.lit("title: "), F.coalesce(F.nullif(title, F.lit("")), F.lit("none")), F.lit(" | text: "), text)
    return F.concat(F.lit("passage: "), doc_text(title, text))


def query_input(profile: str, query: Column) -> Column:
    """A question as the model's profile wants it."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    return F.concat(F.lit(PROFILES[profile][0].split("{query}")[0]), query)


def profile_of(model: str, exists: bool = False) -> str:
    """The profile of a model by the last part of its name. A folder (``exists``, or a name that is none of a hub's) that isn't known is a tuned e5 model;
    a hub's model that isn't known raises ValueError, since its input would be guessed."""
    if (known := MODELS.get(model.rstrip("/").rpartition("/")[2])) is not None:
        return known
    if not exists and re.fullmatch(r"[\w.-]+/[\w.-]+", model):
        raise ValueError(f"no profile for {model}; there are {', '.join(MODELS)}")
    return "e5"


def question_key(query: Column, positive_id: Column) -> Column:
    return F.substring(F.sha1(F.concat(query, F.char(F.lit(0)), positive_id)), 1, 12)


def grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters; none where the text is null or shorter.

    The text is bound once, as a lambda's variable: an expression inside a lambda is computed for each element.
    """

    def runs(bound: Column) -> Column:
        chars = F.split(bound, "")
        joined = chars
        for k in range(2, n + 1):
            joined = F.zip_with(joined, F.slice(chars, k, F.size(chars)), lambda a, b: F.concat(a, b))
        return F.array_distinct(F.filter(joined, lambda x: x.isNotNull() & (x != "")))

    return F.transform(F.array(F.coalesce(text, F.lit(""))), runs)[0]


def squeeze_for_grams(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def containment(query_grams: Column, doc_grams: Column) -> Column:
    """Share of the query's grams that the document has; 0 without any."""
    n = F.size(query_grams)
    return F.when(n > 0, F.size(F.array_intersect(query_grams, doc_grams)) / n).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def snippet(text: Column, width: int = 120) -> Column:
    return F.when(F.char_length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def expanded_query(query: Column, expansion: Column) -> Column:
    return F.trim(F.concat(query, F.lit(" "), squeeze(expansion)))


def citations(text: Column) -> Column:
    """Numbers cited in brackets, in order: [1], [2, 3]."""
    inside = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*[,，]\s*\d+)*)\]"), 1)
    return F.transform(F.flatten(F.transform(inside, lambda s: F.split(F.regexp_replace(s, r"\s", ""), "[,，]"))), lambda s: s.cast("int"))


def context_header(law: Column, chapter: Column, title: Column, text: Column) -> Column:
    head = F.when(F.coalesce(chapter, F.lit("")) != "", F.concat(law, F.lit(" > "), chapter)).otherwise(law)
    return F.concat(F.lit("["), head, F.lit("] "), title, F.lit("\n"), text)


# Marks of emphasis and history in statute files.
ANGLE_MARK = r"(?m)^\*\*<(\d+)>\*\*\s*(?:<\1>\s*)?"
HISTORY_AND_IMAGES = r"\s*<(?:개정|신설|\d{4}\.)[^>]*>|<img[^>]*>|</img>"
DELETED_LINE = r"^(?:[①-⑳㉑-㉟]|\d+(?:의\d+)?\.|[가-하]\.)\s*삭제\s*$"


def strip(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def unlike_lines(text: Column, pattern: str) -> Column:
    """The lines of a text that do not match once stripped."""
    return F.array_join(F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: ~strip(x).rlike(pattern)), "\n")


def clean_text(text: Column) -> Column:
    """Statute text with paragraph marks of one form, without bold marks, escaped dots, amendment and image tags, and lines that only say that they are deleted."""
    marked = F.regexp_replace(text, ANGLE_MARK, "<$1> ")
    plain = F.regexp_replace(F.replace(F.replace(marked, F.lit("**"), F.lit("")), F.lit("\\."), F.lit(".")), HISTORY_AND_IMAGES, "")
    return strip(unlike_lines(plain, DELETED_LINE))


def paragraph_number(mark: Column) -> Column:
    """Number of a circled paragraph mark or of <n>; null for anything else."""
    code = F.ascii(mark)
    return F.when(code.between(0x2460, 0x2473), code - 0x2460 + 1).when(code.between(0x3251, 0x325F), code - 0x3251 + 21).otherwise(F.regexp_extract(mark, r"^<(\d+)>", 1).try_cast("int"))


def table_cells(row: Column) -> Column:
    """The cells of a row of a table in Markdown."""
    return F.transform(F.split(F.regexp_replace(row, r"^\|+|\|+$", ""), r"\|"), strip)


def relative_time(at: Column, now: Column) -> Column:
    """How long ago a time was, in its largest whole unit."""
    seconds = F.floor(F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(at.cast("timestamp")) / 1e6)
    unit = lambda n, name: F.concat(F.floor(seconds / n).cast("string"), F.lit(name))
    return F.when(seconds < 60, "now").when(seconds < 3600, unit(60, " min")).when(seconds < 86400, unit(3600, " h")).otherwise(unit(86400, " d"))
