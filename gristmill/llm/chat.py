"""Chat formatting: record layouts recognised by schema fingerprints, canonical turns, reversible templates.

A record's nested field paths are hashed; the hash selects a declarative mapping that turns the record
(a prompt with its completion, an instruction with its output, a list of messages, a single turn) into turns.
Turns are written between the marks of a template, with control strings inside texts escaped.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``turns`` lists (role, field paths): the fields' texts, empty ones left out, are joined by a blank line;
    an optional turn without text is left out. ``messages`` names a list of messages, ``role`` and ``text``
    the fields in it, ``text`` perhaps in a list of parts; without ``messages`` they are the record's own.
    """

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    messages: str | None = None
    role: str | None = None
    text: str | None = None

    @property
    def paths(self) -> tuple[str, ...]:
        own = tuple(p for _, fields in self.turns for p in fields)
        if self.role:
            prefix = f"{self.messages}[]." if self.messages else ""
            own += (prefix + self.role, prefix + self.text)
        return tuple(sorted(own))


MAPPINGS = (
    Mapping("turn", role="role", text="text"),
    Mapping("message", role="role", text="content"),
    Mapping("messages", messages="messages", role="role", text="content"),
    Mapping("messages_text", messages="messages", role="role", text="text"),
    Mapping("messages_parts", messages="messages", role="role", text="content[].text"),
    Mapping("conversations", messages="conversations", role="from", text="value"),
    Mapping("prompt_completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", (("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("system_prompt_completion", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), ("system",)),
    Mapping("instruction", (("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system_instruction_input", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), ("system",)),
    Mapping("question_answer", (("user", ("question",)), ("assistant", ("answer",)))),
)

#: Names under which layouts know the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant", "chatgpt": "assistant"}


def fingerprint(paths) -> str:
    """Digest of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(value, prefix: str = "") -> set[str]:
    """Paths of all leaves of a record; a list's elements share the path of the list with []."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{prefix}[]") for v in value)) if value else {f"{prefix}[]"}
    return {prefix}


def _text(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _field(record: dict, path: str) -> str:
    """The text of a field; of a list's elements, as in ``content[].text``, the texts joined by a blank line, empty ones left out."""
    name, listed, rest = path.partition("[].")
    if not listed:
        return _text(record.get(name))
    return "\n\n".join(t for x in record.get(name) or [] if isinstance(x, dict) and (t := _text(x.get(rest))))


class Layouts:
    """Mappings by fingerprint. Paths that no mapping names (ids, meta data) do not count."""

    def __init__(self, mappings=MAPPINGS, roles=ROLES):
        self.by_print = {fingerprint(m.paths): m for m in mappings}
        self.known = {p for m in mappings for p in m.paths}
        self.empty = {f"{m.messages}[]": m for m in mappings if m.messages}
        self.roles, self.seen = roles, {}

    def of(self, record) -> Mapping | None:
        if not isinstance(record, dict):
            return None
        paths = field_paths(record)
        own = frozenset(paths & self.known)
        if own not in self.seen:
            self.seen[own] = self.by_print.get(fingerprint(own))
        return self.seen[own] or next((self.empty[p] for p in sorted(paths & self.empty.keys())), None)

    def turns(self, record) -> tuple[str | None, list[tuple[str, str]]]:
        """The layout's name, None if unknown, and the turns."""
        m = self.of(record)
        if m is None:
            return None, []
        if m.role:
            found = (record.get(m.messages) or []) if m.messages else [record]
            found = [x if isinstance(x, dict) else {} for x in found]
            return m.name, [(self.roles.get(r := _text(x.get(m.role)), r), _field(x, m.text)) for x in found]
        out = []
        for role, fields in m.turns:
            text = "\n\n".join(t for f in fields if (t := _text(record.get(f))))
            if text or role not in m.optional:
                out.append((role, text))
        return m.name, out


def canonical_turns(records: DataFrame, id_col: str = "conv_id", order_col: str = "turn", record_col: str = "record", mappings=MAPPINGS) -> DataFrame:
    """One row per turn of JSON records: conv_id, turn, seq, layout, role, text.

    ``turn`` is the record's place in its conversation and ``seq`` the turn's place in the record. A record
    of unknown layout, or that is no JSON object, is not lost: it has one row with null seq, layout, role and
    text. A list without messages has none. Null texts count as empty. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts(mappings)
        for batch in batches:
            rows = []
            for conv, turn, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                name, turns = layouts.turns(record)
                rows += [(conv, turn, None, None, None, None)] if name is None else [(conv, turn, k, name, r, t) for k, (r, t) in enumerate(turns)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "turn", "seq", "layout", "role", "text"])

    rows = records.select(records[id_col].cast("long").alias("conv_id"), records[order_col].cast("long").alias("turn"), records[record_col].alias("record"))
    return rows.mapInArrow(run, "conv_id long, turn long, seq int, layout string, role string, text string")


#: Strings that mean control to tokenizers or templates; inside texts a backslash parts them.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>\n"


def escape(text: Column) -> Column:
    """No control string is left in the text; ``unescape`` gives it back."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """The formatted text in segments, one per turn: conv_id, turn, seq, formatted, loss_start, loss_length.

    A conversation's text is its segments in the order of (turn, seq, role, text). The loss mask is the
    span of ``loss_length`` code points from ``loss_start`` in the segment; 0 long where no loss is taken.
    Rows without a role (records of unknown layout) have no segment.
    """
    role, text = escape(F.col("role")), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.lit(MIDDLE))
    rows = turns.filter(F.col("role").isNotNull())
    return rows.select("conv_id", "turn", "seq", F.concat(head, text, F.lit(CLOSE)).alias("formatted"), F.length(head).cast("long").alias("loss_start"), F.when(F.col("role") == loss_role, F.length(text)).otherwise(0).cast("long").alias("loss_length"))


def write_formatted(segments: DataFrame, path: str) -> None:
    """Write segments as Parquet, each conversation's together and in order, in ascending ranges of ids."""
    segments.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq", "formatted").write.mode("overwrite").parquet(path)


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Turns read back from segments: conv_id, turn, seq, role, text, loss_text, formatted."""
    inner = rf"(?s)^{_quoted(OPEN)}(.*?){_quoted(MIDDLE)}(.*){_quoted(CLOSE)}$"
    loss = F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_length as int))")
    return formatted.select(
        "conv_id",
        "turn",
        "seq",
        unescape(F.regexp_extract("formatted", inner, 1)).alias("role"),
        unescape(F.regexp_extract("formatted", inner, 2)).alias("text"),
        F.when(F.col("loss_length") > 0, unescape(loss)).alias("loss_text"),
        "formatted",
    )


def _quoted(mark: str) -> str:
    return "".join(f"\\{c}" if c in "<|>[]()" else c for c in mark)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation of turns read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    turns_sha256 is of role, line end, text, line end of every turn in order, loss_sha256 of all text under the
    loss mask. A conversation's turns are hashed as they stream by in order, so a task holds one batch of them
    however long it is; a digest of one sequence can't be split further.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, some = None, False
        n = chars = size = 0
        whole = loss = None

        def done():
            return pa.RecordBatch.from_pylist([dict(zip(names, (now, n, whole.hexdigest(), chars, loss.hexdigest(), size), strict=True))], schema)

        for batch in batches:
            out = []
            for conv, role, text, masked, length in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if not some or conv != now:
                    if some:
                        out.append(done())
                    now, some, n, chars, size, whole, loss = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                n += 1
                size += length
                whole.update(f"{role}\n{text}\n".encode())
                if masked:
                    chars += len(masked)
                    loss.update(masked.encode())
            yield from (pa.Table.from_batches(out).combine_chunks().to_batches() if out else ())
        if some:
            yield done()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "role", "text")
    return ordered.select("conv_id", "role", "text", "loss_text", F.length("formatted").cast("long").alias("length")).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_records(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, record: each row of a conversations table (conv_id, turn, role, text) as a JSON record."""
    c = conversations
    record = F.to_json(F.struct(F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"), c["text"].cast("string").alias("text")), {"ignoreNullFields": "false"})
    return c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), record.alias("record"))
