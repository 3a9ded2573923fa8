"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Every text's byte triplets are hashed into buckets and counted. The digest writes, for each bucket, in
which quartile of the text's counts it lies, with the quartiles' ratios and the text's length on
a logarithmic scale. Two digests are compared by a bounded difference score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm import words
from gristmill.llm.shared import settle

BUCKETS = 128
#: Ways to take three of five neighbouring bytes, the newest always among them.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
#: A digest's parts: checksum of the bytes (8 hex digits), length class (2), quartile ratios (2), quartiles of the buckets (2 bits each).
HEAD = 12
#: Weights of the parts in the difference score, and the score at which two digests count as unlike altogether.
LENGTH_WEIGHT, RATIO_WEIGHT, MOST = 6, 4, 200


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the hashed triplets of each text."""
    n = len(offsets) - 1
    counts = np.zeros(n * BUCKETS, np.int64)
    lengths = np.diff(offsets)
    base = np.repeat((np.arange(n) * BUCKETS).astype(np.int32), lengths)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    b = data.astype(np.uint32)
    for t, (i, j) in enumerate(TRIPLETS):
        far = max(i, j)
        if len(data) <= far:
            continue
        h = b[far:] * np.uint32(0x9E3779B1) + b[far - i : len(b) - i] * np.uint32(0x85EBCA77) + b[far - j : len(b) - j] * np.uint32(0xC2B2AE3D) + np.uint32((t + 1) * 0x27D4EB2F & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        slot = (h >> np.uint32(25)).view(np.int32) + base[far:]
        counts += np.bincount(slot[place[far:] >= far], minlength=len(counts))
    return counts.reshape(n, BUCKETS)


def digests(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The fingerprint of each text, in hex."""
    n = len(offsets) - 1
    if not n:
        return []
    counts = bucket_counts(data, offsets)
    ranked = np.sort(counts, axis=1)
    q = ranked[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, :, None] > q[:, None, :]).sum(axis=2).astype(np.uint8)
    packed = codes[:, 0::4] << 6 | codes[:, 1::4] << 4 | codes[:, 2::4] << 2 | codes[:, 3::4]
    top = np.maximum(q[:, 2], 1)
    ratios = (q[:, 0] * 100 // top % 16 << 4 | q[:, 1] * 100 // top % 16).astype(np.uint8)
    length = np.minimum(np.log2(np.diff(offsets) + 1.0) * 8, 255).astype(np.uint8)
    out = []
    raw = data.tobytes()
    for k in range(n):
        check = hashlib.blake2s(raw[offsets[k] : offsets[k + 1]], digest_size=4).hexdigest()
        out.append(f"{check}{length[k]:02x}{ratios[k]:02x}{packed[k].tobytes().hex()}")
    return out


_BITS = np.array([[abs((a >> s & 3) - (b >> s & 3)) for s in (0, 2, 4, 6)] for a in range(256) for b in range(256)])
#: Difference of four bucket codes at once: a step of three quartiles counts six.
_STEP = np.where(_BITS == 3, 6, _BITS).sum(axis=1).reshape(256, 256)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """1 for equal digests, down to 0 for those whose difference score reaches its bound; symmetric."""
    if not left:
        return np.zeros(0)
    a, b = (np.frombuffer(bytes.fromhex("".join(x)), np.uint8).reshape(len(x), -1) for x in (left, right))
    score = _STEP[a[:, 6:], b[:, 6:]].sum(axis=1)
    apart = np.abs(a[:, 4].astype(int) - b[:, 4])
    score += np.where(apart <= 1, apart, LENGTH_WEIGHT * (apart - 1))
    for shift in (4, 0):
        step = np.abs((a[:, 5] >> shift & 15).astype(int) - (b[:, 5] >> shift & 15))
        step = np.minimum(step, 16 - step)
        score += np.where(step <= 1, step, RATIO_WEIGHT * (step - 1))
    score += (a[:, :4] != b[:, :4]).any(axis=1)
    return 1 - np.minimum(score, MOST) / MOST


def _digests_of(texts: list[bytes]) -> list[str]:
    out: list[str] = []
    first, size = 0, 0
    for k, t in enumerate([*texts, None]):
        if t is None or (size and size + len(t) > words.CHUNK_BYTES):
            offsets = np.cumsum([0] + [len(x) for x in texts[first:k]])
            out += digests(np.frombuffer(b"".join(texts[first:k]), np.uint8), offsets)
            first, size = k, 0
        size += len(t or b"")
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_bytes and fingerprint of its whole text.

    Null counts as empty; a text of fewer than three bytes has all counts zero. Equal texts have equal
    fingerprints. An empty table gives an empty result. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                data, offsets = words.buffers(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(digests(data, offsets), pa.string())], ["doc_id", "n_bytes", "fingerprint"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, fingerprint string")


EDITED = (
    ("doc_id", pa.int64()),
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
)


def _edit(text: str, following: str) -> str:
    """The text with its last third replaced by as many first code points of the following one (or all of it)."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _edited_rows(ids: list, texts: list[str], following: list[str]) -> dict:
    changed = [_edit(t, f) for t, f in zip(texts, following, strict=True)]
    own = _digests_of([t.encode() for t in [*texts, following[-1]]])
    edited = _digests_of([t.encode() for t in changed])
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": own[:-1],
        "edited_fingerprint": edited,
        "near_edited": likeness(own[:-1], edited),
        "near_next": likeness(own[:-1], own[1:]),
    }


_EDGES = "part int, edge string, edge_id long, edge_text string"
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, in order: each with the one after it; the range's first and last rows as edges."""
    part, held = TaskContext.get().partitionId(), None
    types = [*EDITED, ("part", pa.int32()), ("edge", pa.string()), ("edge_id", pa.int64()), ("edge_text", pa.string())]

    def emit(rows: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[k], t) if k in rows else pa.nulls(n, t) for k, t in types], [k for k, _ in types])

    for batch in batches:
        for piece in words.chunks(batch, "text"):
            ids, texts = piece.column("doc_id").to_pylist(), [t or "" for t in piece.column("text").to_pylist()]
            if held is None:
                yield emit({"part": [part], "edge": ["first"], "edge_id": ids[:1], "edge_text": texts[:1]}, 1)
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            if len(ids) > 1:
                yield emit(_edited_rows(ids[:-1], texts[:-1], texts[1:]), len(ids) - 1)
    if held:
        yield emit({"part": [part], "edge": ["last"], "edge_id": [held[0]], "edge_text": [held[1]]}, 1)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_pydict(_edited_rows([row["edge_id"]], [row["edge_text"]], [row["following"]]), schema=pa.schema(EDITED))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the code points replaced by the first ones of the next
    document by descending id (after the last: the first). near_edited and near_next are the
    likenesses of the text's fingerprint to the edited text's and to the next document's.

    Texts are shuffled once, into ranges of ids; a range is read in order with one row held. Only the
    ranges' first and last rows are joined afterwards, two for each range.

    Null counts as empty. Rows without an id come last; rows of one id follow one another by
    text. A table of one row is its own next. An empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    by = [F.desc_nulls_last("doc_id"), F.asc("text")]
    ranged = rows.repartitionByRange(by[0]).sortWithinPartitions(*by)
    found = settle(ranged.mapInArrow(_neighbours, f"{_SCHEMA}, {_EDGES}"))
    firsts, lasts = (found.filter(f"edge = '{e}'").select("part", "edge_id", "edge_text") for e in ("first", "last"))
    # Which range follows which is decided on one number for each range; texts are joined to it.
    order = Window.orderBy("part")
    following = firsts.select("part").select(F.col("part").alias("then"), F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())).alias("part"))
    pairs = lasts.join(following, "part").join(firsts.select(F.col("part").alias("then"), F.col("edge_text").alias("following")), "then").select("edge_id", "edge_text", "following")
    columns = [k for k, _ in EDITED]
    return found.filter("edge is null").select(*columns).union(pairs.mapInArrow(_edges, _SCHEMA))
