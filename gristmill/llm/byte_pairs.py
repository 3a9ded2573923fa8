"""Byte-level BPE by prefix dynamic programming, exact appends and edits, and decoding.

Of the encodings of all prefixes of a piece of text, each is an earlier one and one token more: the last token of a prefix is the one
token that ends there and may follow the last token of what stands before it. So a table with the last token of each
prefix holds the encodings of them all. It is filled from left to right, an append goes on where it ends, and after an
edit it is filled anew only until as many entries as the longest token has bytes are the old ones again.

Two tokens may stand side by side if merging their bytes by rank keeps them apart. The merges that could join them across their
border are those of a token on the right flank of the first one's merges with one on the left flank of the second one's;
which of them comes first is told by ranks alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from gristmill.llm import words
from gristmill.llm.shared import small_batches

#: Bytes of text that are encoded at once, and segments of one text that are split off at once.
CHUNK_BYTES, MANY = 1 << 20, 1 << 18
#: Pieces of at most so many bytes are worked on side by side; longer ones by themselves.
WIDE = 64
#: Characters of segments and of pieces whose encodings a worker remembers, and pairs of tokens (a power of 2).
REMEMBERED, PAIRS = 1 << 20, 1 << 20
_BITS = np.uint64(20)

#: The UTF-8 bytes of white space beyond ASCII.
_WHITE = np.array([0xC285, 0xC2A0, 0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])


def _segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments of the texts begin: at texts' beginnings, and at ASCII white space that follows on no white space.

    A match of a pattern that takes white space only in front of other characters, or by itself, never lies across such a place, and
    what is matched on either side doesn't depend on the other.
    """
    space = words.SPACE[data]
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    at = np.flatnonzero(opens)
    wide = at[(at > 0) & (data[at - 1] >= 0x80)]
    wide = wide[wide >= 3]
    two = data[wide - 2].astype(np.int64) << 8 | data[wide - 1]
    opens[wide[np.isin(two, _WHITE) | np.isin(two | data[wide - 3].astype(np.int64) << 16, _WHITE)]] = False
    opens[:3] = False
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(opens)


class Tokens:
    """The byte strings of a vocabulary, by rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        n = max(self.rank.values()) + 1
        if len(set(self.rank.values())) != len(self.rank) or n > 1 << 20 or any(bytes([i]) not in self.rank for i in range(256)):
            raise ValueError(f"{path}: ranks must be distinct, below 2 ** 20, and there for every byte")
        self.bytes: list[bytes | None] = [None] * n
        for token, r in self.rank.items():
            self.bytes[r] = token
        self.longest = max(map(len, self.rank))
        self.size = np.array([len(b or b"") for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(b or b"" for b in self.bytes), np.uint8)
        self.at = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of lists of ids one after the other, and where each list's begin, with the end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        source = np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[source], np.r_[0, ends][offsets]

    def spell(self, last: list[int]) -> list[int]:
        """The ids of the piece that a table is of."""
        ids, at = [], len(last)
        while at:
            token = last[at - 1]
            ids.append(token)
            at -= len(self.bytes[token])
        return ids[::-1]



class Ranks(Tokens):
    """A vocabulary with what encoding needs. Every token must be made by merges of lower ranks (else ValueError)."""

    def __init__(self, path: str):
        super().__init__(path)
        rank, n = self.rank, len(self.bytes)
        half: list[tuple[int, int] | None] = [None] * n
        joins: dict[int, int] = {}
        for token, r in sorted(rank.items(), key=lambda x: x[1]):
            if len(token) > 1:
                half[r] = self._halves(token, r, path)
            for k in range(1, len(token)):
                a, b = rank.get(token[:k]), rank.get(token[k:])
                if a is not None and b is not None:
                    joins[a << 20 | b] = r
        self.keys = np.array(sorted(joins), np.uint64)
        self.joined = np.array([joins[int(k)] for k in self.keys], np.int64)
        self.left_flank, self.right_flank = (_flank(np.array([h[side] if h else -1 for h in half], np.int64)) for side in (0, 1))
        self._automaton()
        self.pair_seen, self.pair_good = np.full(PAIRS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PAIRS, bool)
        self.pairs: dict[int, bool] = {}
        self.pieces, self.segments, self.held = {}, {}, [0, 0]

    def _halves(self, token: bytes, top: int, path: str) -> tuple[int, int]:
        """The two tokens that a token's last merge joins."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, top) for a, b in zip(parts, parts[1:], strict=False)]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] >= top:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) != 2 or max(self.rank[p] for p in parts) >= top:
            raise ValueError(f"{path}: no merges of lower ranks make token {top}")
        return self.rank[parts[0]], self.rank[parts[1]]

    def _automaton(self) -> None:
        """States are beginnings of tokens: where a byte leads, and the longest token that ends there; and of each token the longest that ends it."""
        state = {b"": 0}
        for token in self.rank:
            for k in range(1, len(token) + 1):
                state.setdefault(token[:k], len(state))
        levels: list[list[bytes]] = [[] for _ in range(self.longest + 1)]
        for begin in state:
            levels[len(begin)].append(begin)
        inner = np.zeros(len(state), bool)
        inner[[state[x[:-1]] for x in state if x]] = True
        # Only a state that goes on to longer ones has a row of its own; others go where the state that they fall back to goes.
        self.row = np.where(inner, np.cumsum(inner) - 1, 0).astype(np.int32)
        self.goes, self.ends = np.zeros((int(inner.sum()), 256), np.int32), np.full(len(state), -1, np.int32)
        back = np.zeros(len(state), np.int64)
        self.goes[0] = [state[bytes([k])] for k in range(256)]
        for level in levels[1:]:
            here = np.array([state[x] for x in level])
            above, byte = np.array([state[x[:-1]] for x in level]), np.array([x[-1] for x in level])
            # A state's own longest end that begins a token is where the one above falls back to, gone on by its last byte.
            back[here] = np.where(above > 0, self.goes[self.row[back[above]], byte], 0)
            self.goes[self.row[above], byte] = here
            own = here[inner[here]]
            self.goes[self.row[own]] = self.goes[self.row[back[own]]]
            rest = here[~inner[here]]
            self.row[rest] = self.row[back[rest]]
            whole = np.array([self.rank.get(x, -1) for x in level])
            self.ends[here] = np.where(whole >= 0, whole, self.ends[back[here]])
        self.shorter = np.full(len(self.bytes), -1, np.int64)
        tokens = np.array(sorted(self.rank.values()))
        self.shorter[tokens] = self.ends[back[[state[self.bytes[t]] for t in tokens]]]

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of each a and b, merged by rank, end as just these two tokens."""
        pair = a.astype(np.uint64) << _BITS | b.astype(np.uint64)
        slot = (pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - PAIRS.bit_length())).astype(np.int64)
        seen = self.pair_seen[slot] == pair
        good = self.pair_good[slot]
        if not seen.all():
            new, at, which = np.unique(pair[~seen], return_index=True, return_inverse=True)
            told = self._apart((new >> _BITS).astype(np.int64), (new & np.uint64((1 << 20) - 1)).astype(np.int64))
            good[~seen] = told[which]
            # Several pairs of one slot: the last one stays, in both arrays.
            slots, last = np.unique(slot[~seen][at][::-1], return_index=True)
            last = len(new) - 1 - last
            self.pair_seen[slots], self.pair_good[slots] = new[last], told[last]
        return good

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # x stands at the border until it is merged into the part before it on its flank, and y likewise; of merges of one
        # rank the left one comes first.
        apart = np.ones(len(a), bool)
        flank_a, flank_b = self.right_flank[a], self.left_flank[b]
        for i in range(flank_a.shape[1]):
            for j in range(flank_b.shape[1]):
                there = np.flatnonzero(apart & (flank_a[:, i] >= 0) & (flank_b[:, j] >= 0))
                if not len(there):
                    break
                x, y = flank_a[there, i], flank_b[there, j]
                key = x.astype(np.uint64) << _BITS | y.astype(np.uint64)
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[k] == key
                there, time = there[hit], np.maximum(self.joined[k[hit]], np.maximum(x[hit], y[hit]))
                if i:
                    on = time < flank_a[there, i - 1]
                    there, time = there[on], time[on]
                if j:
                    there = there[time <= flank_b[there, j - 1]]
                apart[there] = False
        return apart

    def follows(self, a: int, b: int) -> bool:
        """The same of one pair."""
        pair = a << 20 | b
        good = self.pairs.get(pair)
        if good is None:
            if len(self.pairs) >= PAIRS >> 4:
                self.pairs.clear()
            good = self.pairs[pair] = bool(self._apart(np.array([a]), np.array([b]))[0])
        return good

    def table(self, piece: bytes, kept=(), tail=()) -> tuple[list[int], int]:
        """The last token of each prefix of a piece, and how many of them were worked out.

        ``kept`` is the table of its first bytes, if that is known. ``tail`` is what the table held for its last bytes
        before an edit in front of them: once the new entries agree with it for as long as a token can be, the rest is the same.
        """
        find, longest, last = self.rank.get, self.longest, list(kept)
        agreed, old = 0, len(piece) - len(tail)
        for end in range(len(last) + 1, len(piece) + 1):
            start = end
            while True:
                start -= 1
                token = find(piece[start:end])
                if token is not None and (not start or self.follows(last[start - 1], token)):
                    break
            last.append(token)
            if tail:
                agreed = agreed + 1 if end > old and tail[end - old - 1] == token else 0
                if agreed >= longest:
                    last.extend(tail[end - old :])
                    return last, end - len(kept)
        return last, len(piece) - len(kept)

    def tables(self, pieces: list[bytes]) -> np.ndarray:
        """Tables of pieces of at most WIDE bytes, in ascending order, as the rows of a matrix; -1 beyond a piece's end.

        Prefixes that a piece shares with the one before it are not worked on again. What may end a prefix is tried from the longest
        token on, of all pieces at once.
        """
        n = len(pieces)
        if not n:
            return np.zeros((0, 0), np.int64)
        size = np.array([len(p) for p in pieces], np.int64)
        width = int(size.max())
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        differs = np.zeros((n, width), bool)
        differs[1:] = data[1:] != data[:-1]
        shared = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        shared = np.minimum(shared, np.minimum(size, np.r_[0, size[:-1]]))
        shared[:1] = 0
        last, state = np.full((n, width), -1, np.int64), np.zeros(n, np.int32)
        for depth in range(1, width + 1):
            here = np.flatnonzero(size >= depth)
            own = here[shared[here] < depth]
            state[own] = self.goes[self.row[state[own]], data[own, depth - 1]]
            token, row = self.ends[state[own]].astype(np.int64), own
            while len(row):
                start = depth - self.size[token]
                good = start == 0
                rest = np.flatnonzero(~good)
                good[rest] = self.may_follow(last[row[rest], start[rest] - 1], token[rest])
                last[row[good], depth - 1] = token[good]
                row, token = row[~good], self.shorter[token[~good]]
            # A row that shares this prefix takes it from the last row above that has worked it out.
            source = np.zeros(n, np.int64)
            source[own] = own
            source = np.maximum.accumulate(source)[here]
            last[here, depth - 1], state[here] = last[source, depth - 1], state[source]
        return last

    def _learn_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        known = self.pieces
        new = [p for p in pieces if p not in known]
        more = sum(map(len, new))
        if self.held[0] + more > REMEMBERED:
            self.pieces = known = {p: known[p] for p in pieces if p in known}
            self.held[0] = sum(map(len, known))
        self.held[0] += more
        side = []
        for p in new:
            raw = p.encode()
            whole = self.rank.get(raw)
            if whole is not None:
                known[p] = struct.pack("<I", whole)
            elif len(raw) > WIDE:
                ids = self.spell(self.table(raw)[0])
                known[p] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                side.append((raw, p))
        if side:
            side.sort()
            last = self.tables([raw for raw, _ in side])
            at = np.array([len(raw) for raw, _ in side])
            row, rows, ids = np.arange(len(side)), [], []
            while len(row):
                token = last[row, at - 1]
                rows.append(row)
                ids.append(token)
                at = at - self.size[token]
                row, at = row[at > 0], at[at > 0]
            rows, ids = np.concatenate(rows)[::-1], np.concatenate(ids)[::-1]
            order = np.argsort(rows, kind="stable")
            raw = ids[order].astype("<u4").tobytes()
            ends = (4 * np.searchsorted(rows[order], np.arange(len(side) + 1))).tolist()
            known.update((p, raw[a:b]) for (_, p), a, b in zip(side, ends, ends[1:], strict=False))
        return known

    def learn(self, segments: list[bytes], split) -> dict[bytes, bytes]:
        """The ids of at least these segments, as little-endian unsigned 32-bit numbers. Bytes that are no UTF-8 are replaced."""
        known = self.segments
        new = [s for s in segments if s not in known]
        if new:
            more = sum(map(len, new))
            if self.held[1] + more > REMEMBERED:
                self.segments = known = {s: known[s] for s in segments if s in known}
                self.held[1] = sum(map(len, known))
            self.held[1] += more
            pieces = [split(s.decode("utf-8", "replace")) for s in new]
            of = self._learn_pieces(set().union(*pieces)).__getitem__
            known.update((s, b"".join(map(of, some))) for s, some in zip(new, pieces, strict=True))
        return known


def _flank(half: np.ndarray) -> np.ndarray:
    """Each token, its half, that one's half and so on down to a byte; -1 beyond."""
    rows = [np.arange(len(half))]
    while (rows[-1] >= 0).any():
        rows.append(np.where(rows[-1] >= 0, half[rows[-1]], -1))
    return np.stack(rows[:-1], axis=1)


_vocabularies: dict = {}


def _loaded(kind, path: str):
    return _vocabularies.get((kind, path)) or _vocabularies.setdefault((kind, path), kind(path))


def _encoded(ranks: Ranks, split, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts one after the other, and how many each has. Equal segments are looked up once."""
    data, offsets = words.buffers(column)
    begins = _segments(data, offsets)
    ends = np.r_[begins[1:], len(data)]
    text = np.searchsorted(offsets, begins, "right") - 1
    whole, out, counts = memoryview(np.ascontiguousarray(data)), [np.zeros(0, np.uint32)], np.zeros(len(offsets) - 1, np.int64)
    for first in range(0, len(begins), MANY):
        a, b = begins[first : first + MANY], ends[first : first + MANY]
        _, one, which = np.unique(words.span_hashes(data, a, b), return_index=True, return_inverse=True)
        if not words.same_spans(data, a, b, one[which]):  # hashes of different segments met: each by itself
            one = which = np.arange(len(a))
        keys = [bytes(whole[x:y]) for x, y in zip(a[one].tolist(), b[one].tolist(), strict=True)]
        known = ranks.learn(list(dict.fromkeys(keys)), split)
        raws = list(map(known.__getitem__, keys))
        many = np.fromiter(map(len, raws), np.int64, len(raws)) >> 2
        begin, size = (np.cumsum(many) - many)[which], many[which]
        flat, upto = np.frombuffer(b"".join(raws), "<u4"), np.cumsum(size)
        out.append(flat[np.repeat(begin - (upto - size), size) + np.arange(upto[-1])])
        counts += np.bincount(text[first : first + MANY], size, len(counts)).astype(np.int64)
    return np.concatenate(out), counts


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids. Each match of ``pattern`` in a text is encoded by itself, without special tokens.

    Nothing is shuffled. A task holds a chunk of texts, or one text if that is longer, and remembers a bounded number of pieces; a piece is looked up
    by all of its characters. ``path`` is the rank file, which is where it is on every executor.

    Null and empty texts have no ids. What a pattern leaves out has no ids either. Bytes that are no UTF-8 count as U+FFFD. Very long
    texts, and pieces without end, are worked through in parts. Rows without an id and repeated rows are encoded like others;
    an empty table gives an empty result; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, split = _loaded(Ranks, path), regex.compile(pattern).findall
        for batch in batches:
            for part in words.chunks(batch, "text", CHUNK_BYTES):
                ids, counts = _encoded(ranks, split, part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def _decoded(batch: pa.RecordBatch, tokens: Tokens) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch of ids, each with the bytes that they spell; null where an id is null or none of the vocabulary's."""
    lengths = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy().astype(np.int64)
    for part in words.slices(batch, lengths, CHUNK_BYTES):
        lists = part.column("ids")
        offsets = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64))]
        ids = pc.fill_null(lists.flatten(), -1).to_numpy().astype(np.int64)
        bad = (ids < 0) | (ids >= len(tokens.size))
        bad |= tokens.size[np.where(bad, 0, ids)] == 0
        data, ends = tokens.decode(np.where(bad, 0, ids), offsets)
        odd = np.r_[0, np.cumsum(bad)][offsets]
        raw = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        yield part, pc.if_else(pa.array(odd[1:] == odd[:-1]), raw, pa.scalar(None, pa.large_binary()))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The encoded rows (doc_id, ids) with ``decoded``, the bytes that their ids spell.

    Null lists spell nothing; a list with a null, or with an id that the vocabulary lacks, has null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _loaded(Tokens, path)
        for batch in batches:
            for part, data in _decoded(batch, tokens):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), data.cast(pa.binary())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit numbers), decoded_sha256 (of what ``decode`` gives).

    Null ids count as 0 in their digest; what can't be decoded has a null one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _loaded(Tokens, path)
        for batch in batches:
            for part, data in _decoded(batch, tokens):
                lists = part.column("ids")
                flat = pc.fill_null(lists.flatten(), 0).to_numpy().astype("<u4")
                many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
                offsets = np.r_[0, np.cumsum(many)]
                sums = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                texts = [None if not x.is_valid else hashlib.sha256(x.as_buffer()).hexdigest() for x in data]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(many), pa.array(sums, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


TABLES = "text string, last_tokens array<int>"


def _table_of(ranks: Ranks, split, text: str) -> list[int]:
    """The last token of each prefix of each piece of a text: an entry for each byte."""
    pieces = [p.encode() for p in split(text)]
    known = {p: ranks.table(p)[0] for p in pieces if len(p) > WIDE}
    some = sorted({p for p in pieces if len(p) <= WIDE})
    known.update((p, row[: len(p)].tolist()) for p, row in zip(some, ranks.tables(some), strict=True))
    return [token for p in pieces for token in known[p]]


def prefix_tables(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text, last_tokens, the table from which ``table_ids`` reads ids and ``edit_tables`` goes on.

    The pattern must match every character. Nulls, empty, odd and very long texts as in ``encode``; null text becomes empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, split = _loaded(Ranks, path), regex.compile(pattern).findall
        for batch in batches:
            for part in words.chunks(batch, "text", CHUNK_BYTES):
                texts = [(b or b"").decode("utf-8", "replace") for b in part.column("text").cast(pa.binary()).to_pylist()]
                tables = [_table_of(ranks, split, t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(tables, pa.list_(pa.int32()))], ["doc_id", "text", "last_tokens"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, {TABLES}")


def _edited(ranks: Ranks, split, text: str, last: list[int], start: int, stop: int, new: str) -> tuple[str, list[int], int]:
    """Text and table after text[start:stop] became ``new``, and how many entries were worked out anew."""
    start = min(max(start, 0), len(text))
    stop = min(max(stop, start), len(text))
    old, i = text.encode(), len(text[:start].encode())
    j, text = i + len(text[start:stop].encode()), text[:start] + new + text[stop:]
    data = text.encode()
    shift = len(data) - len(old)
    cuts = _segments(np.frombuffer(old, np.uint8), np.array([0, len(old)]))
    # Segments that the edit doesn't touch, nor the characters beside their ends, keep their pieces.
    a, b = int(cuts[cuts < i].max(initial=0)), int(cuts[cuts > j].min(initial=len(old)))
    ends, at = {}, a
    for piece in split(old[a:b].decode()):
        ends[at] = at = at + len(piece.encode())
    begins = {e: s for s, e in ends.items()}
    tables, at, fresh = [], a, 0
    for piece in split(data[a : b + shift].decode()):
        raw = piece.encode()
        end = at + len(raw)
        kept = last[at : min(end, i, ends[at])] if at in ends else []
        tail = last[max(begins[end - shift], j) : end - shift] if end - shift in begins else []
        tail = tail[max(len(tail) + len(kept) - len(raw), 0) :]
        found, worked = ranks.table(raw, kept, tail)
        tables += found
        fresh += worked
        at = end
    return text, last[:a] + tables + last[b:], fresh


def edit_tables(tables: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per edit: doc_id, text, last_tokens, fresh, from tables (doc_id, text, last_tokens) and edits (doc_id, start, stop, new).

    An edit puts ``new`` in the place of the code points from ``start`` up to ``stop``; an append has both at the end or beyond. Only pieces
    beside the edit are split off again, of these only what lies behind it is worked out anew, and only until the table
    agrees with the old one for as long as a token can be: ``fresh`` counts these entries. Nulls in ``new`` are empty, in ``start`` 0, in ``stop`` the end; an
    edit of a document that isn't there has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, split = _loaded(Ranks, path), regex.compile(pattern).findall
        for batch in batches:
            for part in words.chunks(batch, "text", CHUNK_BYTES):
                rows = part.select(["text", "last_tokens", "start", "stop", "new"]).to_pylist()
                done = [_edited(ranks, split, r["text"], r["last_tokens"], r["start"] or 0, len(r["text"]) if r["stop"] is None else r["stop"], r["new"] or "") for r in rows]
                columns = [pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.list_(pa.int32()), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "text", "last_tokens", "fresh"])

    kind = tables.schema["doc_id"].dataType.simpleString()
    rows = tables.join(edits.select("doc_id", "start", "stop", "new"), "doc_id").select("doc_id", "text", "last_tokens", "start", "stop", "new")
    return rows.mapInArrow(run, f"doc_id {kind}, {TABLES}, fresh long")


def table_ids(tables: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of tables (doc_id, last_tokens): from the end on, the last token of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _loaded(Tokens, path)
        for batch in batches:
            ids = pa.array([ranks.spell(x or []) for x in batch.column("last_tokens").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    kind = tables.schema["doc_id"].dataType.simpleString()
    return tables.select("doc_id", "last_tokens").mapInArrow(run, f"doc_id {kind}, ids array<int>")
