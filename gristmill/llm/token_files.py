"""Token ids of documents in binary files of patched frame-of-reference blocks.

A file holds the documents of one range of ids, in ascending order, as one sequence of token ids cut into
blocks. A block stores its ids less its smallest one, packed at a width that a percentile of them
fits; the others are exceptions, kept in full with their places. The file ends with the index of
its documents and of its blocks' starts:

    magic (8)
    block, again and again: smallest u32, ids u32, exceptions u32, width u8, packed bits, places u16, values u32
    document index: ids i64 * documents, starts u64 * (documents + 1)
    block index: starts in the file u64 * (blocks + 1)
    documents u64, blocks u64, block size u64, start of the document index u64, magic (8)
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm import words
from gristmill.llm.shared import settle

MAGIC = b"GMPFOR01"
BLOCK = 4096
#: Size at which a file is closed; a file is read as one row, so it must stay below 2 GB.
FILE_BYTES = 256 << 20
#: Ids that a reader yields at once, or one document.
IDS_AT_ONCE = 1 << 20
PERCENTILE = 0.9
NO_ID = -(1 << 63)
_HEAD, _FOOT = struct.Struct("<IIIB"), struct.Struct("<QQQQ8s")


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """A block for each row of ids: at most 65536 ids below 2 ** 32."""
    n = ids.shape[1]
    low = ids.min(axis=1)
    rest = ids - low[:, None]
    at = min(n - 1, int(n * percentile))
    widths = np.array([int(x).bit_length() for x in np.partition(rest, at, axis=1)[:, at]])
    out: list[bytes] = [b""] * len(ids)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        inside = rest[rows]
        over = inside >> np.uint32(width) > 0 if width < 32 else np.zeros(inside.shape, bool)
        inside[over] = 0
        for row, packed, o in zip(rows.tolist(), _pack_bits(inside, width), over, strict=True):
            places = np.flatnonzero(o)
            out[row] = _HEAD.pack(low[row], n, len(places), width) + packed + places.astype("<u2").tobytes() + rest[row, places].astype("<u4").tobytes()
    return out


def _pack_bits(values: np.ndarray, width: int) -> list[bytes]:
    """Each row of values below 2 ** width, one after the other, lowest bits first: 64 of them make ``width`` 64-bit words."""
    m, n = values.shape
    rows = np.zeros((m, -(-n // 64) * 64), np.uint64)
    rows[:, :n] = values
    rows = np.ascontiguousarray(rows.reshape(-1, 64).T)
    packed = np.zeros((width, rows.shape[1]), np.uint64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        packed[word] |= rows[j] << np.uint64(shift)
        if shift + width > 64:
            packed[word + 1] |= rows[j] >> np.uint64(64 - shift)
    flat = np.ascontiguousarray(packed.T).astype("<u8").view(np.uint8).reshape(m, -1)[:, : -(-n * width // 8)]
    return [x.tobytes() for x in flat]


def unpack_blocks(data: bytes, starts: list[int]) -> list[np.ndarray]:
    """The ids of the blocks that start there; those of one size and width are unpacked together."""
    heads = [_HEAD.unpack_from(data, at) for at in starts]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(starts)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (_, n, _, width) in enumerate(heads):
        alike.setdefault((n, width), []).append(i)
    for (n, width), members in alike.items():
        size = -(-n * width // 8)
        rows = _unpack_bits(np.stack([np.frombuffer(data, np.uint8, size, starts[i] + _HEAD.size) for i in members]), n, width)
        for i, rest in zip(members, rows, strict=True):
            low, _, n_over, _ = heads[i]
            at = starts[i] + _HEAD.size + size
            rest[np.frombuffer(data, "<u2", n_over, at)] = np.frombuffer(data, "<u4", n_over, at + 2 * n_over)
            out[i] = rest + np.uint32(low)
    return out


def _unpack_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    m, size = data.shape
    packed = np.zeros((m, -(-n // 64) * width * 8), np.uint8)
    packed[:, :size] = data
    packed = np.ascontiguousarray(packed.view("<u8").reshape(-1, width).T) if width else np.zeros((0, m * -(-n // 64)), np.uint64)
    rows = np.zeros((64, m * -(-n // 64)), np.uint64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        rows[j] = packed[word] >> np.uint64(shift)
        if shift + width > 64:
            rows[j] |= packed[word + 1] << np.uint64(64 - shift)
    return (np.ascontiguousarray(rows.T).reshape(m, -1)[:, :n] & np.uint64((1 << width) - 1)).astype(np.uint32)


class FileWriter:
    """Writes one file, block by block; holds less than a block of ids and the index."""

    def __init__(self, out, block: int = BLOCK, percentile: float = PERCENTILE):
        self.out, self.block, self.percentile = out, block, percentile
        self.at, self.held, self.n_docs, self.n = len(MAGIC), np.zeros(0, np.uint32), 0, 0
        self.ids, self.starts, self.blocks = [], [np.zeros(1, np.int64)], []
        out.write(MAGIC)

    def _put(self, ids: np.ndarray) -> None:
        for packed in pack_blocks(ids, self.percentile):
            self.blocks.append(self.at)
            self.at += len(packed)
            self.out.write(packed)

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents, all their ids in one array, and how many each has."""
        self.ids.append(doc_ids)
        self.starts.append(self.n + np.cumsum(sizes))
        self.n_docs, self.n = self.n_docs + len(doc_ids), self.n + len(ids)
        whole = np.concatenate([self.held, ids])
        full = len(whole) // self.block * self.block
        if full:
            self._put(whole[:full].reshape(-1, self.block))
        self.held = whole[full:]

    def close(self) -> None:
        if len(self.held):
            self._put(self.held[None, :])
        index = np.concatenate(self.ids).astype("<i8").tobytes() + np.concatenate(self.starts).astype("<u8").tobytes() + np.array([*self.blocks, self.at], "<u8").tobytes()
        self.out.write(index + _FOOT.pack(self.n_docs, len(self.blocks), self.block, self.at, MAGIC))


class FileReader:
    """Reads documents of one file's bytes; a document costs the blocks that hold it."""

    def __init__(self, data: bytes):
        docs, blocks, self.block, at, magic = _FOOT.unpack_from(data, len(data) - _FOOT.size)
        if magic != MAGIC or data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.data = data
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
        self.blocks = np.frombuffer(data, "<u8", blocks + 1, at + 8 * (2 * docs + 1)).astype(np.int64)

    def _range(self, first: int, last: int) -> np.ndarray:
        if last <= first:
            return np.zeros(0, np.uint32)
        k = first // self.block
        blocks = unpack_blocks(self.data, self.blocks[k : -(-last // self.block)].tolist())
        return np.concatenate(blocks)[first - k * self.block : last - k * self.block]

    def ids(self, n: int) -> np.ndarray:
        """Token ids of the n-th document of the file."""
        return self._range(int(self.starts[n]), int(self.starts[n + 1]))

    def slices(self, first: int, last: int) -> list[np.ndarray]:
        """Token ids of some consecutive documents of the file."""
        at = self.starts[first : last + 1]
        whole, bounds = self._range(int(at[0]), int(at[-1])), (at - at[0]).tolist()
        return [whole[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


class WordEncoder:
    """A tokenizer whose ids depend on each run of characters other than ASCII white space alone, with the ids of words kept.

    That holds for tokenizers that drop white space and split at it before any model sees the text. Texts are encoded many
    at once: each distinct word is looked up once, and the ids of all words are gathered. At most ``keep`` words
    are kept; then the table starts anew, so memory is bounded.
    """

    def __init__(self, path: str, keep: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        #: Which ids end a word, where the model marks them.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool) if suffix else None
        if suffix:
            self.last[[n for w, n in vocabulary.items() if w.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.upto = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _numbers(self, parts: list[bytes]) -> np.ndarray:
        """The places of words in the table; new ones are encoded."""
        found = list(map(self.number.get, parts))
        if None in found:
            if len(self.number) + found.count(None) > self.keep:
                self._forget()
                found = [None] * len(parts)
            new = list(dict.fromkeys(w for w, n in zip(parts, found, strict=True) if n is None))
            whole = [w for w in new if _LETTERS(w)] if self.last is not None else []
            letters = set(whole)
            for some, together in ((whole, True), ([w for w in new if w not in letters], False)):
                ids, sizes = self._encoded(some, together)
                self.number.update(zip(some, range(len(self.number), len(self.number) + len(some)), strict=True))
                self.upto = np.r_[self.upto, self.upto[-1] + np.cumsum(sizes, dtype=np.int64)]
                self.ids = np.r_[self.ids, ids]
            found = list(map(self.number.__getitem__, parts))
        return np.array(found, np.int64)

    def _encoded(self, some: list[bytes], together: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and how many each has. Words of letters alone are encoded many in one text: each ends with the only id of its that ends a word."""
        texts = [b" ".join(some[i : i + 256]) for i in range(0, len(some), 256)] if together else some
        found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32)
        if not together:
            return ids, np.array([len(x) for x in found], np.int64)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(some) or (len(ends) and ends[-1] != len(ids)):  # a tokenizer that cuts words of letters
            return self._encoded(some, False)
        return ids, np.diff(ends, prepend=0)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, and how many each text has."""
        data, offsets = words.buffers(column)
        starts, ends, per = words.spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), per
        data, starts, ends, first = _units(data, starts, ends)
        _, at, place = np.unique(words.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if not words.same_spans(data, starts, ends, at[place]):  # two of one hash: take each for itself
            at, place = np.arange(len(starts)), np.arange(len(starts))
        raw = data.tobytes()
        word = self._numbers([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])[place]
        size = np.diff(self.upto)[word]
        upto = np.cumsum(size)
        out = self.ids[np.repeat(self.upto[word] - (upto - size), size) + np.arange(upto[-1])]
        return out, np.diff(np.append(0, upto)[first[np.append(0, np.cumsum(per))]])


_MARK, _PLAIN, _ODD = (np.isin(np.arange(256), list(x)) for x in (b".,;:!?", bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)), b"<\xcc\xcd"))


def _units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Parts of words that are encoded apart: fewer different ones than words. With the place of each word's first part.

    Marks at the end of a word, after an ASCII letter or digit, are pieces of their own. The tokenizer lowers case itself; ASCII
    letters are lowered before, but for words that could hold special tokens or combining marks.
    """
    odd = np.unique(np.searchsorted(starts, np.flatnonzero(_ODD[data]), "right") - 1)
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] |= 32
    if len(odd):
        size = (ends - starts)[odd]
        own = np.repeat(starts[odd] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        lower[own] = data[own]
    core = ends.copy()
    on = np.flatnonzero(_MARK[data[core - 1]])
    while len(on):
        core[on] -= 1
        on = on[core[on] > starts[on]]
        on = on[_MARK[data[core[on] - 1]]]
    cut = (core < ends) & (core > starts) & _PLAIN[data[np.maximum(core - 1, 0)]]
    place = np.arange(len(starts)) + np.cumsum(cut) - cut
    begin, end = np.empty(len(starts) + cut.sum(), np.int64), np.empty(len(starts) + cut.sum(), np.int64)
    begin[place], end[place] = starts, np.where(cut, core, ends)
    begin[place[cut] + 1], end[place[cut] + 1] = core[cut], ends[cut]
    return lower, begin, end, np.append(place, len(begin))


#: Words of ASCII letters and those of Latin-1.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch

_encoders: dict[str, WordEncoder] = {}


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, percentile: float = PERCENTILE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the documents' ids below ``path`` (a URI that pyarrow.fs opens on every executor) in ascending id order.

    Returns one row per file, already written: file, n_docs, n_ids, first_id (place of its first id among
    all). Each part of the range partitioning writes a file and begins another after the document with which one passes
    ``file_bytes``; files in the order of their names hold ascending ranges of ids. ``tokenizer`` is the file of a tokenizer
    that drops white space. A task writes under a name of its own attempt and renames, so a repeated or lost task
    leaves the same files.

    Null and empty texts have the end id alone. Rows without an id come first, under the smallest 64-bit
    id. Rows of one id follow one another by text. A very long text is encoded alone, by one task, and stays in one file.
    An empty table gives no file. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, WordEncoder(tokenizer))
        context = TaskContext.get()
        system, folder = fs.FileSystem.from_uri(path)
        number, writer = 0, None

        def close() -> pa.RecordBatch:
            writer.close()
            writer.out.close()
            name = f"part-{context.partitionId():06d}-{number:06d}.pfor"
            system.move(draft, f"{folder}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [writer.n_docs], "n_ids": [writer.n]})

        for batch in batches:
            for part in words.chunks(batch, "text"):
                if writer is None:
                    draft = f"{folder}/.{context.partitionId()}.{context.taskAttemptId()}"
                    writer = FileWriter(system.open_output_stream(draft), block, percentile)
                ids, sizes = encoder.encode(part.column("text"))
                if end_id is not None:
                    ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                writer.add(pc.fill_null(part.column("doc_id"), NO_ID).to_numpy(), ids, sizes)
                if writer.at >= file_bytes:
                    yield close()
                    number, writer = number + 1, None
        if writer:
            yield close()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    ranged = rows.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    files = settle(ranged.mapInArrow(run, "file string, n_docs long, n_ids long"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, path: str, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``files`` is what the writer returned: one row for each file of ``FILE_BYTES``, so it is joined by broadcast. A file that does not begin and end with the
    mark of the format raises ValueError. A document whose ids were written in a very large file costs the blocks that hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                reader = FileReader(content.as_buffer())
                last = 0
                while last < len(reader.doc_ids):
                    first, last = last, max(last + 1, int(np.searchsorted(reader.starts, reader.starts[last] + IDS_AT_ONCE, "right")) - 1)
                    n = range(first, last)
                    ids = reader.slices(first, last)
                    own = reader.doc_ids[n.start : n.stop]
                    out = [
                        pa.array([name.rpartition("/")[2]] * len(n)),
                        pa.array(own, mask=own == NO_ID),
                        pa.array(reader.starts[n.start : n.stop]),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    ]
                    names = ["file", "doc_id", "_start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        out.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(out, names)

    ids = ["ids"] if with_ids else []
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(path).select("path", "content")
    found = content.mapInArrow(run, "file string, doc_id long, _start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return found.join(F.broadcast(files.select("file", "first_id")), "file").select("doc_id", (F.col("first_id") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32", *ids)
