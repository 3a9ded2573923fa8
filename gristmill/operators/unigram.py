"""Unigram tokenizing: the segmentation of each word of largest score, by a dynamic programme over a vocabulary's pieces.

Texts are normalised (NFKC, tabs and line ends as spaces, other control characters dropped, runs of spaces as one), begin with a mark of
a space, and are cut before each such mark; equal words are segmented once a task and remembered.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: By how much a character that no piece covers scores below the least piece.
PENALTY = 10.0
#: Words whose segmentation a worker remembers (some 220 bytes each), and characters of the longest one that it does.
REMEMBERED, LONGEST = 1 << 19, 64
#: Bytes of an id.
WIDTH = array("i").itemsize
_LINES, _CONTROL, _SPACES = re.compile(r"[\t\n\r]"), re.compile(r"[\x00-\x1f\x7f]"), re.compile(r" {2,}")
_WORD = re.compile(f"{MARK}?[^{MARK}]+|{MARK}")


def normalise(text: str | None) -> str:
    text = text or ""
    return _SPACES.sub(" ", _CONTROL.sub("", _LINES.sub(" ", text if text.isascii() else unicodedata.normalize("NFKC", text))))


class Unigram:
    """Pieces with scores by id; ``unknown`` is the id of what no piece covers."""

    def __init__(self, pieces: dict[str, tuple[int, float]], unknown: int):
        self.pieces, self.unknown = pieces, unknown
        # Every beginning of a piece, with the piece if it is one: what isn't here begins none.
        self.begins: dict[str, tuple[int, float] | None] = {p[:n]: None for p in pieces for n in range(1, len(p))}
        self.begins |= pieces
        self.miss = min((score for _, score in pieces.values()), default=0.0) - PENALTY
        self.memory: dict[str, bytes] = {}

    def word(self, word: str) -> list[int]:
        """Ids of the best segmentation: of equal scores the one whose last piece begins first. Unknown characters side by side are one."""
        # For every end the score so far, where its last piece begins and that piece; beginnings ascend, so of equal scores the first one stays.
        n, piece_of, unknown, miss = len(word), self.begins.get, self.unknown, self.miss
        score, back, last = [-math.inf] * (n + 1), [-1] * (n + 1), [unknown] * (n + 1)
        score[0] = 0.0
        for start in range(n):
            before, end = score[start], start + 1
            piece = piece_of(word[start:end], False)
            total = before + (piece[1] if piece else miss)
            if total > score[end] or back[end] < 0:
                score[end], back[end], last[end] = total, start, piece[0] if piece else unknown
            while piece is not False and end < n:
                end += 1
                piece = piece_of(word[start:end], False)
                if piece:
                    total = before + piece[1]
                    if total > score[end] or back[end] < 0:
                        score[end], back[end], last[end] = total, start, piece[0]
        ids, end = [], n
        while end:
            piece = last[end]
            if not (piece == self.unknown and ids and ids[-1] == piece):
                ids.append(piece)
            end = back[end]
        ids.reverse()
        return ids

    def _packed(self, word: str) -> bytes:
        """The ids of a word as 32-bit integers, remembered."""
        known = self.memory.get(word)
        if known is None:
            known = array("i", self.word(word)).tobytes()
            if len(word) <= LONGEST:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[word] = known
        return known

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as 32-bit integers."""
        spaced = normalise(text).replace(" ", MARK)
        words = _WORD.findall(spaced if spaced.startswith(MARK) else MARK + spaced)
        found = list(map(self.memory.get, words))
        if None in found:
            found = [self._packed(word) if known is None else known for word, known in zip(words, found, strict=True)]
        return b"".join(found)

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()


#: The vocabulary that a worker has used last, with the words it remembers: the next task goes on with it.
_models: dict[str, Unigram] = {}


def tokenize(docs: DataFrame, vocabulary: DataFrame, unknown: int, begin: int | None = None, end: int | None = None, most: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of each text by a vocabulary (piece, id, score), between ``begin`` and ``end`` and no more than ``most`` with them.

    The vocabulary is some tens of thousands of rows and goes to every task. Null counts as empty; rows are neither shuffled nor gathered.
    """
    pieces = {r.piece: (r.id, float(r.score)) for r in vocabulary.select("piece", "id", "score").collect()}
    shared, name = docs.sparkSession.sparkContext.broadcast(pieces), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:
            _models.clear()
            _models[name] = Unigram(shared.value, unknown)
        model = _models[name]
        opens, closes = (b"" if i is None else array("i", [i]).tobytes() for i in (begin, end))
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, out = batch.slice(first, 256), []
                for text in part.column("text").to_pylist():
                    ids = opens + model.packed(text)
                    out.append((ids if most is None else ids[: WIDTH * (most - (end is not None))]) + closes)
                sizes = np.array([len(ids) for ids in out], np.int64) // WIDTH
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.frombuffer(b"".join(out), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def kept_ids(vocabulary: DataFrame, tokens: DataFrame, special: list[int], always: Column | None = None) -> DataFrame:
    """id: what a smaller vocabulary keeps: ids in the corpus's ``tokens`` (ids), ``special`` ones, and pieces for which ``always`` is true.

    By default these are pieces with a Hangul syllable, and pieces of ASCII of up to three characters besides marks.
    """
    bare = F.regexp_replace("piece", f"^{MARK}+", "")
    if always is None:
        always = F.col("piece").rlike("[가-힣]") | (F.col("piece").rlike(f"^[\\x00-\\x7f{MARK}]+$") & (F.length(bare) <= 3))
    used = tokens.select(F.explode("ids").alias("id")).distinct()
    rows = vocabulary.filter(always).select(F.col("id").cast("int").alias("id"))
    if special:
        rows = rows.union(vocabulary.sparkSession.createDataFrame([(i,) for i in special], "id int"))
    return used.union(rows).distinct()
