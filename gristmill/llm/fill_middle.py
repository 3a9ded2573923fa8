"""Fill-in-middle: documents cut into prefix, middle and suffix at unit bounds, dealt in two orders, and put together again.

A unit is a word with the white space before it, or the white space that ends a text. Counting a chunk's units leaves a sparse
index: after every so many units, and where a document begins, the byte and the code point reached. A cut after
so many units is found by binary search in that index and a scan from the entry to the cut, at most one stride of units on;
so neither the number of units nor their places are kept, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm import words
from gristmill.llm.shared import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between two entries of the index.
STRIDE = 256
#: Bytes that are scanned at once.
SCAN = 1 << 19


def _unit_ends(data: np.ndarray, last: np.ndarray, first: int, end: int) -> np.ndarray:
    """Offsets at which units end, of those in data[first:end]; ``last`` marks the last byte of each text."""
    space = words.SPACE[data[first : end + 1]]
    here = space[: end - first]
    after = np.ones(end - first, bool)
    after[: len(space) - 1] = space[1:]
    return first + 1 + np.flatnonzero((~here & after) | last[first:end])


class UnitIndex:
    """Checkpoints over the texts of a chunk: units, bytes and code points before each, in ascending order.

    ``first_unit[d]`` and ``first_char[d]`` are the units and code points before text d, with the totals at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, stride: int = STRIDE, scan: int = SCAN):
        self.data, self.offsets, self.stride = data, offsets, stride
        self.last = np.zeros(len(data), bool)
        self.last[offsets[1:][np.diff(offsets) > 0] - 1] = True
        units = chars = 0
        every = [(np.zeros(0, np.int64),) * 3]
        at_unit, at_char = np.zeros(len(offsets), np.int64), np.zeros(len(offsets), np.int64)
        for first in range(0, len(data), scan):
            end = min(first + scan, len(data))
            ends = _unit_ends(data, self.last, first, end)
            opens = np.cumsum((data[first:end] & 0xC0) != 0x80)
            pick = np.arange((-units - 1) % stride, len(ends), stride)
            every.append((units + pick + 1, ends[pick], chars + opens[ends[pick] - first - 1]))
            a, b = np.searchsorted(offsets, (first + 1, end + 1))
            inside = offsets[a:b]
            at_unit[a:b] = units + np.searchsorted(ends, inside, "right")
            at_char[a:b] = chars + opens[inside - first - 1]
            units, chars = units + len(ends), chars + int(opens[-1])
        self.first_unit, self.first_char = at_unit, at_char
        marks = [np.concatenate(x) for x in zip(*every, (at_unit, offsets, at_char), strict=True)]
        order = np.argsort(marks[0], kind="stable")
        self.unit, self.byte, self.char = (m[order] for m in marks)

    def counts(self) -> np.ndarray:
        return np.diff(self.first_unit)

    def cut(self, text: int, units: int) -> tuple[int, int]:
        """The byte offset in the chunk, and the code points of the text before it, after so many units of a text."""
        if not units:
            return int(self.offsets[text]), 0
        goal = int(self.first_unit[text]) + units
        k = int(np.searchsorted(self.unit, goal, "right")) - 1
        byte, char, left = int(self.byte[k]), int(self.char[k]), goal - int(self.unit[k])
        while left:
            end = min(byte + 64 * left + 64, len(self.data))
            ends = _unit_ends(self.data, self.last, byte, end)
            to = int(ends[left - 1]) if len(ends) >= left else end
            left -= min(left, len(ends))
            char += int(np.count_nonzero((self.data[byte:to] & 0xC0) != 0x80))
            byte = to
        return byte, char - int(self.first_char[text])


def draws(id_col: Column, seed: int) -> Column:
    """Four whole numbers below 2 ** 32 from the digest of a seed and an id; a null id is drawn for as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``rate`` of a hundred documents are cut, ``spm_rate`` of a hundred of these put the suffix first (spm), the others the prefix
    (psm); the rest are plain: their output is the text and their lengths are null. Both cuts lie at unit bounds, drawn with
    the form from the digest of ``seed`` and the id, so reruns agree whatever the partitions. Nothing is shuffled. A task
    holds a chunk of texts, or one text if that is longer, and an index of one entry for each STRIDE units.

    Null text counts as empty; empty texts, and texts that hold one of the three marks, are plain. Rows without an id
    are drawn for alike; repeated rows give equal rows. An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                data, offsets = words.buffers(part.column("text"))
                index = UnitIndex(data, offsets)
                counts = index.counts()
                h = part.column("h").flatten().to_numpy().reshape(-1, 4)
                cuts = np.sort(h[:, :2] % (counts + 1)[:, None], axis=1)
                whole = memoryview(data)
                forms, prefixes, middles, outputs = [], [], [], []
                for d in range(len(counts)):
                    first, last = int(offsets[d]), int(offsets[d + 1])
                    text = bytes(whole[first:last])
                    if not text or h[d, 2] % 100 >= rate or any(x in text for x in marks):
                        forms.append("plain"), prefixes.append(None), middles.append(None), outputs.append(text)
                        continue
                    (a, a_chars), (b, b_chars) = (index.cut(d, int(u)) for u in cuts[d])
                    before, middle, after = text[: a - first], text[a - first : b - first], text[b - first :]
                    spm = h[d, 3] % 100 < spm_rate
                    forms.append("spm" if spm else "psm"), prefixes.append(a_chars), middles.append(b_chars - a_chars)
                    outputs.append(b"".join((s, after, p, before, m, middle) if spm else (p, before, s, after, m, middle)))
                columns = (part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), draws(docs[id_col], seed).alias("h"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form were made of. The marks occur in no cut text, so the output splits at them alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    # The pieces stand behind their marks, the first being what stands before any: nothing.
    two, three, four = (F.get(parts, i) for i in (1, 2, 3))
    return F.when(form == "spm", F.concat(three, four, two)).when(form == "psm", F.concat(two, four, three)).otherwise(output)
