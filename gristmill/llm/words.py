"""Words, hashes and shingles of Arrow text columns, on whole byte buffers with numpy.

A word is a run of bytes other than ASCII white space (0x20 and 0x09 to 0x0D). Hashes are 64-bit and
depend on the bytes alone, so they agree between tasks, executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bits of the first 0 to 8 bytes of a block.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values: a fixed invertible mixing."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each text in them; null counts as empty."""
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose rows' sizes sum to at most so much, or one row."""
    ends = np.cumsum(sizes)
    first, n = 0, batch.num_rows
    while first < n:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    yield from slices(batch, lengths, most)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begins)
    at = np.searchsorted(starts, offsets)
    return starts, np.flatnonzero(ends) + 1, np.diff(at)


def _eights(data: np.ndarray):
    """A reader of eight bytes from any places on, of which only the first ``left`` count."""
    padded = np.zeros(len(data) // 8 * 8 + 24, np.uint8)
    padded[: len(data)] = data
    eights = padded.view("<u8")

    def load(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        whole, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return ((eights[whole] >> shift) | (eights[whole + 1] << np.uint64(1) << (np.uint64(63) - shift))) & _FIRST[np.minimum(left, 8)]

    return load


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (none is empty): blocks of eight bytes, each mixed with its place, summed and mixed."""
    load = _eights(data)

    def blocks(at: np.ndarray, left: np.ndarray, place) -> np.ndarray:
        return mix(mix(load(at, left)) + place * np.uint64(0x9E3779B97F4A7C15))

    size = ends - starts
    h = blocks(starts, size, np.uint64(1))
    if (long := np.flatnonzero(size > 8)).size:
        more = (size[long] - 1) >> 3
        firsts = np.cumsum(more) - more
        nth = np.arange(more.sum()) - np.repeat(firsts - 1, more)
        at = np.repeat(starts[long], more) + 8 * nth
        h[long] += np.add.reduceat(blocks(at, np.repeat(ends[long], more) - at, nth.astype(np.uint64) + np.uint64(1)), firsts)
    return mix(h ^ size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether each span has the bytes of the span whose number ``like`` gives."""
    if not np.array_equal(ends - starts, (ends - starts)[like]):
        return False
    load = _eights(data)
    own, other, left = starts, starts[like], ends - starts
    while len(own):
        if not np.array_equal(load(own, left), load(other, left)):
            return False
        on = left > 8
        own, other, left = own[on] + 8, other[on] + 8, left[on] - 8
    return True


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words of each text."""
    data, offsets = buffers(column)
    starts, ends, counts = spans(data, offsets)
    return span_hashes(data, starts, ends), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of one text, and how many each text has.

    With ``short``, a text of 1 to k - 1 words has one shingle, of all its words.
    """
    per = np.maximum(counts - k + 1, 0)
    firsts = np.cumsum(counts) - counts
    at = np.repeat(firsts - (np.cumsum(per) - per), per) + np.arange(per.sum())
    out = np.zeros(len(at), np.uint64)
    factors = [np.uint64(pow(0xA0761D6478BD642F, 2 * j + 1, 1 << 64)) for j in range(k)]
    for j, factor in enumerate(factors):
        out += hashes[at + j] * factor
    if short and (few := np.flatnonzero((counts > 0) & (counts < k))).size:
        tail = np.zeros(len(few), np.uint64)
        for j, factor in enumerate(factors[:-1]):
            there = counts[few] > j
            tail[there] += hashes[firsts[few][there] + j] * factor
        place = np.cumsum(per)[few]
        per = per.copy()
        per[few] = 1
        out = np.insert(out, place, tail)
    return mix(out), per
