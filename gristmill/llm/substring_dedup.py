"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

The documents, in the order of their ids, are cut into blocks. Each block is indexed by its seeds, the
hashes of its windows of consecutive words. The indexes of all blocks are exchanged by seed, so that
every block learns, for each of its seeds, the earliest block that holds it. A document is then parsed
greedily into factors against the documents before it: a factor is a run of words whose seeds all occur
in one reference block, and where a factor ends, the seeds that straddle the boundary are looked up
as well. The factors are at least a window long; their words are the duplicate spans.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from gristmill.llm import words

WINDOW = 13
#: Stands for a missing id: before all others.
NO_ID = -(1 << 63)


def _pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, one plane of bytes after the other: high planes are mostly zero and shrink in the shuffle."""
    steps = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel())


def _seeds(table: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of all texts of a table, and how many each text has."""
    found, per = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for batch in table.to_batches():
        for part in words.chunks(batch, "text"):
            h, n = words.shingles(*words.word_hashes(part.column("text")), window)
            found.append(h)
            per.append(n)
    return np.concatenate(found), np.concatenate(per)


def _bucket(seeds: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending seeds to ascending buckets of equal ranges."""
    return ((seeds >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _index(window: int, buckets: int):
    def index(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        seeds = np.unique(_seeds(table, window)[0])
        at = np.searchsorted(_bucket(seeds, buckets), np.arange(buckets + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(at))
        packed = [_pack(seeds[at[b] : at[b + 1]]) for b in full]
        return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int32()), "seeds": pa.array(packed, pa.binary())})

    return index


def _answer(table: pa.Table) -> pa.Table:
    """For each block's seeds of one bucket: which occur in an earlier block, and the earliest of those."""
    table = table.sort_by("block")
    blocks = table.column("block").to_numpy()
    lists = [_unpack(x.as_buffer()) for x in itertools.chain.from_iterable(c for c in table.column("seeds").chunks)]
    sizes = np.array([len(x) for x in lists], np.int64)
    seeds = np.concatenate(lists)
    del lists
    order = np.argsort(seeds, kind="stable")
    ranked = seeds[order]
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    owner = np.repeat(np.arange(len(blocks)), sizes)
    earliest = np.empty(len(seeds), np.int64)
    earliest[order] = owner[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    known = earliest != owner
    ends = np.cumsum(sizes)
    bits, refs = [], []
    for first, last in zip(ends - sizes, ends, strict=True):
        bits.append(np.packbits(known[first:last]).tobytes())
        refs.append(blocks[earliest[first:last][known[first:last]]].astype("<i4").tobytes())
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary()), "refs": pa.array(refs, pa.binary())})


def _factors(source: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Greedy factors (first word, words, source) of one document; source: of each seed, below 0 for none.

    A factor takes words as long as the seeds stay in one source. At its end the seeds that straddle the
    boundary have another source or none; those that have one open the next factor there.
    """
    found = np.flatnonzero(source >= 0)
    if not len(found):
        return []
    cut = np.flatnonzero((np.diff(found) != 1) | (np.diff(source[found]) != 0)) + 1
    first, last = found[np.r_[0, cut]], found[np.r_[cut - 1, len(found) - 1]]
    return list(zip(first.tolist(), (last - first + window).tolist(), source[first].tolist(), strict=True))


def _parse(window: int, buckets: int):
    def parse(answers: pa.Table, table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in OUT})
        block = table.column("block")[0].as_py()
        ids = pc.fill_null(table.column("doc_id"), NO_ID).to_numpy()
        seeds, per = _seeds(table, window)
        # Rank of each document's id among the block's: rows of one id are one document.
        rank = np.repeat(np.unique(ids, return_inverse=True)[1], per)
        known, place = np.unique(seeds, return_inverse=True)
        source = np.full(len(known), -1, np.int64)
        at = np.searchsorted(_bucket(known, buckets), np.arange(buckets + 1, dtype=np.uint64))
        for bucket, bits, refs in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), answers.column("refs").to_pylist(), strict=True):
            part = source[at[bucket] : at[bucket + 1]]
            part[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(part)).astype(bool)] = np.frombuffer(refs, "<i4")
        lowest = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(lowest, place, rank)
        of = source[place]
        of[(of < 0) & (lowest[place] < rank)] = block
        firsts = np.cumsum(per) - per
        out = {k: [] for k, _ in OUT}
        texts = itertools.chain.from_iterable(c for c in table.column("text").chunks)
        for doc, text, first, n in zip(table.column("doc_id").to_pylist(), texts, firsts.tolist(), per.tolist(), strict=True):
            parts = text.as_buffer().to_pybytes().split() if text.is_valid else []
            factors = _factors(of[first : first + n], window)
            keep = np.ones(len(parts), bool)
            for start, length, _ in factors:
                keep[start : start + length] = False
            out["doc_id"].append(doc)
            out["n_words"].append(len(parts))
            out["n_removed"].append(len(parts) - int(keep.sum()))
            out["kept"].append(b" ".join(itertools.compress(parts, keep.tolist()) if factors else parts).decode())
            out["spans"].append([dict(zip(("first", "words", "ref_block"), x, strict=True)) for x in factors])
        return pa.table({k: pa.array(out[k], t) for k, t in OUT})

    return parse


OUT = (
    ("doc_id", pa.int64()),
    ("n_words", pa.int64()),
    ("n_removed", pa.int64()),
    ("kept", pa.string()),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("ref_block", pa.int64())]))),
)


def _digesting(parse):
    """The parse with the digest of the kept words in their place: texts need not leave the task."""

    def digest(answers: pa.Table, table: pa.Table) -> pa.Table:
        out = parse(answers, table)
        digests = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in out.column("kept").to_pylist()], pa.string())
        return pa.table({"doc_id": out.column("doc_id"), "n_words": out.column("n_words"), "n_removed": out.column("n_removed"), "kept_sha256": digests, "spans": out.column("spans")})

    return digest


def _range_of(bounds: np.ndarray):
    """The number of the range of ids, given by their last ones, that an id falls into; missing ids come first."""

    @pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.fillna(NO_ID).to_numpy(np.int64), "left").astype(np.int32))

    return number


def block_bounds(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, fine: int = 8) -> np.ndarray:
    """Ids at which blocks of about ``block_bytes`` of text end.

    Quantiles of the ids make ``fine`` ranges for each block, whose bytes are summed; consecutive ranges are a block as long as they
    fit. So long texts make blocks of fewer documents, and the driver has ``fine`` numbers for each block.
    """
    size = F.octet_length(docs[text_col].cast("string"))
    found = docs.agg(F.sum(size).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    blocks = min(int((found.n or 0) // block_bytes) + 1, max(found.rows, 1))
    if blocks == 1:
        return np.zeros(0, np.int64)
    n = fine * blocks
    ends = np.array(sorted(set(docs.agg(F.percentile_approx(docs[id_col], [i / n for i in range(1, n)], 100 * n).alias("q")).first().q or [])), np.int64)
    per = docs.select(_range_of(ends)(docs[id_col].cast("long")).alias("r"), size.alias("n")).groupBy("r").agg(F.sum("n").alias("n")).collect()
    sizes = np.zeros(len(ends) + 1, np.int64)
    for row in per:
        sizes[row.r] = row.n or 0
    bounds, held = [], 0
    for end, own, following in zip(ends.tolist(), sizes.tolist(), sizes[1:].tolist(), strict=False):
        held += own
        if held + following > block_bytes:
            bounds.append(end)
            held = 0
    return np.array(bounds, np.int64)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = 12 << 20, digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (its kept words joined by spaces; with
    ``digests`` kept_sha256 instead), spans (the factors: first word, words, reference block).

    A word goes if a window of ``window`` words that covers it also occurs in a document with a smaller
    id. All windows of all documents are looked up; what is removed does not change what is looked up.

    Texts are shuffled once, by block. A block's index sends each distinct seed once, so a passage that
    a third of all documents share costs one entry a block, and blocks and ranges of seeds are both of
    bounded size. Two different windows with one 64-bit hash would count as equal.

    Null and empty texts have no words. Rows that share an id are one document and do not remove each
    other's words. Rows without an id come before all others. A text shorter than a window stays
    whole. An empty table gives an empty result; other columns are ignored.
    """
    bounds = block_bounds(docs, id_col, text_col, block_bytes)
    block = _range_of(bounds)
    buckets = len(bounds) + 1
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.select(block("doc_id").alias("block"), "doc_id", "text")
    index = rows.groupBy("block").applyInArrow(_index(window, buckets), "bucket int, block int, seeds binary")
    answers = index.groupBy("bucket").applyInArrow(_answer, "block int, bucket int, bits binary, refs binary")
    parse = _parse(window, buckets)
    kept, schema = (_digesting(parse), "kept_sha256 string") if digests else (parse, "kept string")
    return answers.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(kept, f"doc_id long, n_words long, n_removed long, {schema}, spans array<struct<first: long, words: long, ref_block: long>>")
