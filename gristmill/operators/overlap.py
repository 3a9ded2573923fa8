"""Character grams that two tables of texts share: an index of one, with bounds, against every text of the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gram_codes(text: str | None, n: int) -> np.ndarray:
    """Distinct runs of n characters, up to three, as sorted numbers; none where the text is null or shorter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = max(len(points) - n + 1, 0)
    codes = np.zeros(size, np.uint64)
    for k in range(n):
        codes = (codes << np.uint64(21)) | points[k : k + size]
    return np.unique(codes)


def micros(common: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """common / whole in millionths, halves rounded up, on integers; 0 of nothing."""
    whole = np.maximum(whole, 1)
    return (2_000_000 * common + whole) // (2 * whole)


class GramIndex:
    """Items' grams, against which documents are counted one chunk after the other; with ``k``, the k most similar documents of each item so far.

    A document enters an item's list only if they have so many grams in common that it can't lack all of any choice of the others and one
    more. So of each item just that many grams are looked for, those that are rarest in what has been seen; a document that has one
    of them, and could be so similar by their number and its size, is compared in full. The bound rises with the list, or is the ``least`` similarity
    that is asked for (in millionths). Whatever is rare or frequent, the result is exact.
    """

    def __init__(self, ids: pa.Array, texts: list[str | None], n: int, k: int | None = None, least: int = 0):
        self.ids, self.n, self.k = ids, n, k
        grams = [gram_codes(t, n) for t in texts]
        self.sizes = np.array([len(g) for g in grams], np.int64)
        self.words, self.gram = np.unique(np.concatenate([*grams, np.zeros(0, np.uint64)]), return_inverse=True)
        self.item = np.repeat(np.arange(len(grams)), self.sizes)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.seen = np.zeros(len(self.words), np.int64)
        self.bound = np.full(len(grams), least, np.int64)
        self.found: list[np.ndarray] = [np.zeros((4, 0), np.int64)]  # item, common, document's grams, place in names
        self.names: list[pa.Array] = []
        self.candidates = 0

    def _postings(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of each gram, of the chosen entries, and where each gram's begin, with the end."""
        order = np.argsort(self.gram[some], kind="stable")
        return self.item[some][order], np.searchsorted(self.gram[some][order], np.arange(len(self.words) + 1))

    def _looked_for(self) -> np.ndarray:
        """Entries of the index: of each item the rarest grams, as many as a document must not lack all of."""
        least = np.ceil(np.maximum(self.bound - 0.5, 0) / 1e6 * self.sizes).astype(np.int64)
        # Some more than that tell more of the others apart by how many of them they have.
        self.many = np.where(self.sizes > 0, np.minimum(self.sizes - np.maximum(least, 1) + 1 + self.sizes // 8, self.sizes), 0)
        order = np.lexsort((self.seen[self.gram], self.item))
        nth = np.arange(len(order)) - self.starts[self.item[order]]
        return order[nth < self.many[self.item[order]]]

    def add(self, names: pa.Array, texts: list[str | None]) -> None:
        """Count a chunk of documents."""
        grams = [gram_codes(t, self.n) for t in texts]
        size = np.array([len(g) for g in grams], np.int64)
        code = np.concatenate([*grams, np.zeros(0, np.uint64)])
        doc = np.repeat(np.arange(len(grams)), size)
        at = np.minimum(np.searchsorted(self.words, code), max(len(self.words) - 1, 0))
        there = self.words[at] == code if len(self.words) else np.zeros(len(code), bool)
        doc, gram = doc[there], at[there]
        chosen = self._looked_for()
        item, begin = self._postings(chosen)
        item, met = self._meet(item, begin, doc, gram)
        pair, common = np.unique(item * len(grams) + met, return_counts=True)
        item, met = np.divmod(pair, max(len(grams), 1))
        # At best all grams that were not looked for are common as well.
        most = np.minimum(np.minimum(common + self.sizes[item] - self.many[item], self.sizes[item]), size[met])
        fits = micros(most, self.sizes[item] + size[met] - most) >= self.bound[item]
        item, met, common = item[fits], met[fits], common[fits]
        self.candidates += len(item)
        if len(chosen) < len(self.item):
            common = self._common(item, met, doc, gram, len(grams))
        self.seen += np.bincount(gram, minlength=len(self.words))
        enough = micros(common, self.sizes[item] + size[met] - common) >= self.bound[item]
        item, met, common = item[enough], met[enough], common[enough]
        offset = sum(map(len, self.names))
        self.found.append(np.stack([item, common, size[met], offset + np.arange(len(met))]))
        self.names.append(names.take(pa.array(met)))
        if self.k is not None:
            self._cut()

    @staticmethod
    def _meet(item: np.ndarray, begin: np.ndarray, doc: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item and document of every gram that a document has and the postings list."""
        many = begin[gram + 1] - begin[gram]
        at = np.arange(many.sum()) + np.repeat(begin[gram] - (np.cumsum(many) - many), many)
        return item[at], np.repeat(doc, many)

    def _common(self, item: np.ndarray, met: np.ndarray, doc: np.ndarray, gram: np.ndarray, docs: int) -> np.ndarray:
        """How many grams each pair of an item and a document has in common: the item's, looked up among the document's."""
        have = doc * len(self.words) + gram  # ascending: documents in order, and grams in each
        out = np.zeros(len(item), np.int64)
        step = max(1, (1 << 22) // max(int(self.sizes.max(initial=1)), 1))
        for first in range(0, len(item), step):
            i, d = item[first : first + step], met[first : first + step]
            many = self.sizes[i]
            at = np.arange(many.sum()) + np.repeat(self.starts[i] - (np.cumsum(many) - many), many)
            key = np.repeat(d, many) * len(self.words) + self.gram[at]
            hit = have[np.minimum(np.searchsorted(have, key), max(len(have) - 1, 0))] == key if len(have) else np.zeros(len(key), bool)
            out[first : first + step] = np.bincount(np.repeat(np.arange(len(i)), many), hit, len(i)).astype(np.int64)
        return out

    def _cut(self) -> None:
        rows, names = np.concatenate(self.found, axis=1), pa.concat_arrays(self.names)
        place = np.empty(len(names), np.int64)
        place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        score = micros(rows[1], self.sizes[rows[0]] + rows[2] - rows[1])
        order = np.lexsort((place[rows[3]], -score, rows[0]))
        nth = np.arange(len(order)) - np.searchsorted(rows[0][order], rows[0][order])
        last = order[nth == self.k - 1]
        self.bound[rows[0][last]] = np.maximum(self.bound[rows[0][last]], score[last])
        rows = rows[:, order[nth < self.k]]
        names = names.take(pa.array(rows[3]))
        rows[3] = np.arange(rows.shape[1])
        self.found, self.names = [rows], [names]

    def rows(self) -> pa.RecordBatch:
        rows = np.concatenate(self.found, axis=1)
        names = pa.concat_arrays(self.names).take(pa.array(rows[3]))
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(rows[0])), names, pa.array(rows[1]), pa.array(self.sizes[rows[0]]), pa.array(rows[2])], ["item_id", "doc_id", "common", "item_grams", "doc_grams"])

    def flush(self) -> pa.RecordBatch:
        """What has been found, which is then forgotten: without ``k`` nothing found later depends on it."""
        out = self.rows()
        self.found, self.names = [np.zeros((4, 0), np.int64)], []
        return out


#: Documents that are counted at once.
CHUNK = 256


def shared_grams(items: DataFrame, docs: DataFrame, n: int, k: int | None = None, least: int = 0, item_block: int = 4096, doc_block: int = 20_000) -> DataFrame:
    """item_id, doc_id, common, item_grams, doc_grams: pairs of items (item_id, text) and docs (doc_id, text) with a common gram.

    With ``k`` only what holds the k most similar documents of each item (by Jaccard in millionths, then by doc_id), with ``least`` only pairs that are
    so similar (in millionths); without either, every pair. Up to ``item_block`` items are one index that goes to every task: the
    documents are read once and not shuffled, and a task compares in full those that pass the index's bounds. More items
    make a grid of blocks, each pair of which is one task's work. Ids of any type that has an order; null texts have no grams.
    """
    left, right = items.select("item_id", "text"), docs.select("doc_id", "text")
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, common long, item_grams long, doc_grams long"
    few = left.limit(item_block + 1).toArrow()

    def count(index: GramIndex, names: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for first in range(0, max(len(names), 1), CHUNK):
            index.add(names.slice(first, CHUNK), texts.slice(first, CHUNK).to_pylist())
            if k is None:
                yield index.flush()

    if few.num_rows <= item_block:
        ids, texts = few.column("item_id").combine_chunks(), few.column("text").to_pylist()

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = GramIndex(ids, texts, n, k, least)
            for batch in batches:
                yield from count(index, batch.column("doc_id"), batch.column("text"))
            if k is not None and index.names:
                yield index.rows()

        return right.mapInArrow(scan, schema)
    blocks, shards = max(1, -(-left.count() // item_block)), max(1, -(-right.count() // doc_block))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = left.select("item_id", "text", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"), every(shards).alias("shard"))
    right = right.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), every(blocks).alias("block"))

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        index = GramIndex(a.column("item_id").combine_chunks(), a.column("text").to_pylist(), n, k, least)
        parts = list(count(index, b.column("doc_id").combine_chunks(), b.column("text").combine_chunks()))
        return pa.Table.from_batches(parts if k is None else [index.rows()])

    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(pair, schema)


def _similarity(rows: DataFrame) -> DataFrame:
    union = F.col("item_grams") + F.col("doc_grams") - F.col("common")
    return rows.select("item_id", "doc_id", "common", union.alias("_union")).withColumn("_m", F.expr("(2000000L * common + _union) div (2 * _union)"))


def nearest_by_jaccard(items: DataFrame, docs: DataFrame, n: int, k: int) -> DataFrame:
    """item_id, doc_id, similarity (six places): the k documents of each item that share most of their grams."""
    order = Window.partitionBy("item_id").orderBy(F.desc("_m"), "doc_id")
    rows = _similarity(shared_grams(items, docs, n, k))
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).select("item_id", "doc_id", (F.col("_m") / 1_000_000).alias("similarity"))


def similar_sets(items: DataFrame, docs: DataFrame, n: int, least: float) -> DataFrame:
    """item_id, doc_id, similarity (six places): all pairs whose Jaccard similarity, rounded to six places, is at least so large."""
    return _similarity(shared_grams(items, docs, n, least=max(1, round(least * 1_000_000)))).select("item_id", "doc_id", (F.col("_m") / 1_000_000).alias("similarity"))


def coverage(items: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """item_id, doc_id, overlap (six places): the share of an item's grams that a document has, for all pairs that share any."""
    return shared_grams(items, docs, n).select("item_id", "doc_id", (F.expr("(2000000L * common + item_grams) div (2 * item_grams)") / 1_000_000).alias("overlap"))


def pair_overlap(pairs: DataFrame, n: int) -> DataFrame:
    """qid, id, overlap (six places): the share of the grams of text a that text b has, for each pair (qid, id, a, b); 0 where a has none."""

    def run(batches):
        for batch in batches:
            sides = [[gram_codes(t, n) for t in batch.column(c).to_pylist()] for c in "ab"]
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides, strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("id"), pa.array(micros(common, np.array([len(x) for x in sides[0]], np.int64)) / 1_000_000)], ["qid", "id", "overlap"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("qid", "id"))
    return pairs.select("qid", "id", "a", "b").mapInArrow(run, f"{kinds}, overlap double")


def pair_jaccard(pairs: DataFrame, n: int) -> DataFrame:
    """qid, id, similarity (six places): the Jaccard similarity of the grams of each pair's texts (qid, id, a, b)."""

    def run(batches):
        for batch in batches:
            sides = [[gram_codes(t, n) for t in batch.column(c).to_pylist()] for c in "ab"]
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides, strict=True)], np.int64)
            whole = np.array([len(x) + len(y) for x, y in zip(*sides, strict=True)], np.int64) - common
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("id"), pa.array(micros(common, whole) / 1_000_000)], ["qid", "id", "similarity"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("qid", "id"))
    return pairs.select("qid", "id", "a", "b").mapInArrow(run, f"{kinds}, similarity double")
