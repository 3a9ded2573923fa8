"""Exact vector search: normalising, quantising, filtered and batched top-k, rankings of pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns a metadata predicate may name, and its comparisons.
FILTER_COLUMNS = ("theme", "law_type", "law_name", "effective_date")
OPERATORS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def predicate(where: dict | None, columns=FILTER_COLUMNS) -> Column:
    """A conjunction from {column: value, (operator, value) or list of values}. Missing values compare as ''."""
    found = F.lit(True)
    for name, value in (where or {}).items():
        if name not in columns:
            raise ValueError(f"cannot filter by {name!r}")
        column = F.coalesce(F.col(name).cast("string"), F.lit(""))
        if isinstance(value, list):
            if not value:
                raise ValueError(f"no values for {name!r}")
            # Missing values match '' alone, so others are compared on the column itself and reach the scan.
            found &= (column if "" in value else F.col(name)).isin([str(v) for v in value])
        else:
            op, v = value if isinstance(value, tuple) else ("=", value)
            if op not in OPERATORS:
                raise ValueError(f"unknown comparison {op!r}")
            found &= getattr(F.col(name) if op == "=" and v != "" else column, OPERATORS[op])(str(v))
    return found


def dot(a: Column, b: Column) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    v = v.cast("array<double>")
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x / norm)


def quantize(v: Column) -> Column:
    """struct(codes, scale): eight-bit codes of a vector, scaled by its largest magnitude, rounded half to even."""
    v = v.cast("array<double>")
    top = F.array_max(F.transform(v, F.abs)) / 127
    scale = F.when(top > 0, top).otherwise(1.0)
    codes = F.transform(v, lambda x: F.greatest(F.least(F.bround(x / scale), F.lit(127.0)), F.lit(-127.0)).cast("int"))
    return F.struct(codes.alias("codes"), scale.alias("scale"))


def search(index: DataFrame, query: list[float], k: int = 5, where: dict | None = None) -> DataFrame:
    """The k nearest rows (id, embedding, ...) to one query vector, after the filter: a distributed top-k."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    e = F.col("embedding")
    score = dot(e, vector) / F.greatest(F.sqrt(dot(e, e)) * F.sqrt(dot(vector, vector)), F.lit(1e-12))
    return index.filter(predicate(where)).withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)


def batch_knn(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = True, block: int = 4096, digits: int = 6) -> DataFrame:
    """qid, id, score, rank: for every query (qid, embedding) the k rows (id, embedding) of largest dot product.

    Exact; ids of any type that has an order, and qids too. Up to ``block`` queries are one matrix that goes to every task: the corpus is read
    once and not shuffled, and a task keeps the k best of each query so far, so what leaves it doesn't grow with its rows. More queries make a
    grid: each pair of a block of up to 4 ``block`` queries and a block of up to 16 ``block`` rows, less where there would be few tasks, is worked
    out in one task, whose k best per query go on. Ties go to the smaller id. A row that has a query's own id is none of its answers with
    ``exclude_self``. Rows without a vector are left out, and so are scores that are no finite numbers.
    """
    left, right = (df.select(c, "embedding").filter("embedding is not null") for df, c in ((queries, "qid"), (corpus, "id")))
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, score double"
    few = left.limit(block + 1).toArrow()
    if few.num_rows <= block:
        qids, q = few.column("qid").combine_chunks(), _matrix(few.column("embedding").combine_chunks())

        def scan(batches):
            best = _Best(qids, q, k, exclude_self, digits)
            for rows in _gathered(batches, 16 * block):
                best.add(rows.column("id").combine_chunks(), _matrix(rows.column("embedding").combine_chunks()))
            if best.id is not None:
                yield best.rows()

        scored = right.mapInArrow(scan, schema)
    else:
        many_q, many_d = left.count(), right.count()
        n_q = max(1, -(-many_q // (4 * block)))
        # Enough pairs for all cores, but of rows that are worth a task.
        n_d = max(1, -(-many_d // (16 * block)), min(-(-4 * left.sparkSession.sparkContext.defaultParallelism // n_q), 4 * many_d // block))
        every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        # Both sides' keys are of one type: cogroup doesn't cast them, and numbers of other types are dealt to other partitions.
        left = left.select("qid", "embedding", F.pmod(F.xxhash64("qid"), F.lit(n_q)).alias("qb"), every(n_d).alias("db"))
        right = right.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(n_d)).alias("db"), every(n_q).alias("qb"))
        # A pair is much work for few bytes: so many partitions that few pairs share one, and as they are given they are not brought together.
        left, right = (df.repartition(4 * n_q * n_d, "qb", "db") for df in (left, right))

        def pair(a: pa.Table, b: pa.Table) -> pa.Table:
            best = _Best(a.column("qid").combine_chunks(), _matrix(a.column("embedding").combine_chunks()), k, exclude_self, digits)
            best.add(b.column("id").combine_chunks(), _matrix(b.column("embedding").combine_chunks()))
            return pa.Table.from_batches([best.rows()])

        scored = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(pair, schema)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class _Best:
    """The k best rows of each query among those seen so far: query numbers, ids and scores, by query and id."""

    #: Scores that are worked out at once, and entries of rows' vectors.
    CELLS = 1 << 22

    def __init__(self, qids: pa.Array, q: np.ndarray, k: int, exclude_self: bool, digits: int):
        self.qids, self.q, self.k, self.exclude_self, self.digits = qids, q.astype(float), k, exclude_self, digits
        self.names = qids.unique()
        code = pc.index_in(qids, self.names).to_numpy(zero_copy_only=False)
        self.by_code = np.argsort(code, kind="stable")
        self.first_of = np.searchsorted(code[self.by_code], np.arange(len(self.names) + 1))
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), None
        self.least = np.full(len(qids), -np.inf)
        self.seen = 0

    def add(self, ids: pa.Array, d: np.ndarray) -> None:
        if self.id is None:
            self.id = ids.slice(0, 0)
        step = max(1, self.CELLS // max(1, d.shape[1]))
        for first in range(0, len(ids) if len(self.qids) else 0, step):
            self._add(ids.slice(first, step), d[first : first + step])

    def _add(self, ids: pa.Array, d: np.ndarray) -> None:
        order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
        order = order[np.isfinite(d).all(axis=1)[order]]
        ids, d = ids.take(pa.array(order)), d[order].astype(float)
        own_query, own_row = self._own(ids)
        step = max(1, self.CELLS // max(1, len(ids)))
        found = [(self.query, self.score, np.arange(len(self.query)))]
        for first in range(0, len(self.qids) if len(ids) else 0, step):
            scores = self.q[first : first + step] @ d.T
            here = (own_query >= first) & (own_query < first + step)
            scores[own_query[here] - first, own_row[here]] = -np.inf
            query, score, row = self._reaching(scores, self.least[first : first + step])
            found.append((query + first, score, row + len(self.id)))
        query, score, row = (np.concatenate(x) for x in zip(*found, strict=True))
        ids = pa.concat_arrays([self.id, ids]).take(pa.array(row))
        if len(self.query):
            place = np.empty(len(ids), np.int64)
            place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
            order = np.lexsort((place, query))
            order = order[self._best(query[order], score[order], len(self.qids))]
            query, score, ids = query[order], score[order], ids.take(pa.array(order))
        self.query, self.score, self.id = query, score, ids
        self.seen += len(d)
        begin = np.searchsorted(query, np.arange(len(self.qids) + 1))
        full = np.flatnonzero(np.diff(begin) >= self.k)
        if len(full):  # of each such query the least of its k scores
            self.least[full] = score[begin[full][:, None] + np.arange(self.k)].min(axis=1)

    def _own(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Queries and rows of one id."""
        if not self.exclude_self or ids.type != self.names.type:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = pc.fill_null(pc.index_in(ids, self.names), -1).to_numpy()
        row = np.flatnonzero(code >= 0)
        begin, end = self.first_of[code[row]], self.first_of[code[row] + 1]
        many = end - begin
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return self.by_code[np.repeat(begin, many) + nth], np.repeat(row, many)

    def _reaching(self, scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, score, row of the k best of a matrix that reach ``least``; rows are in order of id.

        The k-th best of every eighth row is a bound of the k-th best; only what may reach it is rounded and looked at again.
        """
        n = scores.shape[1]
        if n > self.k and self.seen < n:
            some = scores[:, :: max(1, min(8, n // (4 * self.k)))]
            least = np.maximum(least, np.round(np.partition(some, some.shape[1] - self.k, axis=1)[:, -self.k], self.digits))
        flat = np.flatnonzero(scores >= (least - 10.0**-self.digits)[:, None])
        query, score = flat // n, np.round(scores.ravel()[flat], self.digits) + 0.0
        keep = np.flatnonzero((score >= least[query]) & np.isfinite(score))
        query, score, row = query[keep], score[keep], (flat - query * n)[keep]
        keep = self._best(query, score, len(scores))
        return query[keep], score[keep], row[keep]

    def _best(self, query: np.ndarray, score: np.ndarray, queries: int) -> np.ndarray:
        """Which entries, in order of query and id, are among the k best of their query."""
        begin = np.searchsorted(query, np.arange(queries + 1))
        most = np.diff(begin).max(initial=0)
        if most <= self.k:
            return np.arange(len(query))
        keep = np.empty(len(query), bool)
        step = max(1, self.CELLS // most)
        for first in range(0, queries, step):
            inside = slice(begin[first], begin[min(first + step, queries)])
            at = query[inside] - first, np.arange(inside.start, inside.stop) - begin[query[inside]]
            table = np.full((min(step, queries - first), most), -np.inf)
            table[at] = score[inside]
            last = np.partition(table, most - self.k, axis=1)[:, -self.k, None]
            above, tied = table > last, table == last
            keep[inside] = (above | (tied & (np.cumsum(tied, axis=1) <= self.k - above.sum(axis=1, keepdims=True))))[at]
        return np.flatnonzero(keep)

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.qids.take(pa.array(self.query)), self.id, pa.array(self.score)], ["qid", "id", "score"])


def _gathered(batches, least: int):
    """The rows of batches in tables of so many rows at least."""
    held, many = [], 0
    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many >= least:
            yield pa.Table.from_batches(held)
            held, many = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def best_pieces(ranked: DataFrame, group_of: DataFrame, limit: int) -> DataFrame:
    """qid, grp, id, score, rank: the best piece of each article (``group_of``: id, grp), at most ``limit`` articles a query."""
    rows = ranked.select("qid", "id", "score").join(group_of, "id")
    own = Window.partitionBy("qid", "grp").orderBy(F.desc("score"), "id")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    best = rows.withColumn("n", F.row_number().over(own)).filter("n = 1").drop("n")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("qid", "grp", "id", "score", "rank")


def cross_ranks(a: DataFrame, b: DataFrame) -> DataFrame:
    """qid, id, rank, other_rank: where the rows of one ranking stand in another; null beyond its depth."""
    return a.select("qid", "id", "rank").join(b.select("qid", "id", F.col("rank").alias("other_rank")), ["qid", "id"], "left")
