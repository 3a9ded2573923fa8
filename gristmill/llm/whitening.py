"""Whitening of embeddings: exact integer sums, centred outer products merged in a tree, eigenvectors, one projection.

The first pass sums whole numbers, so the mean is exact whatever the order of tasks. The second centres before it multiplies and
adds up one matrix a task; matrices meet in a tree, so the driver gets a few of them however many tasks there are.
What is broadcast is one vector and one matrix of the embedding's dimension.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.shared import small_batches

#: An entry c becomes floor(STEPS * c) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
#: Entries of vectors that are worked on at once.
CHUNK = 1 << 20
#: Entries beyond this in size, as whole numbers, are summed and squared as Python's integers.
SMALL = 1 << 40
#: Eigenvalues below this share of the largest are rounding error: no direction of the data.
RANK = 1e-12


def _vectors(batch: pa.RecordBatch, name: str = "embedding") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch whose vectors become whole numbers, and these numbers, for each length of vector."""
    column = batch.column(name)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # null entries are NaN, null vectors have none
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        for first in range(0, len(rows), max(1, CHUNK // int(size))):
            some = rows[first : first + max(1, CHUNK // int(size))]
            x = flat[(ends[some] - size)[:, None] + np.arange(size)]
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(x * STEPS)
                good = (np.abs(x) < 2.0**62).all(axis=1)
            yield some[good], x[good].astype(np.int64) + SHIFT


def _one_a_task(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], object]):
    """An RDD of what ``work`` makes of each task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work(batches))], pa.binary())], ["part"])

    return df.mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(r.part))


class Fit(NamedTuple):
    """n, exact sums and the transform of a set of vectors: directions[:, k] is the k-th unit eigenvector, values falling."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, in doubles: exact differences with the mean's whole part, less its fraction."""
        whole = np.array([(s // self.n) for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - part

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum over dimensions of (n * x - S) ** 2, exactly: with x = m + a and S = n * m + r it is n * n * sum(a * a) - 2 * n * sum(a * r) + sum(r * r)."""
        whole = np.array([(s // self.n) for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        a = x - whole
        top = int(np.abs(a).max(initial=0))
        wide = top * max(top, self.n) * a.shape[1] >= 1 << 62
        a, r = (a.astype(object), np.array(rest, object)) if wide else (a, np.array(rest, np.int64))
        squares, mixed, last = (a * a).sum(axis=1), (a * r).sum(axis=1), sum(v * v for v in rest)
        return [self.n * self.n * int(q) - 2 * self.n * int(w) + last for q, w in zip(squares, mixed, strict=True)]


def _sum_vectors(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[int, list[int]]]:
    found: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        for _, x in _vectors(batch):
            if len(x):
                sums = x.sum(axis=0) if int(np.abs(x).max()) < SMALL else x.astype(object).sum(axis=0)
                found = _add_sums(found, {x.shape[1]: (len(x), [int(v) for v in sums])})
    return found


def _add_sums(a: dict, b: dict) -> dict:
    out = dict(a)
    for size, (n, sums) in b.items():
        m, have = out.get(size, (0, [0] * size))
        out[size] = (m + n, [x + y for x, y in zip(have, sums, strict=True)])
    return out


def _moments(fit: Fit, project: np.ndarray | None = None):
    """The sum of outer products of a task's centred vectors, or of what they are projected on, and the sum of these themselves."""
    width = len(fit.sums) if project is None else project.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        outer, sums = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            for _, x in _vectors(batch):
                if x.shape[1] == len(fit.sums):
                    c = fit.centred(x)
                    c = c if project is None else c @ project
                    outer += c.T @ c
                    sums += c.sum(axis=0)
        return outer, sums

    return work


def _add_pairs(a, b):
    return a[0] + b[0], a[1] + b[1]


def _entries(vectors: DataFrame, vector_col: str) -> DataFrame:
    small_batches(vectors.sparkSession)
    return vectors.select(vectors[vector_col].cast("array<double>").alias("embedding"))


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", components: int | None = None) -> Fit | None:
    """The transform fitted on all vectors, in two passes; None where there is nothing to whiten.

    Vectors that are null, empty, or hold null, non-finite or too large entries (64 * c beyond 2 ** 62) are left out, and so are
    those of another length than most vectors have (of equally frequent lengths the larger counts). Directions whose
    eigenvalue is rounding error (below RANK of the largest) are none, so there may be fewer than ``components``:
    equal vectors, or a single one, have none and give None. Each direction's largest entry is positive.
    """
    rows = _entries(vectors, vector_col)
    lengths = _one_a_task(rows, _sum_vectors).treeAggregate({}, _add_sums, _add_sums)
    if not lengths:
        return None
    size, (n, sums) = max(lengths.items(), key=lambda x: (x[1][0], x[0]))
    start = Fit(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0)
    zero = np.zeros((size, size)), np.zeros(size)
    outer, rest = _one_a_task(rows, _moments(start)).treeAggregate(zero, _add_pairs, _add_pairs)
    covariance = outer / n - np.outer(rest / n, rest / n)  # what rounding has left of the mean
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > max(values.max() * RANK, 0)][:components]
    if not len(order):
        return None
    values, directions = values[order], directions[:, order]
    directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(len(order))])
    return Fit(n, sums, values, directions, float(np.trace(covariance)))


def identity_error(vectors: DataFrame, fit: Fit, vector_col: str = "embedding") -> float:
    """The largest entry, by size, of the whitened vectors' covariance less the identity: measured over all rows."""
    scaled = fit.directions / np.sqrt(fit.values)
    zero = np.zeros((scaled.shape[1],) * 2), np.zeros(scaled.shape[1])
    outer, rest = _one_a_task(_entries(vectors, vector_col), _moments(fit, scaled)).treeAggregate(zero, _add_pairs, _add_pairs)
    return float(np.abs(outer / fit.n - np.outer(rest / fit.n, rest / fit.n) - np.eye(len(zero[1]))).max())


WHITENED = "deviation decimal(38,0), whitened array<double>"


def whiten(vectors: DataFrame, fit: Fit | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector that the fit counts: vec_id, deviation, whitened (an entry for each component). Nothing is shuffled.

    ``deviation`` is the exact sum over dimensions of (n * x - S) ** 2, null where it has more than 38 digits. Rows without
    an id and repeated rows are kept. Without a fit, or with an empty table, the result is empty. Other columns are ignored,
    whatever their names. Memory follows a chunk of entries, or one vector if that is longer.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("embedding"))
    schema = f"vec_id {kind}, {WHITENED}"
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = shared.value
        scaled = fit.directions / np.sqrt(fit.values)
        for batch in batches:
            for at, x in _vectors(batch):
                if x.shape[1] != len(fit.sums):
                    continue
                w = fit.centred(x) @ scaled
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                exact = fit.deviations(x)
                deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), deviation, lists], ["vec_id", "deviation", "whitened"])

    small_batches(vectors.sparkSession)
    return rows.mapInArrow(run, schema)


def component_rows(whitened: DataFrame, fit: Fit | None, error: float | None) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    ``deviation`` is null where it doesn't fit a long.
    """
    share = F.array(*[F.lit(float(v / fit.total)) for v in (fit.values if fit else ())]).cast("array<double>")
    rows = whitened.select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("_k", "whitened"))
    return rows.select(
        "vec_id", (F.col("_k") + 1).cast("int").alias("component"), F.lit(fit.n if fit else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("_k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
