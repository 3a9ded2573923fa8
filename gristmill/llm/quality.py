"""Quality classifier by positive-unlabelled learning.

Texts are described by shape statistics. A small network minimises the non-negative unbiased risk of
trusted positives and unlabelled text under an estimated class prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import words

#: Classes of bytes: lower case, upper case, digit, space, line end, beyond ASCII, sentence marks, other marks.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[[9, 10, 11, 12, 13]], _CLASS[128:] = 0, 1, 2, 3, 4, 5
_CLASS[[ord(c) for c in ".,;:'\"-?"]] = 6
N_CLASS = 8

NAMES = (
    [f"pair_{i}_{j}" for i in range(N_CLASS) for j in range(N_CLASS)]
    + ["log_bytes", "log_words", "word_bytes", "word_bytes_sd", "upper_words", "mark_end_words", "distinct_words", "distinct_lines", "log_lines", "line_words", "repeated_marks", "short_words"]
)


def features(column: pa.Array) -> np.ndarray:
    """Shape statistics of each text, a row each in the order of NAMES. Null counts as empty; an empty text's are 0."""
    data, offsets = words.buffers(column)
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(n, dtype=np.int64), lengths)
    out = np.zeros((n, len(NAMES)), np.float32)
    if not len(data):
        return out
    kind = _CLASS[data]
    inner = doc[1:] == doc[:-1]
    pairs = np.bincount((doc[1:] * 64 + kind[:-1] * np.int64(N_CLASS) + kind[1:])[inner], minlength=n * 64).reshape(n, 64)
    out[:, :64] = pairs / np.maximum(lengths - 1, 1)[:, None]
    starts, ends, counts = words.spans(data, offsets)
    of = np.repeat(np.arange(n), counts)
    size = (ends - starts).astype(float)
    m = np.maximum(counts, 1)
    mean = np.bincount(of, size, n) / m
    spread = np.sqrt(np.maximum(np.bincount(of, size**2, n) / m - mean**2, 0))
    upper = np.concatenate([[0], np.cumsum(kind == 1)])
    all_upper = (upper[ends] - upper[starts]) * 2 > size
    tail = kind[ends - 1] == 7
    hashes = words.span_hashes(data, starts, ends)
    own = lambda h, d: np.bincount(d[np.unique(words.mix(h + d.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), return_index=True)[1]], minlength=n)
    breaks = np.concatenate([[0], np.flatnonzero(data == 10) + 1, offsets[:-1][lengths > 0]])
    first = np.unique(breaks[breaks < len(data)])
    last = np.append(first[1:], len(data))
    lines = np.bincount(doc[first], minlength=n)
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & (kind[1:] >= 6) & inner
    stats = (
        np.log1p(lengths), np.log1p(counts), mean, spread, np.bincount(of, all_upper, n) / m, np.bincount(of, tail, n) / m,
        own(hashes, of) / m, own(words.span_hashes(data, first, last), doc[first]) / np.maximum(lines, 1),
        np.log1p(lines), counts / np.maximum(lines, 1), np.bincount(doc, same, n) / np.maximum(lengths, 1), np.bincount(of, size <= 2, n) / m,
    )
    out[:, 64:] = np.stack(stats, axis=1)
    out[lengths == 0] = 0
    return out


class Network:
    """One hidden layer over standardised statistics; plain arrays, so that it ships to every task."""

    def __init__(self, centre, scale, w1, b1, w2, b2):
        self.parts = (centre, scale, w1, b1, w2, b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        centre, scale, w1, b1, w2, b2 = self.parts
        return np.tanh(np.clip((x - centre) / scale, -6, 6) @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, epochs: int = 60, batch: int = 512, rate: float = 0.005, decay: float = 1e-4, seed: int = 7) -> Network:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with logistic losses.

    Where the part in the maximum turns negative on a batch, the step climbs it instead, as in the
    non-negative estimator. Batches and first weights come from ``seed``: reruns agree.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled]).astype(float)
    centre, scale = both.mean(0), both.std(0) + 1e-3
    x_p, x_u = (np.clip((x - centre) / scale, -6, 6) for x in (positive.astype(float), unlabelled.astype(float)))
    w = [rng.normal(0, 1 / np.sqrt(both.shape[1]), (both.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    rounds = max(1, -(-len(x_u) // batch))
    for _ in range(epochs):
        order_u, order_p = rng.permutation(len(x_u)), rng.permutation(len(x_p))
        for k in range(rounds):
            u = x_u[order_u[k * batch : (k + 1) * batch]]
            p = x_p[np.take(order_p, np.arange(k * batch, k * batch + min(batch, len(x_p))), mode="wrap")]
            x = np.concatenate([p, u])
            h = np.tanh(x @ w[0] + w[1])
            z = h @ w[2] + w[3]
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            n_p, n_u = len(p), len(u)
            minus = np.logaddexp(0, z)
            negative_part = minus[n_p:].mean() - prior * minus[:n_p].mean()
            sign = 1.0 if negative_part >= 0 else -1.0
            g = np.concatenate([-sign * prior * s[:n_p] / n_p, sign * s[n_p:] / n_u])
            if sign > 0:
                g[:n_p] += prior * (s[:n_p] - 1) / n_p
            gh = np.outer(g, w[2]) * (1 - h**2)
            grads = [x.T @ gh + decay * w[0], gh.sum(0), h.T @ g + decay * w[2], g.sum()]
            step += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Network(centre, scale, *w)


def calibrate(net: Network, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Network:
    """Scale and shift the logits to the labels of the training rows (Platt's targets); unchanged without both classes."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return net
    z, t = net.logits(x.astype(float)), np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):  # Newton's method on two parameters
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        r = p * (1 - p)
        h = np.array([[(r * z * z).sum() + 1e-3, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    if a <= 0:
        return net
    centre, scale, w1, b1, w2, b2 = net.parts
    return Network(centre, scale, w1, b1, w2 * a, b2 * a + b)


def held_out(doc_id):
    """Rows of the fold that no label is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, part, x: the statistics of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.chunks(batch, "text"):
                x = features(piece.column("text"))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("part"), lists], ["doc_id", "part", "x"])

    return docs.mapInArrow(run, "doc_id long, part int, x array<float>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = 8000, negatives: int = 4000, unlabelled: int = 16000, seed: int = 11) -> Network | float:
    """The classifier, fitted on bounded samples; the class prior alone where there is nothing to learn from.

    ``positives``, ``negatives`` and ``unlabelled`` bound the samples, drawn by a hash of the id outside
    the held-out fold. The positives and the unlabelled texts train the network. Labels of the sampled rows
    estimate the class prior and calibrate the scores. The sampled ids, bounded so, are broadcast to the
    texts; only their statistics reach the driver.
    """
    marks = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    marks = marks.filter(~held_out(F.col("doc_id")))
    counts = {r.y: r.n for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (counts.get(1, 0) + 0.8) / (counts.get(1, 0) + counts.get(0, 0) + 1)
    prior = float(np.clip(prior, 0.05, 0.95))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    ids = rows.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    draw = F.xxhash64("doc_id", F.lit(seed))
    known = ids.join(marks, "doc_id")
    free = ids.join(labels.select(labels[id_col].cast("long").alias("doc_id")), "doc_id", "left_anti")
    samples = [
        known.filter("y = 1").orderBy(draw, "doc_id").limit(positives).select("doc_id", F.lit(1).alias("part")),
        known.filter("y = 0").orderBy(draw, "doc_id").limit(negatives).select("doc_id", F.lit(0).alias("part")),
        free.orderBy(draw, "doc_id").limit(unlabelled).select("doc_id", F.lit(2).alias("part")),
    ]
    drawn = samples[0].union(samples[1]).union(samples[2]).distinct()
    described = _described(rows.join(F.broadcast(drawn), "doc_id").select("doc_id", "part", "text"))
    got = described.groupBy("doc_id", "part").agg(F.min("x").alias("x")).toArrow()  # rows of one id are one document, so the samples' bounds hold
    part = got.column("part").to_numpy()
    x = np.asarray(got.column("x").combine_chunks().flatten().to_numpy(), np.float32).reshape(-1, len(NAMES))
    order = np.lexsort((*x.T[::-1], part))  # rows arrive in any order; the result is not to depend on it
    part, x = part[order], x[order]
    positive, free_x = x[part == 1], x[part == 2] if (part == 2).any() else x
    if not len(positive):
        return prior
    return calibrate(train(positive, free_x, prior), x[part < 2], part[part < 2])


def score(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Nothing is shuffled. Null counts as empty; empty texts are scored as statistics of zeros, like
    any other. Rows without an id are scored too and are not held out. Equal texts have
    equal scores. An empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.chunks(batch, "text"):
                s = np.full(piece.num_rows, model) if isinstance(model, float) else model.scores(features(piece.column("text")))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, model: Network | float, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least the threshold. Nothing is shuffled.

    Null counts as empty; empty and very long texts are scored like others, rows without an id and repeated rows too.
    An empty table stays empty; other columns are kept, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.chunks(batch, text_col):
                s = np.full(piece.num_rows, model) if isinstance(model, float) else model.scores(features(piece.column(text_col)))
                yield piece.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
