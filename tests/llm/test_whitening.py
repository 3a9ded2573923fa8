import math

import numpy as np
import pytest

from gristmill.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n long, deviation string"


def result(spark, vectors, components=32):
    fit = whitening.fit_whitening(vectors, components=components)
    error = whitening.identity_error(vectors, fit) if fit else None
    return fit, whitening.component_rows(whitening.whiten(vectors, fit), fit, error).collect()


def brute(rows, components=32):
    """vec_id, deviation and whitened vector, from exact integers and one decomposition."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(good), [sum(c) for c in zip(*(x for _, x in good), strict=True)]
    x = np.array([v for _, v in good], float) - np.array(sums) / n
    values, directions = np.linalg.eigh(x.T @ x / n)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    return n, [(i, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, v in good], x @ directions / np.sqrt(values), values


def test_query_agrees_with_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, exact, whitened, values = brute(rows)
    got = queries.op11_whitening(spark, sf).collect()
    assert len(got) == 32 * n and {r.n for r in got} == {n}
    assert {(r.vec_id, r.deviation) for r in got} == set(exact)
    matrix = np.zeros((n, 32))
    place = {i: k for k, (i, _) in enumerate(exact)}
    for r in got:
        matrix[place[r.vec_id], r.component - 1] = r.whitened
    matrix *= np.sign((matrix * whitened).sum(axis=0))
    assert np.abs(matrix - whitened).max() < 1e-8
    assert np.abs(matrix.T @ matrix / n - np.eye(32)).max() < 1e-9
    assert {round(r.identity_error, 6) for r in got} == {0.0}
    explained = {r.component: r.explained for r in got}
    full = brute(rows, 64)[3]
    assert np.allclose([explained[k + 1] for k in range(32)], values / full.sum(), rtol=1e-9)


def test_nulls_odd_entries_repeats_and_other_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 3, 4).round(2).tolist()) for i in range(40)]
    rows += [(1, rows[1][1]), (None, rows[2][1]), (50, None), (51, []), (52, [1.0, None, 2.0, 3.0]), (53, [1.0, float("nan"), 2.0, 3.0]), (54, [float("inf")] * 4)]
    other = [(60, [1.0, 2.0]), (61, [1e30] * 4)]
    fit, got = result(spark, spark.createDataFrame([(i, v, 7, "x") for i, v in rows + other], SCHEMA), components=3)
    n, exact, whitened, _ = brute(rows, 3)
    assert (fit.n, n) == (42, 42)
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), d) for i, d in exact)
    assert max(abs(abs(a) - abs(b)) for a, b in zip(sorted(abs(r.whitened) for r in got), sorted(np.abs(whitened).ravel()), strict=True)) < 1e-9


def test_large_entries_are_exact(spark):
    rows = [(i, [c * 1e12, c * 3.0, -c * 1e9]) for i, c in enumerate([1.0, 2.5, -7.25, 4.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fit = whitening.fit_whitening(vectors)
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(vectors, fit).collect()}
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert got == {i: sum((4 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    fit, got = result(spark, spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA))
    assert fit is None and got == []


def test_directions_without_variance_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0], 0, "") for i in range(10)]
    fit, got = result(spark, spark.createDataFrame(rows, SCHEMA))
    assert len(fit.values) == 1 and len(got) == 10 and got[0].identity_error < 1e-9


def test_partitions_do_not_matter(spark):
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, rng.normal(size=6).tolist(), 0, "") for i in range(300)], SCHEMA)
    a, b = (whitening.fit_whitening(vectors.repartition(k)) for k in (1, 37))
    assert a.sums == b.sums and np.allclose(a.values, b.values, rtol=1e-12) and np.allclose(a.directions, b.directions, atol=1e-9)
