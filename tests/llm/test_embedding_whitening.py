"""Whitening against numpy's eigenvectors of the covariance, and exact deviations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlore.llm.embedding_whitening import bidiagonalise, whiten_embeddings

VECTORS = "vec_id bigint, embedding array<float>"


def whole(vector):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def brute(vectors):
    """Sums, exact deviations, variances and components (as columns)."""
    x = [whole(v) for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return centred, deviations, values[::-1], axes[:, ::-1]


def table(found):
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    return by_id


def test_equals_eigenvectors(spark):
    pick = np.random.default_rng(5)
    vectors = (pick.standard_normal((400, 40)) * np.linspace(0.1, 9, 40) + 3) @ pick.standard_normal((40, 40))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], VECTORS).repartition(3)
    found = table(whiten_embeddings(df, block_bytes=4000))
    centred, deviations, values, axes = brute(vectors)
    assert sorted(found) == list(range(400))
    for k in range(32):
        ours = np.array([found[i][k + 1]["whitened"] for i in range(400)])
        theirs = centred @ axes[:, k] / np.sqrt(values[k])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-9
        assert found[0][k + 1]["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-10)
    for i, by_component in found.items():
        assert sorted(by_component) == list(range(1, 33))
        assert {r["deviation"] for r in by_component.values()} == {deviations[i]}
        assert {r["n"] for r in by_component.values()} == {400}
        assert all(r["identity_error"] < 1e-10 for r in by_component.values())


def test_equal_and_vanishing_variances(spark):
    """Two equal variances, a constant column and a repeated one: two components, none for the rest."""
    rows = [(a, b, 7.0, a) for a in (-1.0, 1.0) for b in (-1.4142135, 1.4142135)] * 5
    df = spark.createDataFrame([(i % 3, list(v)) for i, v in enumerate(rows)], VECTORS)
    found = whiten_embeddings(df).collect()
    assert {r["component"] for r in found} == {1, 2}
    assert len(found) == 40
    for k in (1, 2):
        values = [r["whitened"] for r in found if r["component"] == k]
        assert np.mean(values) == pytest.approx(0, abs=1e-12)
        assert np.mean(np.square(values)) == pytest.approx(1, rel=1e-10)
    assert max(r["identity_error"] for r in found) < 1e-10


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 2.0]),
        (1, [1.0, 2.0]),
        (None, [3.0, -1.0]),
        (2, None),
        (3, [None, 1.0]),
        (4, [float("nan"), 1.0]),
        (5, [float("inf"), 1.0]),
        (6, []),
        (7, [1.0, 2.0, 3.0]),
        (8, [-0.001, 1e6]),
    ]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(2) for c in ("x", "n", "ids", "known", "size", "component")})
    found = whiten_embeddings(df).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in found) == sorted(
        (i, k) for i in ("1", "1", "None", "8") for k in (1, 2)
    )
    deviations = brute([(1.0, 2.0), (1.0, 2.0), (3.0, -1.0), (-0.001, 1e6)])[1]
    assert {(r["vec_id"], r["deviation"]) for r in found} == set(zip((1, 1, None, 8), deviations, strict=True))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0]), (2, [2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whiten_embeddings(spark.createDataFrame(rows, VECTORS)).collect() == []


def test_beyond_64_bits_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e30]), (2, [0.0])], VECTORS)
    with pytest.raises(Exception, match="OVERFLOW|beyond|overflow"):
        whiten_embeddings(df).collect()


@pytest.mark.parametrize("values", [[5, 5, 5, 2, 2, 1, 0, 0], [1e4, 1, 1e-3], [3], [0, 0], list(range(1, 65))])
def test_bidiagonal_form(values):
    """Right vectors are orthonormal and the small decomposition has all singular values."""
    pick = np.random.default_rng(len(values))
    left = np.linalg.qr(pick.standard_normal((len(values) + 9, len(values))))[0]
    right = np.linalg.qr(pick.standard_normal((len(values), len(values))))[0]
    x = left * np.array(values, float) @ right
    calls = []

    def product(v):
        calls.append(1)
        return x.T @ (x @ v)

    form = bidiagonalise(product, len(values))
    assert len(calls) <= 3 * len(values)
    assert np.abs(form.right.T @ form.right - np.eye(len(values))).max() < 1e-12
    axes, variances = form.components(1)
    expected = np.sort(np.array(values, float) ** 2)[::-1]
    expected = expected[expected > 0]
    # Double precision is relative to the largest variance.
    assert variances == pytest.approx(expected, rel=1e-9, abs=1e-15 * max(expected, default=1))
    assert np.abs(x.T @ (x @ axes) - axes * variances).max(initial=0) <= 1e-10 * max(expected, default=1)
