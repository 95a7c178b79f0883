"""Whitening against a dense decomposition, and its awkward tables."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from threadloom.llm import whitening

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("n", T.StringType())])


def table(spark, vectors, partitions=4):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "mine") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def dense(vectors, k=8):
    """Whole entries, sums, eigenvalues and eigenvectors by numpy over the whole matrix."""
    x = np.floor(1024 * np.array(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 100000
    c = x - x.sum(axis=0) / len(x)
    values, q = np.linalg.eigh(c.T @ c / len(x))
    values, q = values[::-1][:k], q[:, ::-1][:, :k]
    return x, values, (c @ q) / np.sqrt(values), np.trace(c.T @ c / len(x))


def test_equals_a_dense_decomposition(spark):
    random = np.random.default_rng(3)
    vectors = random.normal(size=(700, 12)) * np.linspace(3, 0.2, 12) + random.normal(size=12)
    found = whitening.whitened(table(spark, vectors.tolist())).orderBy("vec_id", "component").collect()
    x, values, y, trace = dense(vectors)
    assert len(found) == 700 * 8
    ours = np.array([r.whitened for r in found]).reshape(700, 8)
    assert np.abs(ours - y * np.sign((ours * y).sum(axis=0))).max() < 1e-9
    assert np.allclose([r.explained for r in found[:8]], values / trace, rtol=1e-10)
    s = x.sum(axis=0)
    assert [r.deviation for r in found[::8]] == [sum((700 * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    assert {r.n for r in found} == {700} and len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_repeated_eigenvalues_and_lost_ranks(spark):
    """Axis vectors have all eigenvalues equal but one; a start vector alone would find two directions."""
    axis = [[1.0 if i == j else 0.0 for j in range(6)] for i in range(6)] + [[-1.0 if i == j else 0.0 for j in range(6)] for i in range(6)]
    found = whitening.whitened(table(spark, axis)).collect()
    assert {r.component for r in found} == set(range(1, 7)) and found[0].identity_error < 1e-9
    assert all(math.isclose(r.explained, 1 / 6, rel_tol=1e-9) for r in found)
    flat = [[float(i), 2.0 * i, 0.0, 5.0] for i in range(20)]
    found = whitening.whitened(table(spark, flat)).collect()
    assert {r.component for r in found} == {1} and math.isclose(found[0].explained, 1.0, rel_tol=1e-9)


def test_vectors_that_do_not_count(spark):
    good = [[1.0, 2.0], [2.0, 1.0], [0.5, -3.0], [2.0, 1.0]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [1.0, 2.0, 3.0]]
    found = whitening.whitened(table(spark, good + bad)).collect()
    assert {r.vec_id for r in found} == {0, 1, 2, 3} and len(found) == 8
    assert np.allclose([r.whitened for r in found if r.vec_id == 1], [r.whitened for r in found if r.vec_id == 3])
    assert {r.n for r in found} == {4}


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_tables_without_a_component(spark, vectors):
    found = whitening.whitened(table(spark, vectors))
    assert found.collect() == []
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_are_exact_or_null(spark):
    huge = [[1e9, 1.0], [-1e9, 2.0], [3e30, 0.0], [0.0, 1.5]]
    found = whitening.whitened(table(spark, huge)).collect()
    assert {r.deviation for r in found} == {None}
    assert whitening.deviations(np.array([[3, 5]]), 4, (8, 12)) == [(12 - 8) ** 2 + (20 - 12) ** 2]
    assert whitening.deviations(np.array([[1 << 40, 0], [1, 0]]), 2, ((1 << 40) + 1, 0)) == [None, None]


def test_ends_early_only_where_no_direction_can_be_missing(spark, monkeypatch):
    """40 dimensions of which few have energy: far fewer passes than dimensions, and the same result."""
    random = np.random.default_rng(5)
    vectors = random.normal(size=(300, 40)) * (4.0 ** -np.arange(40)) * 100
    passes = []
    total = whitening._Rows.total
    monkeypatch.setattr(whitening._Rows, "total", lambda self, f, w: passes.append(w) or total(self, f, w))
    fit = whitening.fitted(table(spark, vectors.tolist()), components=3)
    x, values, _, trace = dense(vectors, 3)
    assert len(passes) < 30
    assert np.allclose(fit.values, values, rtol=1e-9)


@pytest.mark.parametrize("size", ["32m", "1m", "300000"])
def test_any_setting_of_arrow_batches(spark, size):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, size)
        assert whitening.whitened(table(spark, [[1.0, 0.0], [0.0, 2.0], [1.0, 1.0]])).count() == 6
    finally:
        spark.conf.set(name, before)
