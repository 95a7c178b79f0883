"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The rows of a table are a tall matrix X, centred. From a first direction v the method
alternates two products that run as Spark jobs over all rows, Xv and then X'u, and makes
each new direction orthogonal to all before it. What comes of it is a small bidiagonal
matrix on the driver, whose singular values and right vectors are those of X.

A left vector has an entry for each row of the table, so none is ever kept: each is X w
for a short w, the rows know their entries from it, and inner products of left vectors are
sums over rows like the products themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, stored

#: An entry c counts as floor(SCALE c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Entries beyond this either way count as this.
MOST = 1 << 61
#: A direction shorter than this share of the largest singular value so far is rounding.
TINY = 1e-13

_RESULT = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType())]


@dataclass(frozen=True)
class Fit:
    """What the fit list determines: its size, exact sums, and components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  #: eigenvalues of the covariance
    components: np.ndarray  #: a unit eigenvector in each column
    trace: float
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def clean(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has only finite entries."""
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.filter(F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0))


def whole_entries(entries: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(entries.astype(np.float64) * SCALE) + OFFSET, -MOST, MOST).astype(np.int64)


def matrix_of(column: pa.ListArray, width: int) -> np.ndarray:
    """Whole entries of a batch of vectors of one length, a row for each."""
    return whole_entries(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)


def _length(vectors: DataFrame, vector: str) -> int:
    """The most frequent length of a vector, the longest of those; 0 for an empty table."""
    lengths = vectors.groupBy(F.size(vector).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.col("n").desc(), F.col("length").desc()).first()
    return most["length"] if most else 0


def _blocks(vectors: DataFrame, vector: str, width: int) -> DataFrame:
    """A stored table of row blocks, each as packed whole numbers: what all passes read."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column(0), width)
            kind = "<i4" if np.abs(x).max() < 1 << 30 else "<i8"
            yield pa.RecordBatch.from_pydict({"rows": pa.array([len(x)], pa.int64()), "kind": [kind], "block": pa.array([x.astype(kind).tobytes()], pa.binary())})

    return stored(arrow_map(vectors.select(vector), pack, "rows long, kind string, block binary"), "whitening-blocks")


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, block in zip(batch.column("kind").to_pylist(), batch.column("block"), strict=True):
            yield np.frombuffer(block.as_buffer(), dtype=kind).reshape(-1, width)


def _sums(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each dimension; one row a dimension comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (width + 1)
        for x in _unpacked(batches, width):
            own = x.sum(axis=0, dtype=np.int64 if x.dtype.itemsize == 4 else object)
            total = [a + int(b) for a, b in zip(total, [*own, len(x)], strict=True)]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(width + 1), pa.int32()), "part": pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))})

    found = arrow_map(blocks, add, "at int, part decimal(38,0)").groupBy("at").agg(F.sum("part").alias("part")).collect()
    total = {r["at"]: int(r["part"]) for r in found}
    return total.get(width, 0), [total.get(i, 0) for i in range(width)]


@dataclass(frozen=True)
class _Rows:
    """The centred rows: what a pass over all of them sums up."""

    blocks: DataFrame
    n: int
    sums: list[int]

    def total(self, function: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
        """The sum of ``function(centred block)`` over all rows, a vector of ``width`` numbers.

        A task adds up its own blocks, Spark adds up the tasks, and only the sum comes to
        the driver. Whole means are taken off in whole numbers, so nothing cancels.
        """
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = np.zeros(width)
            for x in _unpacked(batches, len(whole)):
                part += function((x - whole) - rest)
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(width), pa.int32()), "part": pa.array(part)})

        found = arrow_map(self.blocks, add, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()
        result = np.zeros(width)
        for r in found:
            result[r["at"]] = r["part"]
        return result


def bidiagonal(rows: _Rows, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """Singular values and right vectors of the centred rows, and the sum of squares of all entries.

    Step j makes u = Xv less beta times the left vector before it, then X'u less alpha v.
    A block of rows gives its part of both in one pass, with the inner products of u and
    all left vectors before it, by which what rounding left of them is taken off u and X'u;
    v is made orthogonal to all right ones on the driver. It
    ends after as many steps as there are dimensions, or earlier once the wanted vectors
    stand still and all energy not yet met is less than the last of them has, so that no
    direction can be missing, repeated eigenvalues included. Where a direction ends in
    rounding, the next starts afresh at right angles to all before.
    """
    width = len(rows.sums)
    random = np.random.default_rng(seed)
    energy = float(rows.total(lambda c: np.array([np.square(c).sum()]), 1)[0])
    right, left = np.zeros((width, 0)), np.zeros((width, 0))  # v in columns, and the w of each u = X w
    back = np.zeros((width, 0))  # X'u of each
    alphas: list[float] = []
    betas: list[float] = []

    def fresh() -> np.ndarray:
        v = random.standard_normal(width)
        for _ in range(3):
            v -= right @ (right.T @ v)
            v /= np.linalg.norm(v)
        return v

    v = fresh()
    while energy > 0 and len(alphas) < width:
        right = np.column_stack([right, v])
        before = left
        w = v - betas[-1] * before[:, -1] if betas else v

        def product(c: np.ndarray, w: np.ndarray = w, before: np.ndarray = before) -> np.ndarray:
            u = c @ w
            return np.concatenate([c.T @ u, (c @ before).T @ u, [u @ u]])

        found = rows.total(product, width + before.shape[1] + 1)
        over = found[width:-1]
        w, pulled = w - before @ over, found[:width] - back @ over
        alpha = float(np.sqrt(max(0.0, found[-1] - over @ over)))
        scale = max([alpha, *alphas, *betas])
        if alpha <= TINY * max(scale, np.sqrt(energy / width)):
            alpha, w, pulled = 0.0, np.zeros(width), np.zeros(width)
        else:
            w, pulled = w / alpha, pulled / alpha
        left, back = np.column_stack([left, w]), np.column_stack([back, pulled])
        alphas.append(alpha)
        v = pulled - alpha * v
        for _ in range(2):
            v = v - right @ (right.T @ v)
        beta = float(np.linalg.norm(v))
        if beta <= TINY * max(scale, np.sqrt(energy / width)):
            beta = 0.0
        small = np.diag(alphas) + np.diag(betas, 1)
        p, sigma, _ = np.linalg.svd(small)
        met = energy - float(np.square(small).sum())
        settled = len(sigma) >= wanted and np.all(beta * np.abs(p[-1, :wanted]) <= 1e-14 * sigma[0])
        if len(alphas) == width or (settled and met < 0.5 * sigma[wanted - 1] ** 2):
            break
        v = v / beta if beta else fresh()
        betas.append(beta)
    if not alphas:
        return np.zeros(0), np.zeros((width, 0)), energy
    _, sigma, turned = np.linalg.svd(np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1))
    return sigma, right @ turned.T, energy


def fitted(vectors: DataFrame, *, vector: str = "embedding", components: int = 8) -> Fit | None:
    """The fit over all clean rows of the most frequent length; None where there are none."""
    rows = clean(vectors, vector)
    width = _length(rows, vector)
    if not width:
        return None
    blocks = _blocks(rows.filter(F.size(vector) == width), vector, width)
    n, sums = _sums(blocks, width)
    centred = _Rows(blocks, n, sums)
    sigma, directions, energy = bidiagonal(centred, min(components, width))
    kept = [i for i in range(min(components, len(sigma))) if sigma[i] > 1e-7 * sigma[0]]
    values, q = np.square(sigma[kept]) / n, directions[:, kept]
    q = q * np.where(q[np.abs(q).argmax(axis=0), range(len(kept))] < 0, -1.0, 1.0)
    error = 0.0
    if kept:
        k, project = len(kept), q / np.sqrt(values)

        def moments(c: np.ndarray) -> np.ndarray:
            y = c @ project
            return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

        total = centred.total(moments, k * k + k) / n
        mean = total[k * k :]
        error = float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    return Fit(n, tuple(sums), values, q, energy / n, error)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The exact sum over dimensions of (n x - S)^2 for each row; None beyond a long."""
    low, high = x.min(axis=0), x.max(axis=0)
    reach = sum(max(abs(n * int(a) - s), abs(n * int(b) - s)) ** 2 for a, b, s in zip(low, high, sums, strict=True))
    if reach < 1 << 63 and max(map(abs, sums)) < 1 << 63 and n * int(max(np.abs(low).max(), np.abs(high).max())) < 1 << 63:
        return np.square(n * x - np.array(sums, dtype=np.int64)).sum(axis=1).tolist()
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whitened(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """A row for each clean vector and component: what the vector is along it, whitened.

    ``whitened`` is the centred row projected on a unit eigenvector of the covariance,
    over the root of its eigenvalue; ``explained`` the eigenvalue's share of the trace,
    ``deviation`` the exact sum of (n x - S)^2, null beyond a long, and ``identity_error``
    how far the covariance of ``whitened`` is from the identity, measured over all rows.
    Components are numbered by falling eigenvalue; the largest entry of each is positive.
    Those whose deviation is under 1e-7 of the first's are rounding and left out, so a
    table of equal vectors, or of one, gives no rows.

    Vectors that are null or empty, hold a null or a number that is not finite, or have
    another length than most, are left out of the fit and of the result. Ids may be null
    or repeat; each row counts. Columns other than the id are not read; an id that has the
    name of a result column is replaced by it. Tables may be empty.
    """
    identity = vectors.schema[id]
    schema = T.StructType([identity, *[T.StructField(n, t) for n, t in _RESULT]])
    fit = fitted(vectors.select(F.col(vector).alias(vector)), vector=vector, components=components)
    names = [id] * (id not in {n for n, _ in _RESULT}) + [n for n, _ in _RESULT]
    error = F.lit(fit.identity_error if fit else 0.0).alias("identity_error")
    rows = clean(vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector")), "vector")
    if fit is None or not len(fit.values):
        return vectors.sparkSession.createDataFrame([], schema).select(*names, error)
    n, sums, width, k = fit.n, fit.sums, len(fit.sums), len(fit.values)
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    project, explained = fit.components / np.sqrt(fit.values), fit.explained

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("vector"), width)
            times = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(times)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(times), n, dtype=np.int64)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(times)),
                    pa.array((((x - whole) - rest) @ project).ravel()),
                    pa.array(np.tile(explained, len(x))),
                ],
                names=["id", *[name for name, _ in _RESULT]],
            )

    found = arrow_map(rows.filter(F.size("vector") == width), along, T.StructType([T.StructField("id", identity.dataType), *schema.fields[1:]]))
    own: list[Column] = [F.col("id").alias(id)] if id in names[:1] else []
    return found.select(*own, *[n for n, _ in _RESULT], error)


def whitened_digest(vectors: DataFrame) -> DataFrame:
    """The contract's columns for the registered query."""
    return whitened(vectors.select("vec_id", "embedding"))
