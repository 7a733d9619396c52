"""Whitening of vectors by matrix-free block subspace iteration.

The covariance is never formed. A pass multiplies it with a thin block Q: Spark tasks compute X'(XQ) on their centred
rows and only the sums of dims x width numbers reach the driver, whatever the rows. The driver orthonormalises the
block by QR against those of earlier passes, solves the small projected problem (Rayleigh-Ritz) and takes the residuals
of its vectors: they are both the certificate, met once all k of them are below ``tolerance``, and the next block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .topk import scaled

#: The largest whole number that a long holds.
LONG = 2**63 - 1


@dataclass
class Whitening:
    """n fitted vectors with exact sums and squares by dimension; ``components`` in columns with their ``eigenvalues`` by fall, the covariance's ``trace``, the ``residuals`` that certify them, and how far the whitened fit list's covariance is from the identity."""

    n: int
    sums: list[int]
    trace: float
    components: np.ndarray
    eigenvalues: np.ndarray
    residuals: np.ndarray
    passes: int
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scales(self) -> np.ndarray:
        """One over the root of each eigenvalue, NaN where there is no variance to scale."""
        known = self.eigenvalues > 1e-12 * max(self.trace, 1e-300)
        return np.where(known, 1 / np.sqrt(np.where(known, self.eigenvalues, 1)), np.nan)


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def summed(cells: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Rows (i, of array<double>) added up to one matrix: each task's part is a row a line, so no more than that meets in one sum."""
    added = cells.select("i", F.posexplode("of").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros(shape)
    for r in added.collect():  # dims x width numbers
        out[r.i, r.j] = r.v
    return out


def moments(fit: DataFrame, dims: int) -> tuple[int, list[int], list[int]]:
    """Rows, and exact sums and sums of squares by dimension."""

    def parts(batches):
        n, s, q = 0, np.zeros(dims, object), np.zeros(dims, object)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            n += len(x)
            if len(x) and int(np.abs(x).max()) ** 2 * len(x) < 2**62:
                s, q = s + x.sum(axis=0), q + (x * x).sum(axis=0)
            else:
                x = x.astype(object)
                s, q = s + x.sum(axis=0), q + (x * x).sum(axis=0)
        yield pa.record_batch({"i": pa.array(range(dims), pa.int32()), "n": pa.array([n] * dims, pa.int64()), "s": pa.array(map(str, s), pa.string()), "q": pa.array(map(str, q), pa.string())})

    rows = fit.mapInArrow(parts, "i int, n long, s string, q string").groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "sq"]).orderBy("i").collect()
    return rows[0].n, [int(r.s) for r in rows], [int(r.q) for r in rows]


def product(fit: DataFrame, mean: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """The covariance times ``block``: one pass over the fitted rows."""
    dims, width = block.shape

    def parts(batches):
        out = np.zeros((dims, width))
        for batch in batches:
            x = matrix(batch.column(0), dims) - mean
            out += x.T @ (x @ block)
        yield pa.record_batch({"i": pa.array(range(dims), pa.int32()), "of": pa.array(list(out), pa.list_(pa.float64()))})

    return summed(fit.mapInArrow(parts, "i int, of array<double>"), (dims, width)) / n


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """As many unit columns as fit beside ``basis``, spanning ``block`` less what the basis has; random ones replace those that vanish."""
    room = min(block.shape[1], len(block) - basis.shape[1])
    block = block[:, :room]
    for _ in range(3):
        block = block - basis @ (basis.T @ block)
        norms = np.linalg.norm(block, axis=0)
        weak = norms < 1e-10 * max(norms.max(initial=0), 1e-300)
        block = np.where(weak, rng.standard_normal(block.shape), block / np.where(weak, 1, norms))
        block = block - basis @ (basis.T @ block)
        block = np.linalg.qr(block)[0]
    return block


def fit(vectors: DataFrame, dims: int, k: int = 4, vector: str = "x", width: int = 16, held: int = 6, tolerance: float = 1e-12, most: int = 300) -> Whitening | None:
    """The k components of greatest variance of rows ``vector`` (ARRAY<BIGINT>, all of ``dims`` entries, no nulls), each row counted once.

    ``width``: columns of a block, at least 2k are used; ``held``: blocks of earlier passes that the projected problem
    spans before it restarts from the best vectors. Iterates until ||Vu - eu|| <= tolerance x greatest eigenvalue for
    all k in a pass of its own, and fails after ``most`` passes. With fewer than k dimensions there are as many
    components as dimensions; None if there are no rows. All rows equal: eigenvalues of zero.
    """
    rows = vectors.select(vector)
    if not dims or rows.isEmpty():
        return None
    n, sums, squares = moments(rows, dims)
    k, width = min(k, dims), min(dims, max(width, 2 * k))
    out = Whitening(n, sums, sum(n * q - s * s for s, q in zip(sums, squares, strict=True)) / n**2, np.zeros((dims, 0)), np.zeros(0), np.zeros(0), 0)
    mean, rng = out.mean, np.random.default_rng(13)
    basis = image = np.zeros((dims, 0))
    block = orthonormal(rng.standard_normal((dims, width)), basis, rng)
    while out.passes < most:
        out.passes += 1
        basis, image = np.hstack([basis, block]), np.hstack([image, product(rows, mean, block, n)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image_of = basis @ turn, image @ turn
        residual = image_of - ritz * values
        norms = np.linalg.norm(residual[:, :k], axis=0)
        bound = tolerance * max(values[0], 0)
        if block.shape[1] == k and basis.shape[1] == k and (norms <= bound).all():  # a pass over these vectors alone
            out.components, out.eigenvalues, out.residuals = ritz, np.maximum(values, 0), norms
            return out
        if (norms <= bound).all() or basis.shape[1] == dims:
            basis = image = np.zeros((dims, 0))
            block = np.linalg.qr(ritz[:, :k])[0]
            continue
        if basis.shape[1] + width > held * width:
            basis, image = ritz[:, : 2 * width], image_of[:, : 2 * width]
        block = orthonormal(residual[:, :width], basis, rng)
    raise RuntimeError(f"{k} components aren't certified after {most} passes: residuals {norms.tolist()}")


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance less the identity; components without variance are left out."""
    dims, k = model.components.shape
    mean, turn = model.mean, model.components * model.scales

    def parts(batches):
        out = np.zeros((k, k + 1))
        for batch in batches:
            w = (matrix(batch.column(0), dims) - mean) @ turn
            out += np.column_stack([w.sum(axis=0), w.T @ w])
        yield pa.record_batch({"i": pa.array(range(k), pa.int32()), "of": pa.array(list(out), pa.list_(pa.float64()))})

    sums = summed(fit.mapInArrow(parts, "i int, of array<double>"), (k, k + 1)) / model.n
    known = np.isfinite(model.scales)
    off = (sums[:, 1:] - np.outer(sums[:, 0], sums[:, 0]) - np.eye(k))[known][:, known]
    return float(np.abs(off).max(initial=0))


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """The exact sum over dimensions of (n x - S) squared; None beyond a long."""
    sums = np.array(model.sums, object)
    reach = model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums), default=0)
    if reach * reach * x.shape[1] <= LONG:
        return ((model.n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((model.n * x.astype(object) - sums) ** 2).sum(axis=1)
    return [int(v) if v <= LONG else None for v in exact]


def transform(rows: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "x") -> DataFrame:
    """(``key``, component, n, deviation, whitened, explained, identity_error): a row for each input row and component.

    ``deviation`` is null beyond a long; ``whitened`` where a component has no variance, ``explained`` where none has.
    Repeated rows and null keys are kept.
    """
    dims, k = model.components.shape
    mean, turn = model.mean, model.components * model.scales
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.eigenvalues]

    def parts(batches):
        for batch in batches:
            x = matrix(batch.column(1), dims)
            w = ((x - mean) @ turn).ravel()
            place = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.record_batch(
                {
                    "key": batch.column(0).take(place),
                    "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    "n": pa.array([model.n] * (len(x) * k), pa.int64()),
                    "deviation": pa.array(deviations(x, model), pa.int64()).take(place),
                    "whitened": pa.array(w, mask=np.isnan(w)),
                    "explained": pa.array(explained * len(x), pa.float64()),
                    "identity_error": pa.array([model.identity_error] * (len(x) * k), pa.float64()),
                }
            )

    key_type = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.select(key, vector).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays(b.columns, [key, *b.schema.names[1:]]) for b in parts(batches)), schema)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 4) -> DataFrame:
    """``transform`` of all rows by a whitening fitted on each distinct vector once, entries as floor(256 x).

    Rows whose vector is null or holds null or non-finite entries go. Vectors are of one length; if not, those of the
    most frequent length are taken (the greater of equally frequent ones), as vectors lacking entries can't be compared
    with whole ones. Repeated rows and null keys are kept, further columns ignored; an empty table gives an empty one.
    """
    rows = vectors.select(key, scaled(F.col(vector)).alias("x")).where("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = lengths.dims if lengths else 0
    whole = rows.where(F.size("x") == dims)
    fitted = written(whole.select("x").distinct(), "fit-list") if dims else None
    model = fit(fitted, dims, k) if dims else None
    if model is None:
        key_type = rows.schema[key].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"`{key}` {key_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    model.identity_error = identity_error(fitted, model)
    return transform(whole, model, key)
