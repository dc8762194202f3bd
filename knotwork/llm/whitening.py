"""Whitening of embeddings by a matrix-free block Lanczos iteration with full reorthogonalisation.

The covariance is never formed. A pass over the fit list (each different vector once) multiplies it into a block of directions: every task
adds up ``(x - mean)((x - mean)^T Q)`` for its vectors, centred before they are multiplied, and the tasks' sums meet cell by cell, so that ``dim * block`` numbers
reach the driver, however many vectors there are. The first such pass also gives the trace, from the squared deviations.

The product, orthogonalised (twice) against the whole basis so far, is the next block. Directions that vanish by that (breakdown: an
invariant subspace is exhausted) are replaced by fresh random ones, until the basis spans the space. The Ritz vectors
of the basis are accepted when their residuals fall below ``tolerance`` times the largest eigenvalue. A basis of ``most_basis`` directions is cut down to the best Ritz
vectors before it grows on (thick restart), so the driver holds no more than ``dim * most_basis`` numbers.

Whole numbers ``x = floor(scale * component) + shift`` and their sums are exact, and ``n * x - S`` is taken in integers: nothing
cancels in floating point. The last pass measures the covariance of what was whitened.

Defined results: vectors that are null or hold null or non-finite components take no part; null ids do; repeated vectors count once in the fit and each get
their rows; vectors of other lengths are fitted and whitened by themselves; components whose eigenvalue is not above 1e-12 of the largest have no
rows (one vector, or all alike: none at all); ``deviation`` beyond 64 bits is clipped; an empty table gives no rows; other input columns do not pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.whole_vectors import MOST, block_of, clipped, whole_vectors
from knotwork.plans.materialize import written

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
LEAST_SHARE = 1e-12


@dataclass(frozen=True)
class Spectrum:
    values: np.ndarray  # falling
    vectors: np.ndarray  # one a column
    passes: int
    residual: float  # the largest, over the largest eigenvalue


def _orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """As many orthonormal directions as ``block`` has, or as are left, orthogonal to ``basis``; those that vanish are drawn anew."""
    dim = len(block)
    out = np.zeros((dim, 0))
    for column in block.T[: dim - basis.shape[1]]:
        have = np.hstack([basis, out])
        for fresh in range(9):
            column = rng.normal(size=dim) if fresh else column
            before = np.linalg.norm(column)
            for _ in range(2):
                column = column - have @ (have.T @ column)
            left = np.linalg.norm(column)
            if left > 1e-10 * before:
                column = column / left
                out = np.column_stack([out, (column - have @ (have.T @ column))])
                out[:, -1] /= np.linalg.norm(out[:, -1])
                break
    return out


def block_lanczos(multiply: Callable[[np.ndarray], np.ndarray], dim: int, want: int, block: int = 16, most_basis: int = 256, tolerance: float = 1e-13, most_passes: int = 500, seed: int = 0) -> Spectrum:
    """The ``want`` largest eigenvalues of a symmetric operator that is known only by its products with blocks of directions."""
    rng, want = np.random.default_rng(seed), min(want, dim)
    most_basis = max(most_basis, want + 2 * block)
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    new, passes = _orthogonal(rng.normal(size=(dim, min(block, dim))), basis, rng), 0
    while True:
        product = multiply(new)
        passes += 1
        basis, image = np.hstack([basis, new]), np.hstack([image, product])
        projected = basis.T @ image
        values, turns = np.linalg.eigh((projected + projected.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        top = max(abs(values[0]), np.finfo(float).tiny)
        kept = min(want, len(values))
        residual = float(np.linalg.norm(image @ turns[:, :kept] - basis @ turns[:, :kept] * values[:kept], axis=0).max() / top)
        if basis.shape[1] == dim or (kept == want and residual <= tolerance):
            return Spectrum(values[:kept], basis @ turns[:, :kept], passes, residual)
        if passes >= most_passes:
            raise RuntimeError(f"no convergence in {passes} passes: residual {residual:.3g}")
        new = _orthogonal(product, basis, rng)
        if basis.shape[1] + new.shape[1] > most_basis:
            keep = want + block
            basis, image = basis @ turns[:, :keep], image @ turns[:, :keep]
            new = _orthogonal(new, basis, rng)


def _summed(cells: DataFrame) -> list:
    return [r["value"] for r in cells.groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").collect()]


def _cells(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(values.size, dtype=np.int32)), pa.array(values.ravel().astype(float))], ["cell", "value"])


def _centred(batch: pa.RecordBatch, dim: int, shift: int, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` of a batch, as whole numbers."""
    x = block_of(batch, dim, 4 * n) + shift
    exact = np.int64 if x.dtype == np.int64 and max(map(abs, sums), default=0) < MOST and n * (int(np.abs(x).max()) if x.size else 0) < MOST else object
    return x.astype(exact) * n - np.array(sums, dtype=exact)


@dataclass(frozen=True)
class Whitening:
    """The model of the vectors of one length, by which :meth:`apply` whitens any of them."""

    dim: int
    shift: int
    n: int
    sums: list[int]
    spectrum: Spectrum
    trace: float
    identity_error: float

    def directions(self) -> np.ndarray:
        return self.spectrum.vectors / np.sqrt(self.spectrum.values)

    def apply(self, kept: DataFrame) -> DataFrame:
        """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row for each vector and component."""
        dim, shift, n, sums, turn = self.dim, self.shift, self.n, self.sums, self.directions()
        parts = turn.shape[1]

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = _centred(batch, dim, shift, n, sums)
                wide = c.dtype != object and c.size and float(np.abs(c).max()) ** 2 * dim >= MOST
                deviation = clipped(((c.astype(object) if wide else c) ** 2).sum(axis=1))
                white = (c.astype(float) / n) @ turn
                at = np.repeat(np.arange(batch.num_rows), parts)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), batch.num_rows)), pa.array(deviation[at]), pa.array(white.ravel())], ["vec_id", "component", "deviation", "whitened"])

        shares = F.array(*(F.lit(float(v / self.trace)) for v in self.spectrum.values))
        rows = kept.where(F.size("v") == dim).mapInArrow(project, "vec_id long, component int, deviation long, whitened double")
        return rows.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("component")).alias("explained"), F.lit(self.identity_error).alias("identity_error"))


def fit_whitening(fit: DataFrame, dim: int, components: int = 16, shift: int = 0, **lanczos) -> Whitening | None:
    """The model of the different vectors ``fit(v)`` of ``dim`` components; None where they do not vary."""
    fit = fit.where(F.size("v") == dim)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(dim + 1, dtype=object)
        for batch in batches:
            x = block_of(batch, dim, batch.num_rows)
            sums += np.append(x.sum(axis=0).astype(object), len(x))
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))], ["cell", "value"])

    found = [int(v) for v in _summed(fit.mapInArrow(totals, "cell int, value decimal(38,0)"))]
    if not found or found[-1] < 2:
        return None
    n = found[-1]
    sums = [s + n * shift for s in found[:-1]]
    traces = []

    def multiply(block: np.ndarray) -> np.ndarray:
        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, squares = np.zeros(block.shape), 0.0
            for batch in batches:
                c = _centred(batch, dim, shift, n, sums).astype(float) / n
                out, squares = out + c.T @ (c @ block), squares + float((c**2).sum())
            yield _cells(np.append(out.ravel(), squares))

        values = np.array(_summed(fit.mapInArrow(products, "cell int, value double"))) / n
        traces.append(values[-1])
        return values[:-1].reshape(block.shape)

    spectrum = block_lanczos(multiply, dim, components, **lanczos)
    varying = spectrum.values > LEAST_SHARE * max(spectrum.values[0], 0.0)
    if not varying.any():
        return None
    spectrum = Spectrum(spectrum.values[varying], spectrum.vectors[:, varying], spectrum.passes, spectrum.residual)
    model = Whitening(dim, shift, n, sums, spectrum, traces[0], 0.0)
    turn = model.directions()

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, outer = np.zeros(turn.shape[1]), np.zeros((turn.shape[1],) * 2)
        for batch in batches:
            z = (_centred(batch, dim, shift, n, sums).astype(float) / n) @ turn
            mean, outer = mean + z.sum(axis=0), outer + z.T @ z
        yield _cells(np.append(mean, outer.ravel()))

    measured = np.array(_summed(fit.mapInArrow(moments, "cell int, value double"))) / n
    mean, outer = measured[: turn.shape[1]], measured[turn.shape[1] :].reshape((turn.shape[1],) * 2)
    error = float(np.abs(outer - np.outer(mean, mean) - np.eye(turn.shape[1])).max())
    return Whitening(dim, shift, n, sums, spectrum, traces[0], error)


def whiten(embeddings: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding", **lanczos) -> DataFrame:
    """Each vector's first ``components`` whitened components, by the model of all different vectors."""
    kept = whole_vectors(embeddings, id_col, vector_col, scale).where(F.size("v") > 0)
    fit = written(kept.select("v").distinct(), "fit-list")
    lengths = sorted(r["dim"] for r in fit.select(F.size("v").alias("dim")).distinct().collect())
    models = [fit_whitening(fit, dim, components, shift, **lanczos) for dim in lengths]
    tables = [model.apply(kept) for model in models if model is not None]
    return reduce(DataFrame.unionByName, tables) if tables else embeddings.sparkSession.createDataFrame([], SCHEMA)
