"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers, and every distinct integer vector is fitted on once, so that copies don't weigh. With X the centred rows of that list,
each step needs Xv, made orthogonal to all earlier left vectors u, and X'u, made orthogonal to all earlier right vectors v. A left vector has an
entry a row, so none is stored: u is X p for a short p, and a task makes its rows' part of it, multiplies that back with the same rows and adds up.
One pass over the rows gives a step both products; the products with earlier left vectors follow from p and X'u, which the driver has. Singular values
of the small bidiagonal matrix are the deviations along the components (times the root of n), its right vectors turn the v into components.

All steps that the dimensions allow are made, so that repeated eigenvalues are found whole; an invariant subspace is left by a fresh vector.
The rows are kept as blocks of the least integers that hold them, written once to the shared folder; the driver holds a few matrices of dimensions by steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import Rounds, fresh, map_rows

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
SEED = 17
#: Scaled entries beyond it count as it; doubles hold all integers up to here.
LIMIT = 2**52
#: Bytes of one block of rows, about.
BLOCK_BYTES = 1 << 20
#: Share of the largest eigenvalue under which one is zero.
RANK = 1e-12
HIGH = 1 << 26


def quantised(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry c; null for a null vector and for one with null, infinite or NaN entries."""
    sound = vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    scaled = lambda c: F.least(F.greatest(c.cast("double") * F.lit(float(SCALE)), F.lit(-float(LIMIT))), F.lit(float(LIMIT)))
    return F.when(sound, F.transform(vector, lambda c: F.floor(scaled(c)) + F.lit(OFFSET)))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Entries less the offset, a row a vector; vectors that are shorter have zeros at their end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) - OFFSET
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


@dataclass(frozen=True)
class Centre:
    """The mean of the rows as n, the integer part and what is left of the sums, all exact."""

    n: int
    whole: np.ndarray
    left: np.ndarray

    def of(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.whole) - self.left / self.n

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)²; None above the largest long."""
        apart = rows - self.whole
        most = (float(np.abs(apart).max(initial=0)) + 1) * self.n
        if most * most * rows.shape[1] < 2**63:
            d = apart * self.n - self.left
            return (d * d).sum(axis=1).tolist()
        sums = [sum((int(y) * self.n - int(s)) ** 2 for y, s in zip(row, self.left, strict=True)) for row in apart]
        return [s if s < 2**63 else None for s in sums]


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` found: components as columns, eigenvalues in falling order, the covariance's trace, and by how much whitened rows miss the identity."""

    width: int
    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    def apply(self, df: DataFrame, *, vector_col: str = "embedding") -> DataFrame:
        """``df`` with deviation (long) and whitened (one double a component), both null where the vector is null or has null or non-finite entries.

        Other columns pass through, but for those named like the new ones, which are replaced; each row is treated by itself, so repeated rows and ties
        get equal results, and an empty table gives an empty table. A deviation above the largest long is null. Vectors of more entries than the fit's are cut to them.
        """
        x = fresh(df.withColumn("deviation", F.lit(0)).withColumn("whitened", F.lit(0)), "_x")
        scale = self.components / np.sqrt(self.eigenvalues)
        width, centre = self.width, self.centre

        def project(batch: pa.RecordBatch) -> dict[str, list]:
            column = batch.column(x)
            some = np.flatnonzero(np.asarray(column.is_valid()))
            deviation: list = [None] * len(column)
            whitened: list = [None] * len(column)
            if centre.n and len(some):
                rows = _rows(column.take(pa.array(some)), width)
                for k, d, w in zip(some.tolist(), centre.deviations(rows), (centre.of(rows) @ scale).tolist(), strict=True):
                    deviation[k], whitened[k] = d, w
            return {"deviation": deviation, "whitened": whitened}

        held = df.withColumn(x, F.slice(quantised(F.col(f"`{vector_col}`")), 1, max(width, 1)))
        add = T.StructType([T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
        return map_rows(held, project, add).drop(x)


_KINDS = {k: np.dtype(k) for k in ("<i1", "<i2", "<i4", "<i8")}


def _blocks(distinct: DataFrame, width: int) -> DataFrame:
    """(rows, kind, cells, low, high): rows in blocks of the least integers, with their sums by dimension in a low and a high part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(1, BLOCK_BYTES // (8 * width))
        for batch in batches:
            for begin in range(0, batch.num_rows, at_once):
                rows = _rows(batch.column("x").slice(begin, at_once), width)
                low, high = int(rows.min()), int(rows.max())
                kind = next(k for k, t in _KINDS.items() if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
                sums = [(rows % HIGH).sum(axis=0).tolist(), (rows // HIGH).sum(axis=0).tolist()]
                columns = [pa.array([len(rows)], pa.int64()), pa.array([kind]), pa.array([rows.astype(kind).tobytes()], pa.binary()), *[pa.array([s], pa.list_(pa.int64())) for s in sums]]
                yield pa.RecordBatch.from_arrays(columns, names=["rows", "kind", "cells", "low", "high"])

    return distinct.mapInArrow(pack, "rows long, kind string, cells binary, low array<long>, high array<long>")


def _summed(blocks: DataFrame, centre: Centre, width: int, fn: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """The sum over all blocks of ``fn`` (a vector of this length) of their centred rows: one row a task, then one global sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            for kind, cells in zip(batch.column("kind").to_pylist(), batch.column("cells"), strict=True):
                rows = np.frombuffer(cells.as_buffer(), _KINDS[kind]).reshape(-1, width)
                total += fn(centre.of(rows.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

    parts = blocks.select("kind", "cells").mapInArrow(run, "part array<double>")
    return np.array(parts.agg(F.array(*[F.sum(F.col("part")[k]) for k in range(length)]).alias("s")).first()["s"])


def bidiagonalised(product: Callable[[np.ndarray], tuple[np.ndarray, float]], width: int, steps: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): orthonormal right vectors as columns, and the upper bidiagonal B with X V = U B for orthonormal U.

    ``product`` of q is X'Xq and the square of Xq's length, ``scale`` the Frobenius norm of X.
    """
    rng, tiny = np.random.default_rng(SEED), 1e-14 * scale
    v_all, p_all, g_all = (np.zeros((width, 0)) for _ in range(3))
    b = np.zeros((steps, steps))

    def apart(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - v_all @ (v_all.T @ w)
        return w

    def another() -> np.ndarray:
        w = apart(rng.standard_normal(width))
        return w / np.linalg.norm(w)

    v, beta, p = another(), 0.0, np.zeros(width)
    for k in range(steps):
        q = v - beta * p
        g, square = product(q)
        along = p_all.T @ g  # products of Xq with all earlier left vectors
        p, g, square = q - p_all @ along, g - g_all @ along, square - along @ along
        alpha = np.sqrt(max(square, 0.0))
        if alpha <= tiny:
            alpha, p, g = 0.0, np.zeros(width), np.zeros(width)
        else:
            p, g = p / alpha, g / alpha
        b[k, k] = alpha
        v_all, p_all, g_all = np.column_stack([v_all, v]), np.column_stack([p_all, p]), np.column_stack([g_all, g])
        if k + 1 == steps:
            break
        w = apart(g - alpha * v)
        beta = np.linalg.norm(w)
        if alpha == 0.0 or beta <= tiny:
            v, beta = another(), 0.0
        else:
            v = w / beta
        b[k, k + 1] = beta
    return v_all, b


def fit(df: DataFrame, *, vector_col: str = "embedding", components: int = COMPONENTS, steps: int | None = None) -> Whitening:
    """The whitening of the distinct integer vectors of ``df``.

    Null vectors and those with null or non-finite entries are left out, repeated ones count once. Vectors that are shorter than the longest count as
    ending in zeros; scaled entries beyond ``LIMIT`` count as it. Components with an eigenvalue of zero are left out, so there may be none (an empty table, a single
    distinct vector, vectors without entries). ``steps`` (all dimensions by default) may be fewer where eigenvalues are known to fall fast; repeated ones may then be missed.
    """
    spark = df.sparkSession
    xs = df.select(quantised(F.col(f"`{vector_col}`")).alias("x")).where("x is not null")
    least, width = xs.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if not width:
        none = np.zeros(0, np.int64)
        return Whitening(0, Centre(0, none, none), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    if least < width:
        xs = xs.select(F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), width - F.size("x"))).alias("x"))
    blocks = Rounds(spark).written(_blocks(xs.distinct(), width), "blocks")
    sums = blocks.agg(F.sum("rows").alias("n"), *[F.sum(F.col(part)[k]).alias(f"{part}{k}") for part in ("low", "high") for k in range(width)]).first()
    n = sums["n"]
    exact = [sums[f"low{k}"] + sums[f"high{k}"] * HIGH for k in range(width)]
    centre = Centre(n, np.array([s // n for s in exact], np.int64), np.array([s % n for s in exact], np.int64))
    total = float(_summed(blocks, centre, width, lambda rows: np.array([np.einsum("ij,ij->", rows, rows)]), 1)[0])
    if total == 0.0:
        return Whitening(width, centre, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0)

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        def part(rows: np.ndarray) -> np.ndarray:
            u = rows @ q
            return np.append(rows.T @ u, u @ u)

        both = _summed(blocks, centre, width, part, width + 1)
        return both[:-1], float(both[-1])

    v, b = bidiagonalised(product, width, min(steps or width, width), np.sqrt(total))
    _, singular, right = np.linalg.svd(b)
    eigenvalues = singular**2 / n
    taken = np.flatnonzero(eigenvalues > RANK * eigenvalues[0])[:components]
    own = v @ right[taken].T
    own = own / np.linalg.norm(own, axis=0)
    own = own * np.where(own[np.abs(own).argmax(axis=0), np.arange(len(taken))] < 0, -1.0, 1.0)
    eigenvalues = eigenvalues[taken]
    scale, c = own / np.sqrt(eigenvalues), len(taken)

    def moments(rows: np.ndarray) -> np.ndarray:
        z = rows @ scale
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    found = _summed(blocks, centre, width, moments, c + c * c) / n
    error = np.abs(found[c:].reshape(c, c) - np.outer(found[:c], found[:c]) - np.eye(c)).max()
    return Whitening(width, centre, own, eigenvalues, total / n, float(error))


def whitening_digest(embeddings: DataFrame) -> DataFrame:
    """One row a vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    w = fit(embeddings)
    rows = w.apply(embeddings.select("vec_id", "embedding")).where("whitened is not null").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(e / w.trace)) for e in w.eigenvalues]) if len(w.eigenvalues) else F.array(F.lit(None).cast("double"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.centre.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(w.identity_error).alias("identity_error"))
