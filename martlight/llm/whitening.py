"""Whitening of embeddings from a pivoted Cholesky factor that is rotated by one-sided Jacobi.

Entries become whole numbers, so sums and products over the distinct vectors are exact whatever the order of the tasks:
blocks of vectors, moved near the origin by a whole-numbered centre, are multiplied within 53 bits and added up as
decimals.  The centred scatter follows exactly on the driver, where it has one number per pair of dimensions.  Its
pivoted Cholesky factor B (B Bt = covariance) is rotated from the right until its columns are orthogonal; their squared
norms are the eigenvalues, and the columns over their norms the components.  The covariance is never diagonalised itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.llm.base import columns_of, table
from martlight.session import stable

SCALE = 256
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53
#: Vectors handled at once inside a task.
ROWS = 2048
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Partial sums; numbers of over 100 bits are sent in two parts, ``high`` counting in 2^60.
_INTS = "i long, high boolean, v array<decimal(38,0)>"
_LIMB = 60


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``B`` with ``B @ B.T == v``: the largest remaining diagonal entry is the next pivot.

    Rows keep their order, columns come in that of the pivots; as many as the rank that is left above rounding.
    """
    rest, size = v.astype(float).copy(), len(v)
    factor, left = np.zeros((size, size)), np.ones(size, dtype=bool)
    limit = max(float(np.diag(v).max(initial=0.0)), 0.0) * size * np.finfo(float).eps
    for k in range(size):
        diagonal = np.where(left, np.diag(rest), -np.inf)
        pivot = int(np.argmax(diagonal))
        if diagonal[pivot] <= limit:
            return factor[:, :k]
        column = np.where(left, rest[:, pivot], 0.0) / np.sqrt(diagonal[pivot])
        factor[:, k] = column
        rest -= np.outer(column, column)
        left[pivot] = False
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and components (as columns) of ``factor @ factor.T``.

    Columns are rotated in pairs until all are orthogonal; a round of a sweep rotates disjoint pairs at once.
    """
    b = factor.copy()
    count = b.shape[1]
    if not count:
        return np.zeros(0), b
    players = list(range(count + count % 2))
    tolerance = np.finfo(float).eps * np.sqrt(len(b))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(players) - 1):
            half = len(players) // 2
            pairs = [(p, q) for p, q in zip(players[:half], reversed(players[half:])) if max(p, q) < count]
            players = [players[0], players[-1], *players[1:-1]]
            if not pairs:
                continue
            left, right = (np.array(side) for side in zip(*pairs))
            x, y = b[:, left], b[:, right]
            a, c, d = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(a) * np.sqrt(c)
            angle = np.divide(np.abs(d), size, out=np.zeros_like(d), where=size > 0)
            worst = max(worst, float(angle.max()))
            turn = (angle > tolerance) & (d != 0)
            zeta = np.divide(c - a, 2 * d, out=np.zeros_like(d), where=turn)
            tangent = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cosine = 1 / np.hypot(1.0, tangent)
            b[:, left], b[:, right] = cosine * x - cosine * tangent * y, cosine * tangent * x + cosine * y
        if worst <= tolerance:
            break
    values = (b * b).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > 0]
    return values[order], b[:, order] / np.sqrt(values[order])


@dataclass(frozen=True)
class Whitening:
    """What a fit keeps; its size is set by the dimensions alone."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray  # eigenvalues, falling
    components: np.ndarray  # one per column
    identity_error: float

    @property
    def dims(self) -> int:
        return len(self.sums)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Ids, and whole numbers as a matrix, of the valid vectors (column 1) of each length in the batch."""
    vectors = batch.column(1)
    lengths = pc.fill_null(pc.list_value_length(vectors), 0)
    for length in pc.unique(lengths).to_pylist():
        if not length:
            continue
        same = pc.equal(lengths, length)
        ids, entries = batch.column(0).filter(same), vectors.filter(same).flatten().cast(pa.float64())
        matrix = entries.to_numpy(zero_copy_only=False).reshape(-1, length)
        whole = np.isfinite(matrix).all(axis=1)
        scaled = np.floor(matrix[whole] * SCALE)
        inside = np.abs(scaled) < float(1 << 63)
        codes = np.where(inside, scaled, 0).astype(np.int64)
        codes[~inside] = np.where(scaled[~inside] > 0, _MOST, _LEAST)
        yield ids.filter(pa.array(whole)), length, codes


def _packed(codes: np.ndarray) -> list[bytes]:
    """A row as bytes, four per entry where all of its entries fit; equal rows have equal bytes."""
    small = ((codes >= -(1 << 31)) & (codes < 1 << 31)).all(axis=1)
    return [(b"i" + row.astype("<i4").tobytes()) if s else (b"q" + row.astype("<i8").tobytes()) for row, s in zip(codes, small)]


def _unpacked(packed: list[bytes], dims: int) -> np.ndarray:
    rows = [np.frombuffer(p, dtype="<i4" if p[:1] == b"i" else "<i8", offset=1) for p in packed]
    return np.stack(rows).astype(np.int64) if rows else np.zeros((0, dims), dtype=np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def whole_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, dims, code`` of the rows whose vector is not empty and holds finite entries only.

    ``code`` packs floor(256 * entry); entries beyond a long become the nearest long.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            for ids, length, codes in _vectors(part):
                packed = pa.array(_packed(codes), pa.binary())
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([length] * len(ids), pa.int32()), packed], ["vec_id", "dims", "code"])

    return columns_of(df, {"vec_id": id_col, "embedding": vector_col}).mapInArrow(code, "vec_id long, dims int, code binary")


def _added_up(partials: DataFrame) -> dict[int, list[int]]:
    """Sums per ``i`` and place of partial rows; one ``i`` per dimension, so at most their square is collected."""
    each = partials.select("i", "high", F.posexplode("v").alias("j", "v")).groupBy("i", "high", "j").agg(F.sum("v").alias("v"))
    sums: dict[int, list[int]] = {}
    for r in each.orderBy("i", "j").collect():
        row = sums.setdefault(r["i"], [])
        row.extend([0] * (r["j"] + 1 - len(row)))
        row[r["j"]] += int(r["v"]) << (_LIMB if r["high"] else 0)
    return sums


def _row(i: int, values) -> pa.RecordBatch:
    whole = [int(v) for v in values]
    large = any(abs(v) >> 100 for v in whole)
    parts = [[v & (1 << _LIMB) - 1 for v in whole], [v >> _LIMB for v in whole]] if large else [whole]
    numbers = pa.array([[Decimal(v) for v in part] for part in parts], pa.list_(pa.decimal128(38, 0)))
    return pa.RecordBatch.from_arrays([pa.array([i] * len(parts), pa.int64()), pa.array([False, True][: len(parts)]), numbers], ["i", "high", "v"])


def _exact_product(y: np.ndarray, most: int) -> np.ndarray:
    """``y.T @ y`` as whole numbers: by doubles while they are exact, else by Python's."""
    if most * most * len(y) < EXACT:
        real = y.astype(float)
        return (real.T @ real).astype(np.int64)
    return y.astype(object).T @ y.astype(object)


def _centre(vectors: DataFrame, dims: int) -> list[int]:
    """A whole-numbered point near the middle of all rows; any would give the same scatter."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, dtype=object)
        for part in _slices(batches):
            codes = _unpacked(part.column(0).to_pylist(), dims)
            total[0] += len(codes)
            total[1:] += codes.astype(object).sum(axis=0) if np.abs(codes.astype(float)).max(initial=0) > 1 << 50 else codes.sum(axis=0)
        yield _row(0, total)

    count, *sums = _added_up(vectors.select("code").mapInArrow(add, _INTS))[0]
    return [s // count for s in sums]


def fit(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of the distinct codes among :func:`whole_vectors` rows of one length; None if there are none.

    ``identity_error`` is measured on the whitened vectors of all distinct codes, over the first ``components``.
    """
    first = vectors.select("dims").first()
    if first is None:
        return None
    dims = first["dims"]
    distinct = stable(vectors.select("code").distinct())
    centre = np.array(_centre(distinct, dims), dtype=object)
    middle = centre.astype(np.int64)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, count = np.zeros((dims, dims), dtype=object), np.zeros(dims, dtype=object), 0
        for part in _slices(batches):
            codes = _unpacked(part.column(0).to_pylist(), dims)
            if np.abs(codes.astype(float)).max(initial=0) < float(1 << 61):
                y = codes - middle
                total += _exact_product(y, int(np.abs(y).max(initial=0)))
            else:
                y = codes.astype(object) - centre
                total += y.T @ y
            sums += y.sum(axis=0)
            count += len(y)
        yield _row(-1, [count, *sums])
        for i, row in enumerate(total):
            yield _row(i, row)

    added = _added_up(distinct.mapInArrow(multiply, _INTS))
    n, *moved = added[-1]
    # n * n * covariance, exact; one division per entry rounds once.
    scatter = [[n * added[i][j] - moved[i] * moved[j] for j in range(dims)] for i in range(dims)]
    covariance = np.array([[x / (n * n) for x in row] for row in scatter])
    trace = sum(scatter[i][i] for i in range(dims)) / (n * n)
    values, directions = one_sided_jacobi(pivoted_cholesky(covariance))
    sums = tuple(m + n * int(c) for m, c in zip(moved, centre))
    model = Whitening(n, sums, trace, values, directions, 0.0)
    error = _identity_error(distinct, model, min(components, len(values)))
    return Whitening(n, sums, trace, values, directions, error)


def _whitened(codes: np.ndarray, model: Whitening, components: int) -> np.ndarray:
    # Whole and broken part of the mean apart, so that large entries lose nothing before the subtraction.
    whole = np.array([s // model.n for s in model.sums], dtype=np.int64)
    part = np.array([(s % model.n) / model.n for s in model.sums])
    near = np.abs(codes.astype(float)).max(initial=0) < float(1 << 61)
    centred = (codes - whole if near else codes.astype(float) - whole.astype(float)) - part
    return centred @ (model.components[:, :components] / np.sqrt(model.values[:components]))


def _identity_error(distinct: DataFrame, model: Whitening, components: int) -> float:
    """Largest difference between the covariance of the whitened distinct vectors and the identity."""
    if not components:
        return 0.0
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total, sums = np.zeros((components, components)), np.zeros(components)
        for part in _slices(batches):
            w = _whitened(_unpacked(part.column(0).to_pylist(), model.dims), model, components)
            total += w.T @ w
            sums += w.sum(axis=0)
        rows = [*total.tolist(), sums.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(components + 1), pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["i", "v"])

    partials = distinct.mapInArrow(multiply, "i long, v array<double>")
    each = partials.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    found = np.zeros((components + 1, components))
    for r in each:
        found[r["i"], r["j"]] = r["v"] / model.n
    means = found[components]
    return float(np.abs(found[:components] - np.outer(means, means) - np.eye(components)).max())


def whiten(vectors: DataFrame, model: Whitening, components: int) -> DataFrame:
    """``vec_id, deviation, whitened``: one row per row of ``vectors``, with as many whitened numbers as there are
    components up to ``components``; ``deviation`` is null where it does not fit a long."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    wanted = min(components, len(model.values))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sums = np.array(model.sums, dtype=object)
        widest = max(map(abs, model.sums))
        for part in _slices(batches):
            codes = _unpacked(part.column(1).to_pylist(), model.dims)
            most = model.n * int(np.abs(codes.astype(float)).max(initial=0)) + widest
            if most * most * model.dims < 1 << 62:
                gap = model.n * codes - sums.astype(np.int64)
                deviation = pa.array((gap * gap).sum(axis=1), pa.int64())
            else:
                gap = model.n * codes.astype(object) - sums
                exact = [int(x) for x in (gap * gap).sum(axis=1)]
                deviation = pa.array([x if x <= _MOST else None for x in exact], pa.int64())
            rows = pa.array(list(_whitened(codes, model, wanted)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), deviation, rows], ["vec_id", "deviation", "whitened"])

    return vectors.select("vec_id", "code").mapInArrow(project, "vec_id long, deviation long, whitened array<double>")


def whitened_components(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4
) -> DataFrame:
    """One row per valid vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null, empty or hold null or non-finite entries take no part; nor do those of another length than
    the commonest (of equally common ones the longest).  Repeated vectors count once in the fit and are all whitened; ids
    may be null or repeated.  Components of variance zero are left out, so fewer than ``components`` rows, or none, come
    out of vectors that span less.  Other columns are ignored.  Only sums per pair of dimensions reach the driver.
    """
    vectors = whole_vectors(df, id_col=id_col, vector_col=vector_col)
    lengths = vectors.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    model = fit(vectors.where(F.col("dims") == lengths["dims"]), components) if lengths else None
    if model is None:
        empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], empty)
    own = whiten(vectors.where(F.col("dims") == lengths["dims"]), model, components)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.values[:components]))
    each = own.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_jacobi_whitening": op11_jacobi_whitening}
#: An iterative decomposition has no statement; tests compare with a brute-force one.
SQL: dict[str, str] = {}
