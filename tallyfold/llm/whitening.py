"""Whitening of vectors from exact variances alone: the covariance by polarisation.

Entries become integers x. A first pass sums them (n, S). A second pass centres them as c = n*x - S, in integers, and
sums the squares of every c_i and of every c_i + c_j. Since Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b), half of what
the variance of a pair's sum has beyond those of its two dimensions is their covariance; no product of two different
dimensions is formed. The matrix is assembled exactly and only then rounded, once an entry, for `eigh`.
"""

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Squares are summed in three parts of so many bits, so that 2^20 of them fit 64 bits.
_LIMB = 21
#: Entries beyond this have no exact place in the arithmetic and raise an error.
_LARGEST = 2.0**50


def integer_vectors(rows: DataFrame, scale: int = 64, offset: int = 1_000_000, vector: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) with x = floor(scale * c) + offset of rows whose vector is whole: not null or empty, entries
    neither null nor NaN nor infinite."""
    v = F.col(vector).cast("array<double>")
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(F.coalesce(whole, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(v, lambda c: F.when(F.abs(c) < F.lit(_LARGEST / scale), F.floor(c * scale) + offset).otherwise(
            F.raise_error(F.lit("an entry of a vector is too large for exact sums")).cast("long"))).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column whose rows all have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _square_sums(p: np.ndarray) -> list[int]:
    """Exact sum of the squares of every column of 64-bit integers below 2^62 in size."""
    limbs = [p & ((1 << _LIMB) - 1), p >> _LIMB & ((1 << _LIMB) - 1), p >> 2 * _LIMB]
    out = np.zeros(p.shape[1], object)
    for i in range(3):
        if not limbs[i].any():
            continue
        for j in range(i, 3):
            out += np.einsum("ij,ij->j", limbs[i], limbs[j]).astype(object) * ((1 if i == j else 2) << _LIMB * (i + j))
    return out.tolist()


def centred_square_sums(centred: np.ndarray, batch: int = 1 << 12) -> dict[tuple[int, int], int]:
    """Sums of the squares of every dimension (i, i) and of every sum of two dimensions (i, j), i < j."""
    d = centred.shape[1]
    out: dict = {}
    for low in range(0, len(centred), batch):
        c = centred[low:low + batch]
        for k, s in enumerate(_square_sums(c)):
            out[k, k] = out.get((k, k), 0) + s
        for i in range(d - 1):
            for j, s in enumerate(_square_sums(c[:, i:i + 1] + c[:, i + 1:]), i + 1):
                out[i, j] = out.get((i, j), 0) + s
    return out


def exact_sums(vectors: DataFrame) -> tuple[int, list[int], int]:
    """(n, sums by dimension, largest distance of an entry from its mean times n) over (vec_id, x).

    Vectors of another length than most (the smaller length, if two are as many) are left out; see `whiten`.
    """
    def run(batches):
        for batch in batches:
            column = batch.column(0)
            lengths = np.diff(np.asarray(column.offsets))
            for size in np.unique(lengths):
                x = _matrix(column.filter(pa.array(lengths == size)))
                n = len(x)
                yield pa.RecordBatch.from_pydict({
                    "size": pa.array([size] * size, pa.int32()), "dim": pa.array(np.arange(size), pa.int32()), "n": pa.array([n] * size, pa.int64()),
                    "s": pa.array([Decimal(v) for v in x.astype(object).sum(0)], pa.decimal128(38, 0)), "low": pa.array(x.min(0)), "high": pa.array(x.max(0))})

    parts = vectors.select("x").mapInArrow(run, "size int, dim int, n long, s decimal(38,0), low long, high long")
    sums = parts.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    most = sums.where("dim = 0").orderBy(F.desc("n"), "size").limit(1).select("size")
    found = sums.join(F.broadcast(most), "size").orderBy("dim").collect()  # one row a dimension
    if not found:
        return 0, [], 0
    n, s = int(found[0]["n"]), [int(r["s"]) for r in found]
    return n, s, max(max(abs(n * int(r["low"]) - t), abs(n * int(r["high"]) - t)) for r, t in zip(found, s))


def polarised_covariance(vectors: DataFrame, n: int, sums: list[int], largest: int) -> np.ndarray:
    """Covariance matrix (divisor n), every entry the exact quotient rounded once.

    Each task emits one row a dimension and pair, added up before the shuffle; D(D+1)/2 rows reach the driver.
    """
    if largest >= 1 << 61:
        raise ValueError("too many rows for their range: centred entries pass 61 bits")
    d, shift = len(sums), np.array(sums, np.int64) if max(map(abs, sums)) < 1 << 63 else None
    if shift is None:
        raise ValueError("sums of a dimension pass 64 bits")

    def run(batches):
        total: dict = {}
        for batch in batches:
            column = batch.column(0)
            x = _matrix(column.filter(pa.array(np.diff(np.asarray(column.offsets)) == d)))
            for key, s in centred_square_sums(_centred(x, n, shift)).items():
                total[key] = total.get(key, 0) + s
        if total:
            keys = sorted(total)
            yield pa.RecordBatch.from_pydict({
                "i": pa.array([k[0] for k in keys], pa.int32()), "j": pa.array([k[1] for k in keys], pa.int32()),
                "high": pa.array([Decimal(total[k] >> 62) for k in keys], pa.decimal128(38, 0)), "low": pa.array([total[k] & ((1 << 62) - 1) for k in keys], pa.int64())})

    parts = vectors.select("x").mapInArrow(run, "i int, j int, high decimal(38,0), low long").groupBy("i", "j").agg(
        F.sum("high").cast("decimal(38,0)").alias("high"), F.sum(F.col("low").cast("decimal(28,0)")).alias("low"))
    squares = {(r.i, r.j): (int(r.high) << 62) + int(r.low) for r in parts.collect()}
    out = np.zeros((d, d))
    for (i, j), q in squares.items():
        # squares are those of n * (x - mean), summed over n rows: n^3 takes them back to a variance
        out[i, j] = out[j, i] = q / n**3 if i == j else (q - squares[i, i] - squares[j, j]) / (2 * n**3)
    return out


def _centred(x: np.ndarray, n: int, shift: np.ndarray) -> np.ndarray:
    """n * x - S; products may pass 64 bits, what is left after the subtraction does not, so wrapping is harmless."""
    with np.errstate(over="ignore"):
        return x * np.int64(n) - shift


def whitening_axes(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(projection (D, k) already divided by the deviations, explained shares) of the leading axes.

    Axes whose variance is nil beside the largest (below 1e-12 of it) cannot be scaled to one and are left out. The sign of an
    axis is that which makes its largest entry positive.
    """
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    order = order[values[order] > 1e-12 * max(values.max(initial=0.0), 0.0)] if len(values) else order
    axes = axes[:, order]
    if axes.size:
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return axes / np.sqrt(values[order]), values[order] / np.trace(covariance)


def whiten(rows: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """One row a vector and leading component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped; so are vectors of another length
    than most, since they have no place in the covariance. Repeated rows count again, a null vec_id is kept, other columns are
    not looked at, and an empty table gives no rows. With all vectors equal, or for axes without variance, there is no component
    to give. `deviation` is decimal(38,0), exact for any n; `identity_error` is measured over all whitened rows. Three scans,
    no shuffle of vectors: what meets across tasks is one number a pair of dimensions.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, scale, offset)
    n, sums, largest = exact_sums(vectors)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if n == 0 or largest == 0:
        return spark.createDataFrame([], schema)
    axes, explained = whitening_axes(polarised_covariance(vectors, n, sums, largest), components)
    d, k, shift = len(sums), axes.shape[1], np.array(sums, np.int64)

    def projected(column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        keep = np.diff(np.asarray(column.offsets)) == d
        c = _centred(_matrix(column.filter(pa.array(keep))), n, shift)
        return keep, c, (c / n) @ axes

    def moments(batches):
        total, cross, count = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            _, _, w = projected(batch.column(0))
            total, cross, count = total + w.sum(0), cross + w.T @ w, count + len(w)
        if count:
            i, j = np.meshgrid(np.arange(-1, k), np.arange(k), indexing="ij")  # row -1 holds the sums
            yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "s": pa.array(np.vstack([total, cross]).ravel())})

    sums_of = {(r.i, r.j): r.s for r in vectors.select("x").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    mean = np.array([sums_of[-1, j] for j in range(k)]) / n
    spread = np.array([[sums_of[i, j] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
    error = float(np.abs(spread - np.eye(k)).max())

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                keep, c, w = projected(part.column(1))
                m = len(w)
                if d * largest**2 < 1 << 62:
                    deviation = np.einsum("ij,ij->i", c, c).tolist()
                else:
                    deviation = [sum(v * v for v in row) for row in c.tolist()]
                ids = part.column(0).filter(pa.array(keep)).take(pa.array(np.repeat(np.arange(m), k)))
                exact = pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), exact,
                    pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "x").mapInArrow(run, schema)
