"""Sums of fixed size over all partitions, and calibration from counts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed_arrays(parts: DataFrame, dtype, ways: int = 8) -> dict[str, np.ndarray]:
    """Add up arrays by key: `parts` has (key string, data binary), a few rows a partition.

    Rows meet in `ways` tasks first, each of which holds one array a key, so the driver receives `ways`
    rows a key whatever the size of the input. The number of keys must not grow with the data.
    """
    def add(batches):
        total = {}
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                array = np.frombuffer(data, dtype)
                total[key] = total[key] + array if key in total else array
        yield pa.RecordBatch.from_pydict(
            {"key": pa.array(total.keys(), pa.string()), "data": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    out = {}
    for row in parts.repartition(ways).mapInArrow(add, "key string, data binary").collect():
        array = np.frombuffer(row.data, dtype)
        out[row.key] = out[row.key] + array if row.key in out else array
    return out


def isotonic(bins: np.ndarray, weight: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing share of positives by bin (pool adjacent violators), with half a count of each kind added."""
    order = np.argsort(bins)
    blocks: list[list[float]] = []
    for b, w, p in zip(bins[order].tolist(), weight[order].tolist(), positive[order].tolist()):
        blocks.append([p, w, b, b])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, w2, _, high = blocks.pop()
            blocks[-1][0] += p2
            blocks[-1][1] += w2
            blocks[-1][3] = high
    xs, ys = [], []
    for p, w, low, high in blocks:
        xs += [low, high] if high > low else [low]
        ys += [(p + 0.5) / (w + 1.0)] * (2 if high > low else 1)
    return np.array(xs, float), np.maximum.accumulate(np.array(ys, float)) if ys else np.array(ys, float)


def calibration(scored: DataFrame, bins: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Calibration curve from (raw double in 0..1, label int): counts by bin over all rows, then isotonic."""
    rows = scored.groupBy(F.floor(F.col("raw") * bins).cast("long").alias("b")).agg(
        F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("p")).collect()
    if not rows:
        return np.array([0.0]), np.array([0.5])
    b, n, p = (np.array([r[i] for r in rows], float) for i in range(3))
    return isotonic(b / bins, n, p)


def calibrated(raw: np.ndarray, curve) -> np.ndarray:
    return np.clip(np.interp(raw, *curve), 0.0, 1.0)


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo the number of folds; null without an id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
