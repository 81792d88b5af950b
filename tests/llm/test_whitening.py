"""Whitening against numpy and against integers of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import whitening
from tallyfold.llm.queries import LLM_QUERIES


def test_square_sums_are_exact():
    chance = np.random.default_rng(1)
    p = chance.integers(-(1 << 61), 1 << 61, (500, 7))
    assert whitening._square_sums(p) == [sum(int(v) ** 2 for v in column) for column in p.T]
    c = chance.integers(-(1 << 40), 1 << 40, (50, 4))
    got = whitening.centred_square_sums(c, batch=16)
    for i in range(4):
        assert got[i, i] == sum(int(v) ** 2 for v in c[:, i])
        for j in range(i + 1, 4):
            assert got[i, j] == sum(int(a + b) ** 2 for a, b in zip(c[:, i], c[:, j]))


def brute(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = n * x - s
    v = np.array([[sum(int(a) * int(b) for a, b in zip(c[:, i], c[:, j])) / n**3 for j in range(x.shape[1])] for i in range(x.shape[1])])
    e, axes = np.linalg.eigh(v)
    order = np.argsort(e)[::-1][:32]
    return x, c, v, e[order], axes[:, order]


def test_query_equals_numpy(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None and np.isfinite(np.array([np.nan if c is None else c for c in r.embedding], float)).all()]
    x, c, v, e, axes = brute([r.embedding for r in rows])
    got = LLM_QUERIES["op12_whitening"](spark, sf).toPandas()
    assert len(got) == 32 * len(rows) and (got.n == len(rows)).all() and got.identity_error.nunique() == 1 and 0 <= got.identity_error[0] < 1e-8
    deviation = {r.vec_id: int((row.astype(object) ** 2).sum()) for r, row in zip(rows, c)}
    assert all(deviation[i] == d for i, d in zip(got.vec_id, got.deviation))
    want = (c / len(rows)) @ axes / np.sqrt(e)
    place = {r.vec_id: k for k, r in enumerate(rows)}
    table = np.zeros((len(rows), 32))
    table[[place[i] for i in got.vec_id], got.component - 1] = got.whitened
    sign = np.sign((table * want).sum(0))
    assert np.abs(table * sign - want).max() < 1e-6
    shares = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.abs(shares / (e / np.trace(v)) - 1).max() < 1e-9
    w = table - table.mean(0)
    assert np.abs(w.T @ w / len(rows) - np.eye(32)).max() == pytest.approx(got.identity_error[0], abs=1e-9)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, 2.0]), (1, [0.5, 1.0, 2.0]), (2, None), (3, [None, 1.0, 1.0]), (4, [nan, 1.0, 1.0]), (5, []), (6, [inf, 1.0, 0.0]),
            (None, [0.0, -3.0, 1.0]), (7, [1.0, 0.25, 1.0]), (8, [1.0, 2.0]), (9, [-1e9, 1e9, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("own")).withColumn("n", F.lit("own"))
    got = whitening.whiten(frame).collect()
    assert sorted({(r.vec_id, r.n) for r in got}, key=repr) == sorted([(1, 5), (7, 5), (9, 5), (None, 5)], key=repr)
    assert len([r for r in got if r.vec_id == 1]) == 2 * len({r.component for r in got}) and len(got) <= 15
    assert max(int(r.deviation) for r in got) > 1 << 63  # beyond 64 bits, exact
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows if v and len(v) == 3 and all(c is not None and np.isfinite(c) for c in v)]
    sums = [sum(c) for c in zip(*x)]
    assert {int(r.deviation) for r in got} == {sum((5 * a - s) ** 2 for a, s in zip(v, sums)) for v in x}
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.where("vec_id = 1")).count() == 0  # no variance
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>")).count()


def test_axes_without_variance_are_left_out(spark):
    rows = spark.createDataFrame([(i, [float(i), float(2 * i), 0.0]) for i in range(20)], "vec_id long, embedding array<double>")
    got = whitening.whiten(rows).collect()
    assert {r.component for r in got} == {1} and len(got) == 20 and got[0].explained == pytest.approx(1.0)
