"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are ordered so that similar ones lie in one range, and each range of that order is cut into chunks of blocks. A block
keeps the largest and smallest value of every component (term), hence the largest score it could make with a query. The
blocks of a chunk are visited from the greatest such bound on, each by the queries whose k-th score so far its bound reaches.
Pruning never changes a result: a block is left out only if its bound is below a score that k rows are known to have.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.tables import stored

BLOCK, CHUNK, QUERIES = 64, 4096, 2048
#: Rows found that a task holds before it keeps the best; pairs of a chunk and a block of queries in a task; most tasks.
HITS, PAIRS, TASKS = 1 << 18, 16, 4096
_EXACT = float(1 << 53)
_FAR = float(1 << 62)


def _floored(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x); values beyond 62 bits are held at that bound."""
    return np.clip(np.floor(values * scale), -_FAR, _FAR)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of a and b: in doubles while no sum can pass 2^53, else in Python integers held at 63 bits."""
    largest = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1]
    if largest < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _padded(column: pa.Array) -> np.ndarray:
    """Vectors of a list column as rows of doubles, filled up with zeros to the longest."""
    sizes = np.asarray(column.value_lengths(), np.int64)
    flat = np.asarray(column.flatten(), float)
    width = int(sizes.max(initial=0))
    if len(flat) == width * len(sizes):
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _narrow(rows: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the narrowest type that holds them, and its name."""
    most = np.abs(rows).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, rows.astype(kind).tobytes()


def _wide(kind: str, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, -1).astype(float)


def _sized(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] == width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def own_floors(data: np.ndarray, asks: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each of the rows `asks` among the others of its chunk; the least number where there are fewer."""
    floors = np.full(len(asks), -(1 << 63))
    if len(data) > k:
        for at in range(0, len(asks), BLOCK):
            some = asks[at:at + BLOCK]
            scores = inner(data[some], data)
            own = np.arange(len(data)) == some[:, None]
            floors[at:at + BLOCK] = np.partition(scores[~own].reshape(len(some), -1), -k, axis=1)[:, -k]
    return floors


def best_each(asks, ids, scores, floors, k: int):
    """The k best of each query, ties to the smaller id; the k-th score of a query raises its floor in place."""
    order = np.lexsort((ids, ~scores, asks))
    asks, ids, scores = asks[order], ids[order], scores[order]
    nth = np.arange(len(asks)) - np.searchsorted(asks, asks)
    full = nth == k - 1
    floors[asks[full]] = np.maximum(floors[asks[full]], scores[full])
    kept = nth < k
    return asks[kept], ids[kept], scores[kept]


def search_chunk(ids, rows, rownum, q_rows, q_rownum, floors, held, k: int):
    """Best k of `held` and of one chunk for each query that are no worse than its floor, as (queries, ids, scores).

    `floors` rise in place with what is found. All queries that a block may serve meet it at once.
    """
    at = np.arange(0, len(ids), BLOCK)
    bound_high, bound_low = np.maximum.reduceat(rows, at, axis=0), np.minimum.reduceat(rows, at, axis=0)
    up, down = np.maximum(q_rows, 0), np.minimum(q_rows, 0)
    reach = up @ bound_high.T + down @ bound_low.T
    slack = 1e-9 * (np.abs(up) @ np.abs(bound_high).T + np.abs(down) @ np.abs(bound_low).T)
    reach = np.maximum(reach + slack, -2 * _FAR)  # scores are held at 63 bits
    hits, size = [held], 0
    for b in np.argsort(-reach.max(axis=0, initial=-np.inf), kind="stable"):
        asks = np.flatnonzero(reach[:, b] >= floors)
        if not len(asks):
            continue
        a, z = b * BLOCK, min((b + 1) * BLOCK, len(ids))
        scores = inner(q_rows[asks], rows[a:z])
        i, j = np.nonzero((scores >= floors[asks, None]) & (rownum[a:z] != q_rownum[asks, None]))
        hits.append((asks[i], ids[a:z][j], scores[i, j]))
        size += len(i)
        if size > HITS:
            hits, size = [best_each(*map(np.concatenate, zip(*hits)), floors, k)], 0
    return best_each(*map(np.concatenate, zip(*hits)), floors, k)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, pivots: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of (vec_id, embedding) whose id is divisible by `every`, its k best others.

    Components become floor(scale * x). Rows whose vector or id is null, or that hold a null or non-finite component,
    take no part. A shorter vector counts as filled up with zeros; an empty one scores 0 with all. Repeated rows take
    part one by one, a query leaves out its own row only, and ties go to the smaller vec_id. Fewer than k candidates give
    fewer ranks. Other columns are not looked at. The order of rows is fitted on `pivots` rows of lowest id hash, which
    decides only how much is pruned. Queries meet all chunks in blocks; what a task returns are the k best of its chunks at most.
    """
    spark = vectors.sparkSession
    value = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & value.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("embedding")).where(sound)
    sample = [r.embedding for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]
    width = max(map(len, sample), default=0)
    middle = np.array([x + [0.0] * (width - len(x)) for x in sample]).reshape(len(sample), width)

    def place(batches):
        for batch in batches:
            nearest = np.zeros(batch.num_rows, np.int64)
            if len(middle) and width:
                x = _padded(batch.column(1))
                w = min(width, x.shape[1])
                nearest = np.argmax(x[:, :w] @ middle[:, :w].T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32())], ["vec_id", "embedding", "place"])

    placed = rows.mapInArrow(place, "vec_id long, embedding array<double>, place int")
    placed = placed.repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id")
    names = ["kind", "chunk", "n", "type", "ids", "rownum", "data", "floors"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.binary()] * 4]
    shape = "kind string, chunk long, n int, type string, ids binary, rownum binary, data binary, floors binary"

    def row(kind, chunk, ids, rownum, data, floors):
        name, packed = _narrow(data)
        return kind, chunk, len(ids), name, ids.tobytes(), rownum.tobytes(), packed, floors.tobytes()

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def chunks(batches):
        from pyspark import TaskContext

        base, number, seen = TaskContext.get().partitionId() << 20, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids, data = np.asarray(part.column(0), np.int64), _floored(_padded(part.column(1)), scale)
                rownum = (base << 20) + seen + np.arange(len(ids))
                made = [row("rows", base + number, ids, rownum, data, np.zeros(0, np.int64))]
                asks = np.flatnonzero(ids % every == 0)
                if len(asks):  # the queries of a chunk get their first floor from it
                    made.append(row("asks", base + number, ids[asks], rownum[asks], data[asks], own_floors(data, asks, k)))
                yield out(made)
                number, seen = number + 1, seen + len(ids)

    store = stored(placed.mapInArrow(chunks, shape), "topk-chunks")
    sizes = {r.kind: (r.rows, r.whole) for r in store.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("n").alias("whole")).collect()}
    slots, blocks = max(1, sizes.get("rows", (0, 0))[0]), max(1, (sizes.get("asks", (0, 0))[1] or 0) // QUERIES)

    def merged(batches):
        from pyspark import TaskContext

        held, size, number = [], 0, TaskContext.get().partitionId() << 20

        def block():
            width = max(len(x["data"][0]) for x in held)
            return out([row("asks", number, *(np.concatenate([x[c] for x in held]) for c in ("ids", "rownum")),
                            np.concatenate([_sized(x["data"], width) for x in held]), np.concatenate([x["floors"] for x in held]))])

        for batch in batches:
            for x in batch.to_pylist():
                held.append({c: np.frombuffer(x[c], np.int64) for c in ("ids", "rownum", "floors")} | {"data": _wide(x["type"], x["data"], x["n"])})
                size += x["n"]
                if size >= QUERIES:
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()

    asked = stored(store.where("kind = 'asks'").repartition(blocks).mapInArrow(merged, shape), "topk-asks")
    packed = lambda part, tag: part.select(*[F.col(c).alias(f"{tag}_{c}") for c in ("chunk", "n", "type", "ids", "rownum", "data", "floors")])
    tasks = min(slots, TASKS, max(slots * blocks // PAIRS, spark.sparkContext.defaultParallelism))
    base = packed(store.where("kind = 'rows'").repartition(tasks, "chunk"), "r")
    # Every block of queries meets every chunk of rows: a stated query set against all rows, in blocks. Each task has some chunks
    # and reads all blocks of queries: nothing is copied to disk for the pairs, and neither side passes the driver.
    pairs = packed(asked.coalesce(1), "q").hint("shuffle_replicate_nl").crossJoin(base)

    def search(batches):
        number, ids, rownums, best = None, None, None, None

        def result():
            asks, found, scores = best
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[asks], rownums[asks], found, scores)], ["query_id", "query_row", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                if r["q_chunk"] != number:  # all chunks of the task meet a block of queries before the next does
                    if best is not None:
                        yield result()
                    ids, rownums, floors = (np.frombuffer(r[c], np.int64) for c in ("q_ids", "q_rownum", "q_floors"))
                    number, floors, best, asked = r["q_chunk"], floors.copy(), (np.zeros(0, np.int64),) * 3, _wide(r["q_type"], r["q_data"], r["q_n"])
                data = _wide(r["r_type"], r["r_data"], r["r_n"])
                wide = max(data.shape[1], asked.shape[1])
                best = search_chunk(np.frombuffer(r["r_ids"], np.int64), _sized(data, wide), np.frombuffer(r["r_rownum"], np.int64), _sized(asked, wide), rownums, floors, best, k)
        if best is not None:
            yield result()

    found = pairs.mapInArrow(search, "query_id long, query_row long, vec_id long, score long")
    window = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
