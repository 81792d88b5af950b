"""Packing along a space-filling curve: neighbouring documents share a training sequence.

Each document becomes token ids; its hashed counts are projected to a few dimensions, and the cell they fall
into gets its place on a Hilbert curve. Rows are sorted by that place (range partitions) and each partition cuts
its stream of ids into full sequences; what is left over at its end becomes sequences whose lengths are powers of two.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.kernels import lean
from tallyfold.llm.tables import small_batches, stored
from tallyfold.llm.wordids import word_ids

DIMENSIONS, BITS, BUCKETS = 4, 12, 512


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (n, d), each coordinate of `bits` bits (Skilling's transposition)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(5).normal(0, 1, (BUCKETS, DIMENSIONS))


def curve_places(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hilbert key of each of some id sequences (the k-th is ids[ends[k]:ends[k + 1]]): hashed counts, unit length,
    projected, cut into equal cells."""
    n = len(ends) - 1
    bucket = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(23)
    counts = np.bincount(np.repeat(np.arange(n), np.diff(ends)) * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    counts = np.sqrt(counts)
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)
    place = (np.tanh(counts @ _projection()) + 1) / 2
    return hilbert_keys(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, row_ids: int = 1024) -> DataFrame:
    """(doc_id, place, mark, start, whole, ids binary): ids (little-endian, unsigned 32 bit, the closing one included) in rows of at
    most `row_ids`, so that ranges with as many rows have about as many bytes wherever long texts lie.

    `start` is the place of the row's first id in its document of `whole` ids, `mark` a checksum of all its ids.
    """
    names = ["doc_id", "place", "mark", "start", "whole", "ids"]

    def run(batches):
        codec = word_ids(tokenizer)
        for batch in batches:
            ids, ends = codec.encode(batch.column(1))
            low, n = 0, len(ends) - 1
            while low < n:
                high = min(max(low + 1, int(np.searchsorted(ends, ends[low] + (1 << 18), "right")) - 1), low + 1024)
                part, cuts = ids[ends[low]:ends[high]], ends[low:high + 1] - ends[low]
                places = curve_places(part, cuts)
                part = np.insert(part, cuts[1:], end_id).astype("<u4")
                cuts = cuts + np.arange(len(cuts))
                data, whole = part.tobytes(), np.diff(cuts)
                marks = np.array([zlib.crc32(memoryview(data)[4 * a:4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], np.int64)
                rows = -(-whole // row_ids)
                doc = np.repeat(np.arange(len(whole)), rows)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)) * row_ids
                offsets = np.append(cuts[doc] + start, cuts[-1]) * 4
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low).take(pa.array(doc)), pa.array(places[doc]), pa.array(marks[doc]), pa.array(start), pa.array(whole[doc]),
                    pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])], names)
                low = high

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(lean(run), "doc_id long, place long, mark long, start long, whole long, ids binary")


def tail_lengths(left: int, size: int) -> list[int]:
    """Powers of two, largest first, that add up to what is left (below `size`); `size` itself need not be one."""
    return [1 << b for b in range(max(left, 1).bit_length() - 1, -1, -1) if left >> b & 1]


def pack_sequences(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, partition_bytes: int = 64 << 20) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves.

    Every row of documents is packed, repeated ones too; null or empty texts are just the closing id, and a null
    doc_id stays null. Documents are cut wherever a sequence is full, so none is too long. Order is by place on
    the curve, then doc_id and a checksum of the ids; equal texts lie side by side and may be spread over partitions. No sequence
    is padded: each has `size` ids or a power of two. Other columns of documents are not carried. An empty table
    gives no rows.
    """
    with small_batches(docs.sparkSession, "2m"):
        coded = stored(tokenised(docs, tokenizer, end_id), "packing-ids")
    total = coded.agg(F.sum(F.length("ids"))).first()[0] or 0
    parts = max(1, -(-total // partition_bytes), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total >> 22))
    order = ("place", "doc_id", "mark", "start")
    ordered = coded.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)

    def pack(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        held: list[list] = []  # pieces of the sequence that is being filled
        filled, number = 0, 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        types = [pa.int64()] * 7 + [pa.binary()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        def row(piece, sequence, offset):
            doc, start, ids, whole = piece
            return (doc, start, len(ids) // 4, zlib.crc32(ids), whole, base + sequence, offset, bytes(ids))

        def hold(doc, start, data, whole):
            if held and held[-1][0] == doc and held[-1][3] == whole and held[-1][1] + len(held[-1][2]) // 4 == start and start:
                held[-1][2] = b"".join((held[-1][2], data))  # the document goes on
            else:
                held.append([doc, start, data, whole])

        for part in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
            rows, carried = [], 0
            for doc, begin, whole, data in zip(*[part.column(c).to_pylist() for c in ("doc_id", "start", "whole", "ids")]):
                data, done = memoryview(data), 0
                while 4 * done < len(data):
                    take = min(size - filled, len(data) // 4 - done)
                    hold(doc, begin + done, data[4 * done:4 * (done + take)], whole)
                    done, filled = done + take, filled + take
                    if filled == size:
                        offset = 0
                        for piece in held:
                            rows.append(row(piece, number, offset))
                            offset += len(piece[2]) // 4
                        held, filled, number, carried = [], 0, number + 1, carried + 4 * size
                        if carried > 1 << 20:
                            yield out(rows)
                            rows, carried = [], 0
            if rows:
                yield out(rows)
        rows = []
        for length in tail_lengths(filled, size) if filled else []:
            offset = 0
            while offset < length:
                doc, start, data, whole = held[0]
                take = min(length - offset, len(data) // 4)
                rows.append(row([doc, start, data[:4 * take], whole], number, offset))
                offset += take
                held[0] = [doc, start + take, data[4 * take:], whole]
                if not len(held[0][2]):
                    held.pop(0)
            number += 1
        if rows:
            yield out(rows)

    return ordered.mapInArrow(lean(pack), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
