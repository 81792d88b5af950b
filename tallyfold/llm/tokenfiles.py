"""Token ids in binary files: length-delimited records with masked checksums, and a separate offset index.

A record is its payload's length (unsigned 64 bit), the masked CRC-32C of those eight bytes, the payload, and the masked
CRC-32C of the payload, all little-endian, as in the public TFRecord format. A payload is one document's sequence:
version, bytes an id, whether there is a doc_id, five zero bytes, doc_id (64 bit), number of ids (64 bit), the ids. The
index of a file has one entry of 32 bytes a record (doc_id, byte offset of the record, bytes of the payload, ids of the file
before it), so that records can be read in any order.
"""

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.tables import stored
from tallyfold.llm.wordids import word_ids
from tallyfold.session import new_table_path

_HEADER = struct.Struct("<BBB5xqQ")
_ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("before", "<u8")])
_FRAME = 16  # bytes of a record besides its payload
#: Ids that are framed or checked at a time; one longer sequence is still taken whole.
_BATCH_BYTES = 1 << 20
#: A checksum of more bytes than this is put together from parts.
_PART_BYTES = 1 << 20


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0x82F63B78), np.uint32(0))
    return table


def _applied(shift: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return shift[0][crc & 255] ^ shift[1][crc >> 8 & 255] ^ shift[2][crc >> 16 & 255] ^ shift[3][crc >> 24]


def _zero_shifts(n: int = 48) -> list[np.ndarray]:
    """What 2^k zero bytes do to a checksum, by its bytes: four tables for each k."""
    values = np.arange(256, dtype=np.uint32)
    spread = np.stack([values << np.uint32(8 * i) for i in range(4)])
    out = [np.stack([_byte_table()[row & 255] ^ (row >> np.uint32(8)) for row in spread])]
    while len(out) < n:
        out.append(_applied(out[-1], out[-1]))
    return out


_SHIFTS = _zero_shifts()
_LEAF = [_applied(_SHIFTS[0], np.arange(256, dtype=np.uint32))]  # a byte and then 0, 1, 2, 3 zero bytes
for _ in range(3):
    _LEAF.append(_applied(_SHIFTS[0], _LEAF[-1]))


def _shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums after so many zero bytes."""
    crc = crc.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        some = (lengths >> k & 1) == 1
        crc[some] = _applied(_SHIFTS[k], crc[some])
    return crc


def _plain(rows: np.ndarray) -> np.ndarray:
    """Checksum that begins at 0 of every row of a byte matrix, whose width is four times a power of two."""
    quads = rows.reshape(len(rows), -1, 4)
    crc = _LEAF[3][quads[:, :, 0]] ^ _LEAF[2][quads[:, :, 1]] ^ _LEAF[1][quads[:, :, 2]] ^ _LEAF[0][quads[:, :, 3]]
    k = 2
    while crc.shape[1] > 1:
        crc = _applied(_SHIFTS[k], crc[:, 0::2]) ^ crc[:, 1::2]
        k += 1
    return crc[:, 0]


def crc32c(payloads: list) -> np.ndarray:
    """CRC-32C of each of some byte strings: halves are combined level by level, all strings of a size class at once."""
    lengths = np.array([len(p) for p in payloads], np.int64)
    out = np.zeros(len(payloads), np.uint32)
    short = lengths <= _PART_BYTES
    classes = np.maximum(np.ceil(np.log2(np.maximum(lengths, 4) / 4)), 0).astype(int)
    for c in np.unique(classes[short]):
        members = np.flatnonzero(short & (classes == c))
        rows = np.zeros((len(members), 4 << c), np.uint8)
        for row, i in zip(rows, members):
            if lengths[i]:
                row[-lengths[i]:] = np.frombuffer(payloads[i], np.uint8)  # zeros in front change nothing
        out[members] = _plain(rows)
    for i in np.flatnonzero(~short):
        whole = np.frombuffer(payloads[i], np.uint8)
        crc = np.zeros(1, np.uint32)
        for a in range(0, len(whole), _PART_BYTES):
            part = whole[a:a + _PART_BYTES]
            row = np.zeros((1, _PART_BYTES), np.uint8)
            row[0, -len(part):] = part
            crc = _shifted(crc, np.array([len(part)])) ^ _plain(row)
        out[i] = crc[0]
    return ~(out ^ _shifted(np.full(len(payloads), 0xFFFFFFFF, np.uint32), lengths))


def masked(crc: np.ndarray) -> np.ndarray:
    """The checksum turned and moved, so that a checksum of data that holds checksums is no special case."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def framed(payloads: list[bytes]) -> list[bytes]:
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    return [h + a.tobytes() + p + b.tobytes() for h, a, p, b in
            zip(heads, masked(crc32c(heads)).astype("<u4"), payloads, masked(crc32c(payloads)).astype("<u4"))]


def encoded(doc_id: int | None, ids: np.ndarray, end_id: int, kind: np.dtype) -> bytes:
    """Payload of a sequence with its closing id."""
    return _HEADER.pack(1, kind.itemsize, doc_id is not None, doc_id or 0, len(ids) + 1) + ids.astype(kind).tobytes() + end_id.to_bytes(kind.itemsize, "little")


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


MANIFEST = "part int, number int, path string, index_path string, records long, tokens long, bytes long"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, file_bytes: int = 128 << 20) -> DataFrame:
    """Write the ids of every text, ascending by doc_id; gives one row a file (the manifest, itself a stored table).

    Every row of documents is a record: null and empty texts are the closing id alone, rows without doc_id come first, rows
    that repeat a doc_id follow each other in the order of a hash of their text. Files hold whole records and end beyond
    `file_bytes`; their names are new in every attempt of a task, and only the manifest says which of them count, so what a
    lost or repeated task left behind is never read. Ids take two bytes if the vocabulary allows it, else four. An empty table
    gives no rows. Other columns are not written. The folder may be on any file system that pyarrow opens by its address.
    """
    folder = new_table_path(docs.sparkSession, "token-files")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    mark = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", mark).sortWithinPartitions("doc_id", mark)

    def run(batches):
        from pyspark import TaskContext

        codec = word_ids(tokenizer)
        kind = np.dtype("<u2") if max(codec.size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        store, base = _opened(folder)
        store.create_dir(base, recursive=True)
        part, number, out = TaskContext.get().partitionId(), 0, None

        def done():
            out["file"].close()
            with store.open_output_stream(f"{base}/{out['name']}.index") as f:
                for entries in out["entries"]:
                    f.write(entries.tobytes())
            one = {"part": part, "number": number, "path": f"{folder}/{out['name']}.records", "index_path": f"{folder}/{out['name']}.index",
                   "records": out["records"], "tokens": out["tokens"], "bytes": out["bytes"]}
            return pa.RecordBatch.from_pylist([one], pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("index_path", pa.string()),
                                                                ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            ids, ends = codec.encode(batch.column(1))
            doc_ids, low = batch.column(0).to_pylist(), 0
            while low < len(doc_ids):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + min(_BATCH_BYTES, file_bytes) // kind.itemsize, "right")) - 1)
                if out is None:
                    name = f"part-{part:06d}-{number:05d}-{uuid.uuid4().hex}"
                    out = {"name": name, "file": store.open_output_stream(f"{base}/{name}.records"), "entries": [], "records": 0, "tokens": 0, "bytes": 0}
                payloads = [encoded(d, ids[a:b], end_id, kind) for d, a, b in zip(doc_ids[low:high], ends[low:high].tolist(), ends[low + 1:high + 1].tolist())]
                sizes = np.array([len(p) for p in payloads], np.int64)
                counts = np.diff(ends[low:high + 1]) + 1
                entries = np.zeros(len(payloads), _ENTRY)
                entries["doc_id"] = [d or 0 for d in doc_ids[low:high]]
                entries["offset"] = out["bytes"] + np.cumsum(sizes + _FRAME) - sizes - _FRAME
                entries["length"], entries["before"] = sizes, out["tokens"] + np.cumsum(counts) - counts
                data = b"".join(framed(payloads))
                out["file"].write(data)
                out["entries"].append(entries)
                out["records"] += len(payloads)
                out["tokens"] += int(counts.sum())
                out["bytes"] += len(data)
                if out["bytes"] >= file_bytes:
                    yield done()
                    out, number = None, number + 1
                low = high
        if out is not None:
            yield done()

    return stored(ordered.mapInArrow(run, MANIFEST), "token-manifest")


class BadRecord(ValueError):
    pass


def _checked(heads: list[bytes], payloads: list[bytes], tails: list[bytes]):
    """Raise BadRecord unless the checksums of lengths (first 8 of 12 bytes) and payloads agree."""
    want = masked(crc32c([h[:8] for h in heads])), masked(crc32c(payloads))
    got = [np.frombuffer(b"".join(x), "<u4") for x in ([h[8:] for h in heads], tails)]
    if (want[0] != got[0]).any() or (want[1] != got[1]).any():
        raise BadRecord("checksum")


def decoded(payload: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids (little-endian unsigned 32 bit) of a payload."""
    if len(payload) < _HEADER.size:
        raise BadRecord("header")
    version, width, has_id, doc_id, n = _HEADER.unpack_from(payload)
    if version != 1 or width not in (2, 4) or len(payload) != _HEADER.size + width * n:
        raise BadRecord("header")
    return doc_id if has_id else None, np.frombuffer(payload, f"<u{width}", n, _HEADER.size).astype("<u4")


def _records(file, left: int, check_bytes: int = _BATCH_BYTES):
    """Payloads of a file of `left` bytes, checked in batches; BadRecord where it is cut off or damaged."""
    heads, payloads, tails, size = [], [], [], 0
    while True:
        head = file.read(12)
        if head:
            length = int.from_bytes(head[:8], "little")
            left -= length + _FRAME
            if len(head) < 12 or left < 0:
                raise BadRecord("cut off, or a wrong length")
            payload, tail = file.read(length), file.read(4)
            heads.append(head)
            payloads.append(payload)
            tails.append(tail)
            size += length + _FRAME
        if payloads and (size >= check_bytes or not head):
            _checked(heads, payloads, tails)
            yield payloads
            heads, payloads, tails, size = [], [], [], 0
        if not head:
            return


RECORDS = "doc_id long, start long, n_tokens long, ids binary"
_RECORDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _file_starts(manifest: DataFrame, width: int = 1000) -> DataFrame:
    """Manifest with `start`, the ids of all files before: sums inside ranges of parts, then over ranges."""
    ranged = manifest.withColumn("_range", F.floor(F.col("part") / width))
    inside = Window.partitionBy("_range").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("_range").agg(F.sum("tokens").alias("_tokens")).withColumn("_before", F.coalesce(F.sum("_tokens").over(before), F.lit(0))).drop("_tokens")
    return ranged.withColumn("start", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(ranges, "_range").withColumn("start", F.col("start") + F.col("_before")).drop("_range", "_before")


def _spread_tasks(manifest: DataFrame) -> int:
    """Tasks for reading: one a file, as far as the session's number of partitions times four goes."""
    return max(1, min(manifest.count(), 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """All records of the manifest's files: doc_id, start (ids of all records before), n_tokens, ids (little-endian 32 bit).

    Each file is streamed by one task. A record whose lengths or checksums are wrong raises an error.
    """
    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = _opened(path)
                with store.open_input_stream(name, buffer_size=4 << 20) as file:
                    for payloads in _records(file, store.get_file_info(name).size):
                        found = [decoded(p) for p in payloads]
                        counts = np.array([len(ids) for _, ids in found], np.int64)
                        starts = start + np.cumsum(counts) - counts
                        start += int(counts.sum())
                        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array(starts), pa.array(counts), pa.array([x.tobytes() for _, x in found], pa.binary())], schema=_RECORDS)

    files = _file_starts(manifest).select("path", "start").repartition(_spread_tasks(manifest), "path")
    return files.mapInArrow(run, RECORDS)


def read_index(manifest: DataFrame) -> DataFrame:
    """One row a record from the indexes alone: part, number, record, path, offset, length, start, doc_id (0 for none)."""
    def run(batches):
        for batch in batches:
            for part, number, path, index, start in zip(*[c.to_pylist() for c in batch.columns]):
                store, name = _opened(index)
                with store.open_input_stream(name, buffer_size=1 << 20) as file:
                    at = 0
                    while data := file.read(_ENTRY.itemsize << 15):
                        e = np.frombuffer(data, _ENTRY)
                        n = len(e)
                        yield pa.RecordBatch.from_pydict({
                            "part": pa.array([part] * n, pa.int32()), "number": pa.array([number] * n, pa.int32()), "record": pa.array(np.arange(at, at + n)), "path": pa.array([path] * n),
                            "offset": pa.array(e["offset"].astype(np.int64)), "length": pa.array(e["length"].astype(np.int64)),
                            "start": pa.array(start + e["before"].astype(np.int64)), "doc_id": pa.array(e["doc_id"])})
                        at += n

    files = _file_starts(manifest).select("part", "number", "path", "index_path", "start").repartition(_spread_tasks(manifest), "path")
    return files.mapInArrow(run, "part int, number int, record long, path string, offset long, length long, start long, doc_id long")


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """The records of read_token_files in a random order that depends on `seed` alone, each read from its place by the index.

    Index entries are range-sorted by a hash of their place and the seed; texts are never shuffled. `turn` numbers the order
    within a task's share, and partitions follow each other.
    """
    key = F.xxhash64(F.lit(seed), "part", "number", "record")
    entries = read_index(manifest).select("path", "offset", "length", "start", key.alias("turn")).repartitionByRange("turn").sortWithinPartitions("turn")

    def run(batches):
        opened: dict = {}
        try:
            for batch in batches:
                rows, size = [], 0
                for path, offset, length, start, turn in zip(*[c.to_pylist() for c in batch.columns]):
                    if path not in opened:
                        if len(opened) >= 64:
                            opened.pop(next(iter(opened))).close()
                        store, name = _opened(path)
                        opened[path] = store.open_input_file(name)
                    opened[path].seek(offset)
                    data = opened[path].read(length + _FRAME)
                    if len(data) < length + _FRAME or int.from_bytes(data[:8], "little") != length:
                        raise BadRecord("index")
                    rows.append((data, start, turn))
                    size += len(data)
                    if size > _BATCH_BYTES:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)
        finally:
            for file in opened.values():
                file.close()

    def out(rows):
        payloads = [d[12:-4] for d, *_ in rows]
        _checked([d[:12] for d, *_ in rows], payloads, [d[-4:] for d, *_ in rows])
        found = [decoded(p) for p in payloads]
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _ in found], pa.int64()), pa.array([s for _, s, _ in rows], pa.int64()), pa.array([len(x) for _, x in found], pa.int64()),
            pa.array([x.tobytes() for _, x in found], pa.binary()), pa.array([t for *_, t in rows], pa.int64())], names=["doc_id", "start", "n_tokens", "ids", "turn"])

    return entries.mapInArrow(run, RECORDS + ", turn long")


def token_file_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write all texts as token files and read them back: doc_id, start, n_tokens, ids_crc32 (unsigned, of the 32-bit ids)."""
    read = read_token_files(write_token_files(docs, tokenizer, end_id))

    def run(batches):
        for batch in batches:
            sums = np.array([zlib.crc32(x.as_buffer()) for x in batch.column(3)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
