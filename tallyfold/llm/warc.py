"""WARC archives as Zstandard files: a dictionary in a leading skippable frame, then one frame a record."""

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.tables import stored
from tallyfold.operators.joins import lookup_join
from tallyfold.session import new_table_path

DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
#: A new archive is begun beyond so many bytes; one record is never split.
ARCHIVE_BYTES = 8 << 20
_SAMPLES, _SAMPLE_BYTES, _DICTIONARY_BYTES = 200, 2 << 20, 32 << 10


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """Add payload_digest, payload_bytes, record_type and refers_to to (page_id, url, html).

    Rows of one digest and length, from `least` bytes on, refer to the one with the largest page_id; rows that
    repeat that page_id are responses too, and so is each row of a group without any page_id. The largest id is
    summed before the shuffle, and the join back splits a digest that many rows share.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body")).select(
        "*", F.sha1("body").alias("digest"), F.length("body").cast("long").alias("payload_bytes"))
    large = F.col("payload_bytes") >= least
    keepers = rows.where(large).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("keeper"))
    joined = lookup_join(rows, keepers, ["digest", "payload_bytes"], "left")
    revisit = large & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "body", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("keeper")).alias("refers_to"))


def _record_id(page_id, digest: str) -> str:
    """Stable id: a task that runs again writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _target(page_id, url) -> str:
    return urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"


def record_bytes(page_id, url, body: bytes, kind: str, refers_to) -> bytes:
    digest = digest32(body)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + (body if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest)}", "WARC-Date: 2024-01-01T00:00:00Z",
             f"WARC-Target-URI: {_target(page_id, url)}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}", f"WARC-Block-Digest: sha1:{digest32(block)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]):
    """Trained on the first records of an archive; plain content where these are too few to train on."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(_DICTIONARY_BYTES, samples)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(samples)[-_DICTIONARY_BYTES:] or b"\0" * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)


def archives_of(records):
    """Whole archives (bytes) from an iterator of records."""
    import zstandard as zstd

    def begin(samples):
        words = _dictionary(samples)
        data = words.as_bytes()
        packed = zstd.ZstdCompressor().compress(data)
        coder = zstd.ZstdCompressor(dict_data=words, write_content_size=True, write_checksum=True)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed
        return coder, [head, *map(coder.compress, samples)]

    waiting, coder, frames, size = [], None, [], 0
    for record in records:
        if coder is None:
            waiting.append(record)
            size += len(record)
            if len(waiting) >= _SAMPLES or size > _SAMPLE_BYTES:
                coder, frames = begin(waiting)
                waiting, size = [], sum(map(len, frames))
        else:
            frame = coder.compress(record)
            frames.append(frame)
            size += len(frame)
            if size > ARCHIVE_BYTES:
                yield b"".join(frames)
                coder, frames, size = None, [], 0
    if waiting:
        coder, frames = begin(waiting)
    if frames:
        yield b"".join(frames)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, body, record_type, refers_to) as archives below `folder`; gives (path, bytes).

    Every attempt of a task writes files of new names, and only the rows given back say which of them count: read those
    (`read_listed`), since a lost attempt may have left others. The folder may be on any file system that pyarrow opens by its address.
    """
    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")

        def records_of():
            for batch in batches:
                for part in range(0, batch.num_rows, 256):
                    columns = [c.to_pylist() for c in batch.slice(part, 256).columns]
                    for row in zip(*columns):
                        yield record_bytes(*row)

        store.create_dir(base, recursive=True)
        for i, data in enumerate(archives_of(records_of())):
            name = f"pages-{context.partitionId():06d}-{i:05d}-{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:  # the name alone would make it compress once more
                f.write(data)
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{name}"]), "bytes": pa.array([len(data)], pa.int64())})

    return records.select("page_id", "url", "body", "record_type", "refers_to").mapInArrow(run, "path string, bytes long")


class BadRecord(ValueError):
    pass


def _headers(block: bytes, first: bytes) -> tuple[dict[str, str], int]:
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise BadRecord("headers do not end")
    lines = block[:end].decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(first.decode(), lines[0]):
        raise BadRecord(f"first line {lines[0][:40]!r}")
    found = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise BadRecord(f"header line {line[:40]!r}")
        found[name.lower()] = value.strip()
    return found, end + 4


def parse_record(data: bytes) -> dict:
    """Fields of one record; BadRecord where a header, a length or a digest is wrong."""
    headers, at = _headers(data, rb"WARC/1\.[01]")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BadRecord(f"no {name}")
    if not re.fullmatch("[0-9]+", headers["content-length"]) or len(data) != at + int(headers["content-length"]) + 4 or data[-4:] != b"\r\n\r\n":
        raise BadRecord("length of the record")
    block = data[at:-4]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{digest32(block)}":
        raise BadRecord("digest of the block")
    out = {"record_type": headers["warc-type"], "record_id": headers["warc-record-id"], "url": headers.get("warc-target-uri"), "refers_to_id": headers.get("warc-refers-to"),
           "page_id": headers.get("x-page-id"), "refers_to": headers.get("x-refers-to-page"), "payload_digest": None, "payload_bytes": None, "payload": None}
    if headers["warc-type"] in ("response", "revisit") and headers.get("content-type", "").startswith("application/http"):
        http, start = _headers(block, rb"HTTP/1\.[01] [0-9]{3}.*")
        length = http.get("content-length", "")
        if not re.fullmatch("[0-9]+", length):
            raise BadRecord("length of the payload")
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if headers["warc-type"] == "response":
            payload = block[start:]
            if len(payload) != int(length) or digest != digest32(payload):
                raise BadRecord("payload")
            out["payload"] = payload
        elif "warc-refers-to" not in headers or len(block) != start:
            raise BadRecord("revisit")
        out |= {"payload_digest": digest, "payload_bytes": int(length)}
    return out


def frames_of(data: bytes):
    """Bytes of every record of an archive. Frames of the file are decoded one at a time; each must be whole."""
    import zstandard as zstd

    words, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise BadRecord("dictionary frame is cut off")
        held = data[8:8 + size]
        if held[:4] == ZSTD_MAGIC:
            held = zstd.ZstdDecompressor().decompress(held)
        words, at = zstd.ZstdCompressionDict(held), 8 + size
    coder = zstd.ZstdDecompressor(dict_data=words) if words else zstd.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        if len(data) - at >= 8 and data[at:at + 4] != ZSTD_MAGIC and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]  # other skippable frames
            continue
        one, found = coder.decompressobj(), []
        try:
            while not one.eof and at < len(data):
                found.append(one.decompress(view[at:at + 2048]))
                at += len(view[at:at + 2048])
        except zstd.ZstdError as e:
            raise BadRecord(f"frame: {e}") from None
        if not one.eof:
            raise BadRecord("frame is cut off")
        at -= len(one.unused_data)
        yield b"".join(found)


RECORD_SCHEMA = ("path string, record int, page_id long, url string, record_type string, record_id string, refers_to long, refers_to_id string, "
                 "payload_bytes long, payload_digest string, payload binary, error string")


def _rows_of(path: str, content: bytes):
    """Batches of the records of one archive."""
    def number(text):
        return int(text) if text and re.fullmatch("-?[0-9]{1,18}", text) else None

    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in RECORD_SCHEMA.split(", ")]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)

    rows, size, i = [], 0, -1
    try:
        for i, data in enumerate(frames_of(content)):
            try:
                row = parse_record(data)
                row["page_id"], row["refers_to"] = number(row["page_id"]), number(row["refers_to"])
            except BadRecord as e:
                row = {"error": str(e)}
            rows.append(row | {"path": path, "record": i})
            size += len(data)
            if size > 2 << 20:
                yield out(rows)
                rows, size = [], 0
    except BadRecord as e:
        rows.append({"path": path, "record": i + 1, "error": str(e)})
    if rows:
        yield out(rows)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives `*.warc.zst` in a folder, read by Spark's own file source.

    A record that is not valid has only path, record and error; a frame that cannot be decoded ends its archive
    with such a row, since where the next one begins is then unknown.
    """
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                yield from _rows_of(path.as_py(), content.as_py())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "content").mapInArrow(run, RECORD_SCHEMA)


def read_listed(archives: DataFrame) -> DataFrame:
    """The records of the archives that `write_archives` gave back (path), and of no others; each is opened by one task."""
    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
                with store.open_input_stream(name, compression=None) as f:
                    content = f.read()
                yield from _rows_of(path, content)

    return archives.select("path").mapInArrow(run, RECORD_SCHEMA)


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write every row of pages as a WARC record and read all archives back: the records, as read_archives gives them.

    A null html is an empty payload, a null url the address urn:page:<id>; a row without page_id is kept, and is
    never what others refer to. Repeated rows each have their record. An empty table gives no rows. Other columns
    are not archived. A record that does not read back whole raises an error.
    """
    spark = pages.sparkSession
    folder = new_table_path(spark, "warc")
    archives = stored(write_archives(roles(pages, least), folder), "warc-list")
    read = read_listed(archives.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path"))
    return read.where(F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad record: "), "path", F.lit(" "), "error")).cast("boolean")).otherwise(True))
