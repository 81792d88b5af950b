"""Token files: the codec against the tokenizer itself, checksums, round trips, damage, other orders."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from frames import SHORT, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.llm import tokenfiles, wordids
from tallyfold.llm.queries import LLM_QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


SIGNS = [*"aAbJIİıſKk'stTmMdDlLvVrReE .,;!?\n\t\r\x0b\x1c\x85\xa0 -_\"«»“…éÉßÑñ×÷̧́̌̇ǰשׁΣςσ日本क१2½5<|>@#🙂🏽‍", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'ll"]


@pytest.mark.parametrize("slice_bytes,kept", [(64, 200), (1 << 20, 800_000)])
def test_codec_equals_the_tokenizer(tokenizer, monkeypatch, slice_bytes, kept):
    monkeypatch.setattr(wordids, "SLICE_BYTES", slice_bytes)
    chance = random.Random(5)
    texts = ["".join(chance.choices(SIGNS, k=chance.randint(0, 50))) for _ in range(3000)] + ["x" * 500, "", None, " "]
    ids, ends = wordids.WordIds(PATH, kept).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[ends[i]:ends[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def bitwise_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=8))
def test_checksum_by_definition(payloads):
    assert tokenfiles.crc32c(payloads).tolist() == [bitwise_crc(p) for p in payloads]


def test_checksum_known_values(monkeypatch):
    assert tokenfiles.crc32c([b"123456789"])[0] == 0xE3069283 and tokenfiles.crc32c([bytes(32)])[0] == 0x8A9136AA
    data = bytes(range(256)) * 40
    whole = tokenfiles.crc32c([data])
    monkeypatch.setattr(tokenfiles, "_PART_BYTES", 1024)
    assert tokenfiles.crc32c([data])[0] == whole[0]


def expected(tokenizer, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark, sf, tokenizer):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in LLM_QUERIES["op11_tokenfiles"](spark, sf).collect())
    assert got == expected(tokenizer, rows)


def test_edges(spark, tokenizer):
    out = tokenfiles.token_file_round_trip(documents(spark), PATH).orderBy("start").collect()
    assert sorted((r.doc_id, r.n_tokens) for r in out if r.doc_id) == sorted((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in SHORT if i)
    assert [r.doc_id for r in out] == sorted([i for i, _, _ in SHORT], key=lambda i: (i is not None, i or 0))
    assert [r.start for r in out] == np.cumsum([0] + [r.n_tokens for r in out])[:-1].tolist()
    assert tokenfiles.token_file_round_trip(documents(spark, []), PATH).count() == 0


def test_files_split_shuffle_and_index(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    manifest = tokenfiles.write_token_files(docs, PATH, file_bytes=20_000)
    assert manifest.count() > 8
    rows = {tuple(r) for r in tokenfiles.read_token_files(manifest).collect()}
    mixed = tokenfiles.read_shuffled(manifest, 7).collect()
    assert {tuple(r)[:4] for r in mixed} == rows and len(mixed) == docs.count()
    turns, starts = [r.turn for r in mixed], [r.start for r in mixed]
    assert turns == sorted(turns) and starts != sorted(starts)
    assert [r.start for r in tokenfiles.read_shuffled(manifest, 8).collect()] != starts
    index = tokenfiles.read_index(manifest)
    assert {(r.doc_id, r.start) for r in index.collect()} == {(r[0], r[1]) for r in rows}


def test_leftovers_are_not_read_and_damage_is_found(spark, sf):
    manifest = tokenfiles.write_token_files(spark.read.parquet(f"{sf}/documents.parquet"), PATH)
    one = manifest.first()
    name = one.path.removeprefix("file://").removeprefix("file:")
    data = open(name, "rb").read()
    with open(name.replace("part-", "part-9"), "wb") as f:  # an attempt that did not count
        f.write(data)
    assert tokenfiles.read_token_files(manifest).count() == manifest.agg(F.sum("records")).first()[0]
    for broken in (data[:-3], data[:40] + bytes([data[40] ^ 1]) + data[41:], b"\xff" + data[1:]):
        with open(name, "wb") as f:
            f.write(broken)
        with pytest.raises(Exception, match="BadRecord"):
            tokenfiles.read_token_files(manifest).count()
