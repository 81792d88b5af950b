"""Double-array tries and collocations against brute force over Python's own counting."""

import re
from collections import Counter

import numpy as np
import pytest
from frames import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.llm import collocations as module
from tallyfold.llm.collocations import collocations
from tallyfold.llm.tries import build_trie, walk


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 4).flatmap(lambda k: st.tuples(st.lists(st.lists(st.integers(0, 40), min_size=k, max_size=k), min_size=1, max_size=60), st.lists(st.integers(-1, 40), max_size=200))), st.sampled_from([(6, 1), (3, 2), (2, 3)]))
def test_trie_finds_what_a_dictionary_finds(case, shape):
    phrases = np.unique(np.array(case[0]), axis=0)
    k = phrases.shape[1]
    trie = build_trie(phrases, *shape)
    codes = np.array(case[1] + [-1] * k, np.int32)
    at, found = walk(trie, codes, np.flatnonzero(codes >= 0))
    known = {tuple(p): i for i, p in enumerate(phrases.tolist())}
    assert list(zip(at.tolist(), found.tolist())) == [(i, known[t]) for i in range(len(case[1])) if (t := tuple(codes[i:i + k].tolist())) in known]


def test_trie_with_wide_and_narrow_nodes():
    chance = np.random.default_rng(3)
    phrases = np.unique(np.concatenate([np.stack([np.zeros(5000, int), np.arange(5000)], 1), chance.integers(0, 60_000, (20_000, 2))]), axis=0)
    trie = build_trie(phrases, 8, 2)
    codes = np.append(phrases.ravel(), [-1, -1]).astype(np.int32)
    at, found = walk(trie, codes, np.arange(0, len(codes) - 2, 2))
    assert found.tolist() == list(range(len(phrases)))


def brute(rows, least=30, longest=4, per_lang=2000, cover=80):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= cover * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items() if len(q) > len(p)):
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:per_lang], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("files", [None, 7])
def test_equals_brute_force(spark, monkeypatch, files):
    if files:  # many files of words, buckets and tries, and few kept
        monkeypatch.setattr(module, "FILE_ROWS", dict.fromkeys(module.FILE_ROWS, files))
        monkeypatch.setattr(module, "KEPT_BYTES", 1)
    chance = np.random.default_rng(7)
    words = ["a", "b\x01", "b", "Über", "über", "x-y", "日本", "the", "The", "of", "...", "n m"]
    rows = []
    for i in range(150):
        body = "".join(w + chance.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for w in chance.choice(words, 120, p=np.arange(12, 0, -1) / 78))
        rows.append((["en", None, "und", "de"][i % 4], body))
    rows += [("en", None), ("fr", ""), (None, "a b"), ("en", "a " * 3000)]
    frame = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit("own")).withColumn("code", F.lit("own"))
    want = brute(rows)
    assert len(want) > 100 and rows_of(collocations(frame)) == want
    assert rows_of(collocations(frame, least=12, longest=3, per_lang=9, cover=50)) == brute(rows, 12, 3, 9, 50)


def test_words_across_slices_and_pieces():
    text = "Ab c, d " * 400_000  # more than one slice
    import pyarrow as pa

    got, marks = [], []
    for words, index, owner, fresh in module._words_of(pa.array([text, None, "", "d e", "x"])):
        names = words.to_pylist()
        got += [(names[i], o) for i, o in zip(index.tolist(), owner.tolist())]
        marks += fresh.tolist()
    assert got == [(w, 0) for w in (b"ab", b"c", b"d") * 400_000] + [(b"d", 3), (b"e", 3), (b"x", 4)]
    assert marks == [True] + ([False, True, False] * 400_000)[:-1] + [True, False, True]


def test_edges(spark):
    assert rows_of(collocations(documents(spark))) == brute([(r.lang, r.text) for r in documents(spark).collect()])
    assert collocations(documents(spark, [])).count() == 0
    assert collocations(documents(spark, [(1, None, None), (2, "", "en"), (3, ".,;", "en")])).count() == 0
