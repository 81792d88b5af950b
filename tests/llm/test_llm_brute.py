"""The pipeline's chain, and fits, against direct computation."""

import re

import numpy as np
import public_tokenizers

import corpus_pipeline
from tallyfold.llm.quality import STATISTICS, Cosines, fit
from tallyfold.llm.tables import stored, table


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def near_groups(texts):
    """doc_id kept of each group, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    leader = {i: i for i in texts}

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                leader[b] = a
    return {i for i in texts if not sets[i] or find(i) == i}


def test_pipeline_chain(spark, sf):
    """Each stage works on all its predecessor kept: near duplicates by all pairs, benchmark windows by search, sequences by the tokenizer."""
    from tokenizers import Tokenizer

    docs, kept = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), f"test-{name}")
        kept.append({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    languages, lines, near, clean = kept
    assert set(lines) <= set(languages) and len(languages) > 100
    assert set(near) == near_groups(lines) and all(near[i] == lines[i] for i in near)

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = set()
    for r in table(spark, sf, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[i:i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}
    for i, text in near.items():
        w = words(text)
        hit = {k for n in sizes for s in range(len(w) - n + 1) if tuple(w[s:s + n]) in windows for k in range(s, s + n)}
        assert (i in clean) == (not (hit and 20 * len(hit) >= len(w))), i

    codec = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(clean)
    for i, rows in pieces.items():
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(rows, key=lambda r: r.start)])
        assert ids.tolist() == [*codec.encode(clean[i] or "", add_special_tokens=False).ids, 2]


def test_ridge_equals_direct_solution(spark):
    rng = np.random.default_rng(2)
    rows, label = rng.normal(2, 3, (400, len(STATISTICS))), rng.integers(0, 2, 400)
    train = spark.createDataFrame([(r.tolist(), int(y)) for r, y in zip(rows, label)], "stats array<double>, label int").repartition(5)
    cosines, weights = fit(train, rows.mean(0), rows.std(0), 64, 4.0, 1.0, 11)
    z = cosines(rows)
    direct = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ label)
    assert np.allclose(weights, direct, atol=1e-8)


def test_cosines_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(3)
    rows = rng.normal(0, 1, (40, 6))
    z = Cosines(np.zeros(6), np.ones(6), 20_000, 2.0, 4)(rows)[:, 7:]
    distance = ((rows[:, None] - rows[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-distance / (2 * 2.0**2))).max() < 0.05
