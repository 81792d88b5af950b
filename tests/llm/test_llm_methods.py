"""Operators against brute force on small inputs, exact round trips, and groups that a shortcut would get wrong."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from frames import documents
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfold.llm import warc
from tallyfold.llm.components import connected_components
from tallyfold.llm.credentials import Automaton, base_spans, prefix_counts, scan_secrets, shape
from tallyfold.llm.decontaminate import contamination
from tallyfold.llm.langid import identify_languages
from tallyfold.llm.linededup import dedup_lines, may_be_within, middles, within_edits
from tallyfold.llm.neardup import near_duplicates
from tallyfold.llm.packing import hilbert_keys, pack_sequences, tail_lengths
from tallyfold.llm.sums import isotonic
from tallyfold.llm.topk import top_k
from tallyfold.llm.wordids import WordIds
from tallyfold.llm.toxicity import Matcher, folded, toxicity_scores

WORDS = [f"w{i}" for i in range(4000)]


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return out


def brute_components(rows, size, percent):
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    """A hot group of near copies of which many lie just at the threshold, chains, exact copies, and a passage that many share."""
    rng = random.Random(size)
    base, rows = [rng.choice(WORDS) for _ in range(120)], []
    for i in range(260):
        rows.append((i, " ".join(edited(base, rng.randrange(0, 12), rng))))
    chain = [rng.choice(WORDS) for _ in range(80)]
    for i in range(300, 330):
        chain = edited(chain, 2, rng)
        rows.append((i, " ".join(chain)))
    shared = " ".join(rng.choice(WORDS) for _ in range(25))
    for i in range(400, 520):
        rows.append((i, shared + " " + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12)))))
    rows += [(600 + i, rows[i][1].upper()) for i in range(20)] + [(700, ""), (701, None), (702, "one"), (703, "One")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(spark, [(i, t, "en") for i, t in rows]), words=size).collect()}
    assert got == brute_components(rows, size, 80)


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_edit_distance(spark):
    rng, rows = random.Random(3), []
    for _ in range(600):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 9)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i:i + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "x string, y string")
    for t in range(4):
        assert df.where(within_edits(F.col("x"), F.col("y"), t) != (F.levenshtein("x", "y") <= t)).count() == 0
        assert df.where((F.levenshtein("x", "y") <= t) & ~may_be_within(F.col("x"), F.col("y"), t, 4 * (t + 1))).count() == 0
    got = df.select("x", "y", F.explode(F.array(middles(F.col("x"), F.col("y")))).alias("m")).select("x", "y", "m.a", "m.b", F.levenshtein("x", "y").alias("d"), F.levenshtein("m.a", "m.b").alias("e"))
    for r in got.collect():
        same = len(os.path.commonprefix([r.x, r.y]))
        x, y = r.x[same:], r.y[same:]
        end = len(os.path.commonprefix([x[::-1], y[::-1]]))
        assert (r.a, r.b) == (x[:len(x) - end], y[:len(y) - end]) and r.d == r.e


def levenshtein(a, b):
    same = len(os.path.commonprefix([a, b]))  # a shared beginning adds no edit
    a, b = a[same:], b[same:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_line_dedup_equals_brute_force(spark, threshold):
    """Many distinct lines share half of their characters, so their buckets are large and must be divided."""
    rng, lines = random.Random(threshold), []
    head = "the same beginning of many lines: "
    for i in range(150):
        lines.append(head + "".join(rng.choice("abcdefgh") for _ in range(30)))
    for _ in range(150):
        b = list(rng.choice(lines))
        for _ in range(rng.randint(1, threshold + 1)):
            i = rng.randrange(len(b))
            b[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        lines.append("".join(b))
    rng.shuffle(lines)
    rows = [(i // 5, lines[i:i + 5]) for i in range(0, len(lines), 5)]
    kept, seen = {}, []
    for d, part in rows:
        kept[d] = "\n".join(x for x in part if not any(levenshtein(x, y) <= threshold for y in seen[:] + part[:part.index(x)]) and True)
        seen += part
    got = {r.doc_id: r.text for r in dedup_lines(documents(spark, [(d, "\n".join(p), "en") for d, p in rows]), threshold=threshold).collect()}
    assert got == kept


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.2, (700, 16)), np.repeat(rng.normal(0, 0.2, (1, 16)), 300, 0)])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(2000)[:1000], x)]
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect())
    q = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows}
    want = []
    for i in q:
        if i % 10 == 0:
            best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_topk_copies_no_queries_for_the_driver(spark):
    """Many queries in several blocks: they meet the rows without a broadcast, and without a row for each block and chunk."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.2, (4900, 6)), np.repeat(rng.normal(0, 0.2, (1, 6)), 100, 0)])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(5000), x)]
    out = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1, k=3)
    got = sorted(tuple(r) for r in out.collect())
    ids, whole = np.array([i for i, _ in rows]), np.floor(256 * x).astype(np.int64)
    want = []
    for n, i in enumerate(ids):
        scores = whole @ whole[n]
        best = [j for j in np.lexsort((ids, -scores))[:4] if j != n][:3]
        want += [(int(i), r + 1, int(ids[j]), int(scores[j])) for r, j in enumerate(best)]
    assert got == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan


def brute_spans(text):
    out = []
    for kind, pattern, ok in (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if ok(m)]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))


def test_secrets_equal_brute_force_and_the_grammar_adds(spark):
    rng = random.Random(5)
    make = lambda n, alphabet: "".join(rng.choice(alphabet) for _ in range(n))
    hexes, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows = []
    for i in range(300):
        rows.append((i, rng.choice([f"é api_key = '{make(32, hexes + 'ghijkl')}' x", f"AKIA{make(16, upper)} and {make(rng.randint(10, 40), hexes)}", f"password:ab token=secret:{make(8, hexes)}",
                                    f"ToKeN: \"{make(5, hexes)}\" ſecret=abcdefgh", "plain words only"]), "en"))
    hidden = f"see {make(32, hexes + 'ghijkl')} here, not https://example.org/2024/01/02/some-words-in-a-path.html"
    rows.append((1000, hidden, "en"))
    out = {r.doc_id: r for r in scan_secrets(documents(spark, rows)).collect()}
    for i, text, _ in rows:
        spans = brute_spans(text)
        base = ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
        assert out[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(out[i].spans.split(",")) | {""}
        assert [(s, k, e) for s, e, k, _ in base_spans(text)] == spans
    assert out[1000].spans == "format:4:36"


def test_automaton_merges_states():
    counts, ends = {}, {}
    rng = random.Random(2)
    for _ in range(3000):
        w = "A" * 4 + "".join(rng.choice("A0") for _ in range(8))
        ends[w] = ends.get(w, 0) + 1
        for k in range(len(w) + 1):
            counts[w[:k]] = counts.get(w[:k], 0) + 1
    pruned = {p: c for p, c in counts.items() if c < 20 <= counts[p[:-1]]}
    machine = Automaton({p: c for p, c in counts.items() if c >= 20}, ends, pruned)
    assert len(machine.states) < 60 < len(counts)
    assert machine.bits("AAAAA0A0AA0A") > machine.bits("zzzz0zzz0zzz") + 2 and shape("AKIA9z-f") == "AAAA0z-a"


def test_prefix_counts_equal_counting(spark):
    """Whole strings, step by step: as by counting all prefixes at once."""
    rng = random.Random(9)
    words = ["A" * 30 + "0" * rng.randrange(0, 9) + rng.choice(["z", "zz", ""]) for _ in range(300)] + ["".join(rng.choice("a0") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    counts, ends = {}, {}
    for w in words:
        ends[w] = ends.get(w, 0) + 1
        for k in range(len(w) + 1):
            counts[w[:k]] = counts.get(w[:k], 0) + 1
    kept = {p for p, c in counts.items() if c >= len(words) * 0.02}
    rows = prefix_counts(spark.createDataFrame([("k", w) for w in words], "kind string, word string"), 0.02, step=7)
    assert {(r.prefix, r.n, r.ends) for r in rows if r.kept} == {(p, counts[p], ends.get(p, 0)) for p in kept} and max(map(len, kept)) > 30
    assert {(r.prefix, r.n) for r in rows if not r.kept} == {(p, c) for p, c in counts.items() if p not in kept and p[:-1] in kept}


def test_contamination_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS[:50]) for _ in range(rng.choice([1, 4, 12, 13, 14, 30])))) for i in range(40)] + [(90, "Ω w1 Ω"), (91, "w1 w1 w1")]
    docs = []
    for i in range(120):
        w = [rng.choice(WORDS[:50]) for _ in range(rng.randrange(0, 200))]
        for _ in range(rng.randrange(0, 3)):
            t = rng.choice(items)[1].split()
            at = rng.randrange(len(w) + 1)
            w[at:at] = t[rng.randrange(len(t)):] if rng.random() < 0.3 else t
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper() if rng.random() < 0.3 else "; ".join(w)))
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    want = {}
    for d, text in docs:
        w, hit, found = cut(text), set(), set()
        for i, t in items:
            t = cut(t)
            for p in range(max(1, len(t) - 12)):
                part = t[p:p + 13]
                for at in range(len(w) - len(part) + 1):
                    if w[at:at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        found.add(str(i))
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    out = contamination(documents(spark, [(d, t, "en") for d, t in docs]), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()} == want


def test_mixture_of_languages(spark):
    rng = random.Random(4)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    one, two = "abcdefgh", "ijklmnopé"
    rows = [(i, text(one, 60), "xx") for i in range(40)] + [(100 + i, text(two, 60), "yy") for i in range(40)]
    rows += [(900, text(one, 200) + " " + text(two, 100), None), (901, text(two, 4), None)]
    out = {r.doc_id: r for r in identify_languages(documents(spark, rows, clash=False)).collect()}
    assert out[900].lang_pred == "xx" and out[900].n_langs == 2 and 0.55 < out[900].score < 0.78
    assert out[901].lang_pred == "yy" and out[901].n_langs == 1


def test_hilbert_curve_visits_neighbours():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    key = hilbert_keys(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_packing_is_exact(spark):
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    rng = random.Random(6)
    odd = ["I'M  here\tnow\n\nit's", "Ως É é  x\x1cy <|endoftext|> a<|startoftext|>b", "日本 12 345", ""]
    texts = odd + [" ".join(rng.choice(["Hello", "world,", "don't", "été", "ΑΣ", "x1y2"]) for _ in range(rng.randrange(0, 3000))) for _ in range(40)]
    ids, ends = WordIds(corpus_pipeline.TOKENIZER).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[ends[i]:ends[i + 1]].tolist() == codec.encode(t, add_special_tokens=False).ids
    rows = pack_sequences(documents(spark, [(i, t, "en") for i, t in enumerate(texts)]), corpus_pipeline.TOKENIZER).collect()
    for i, t in enumerate(texts):
        ids = np.array(codec.encode(t, add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            part = ids[r.start:r.start + r.length].tobytes()
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part) and bytes(r.ids) == part
            at += r.length
        assert at == len(ids)
    lengths = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == lengths.get(r.sequence_id, 0)
        lengths[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in lengths.values())
    assert tail_lengths(4095, 4096) == [2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1]


def test_warc_reader_rejects(spark, tmp_path):
    records = [warc.record_bytes(i, f"http://h/{i}", b"<p>%d</p>" % i * 40, "response", None) for i in range(300)]
    data = b"".join(warc.archives_of(iter(records)))
    assert list(warc.frames_of(data)) == records
    for bad in (records[0][:-1], records[0].replace(b"WARC/1.1", b"WARC/9.9"), records[0].replace(b"<p>0", b"<p>1"), re.sub(rb"Content-Length: \d+", b"Content-Length: 1", records[0])):
        with pytest.raises(warc.BadRecord):
            warc.parse_record(bad)
    (tmp_path / "a.warc.zst").write_bytes(data[:-20])
    (tmp_path / "b.warc.zst").write_bytes(data[:100])
    rows = warc.read_archives(spark, str(tmp_path)).orderBy("path", "record").collect()
    assert [r.error is None for r in rows if r.path.endswith("a.warc.zst")] == [True] * 299 + [False]
    assert [r.error for r in rows if r.path.endswith("b.warc.zst")] == ["dictionary frame is cut off"]


def test_warc_reads_what_was_committed_only(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>") for i in range(50)], "page_id long, url string, html string")
    archives = spark.createDataFrame(warc.write_archives(warc.roles(pages), str(tmp_path)).collect())  # written once
    one = archives.first().path
    with open(one, "rb") as f, open(one.replace("pages-", "pages-9"), "wb") as surplus:  # an attempt that did not count
        surplus.write(f.read())
    assert warc.read_archives(spark, str(tmp_path)).count() > 50
    assert sorted(r.page_id for r in warc.read_listed(archives).collect()) == list(range(50))


def test_folding_and_exceptions(spark):
    assert folded("ST­UPID, ѕtupіd 5tup1d $tupid! 1999") == " stupid stupid stupid stupid 1999 "
    matcher = Matcher({" trash ": 2.0, " tra": 1.0}, {" trash can ": 1.0})
    assert matcher.total(" the trash can ")[0] == 0 and matcher.total(" you trash ")[0] == 2.0 and matcher.total(" traitor ")[0] == 1.0
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(400):
        words = [rng.choice(WORDS) for _ in range(60)]
        if i % 4 == 0:
            words[rng.randrange(60)] = rng.choice(["moron", "m0r0n", "MORON"])
        elif i % 4 == 1:
            words[7:9] = ["moron", "mountain"]
        rows.append((i, " ".join(words), "en"))
        marks.append((i, 1, int(i % 4 == 0)))
    out = {r.doc_id: r for r in toxicity_scores(documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    wrong = sum(out[i].predicted != t for i, _, t in marks)
    assert wrong <= 8


def test_isotonic_is_monotone():
    x, y = isotonic(np.array([0.0, 1, 2, 3]), np.array([10.0, 10, 10, 10]), np.array([1.0, 5, 3, 9]))
    assert (np.diff(y) >= 0).all() and x[0] == 0 and y[0] < 0.2 and y[-1] > 0.8
