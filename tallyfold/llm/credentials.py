"""Secret scan: fixed patterns, and formats inferred from what they find.

The strings that the patterns find are labelled credentials. Their prefix-tree counts (by character class) are summed
over all documents; statistically compatible states of the tree are merged (ALERGIA, with the Hoeffding bound) into one
probabilistic automaton a kind. Every other credential-like string of every text is then scored by the likelihood of its
format, and added where it looks like a labelled kind and unlike the strings around.
"""

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.tables import stored

KINDS = ("assign", "access", "hex")
GRAMMAR = "format"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates: whole runs of credential characters that hold a digit and a letter.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])[A-Za-z0-9+/_.=-]{16,}")
_CLASSES = str.maketrans({**{c: "0" for c in "0123456789"}, **{c: "a" for c in "abcdef"}, **{c: "z" for c in "ghijklmnopqrstuvwxyz"}, **{chr(c): "A" for c in range(65, 91)}})
#: Lengths of prefixes that are counted in one go.
STEP = 48


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the fixed patterns, in code points, by start and then kind as listed."""
    found = [(m.start(), m.end(), "assign", m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), m.end(), "access", m.group()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex", m.group()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidate_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Runs that may be credentials and touch no span that is already there."""
    out = []
    for m in _CANDIDATE.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in taken):
            out.append((m.start(), m.end(), m.group()))
    return out


def shape(text: str) -> str:
    """Class of each character: digit 0, a-f a, other small letters z, capitals A, others as they are."""
    return text.translate(_CLASSES)


class Automaton:
    """Probabilistic automaton from prefix counts, by merging states whose outgoing frequencies are compatible.

    `counts` maps prefixes to the number of strings that begin so, `ends` to those that end there. `pruned` has the counts of
    prefixes that are too rare to be states while what stands before their last character is one: that character is drawn as
    often as it was seen, and leads back into its state, which then stands for the tail. That step is drawn
    only after merging: until then what hangs below a state that is not kept yet is a tree, so folding it into a kept
    state never puts one kept state into another.
    """

    def __init__(self, counts: dict[str, int], ends: dict[str, int], pruned: dict[str, int] | None = None, alpha: float = 0.05):
        self.n = {p: c for p, c in counts.items()} or {"": 0}
        self.end = dict.fromkeys(self.n, 0) | {p: c for p, c in ends.items() if p in self.n}
        self.next: dict[str, dict[str, str]] = {p: {} for p in self.n}
        self.flow: dict[str, Counter] = {p: Counter() for p in self.n}
        for p in sorted(self.n, key=len):
            if p:
                parent = p[:-1]
                self.next[parent][p[-1]] = p
                self.flow[parent][p[-1]] += self.n[p]
        for p, c in (pruned or {}).items():  # what the tree leaves out goes on from the state it left
            self.flow[p[:-1]][p[-1]] += c
        self.alpha = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _differ(self, f1, n1, f2, n2) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.alpha * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _fold(self, a: str, b: str, into: dict[str, str]) -> None:
        """Put b and all below it into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            while a in into:
                a = into[a]
            while b in into:
                b = into[b]
            if a == b:
                continue
            into[b] = a
            self.n[a] += self.n[b]
            self.end[a] += self.end[b]
            self.flow[a] += self.flow[b]
            for c, t in list(self.next[b].items()):
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self) -> None:
        into: dict[str, str] = {}

        def root(p):
            while p in into:
                p = into[p]
            return p

        red, blue = [""], []
        while True:
            blue = sorted({root(t) for r in red for t in self.next[r].values()} - set(red), key=lambda p: (-self.n[p], len(p), p))
            if not blue:
                break
            b = blue[0]
            for r in red:
                if self._compatible(r, b, root):
                    self._fold(r, b, into)
                    break
            else:
                red.append(b)
        self.first, self.states = "", {}
        for r in red:
            for c in self.flow[r]:
                self.next[r].setdefault(c, r)
            total = self.n[r] + 2.0
            self.states[r] = ({c: (self.flow[r][c] / total, root(t)) for c, t in self.next[r].items()}, (self.end[r] + 0.5) / total, 0.5 / total)

    def _compatible(self, a, b, root) -> bool:
        for p in (a, b):
            self.next[p] = {c: root(t) for c, t in self.next[p].items()}
        seen, todo = set(), [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            for p in (a, b):
                self.next[p] = {c: root(t) for c, t in self.next[p].items()}
            if self._differ(self.end[a], self.n[a], self.end[b], self.n[b]):
                return False
            for c in self.flow[a].keys() | self.flow[b].keys():
                if self._differ(self.flow[a][c], self.n[a], self.flow[b][c], self.n[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def bits(self, text: str) -> float:
        """Mean log2 probability of a character, the end counted as one; a step that was never seen costs its share of one half count."""
        state, total = self.first, 0.0
        for c in text:
            steps, _, other = self.states[state]
            share, state = steps.get(c, (other, state))
            total += math.log2(max(share, 1e-9))
        return (total + math.log2(max(self.states[state][1], 1e-9))) / (len(text) + 1)


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base array, candidates array) of every row; texts are read once."""
    def run(batches):
        item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("word", pa.string())])
        for batch in batches:
            base, others = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = base_spans(text)
                base.append([{"start": s, "end": e, "kind": k, "word": w} for s, e, k, w in spans])
                others.append([{"start": s, "end": e, "kind": GRAMMAR, "word": w} for s, e, w in candidate_spans(text, [(s, e) for s, e, *_ in spans])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(item)), pa.array(others, pa.list_(item))], ["doc_id", "base", "others"])

    spans = "array<struct<start: long, end: long, kind: string, word: string>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, base {spans}, others {spans}")


def prefix_counts(words: DataFrame, least_share: float, step: int = STEP) -> list:
    """Rows (kind, prefix, n, ends, kept) of (kind, word): prefixes with which at least `least_share` of the kind begin (kept), and
    those rarer ones that go on from a kept one by a character.

    Whole strings are counted, `step` lengths at a time: strings whose prefix is still kept at the end of a step go on to the next, so
    a long string is taken apart only as far as it is shared. There are at most 1 / least_share kept prefixes a length, and
    as many rarer ones behind each as there are classes of characters. Equal shapes are counted first, so a frequent credential
    is one row.
    """
    upper = F.translate("word", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdefghijklmnopqrstuvwxyz", "A" * 26 + "0" * 10 + "a" * 6 + "z" * 20)
    shapes = stored(words.select("kind", upper.alias("shape")).groupBy("kind", "shape").agg(F.count("*").alias("c")), "secret-shapes")
    total = shapes.groupBy("kind").agg(F.sum("c").alias("total"))
    out, done, rows = [], 0, shapes.withColumn("head", F.lit(""))
    while True:
        sizes = F.sequence(F.lit(done + 1 if done else 0), F.least(F.length("shape"), F.lit(done + step)))
        split = rows.where(F.length("shape") >= (done + 1 if done else 0)).select("kind", "c", "shape", "head", F.explode(sizes).alias("size"))
        prefix = F.concat("head", F.expr(f"substring(shape, {done + 1}, size - {done})"))
        counted = split.groupBy("kind", prefix.alias("prefix")).agg(
            F.sum("c").alias("n"), F.sum(F.when(F.col("size") == F.length("shape"), F.col("c")).otherwise(0)).alias("ends"))
        marked = stored(counted.join(total, "kind").select("kind", "prefix", "n", "ends", (F.col("n") >= F.col("total") * least_share).alias("kept")), "secret-prefixes")
        kept = marked.where("kept")
        parents = kept.select("kind", F.col("prefix").alias("_parent")).unionByName(rows.select("kind", F.col("head").alias("_parent")).distinct()).distinct()
        rarer = marked.where("not kept").withColumn("_parent", F.expr("substring(prefix, 1, length(prefix) - 1)")).join(parents, ["kind", "_parent"], "left_semi")
        out += kept.collect() + rarer.select("kind", "prefix", "n", "ends", "kept").collect()
        done += step
        heads = kept.where(F.length("prefix") == done).select("kind", F.col("prefix").alias("head"))
        if heads.isEmpty():
            return out
        rows = shapes.where(F.length("shape") > done).withColumn("head", F.substring("shape", 1, done)).join(heads, ["kind", "head"], "left_semi")


def automata_of(counts: list) -> dict[str, Automaton]:
    grouped: dict[str, tuple[dict, dict, dict]] = {}
    for r in sorted(counts, key=lambda r: (r.kind, len(r.prefix), r.prefix)):  # merging depends on the order
        n, ends, pruned = grouped.setdefault(r.kind, ({}, {}, {}))
        if r.kept:
            n[r.prefix], ends[r.prefix] = r.n, r.ends
        else:
            pruned[r.prefix] = r.n
    return {kind: Automaton(*grouped[kind]) for kind in sorted(grouped)}


def scan_secrets(docs: DataFrame, least_share: float = 2e-3, cut: float = 0.05, odds: float = 16.0) -> DataFrame:
    """Spans of secrets in every text: (doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans).

    The spans of the fixed patterns always stay. A candidate is added as kind `format` where its likelihood a character
    under one kind's automaton is at least the `cut` quantile of that kind's own strings, and its whole likelihood
    `odds` times that under the automaton of all candidates, so that longer strings need less a character. Candidates are whole
    runs of at least 16 credential characters with a letter and a digit that touch no base span; shorter runs and plain words are
    not scored, since a format says too little about them. Null texts count as empty (no spans, empty strings); a null doc_id
    stays null; repeated rows each have their result. If nothing is labelled nothing is added. Other columns are not
    looked at. Positions are code points, the end exclusive; spans are ordered by start, then kind as listed, `format` last.
    """
    found = stored(_found(docs), "secret-spans")
    labelled = found.select(F.explode("base").alias("s")).select("s.kind", "s.word")
    others = found.select(F.explode("others").alias("s")).select("s.kind", "s.word")
    automata = automata_of(prefix_counts(labelled.unionByName(others), least_share))
    around = automata.pop(GRAMMAR, None)

    def bits(batches):
        for batch in batches:
            found = [automata[k].bits(shape(w)) for k, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["kind", "bits"])

    cuts = {r.kind: r.cut for r in labelled.mapInArrow(bits, "kind string, bits double").groupBy("kind").agg(
        F.percentile_approx("bits", F.lit(cut), F.lit(1000)).alias("cut")).collect()} if automata else {}

    def accepted(word: str) -> bool:
        form = shape(word)
        rest = around.bits(form) if around else -1e9
        return any((b := automata[k].bits(form)) >= cuts[k] and (b - rest) * (len(form) + 1) >= math.log2(odds) for k in cuts)

    def result(batches):
        order = {k: i for i, k in enumerate((*KINDS, GRAMMAR))}
        for batch in batches:
            rows, known = [], {}
            for base, others in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base)
                added = []
                for s in others:
                    if s["word"] not in known:
                        known[s["word"]] = accepted(s["word"])
                    if known[s["word"]]:
                        added.append(s)
                spans = sorted(base + added, key=lambda s: (s["start"], order[s["kind"]]))
                kinds = Counter(s["kind"] for s in spans)
                rows.append((*[kinds[k] for k in (*KINDS, GRAMMAR)], hashlib.sha256(text.encode()).hexdigest(), ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2)]],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"])

    return found.select("doc_id", "base", "others").mapInArrow(result, "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string")
