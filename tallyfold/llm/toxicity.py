"""Toxicity from a weighted lexicon, matched by Aho-Corasick over folded texts.

Folding undoes capitals, look-alike letters and digits that stand for letters. The lexicon (words, and
beginnings of words) and the phrases that excuse a word are learnt from labelled rows; the sum of weights is
normalised by length and calibrated against the labels.
"""

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.sums import calibrated, calibration, fold_of
from tallyfold.llm.tables import stored

# Letters of other alphabets that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ℓ": "l",
}
# Digits and signs that stand for letters inside a word.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}

_SIGN = re.compile(r"(?<=[^\W_])[0134578@$!|]+(?=[^\W_])|[0134578@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578]+")
_STAND_INS = str.maketrans(STAND_INS)
_LOOKALIKES = str.maketrans(LOOKALIKES)
_GAPS = re.compile(r"[\W_]+")
_UNSEEN = re.compile("[­​-‏⁠﻿]+")


def folded(text: str) -> str:
    """Words in one folded spelling, one blank between and around them."""
    text = text.lower()
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text)).translate(_LOOKALIKES)
    text = _SIGN.sub(lambda m: m.group().translate(_STAND_INS), text)
    return f" {_GAPS.sub(' ', text).strip()} "


def terms_of(words, stems=(4, 5, 6)) -> set[str]:
    """Patterns of a document's words: ' word ' as a whole, ' wor' as the beginning of a longer one."""
    out = set()
    for w in words:
        out.add(f" {w} ")
        for n in stems:
            if len(w) > n:
                out.add(" " + w[:n])
    return out


def _counted(sample: DataFrame, terms) -> DataFrame:
    """(term, pos, neg): documents of either label that hold each term; counts are added up in the task first."""
    def run(batches):
        found = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[label].update(terms(folded(text or "")))
        names = list(found[0].keys() | found[1].keys())
        for at in range(0, len(names), 50_000):
            part = names[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([found[k][x] for x in part], pa.int64()) for k in (1, 0)]], ["term", "pos", "neg"])

    return sample.select("text", "label").mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn_lexicon(sample: DataFrame, size: int, support: int = 4) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of terms and of excusing phrases, from (text, label).

    A term enters if the lower end (1.64 deviations) of its log odds is above 1; at most `size` of the clearest.
    A phrase of a term's word with the word before or after it excuses that word if the same lower end shows
    that it stands in clean documents.
    """
    totals = sample.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in totals}
    if not n.get(1) or not n.get(0):
        return {}, {}

    def odds(pos, neg):
        a, b = (pos + 0.5) / (n[1] - pos + 0.5), (neg + 0.5) / (n[0] - neg + 0.5)
        dev = math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        return math.log(a / b), dev

    log_odds = F.log((F.col("pos") + 0.5) / (n[1] - F.col("pos") + 0.5)) - F.log((F.col("neg") + 0.5) / (n[0] - F.col("neg") + 0.5))
    deviation = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = (_counted(sample, lambda t: terms_of(set(t.split()))).where(F.col("pos") >= support)
            .withColumn("low", log_odds - 1.64 * deviation).where("low > 1").orderBy(F.desc("low"), "term").limit(size).collect())
    lexicon = {r.term: odds(r.pos, r.neg)[0] for r in best}
    if not lexicon:
        return {}, {}

    def phrases(text):
        words = text.split()
        hit = [f" {w} " in lexicon or any(" " + w[:k] in lexicon for k in (4, 5, 6) if len(w) > k) for w in words]
        return {f" {words[i]} {words[i + 1]} " for i in range(len(words) - 1) if hit[i] or hit[i + 1]}

    found = _counted(sample, phrases).where(F.col("neg") >= support).withColumn("low", -log_odds - 1.64 * deviation).where("low > 0")
    excuses = {r.term: 1.0 for r in found.orderBy(F.desc("low"), "term").limit(size).collect()}
    return lexicon, excuses


class Matcher:
    """Weights found in a folded text; each word counts once, by its heaviest pattern, unless a phrase excuses it."""

    def __init__(self, lexicon: dict[str, float], excuses: dict[str, float]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.machine.add_word(term, (len(term), weight))
        for phrase in excuses:
            if phrase not in lexicon:
                self.machine.add_word(phrase, (len(phrase), -1.0))
        self.empty = len(self.machine) == 0
        if not self.empty:
            self.machine.make_automaton()

    def total(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        if self.empty:
            return 0.0, []
        words, excused = {}, []
        for end, (length, weight) in self.machine.iter(text):
            start = end - length + 1
            if weight < 0:
                excused.append((start, end))
            elif weight > words.get(start, (0, 0))[0]:
                words[start] = (weight, end)
        spans = [(s, e, w) for s, (w, e) in sorted(words.items()) if not any(a <= s < b for a, b in excused)]
        return sum(w for *_, w in spans), spans


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, cut: float = 0.5,
                    max_labelled: int = 20_000, size: int = 4_000, lexicon: dict[str, float] | None = None, exceptions=()) -> DataFrame:
    """Score every document: (doc_id, held_out, score, predicted, n_hits).

    The lexicon is fitted on at most `max_labelled` rows of each label (those whose ids hash lowest; a documented
    bound) from folds other than 0; the calibration uses all labelled rows of those folds. `lexicon` and `exceptions`
    are added to what is learnt, in folded spelling. Weights of a text are summed and divided by the logarithm of its
    number of words, so that long texts need more. Null and empty texts score as texts without a hit. Rows without
    doc_id are scored and never learnt from; null labels are left out, repeated ones count again. Without usable
    labels all scores are 0.5. Other columns are not looked at.
    """
    fold = fold_of(F.col("doc_id"), folds)
    marked = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where("label in (0, 1)").where(fold != 0)
    lowest = None
    for value in (1, 0):
        part = marked.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
        lowest = part if lowest is None else lowest.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sample = stored(texts.join(lowest, "doc_id").select("text", "label"), "toxicity-sample")
    learnt, excuses = learn_lexicon(sample, size)
    matcher_of = (learnt | {f" {k.strip()} ": v for k, v in (lexicon or {}).items()}, excuses | {f" {k.strip()} ": 1.0 for k in exceptions})

    def run(batches):
        matcher = Matcher(*matcher_of)
        for batch in batches:
            raw, hits = [], []
            for text in batch.column(1):
                text = folded(text.as_py() or "")
                total, spans = matcher.total(text)
                hits.append(len(spans))
                raw.append(total / math.log2(8 + text.count(" ")))
            raw = np.array(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw / (1 + raw)), pa.array(hits, pa.int32())], ["doc_id", "raw", "n_hits"])

    raws = stored(texts.mapInArrow(run, "doc_id long, raw double, n_hits int"), "toxicity-raw")
    curve = calibration(raws.join(marked, "doc_id").select("raw", "label"))

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(calibrated(np.asarray(batch.column(1), float), curve)), batch.column(2)], ["doc_id", "score", "n_hits"])

    return raws.mapInArrow(score, "doc_id long, score double, n_hits int").select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "n_hits")
