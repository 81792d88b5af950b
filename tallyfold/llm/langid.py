"""Language identification as mixture inference: each text is a mixture of languages, found by expectation-maximisation.

Byte trigrams of the labelled texts give one distribution a language (counts are sums over partitions). A text
is cut into short windows of trigrams; EM estimates from the windows' likelihoods which share each language has.
Sets of one, two, … languages are compared by their likelihood less a penalty for each language.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.kernels import bytes_in, lean, lower_table, slices, text_bytes
from tallyfold.llm.sums import fold_of, summed_arrays

BUCKETS = 1 << 15
WINDOW = 24
#: Bytes of text that are predicted at a time: a byte takes some numbers a language meanwhile.
PREDICTED_BYTES = 1 << 18
_FOLDED = np.where(bytes_in((65, 90), (97, 122), (128, 255)), lower_table(), 32).astype(np.uint8)


def trigrams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every byte trigram within a text; runs of blanks count once."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _FOLDED[data]
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    keep = (owner[2:] == owner[:-2]) & ~((b[:-2] == 32) & (b[1:-1] == 32)) & ~((b[1:-1] == 32) & (b[2:] == 32))
    code = (b[:-2].astype(np.uint64) << np.uint64(16)) | (b[1:-1].astype(np.uint64) << np.uint64(8)) | b[2:]
    bucket = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)
    return bucket[keep], owner[:-2][keep]


def language_counts(train: DataFrame) -> dict[str, np.ndarray]:
    """Trigram counts by language over all rows of (lang, text)."""
    def count(batches):
        total = {}
        for batch in batches:
            data, ends = text_bytes(batch.column(1))
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            at = np.array([names.index(x) for x in langs], np.int64)
            for a, b in slices(ends):
                bucket, owner = trigrams(data[ends[a]:ends[b]], ends[a:b + 1] - ends[a])
                found = np.bincount(at[a:b][owner] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for i in np.unique(at[a:b]).tolist():
                    total[names[i]] = total.get(names[i], 0) + found[i]
        yield pa.RecordBatch.from_pydict({"key": pa.array(total.keys(), pa.string()),
                                          "data": pa.array([v.astype(np.int64).tobytes() for v in total.values()], pa.binary())})

    return summed_arrays(train.select("lang", "text").mapInArrow(lean(count), "key string, data binary"), np.int64)


def _em(like: np.ndarray, unit_doc: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int):
    """Shares of languages by document after some rounds, and the logarithm of the mixture likelihood (like is scaled by window)."""
    for _ in range(rounds):
        weight = like * share[unit_doc]
        weight /= np.maximum(weight.sum(1, keepdims=True), 1e-300)
        share = np.add.reduceat(weight, starts)
        share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
    return share, np.add.reduceat(np.log(np.maximum((like * share[unit_doc]).sum(1), 1e-300)), starts)


def infer(bucket, owner, n: int, logs: np.ndarray, most: int, penalty: float):
    """Best language, its share and the number of languages of each of n documents; -1 without a trigram."""
    best, share_of, sizes = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
    if not len(bucket):
        return best, share_of, sizes
    begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    present = owner[begin]
    index = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
    unit = np.flatnonzero(index % WINDOW == 0)
    single = np.add.reduceat(logs[bucket], unit)
    unit_doc = np.searchsorted(present, owner[unit])
    starts = np.searchsorted(unit_doc, np.arange(len(present)))
    top = single.max(1)
    like = np.exp(single - top[:, None])
    base = np.add.reduceat(top, starts)
    langs, d = logs.shape[1], len(present)
    share, _ = _em(like, unit_doc, starts, np.full((d, langs), 1 / langs), 12)
    order = np.argsort(-share, axis=1, kind="stable")
    whole = np.add.reduceat(single, starts)
    order_one = whole.argmax(1)
    value, pick, part, count = whole[np.arange(d), order_one], order_one.copy(), np.ones(d), np.ones(d, np.int64)
    odds = np.exp(np.maximum(whole - whole.max(1, keepdims=True), -700))
    part = 1 / odds.sum(1)
    cost = penalty * np.log1p(np.diff(np.append(starts, len(unit_doc))))
    for k in range(2, min(most, langs) + 1):
        mask = np.zeros((d, langs))
        np.put_along_axis(mask, order[:, :k], 1 / k, 1)
        mixed, gain = _em(like, unit_doc, starts, mask, 8)
        now = gain + base - cost * (k - 1)
        better = now > value
        value = np.where(better, now, value)
        pick, part = np.where(better, mixed.argmax(1), pick), np.where(better, mixed.max(1), part)
        count = np.where(better, k, count)
    best[present], share_of[present], sizes[present] = pick, part, count
    return best, share_of, sizes


def identify_languages(docs: DataFrame, folds: int = 3, held: int = 1, most: int = 4, penalty: float = 4.0, smoothing: float = 0.5) -> DataFrame:
    """Add held_out, lang_pred, score and n_langs to every row of documents; their own columns stay.

    Learnt from rows with a text, a lang and a fold other than `held`. lang_pred is the language with the
    largest share in the chosen set, score that share (with one language: its probability among all single
    ones), n_langs the size of the set. Texts that are null or have no letter get `und`, score 0. A text too
    short for a trigram, or any if nothing could be learnt, gets the most frequent learnt language with its
    share of the labelled trigrams, or `und` if there is none. Rows without doc_id are predicted and never
    learnt from; repeated rows are treated alike. Columns that the caller has of these four names are replaced.
    """
    fold = fold_of(F.col("doc_id"), folds)
    counts = language_counts(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != held)))
    names = sorted(counts)
    if names:
        table = np.stack([counts[x] for x in names], axis=1) + smoothing
        logs = np.log(table / table.sum(0))
        common = int(np.argmax([counts[x].sum() for x in names]))
        usual = float(counts[names[common]].sum() / max(1, sum(c.sum() for c in counts.values())))
    added = {"held_out", "lang_pred", "score", "n_langs"}
    own = [c for c in docs.columns if c not in added]
    at = own.index("text")
    schema = docs.select(own).schema.add("lang_pred", "string").add("score", "double").add("n_langs", "integer")

    def predict(batches):
        for batch in batches:
            texts, rows = batch.column(at), batch.num_rows
            letters, lang, score, size = np.zeros(rows, bool), np.full(rows, -1), np.zeros(rows), np.zeros(rows, np.int64)
            data, ends = text_bytes(texts)
            for a, b in slices(ends, PREDICTED_BYTES):
                letters[a:b] = [bool(t) and any(map(str.isalpha, t)) for t in texts.slice(a, b - a).to_pylist()]
                if names:
                    bucket, owner = trigrams(data[ends[a]:ends[b]], ends[a:b + 1] - ends[a])
                    lang[a:b], score[a:b], size[a:b] = infer(bucket, owner, b - a, logs, most, penalty)
            if names:
                bare = letters & (lang < 0)
                lang[bare], score[bare], size[bare] = common, usual, 1
            lang[~letters], score[lang < 0], size[lang < 0] = -1, 0.0, 0
            score[~letters], size[~letters] = 0.0, 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([names[i] if i >= 0 else "und" for i in lang.tolist()], pa.string()),
                 pa.array(np.clip(score, 0, 1)), pa.array(size.astype(np.int32))],
                [*own, "lang_pred", "score", "n_langs"])

    return docs.select(own).mapInArrow(lean(predict), schema).withColumn("held_out", F.coalesce(fold == held, F.lit(False)))
