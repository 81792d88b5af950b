"""Quality scores: random Fourier features over document statistics, ridge from partition sums, isotonic calibration.

Every text is read once for its statistics. They are standardised by means and deviations over all documents
and mapped to cosines of random projections, whose inner products approximate a Gaussian kernel. The normal
equations of the ridge fit are sums over partitions, so no row reaches the driver.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.kernels import bytes_in, lower_table, runs, slices, text_bytes, word_hashes
from tallyfold.llm.sums import calibrated, calibration, fold_of, summed_arrays
from tallyfold.llm.tables import stored

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_dev", "letters", "upper", "digits", "blanks", "breaks", "stops",
    "commas", "high_bytes", "other_marks", "bars", "exclaims", "marked_words", "distinct_words", "repeat_next", "top_word",
    "distinct_pairs", "line_words", "distinct_lines", "all_upper_words",
)
_LETTERS = bytes_in((65, 90), (97, 122), (128, 255))
_WORD = ~bytes_in((9, 13), (32, 32))
_LINE = ~bytes_in((10, 10))
_MARKS = bytes_in((33, 33), (35, 38), (42, 43), (60, 62), (64, 64), (91, 96), (123, 126))


def _distinct(owner, value, n):
    """Distinct values of each owner, and how often its most frequent one occurs."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    often = np.diff(np.append(at, len(o)))
    top = np.zeros(n)
    np.maximum.at(top, o[at], often)
    return np.bincount(o[at], minlength=n), top


def statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; all shares are 0 for a text without bytes or words."""
    n = len(ends) - 1
    size = np.diff(ends).astype(float)
    owner = np.repeat(np.arange(n), np.diff(ends))
    counts = lambda mask: np.bincount(owner, weights=mask[data], minlength=n)
    share = lambda x, whole: np.divide(x, whole, out=np.zeros(n), where=whole > 0)
    h, doc, starts, stops = word_hashes(lower_table()[data], ends, _WORD)
    words = np.bincount(doc, minlength=n).astype(float)
    length = (stops - starts).astype(float)
    mean = share(np.bincount(doc, weights=length, minlength=n), words)
    square = share(np.bincount(doc, weights=length * length, minlength=n), words)
    same = (doc[1:] == doc[:-1])
    next_same = np.bincount(doc[1:][same & (h[1:] == h[:-1])], minlength=n)
    pair_doc, pair = doc[1:][same], (h[:-1] * np.uint64(3) + h[1:])[same]
    distinct, top = _distinct(doc, h, n)
    pairs, _ = _distinct(pair_doc, pair, n)
    lines_h, lines_doc, *_ = word_hashes(data, ends, _LINE)
    lines = np.bincount(lines_doc, minlength=n).astype(float)
    distinct_lines, _ = _distinct(lines_doc, lines_h, n)
    marks = np.concatenate([[0], np.cumsum(_MARKS[data])])
    lowers = np.concatenate([[0], np.cumsum(bytes_in((97, 122), (128, 255))[data])])
    uppers = np.concatenate([[0], np.cumsum(bytes_in((65, 90))[data])])
    per_word = lambda mask: share(np.bincount(doc[mask], minlength=n).astype(float), words)
    return np.stack([
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(square - mean * mean, 0)),
        share(counts(_LETTERS), size), share(counts(bytes_in((65, 90))), size), share(counts(bytes_in((48, 57))), size),
        share(counts(bytes_in((9, 13), (32, 32))), size), share(counts(bytes_in((10, 10))), size), share(counts(bytes_in((46, 46))), size),
        share(counts(bytes_in((44, 44))), size), share(counts(bytes_in((128, 255))), size), share(counts(bytes_in((35, 38), (42, 42))), size),
        share(counts(bytes_in((124, 124))), size), share(counts(bytes_in((33, 33))), size),
        per_word(marks[stops] > marks[starts]), share(distinct, words), share(next_same, words), share(top, words),
        share(pairs, np.maximum(words - 1, 0)), np.log1p(share(words, lines)), share(distinct_lines, lines),
        per_word((uppers[stops] - uppers[starts] >= 2) & (lowers[stops] == lowers[starts])),
    ], axis=1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<double>) of every row, from the whole text."""
    def run(batches):
        for batch in batches:
            data, ends = text_bytes(batch.column(1))
            found = [statistics(data[ends[a]:ends[b]], ends[a:b + 1] - ends[a]) for a, b in slices(ends)]
            rows = np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.FixedSizeListArray.from_arrays(rows.ravel(), len(STATISTICS)).cast(pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


class Cosines:
    """Random Fourier features of a Gaussian kernel over standardised statistics."""

    def __init__(self, mean, deviation, size: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.turn = rng.normal(0, 1 / width, (len(mean), size))
        self.shift = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.deviation, -8, 8)
        z = np.cos(x @ self.turn + self.shift) * np.sqrt(2 / len(self.shift))
        return np.concatenate([np.ones((len(z), 1)), x / np.sqrt(x.shape[1]), z], axis=1)


def fit(train: DataFrame, mean, deviation, size: int, width: float, ridge: float, seed: int):
    """Ridge weights from (stats, label): one sum of outer products a partition, then a solve of fixed size."""
    cosines = Cosines(mean, deviation, size, width, seed)

    def sums(batches):
        gram = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                if part.num_rows:
                    z = cosines(_matrix(part.column(0)))
                    z = np.concatenate([z, np.asarray(part.column(1), float)[:, None]], axis=1)
                    gram = z.T @ z + (0 if gram is None else gram)
        if gram is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array(["gram"]), "data": pa.array([gram.tobytes()], pa.binary())})

    gram = summed_arrays(train.select("stats", "label").mapInArrow(sums, "key string, data binary"), float).get("gram")
    if gram is None:
        return cosines, None
    k = int(round(len(gram) ** 0.5))
    gram = gram.reshape(k, k)
    return cosines, np.linalg.solve(gram[:-1, :-1] + ridge * np.eye(k - 1), gram[:-1, -1])


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, cut: float = 0.3,
                   features: int = 256, width: float = 4.0, ridge: float = 1.0, seed: int = 11) -> DataFrame:
    """Score every document: (doc_id, held_out, score, predicted).

    Labels count only where the fold of doc_id is not 0 and the label is not null; a document labelled
    several times counts as often. Rows without doc_id are scored and never learnt from (held_out false).
    Null and empty texts have the statistics 0 and are scored like any other. Without a label all scores
    are 0.5. Repeated rows each get their score; other columns of either table are not looked at.
    """
    stats = stored(document_statistics(docs), "quality-statistics")
    k = len(STATISTICS)
    shape = stats.agg(*[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(k)],
                      *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(k)]).first()
    mean, deviation = (np.array([x or 0.0 for x in part]) for part in (shape[:k], shape[k:]))
    fold = fold_of(F.col("doc_id"), folds)
    marked = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where("label is not null")
    train = stats.join(marked, "doc_id").where(fold != 0)
    cosines, weights = fit(train, mean, deviation, features, width, ridge, seed)

    def raw_of(column):
        # the fit aims at 0 and 1; the margin leaves room for what lies outside
        return np.clip((cosines(_matrix(column)) @ weights + 1) / 3, 0, 1 - 1e-9)

    if weights is None:
        curve = np.array([0.0]), np.array([0.5])
    else:
        def raws(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(raw_of(batch.column(0))), batch.column(1)], ["raw", "label"])

        curve = calibration(train.select("stats", "label").mapInArrow(raws, "raw double, label int"))

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                found = np.full(batch.num_rows, 0.5) if weights is None else calibrated(raw_of(batch.column(1)), curve)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    return stats.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
