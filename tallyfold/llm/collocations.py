"""Phrases whose words belong together, by language: frequent phrases level by level, counted by double-array tries.

Words become codes once (a stored table of blocks). For phrases of 2, 3 and 4 words in turn: every place whose two shorter
phrases are frequent adds one to a hashed bucket, an upper bound of its phrase's count; phrases in buckets that reach
the least count are the candidates; they are built into double-array tries, with which every task walks all
positions of its blocks at once and counts accepting states; the counts of all blocks are added up.

Whatever grows with the data (vocabulary, buckets, tries) is cut into files of bounded size in the shared folder. A task reads
them one after the other and keeps a bounded number of bytes of them, so no broadcast and no worker holds them whole.
"""

import io
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.kernels import bytes_in, mixed, text_bytes, word_hashes
from tallyfold.llm.tables import small_batches, stored
from tallyfold.llm.tries import build_trie, walk
from tallyfold.llm.wordids import blank_slices
from tallyfold.operators.joins import lookup_join
from tallyfold.session import new_table_path

#: Rows of a file: words of the vocabulary, buckets, phrases of a trie.
FILE_ROWS = {"words": 500_000, "buckets": 4_000_000, "phrases": 50_000}
#: Codes of a stored block, and codes that a task walks at a time.
BLOCK_CODES, HELD_CODES = 1 << 19, 1 << 19
#: Bytes of such files that a worker keeps for its next blocks.
KEPT_BYTES = 24 << 20
BUCKET_BITS = 31

_ENDS = bytes_in((10, 13), *[(ord(c),) * 2 for c in ".,;:!?"])  # of pieces
_GAPS = _ENDS | bytes_in((9, 9), (32, 32))


# Files of arrays in the shared folder.

def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


_loaded: OrderedDict = OrderedDict()


def _arrays(path: str) -> dict[str, np.ndarray]:
    """Arrays of a file; the files used last stay in the worker."""
    if path not in _loaded:
        store, name = _opened(path)
        with store.open_input_stream(name) as f, np.load(io.BytesIO(f.read())) as found:
            _loaded[path] = dict(found)
        while len(_loaded) > 1 and sum(a.nbytes for x in _loaded.values() for a in x.values()) > KEPT_BYTES:
            _loaded.popitem(last=False)
    _loaded.move_to_end(path)
    return _loaded[path]


def _filed(rows: DataFrame, kind: str, order: list[str], build) -> list[tuple[int, int, str]]:
    """Sort rows by integer columns and write files of FILE_ROWS[kind] rows: (first, last value of the first column, path) of each.

    `build` makes a dict of arrays from the columns of a file. The list has one entry a file, so the driver sees file names only; a
    task that runs again writes new files, and those of its lost attempt are not listed.
    """
    folder, limit = new_table_path(rows.sparkSession, f"collocation-{kind}"), FILE_ROWS[kind]

    def run(batches):
        store, base = _opened(folder)
        store.create_dir(base, recursive=True)
        held, n = [], 0

        def written():
            data = pa.Table.from_batches(held).combine_chunks()
            first = data.column(0)
            buffer, name = io.BytesIO(), f"{uuid.uuid4().hex}.npz"
            np.savez(buffer, **build(data))
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(buffer.getbuffer())
            return pa.RecordBatch.from_pydict({"first": pa.array([first[0].as_py()], pa.int64()), "last": pa.array([first[-1].as_py()], pa.int64()), "path": pa.array([f"{folder}/{name}"])})

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, limit - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == limit:
                    yield written()
                    held, n = [], 0
        if held:
            yield written()

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted(tuple(r) for r in ordered.mapInArrow(run, "first long, last long, path string").collect())


# Words and codes.

def _words_of(column: pa.Array):
    """Words of all texts, slice by slice: (distinct words as bytes, word of each place, text of each place, whether a piece begins there)."""
    data, ends = text_bytes(column)
    owner_before, ended = -1, False
    for low, high in blank_slices(data, ends, 1 << 20):
        part = data[low:high]
        part = part + (((part >= 65) & (part <= 90)).astype(np.uint8) << 5)
        solid = ~_GAPS[part]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        heads = ends[np.searchsorted(ends, low):np.searchsorted(ends, high)] - low
        heads = heads[heads < len(part)]
        begins[heads] = solid[heads]
        starts = np.flatnonzero(begins)
        pieces = np.cumsum(_ENDS[part])
        if not len(starts):
            ended |= bool(len(pieces) and pieces[-1])
            continue
        place = np.zeros(len(part) + 1, np.int32)
        np.cumsum(solid, out=place[1:])
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(place[starts], place[-1]).astype(np.int32)), pa.py_buffer(part[solid])]).dictionary_encode()
        owner = np.searchsorted(ends, starts + low, "right") - 1
        fresh = np.ones(len(starts), bool)
        fresh[0] = ended or pieces[starts[0]] > 0 or owner[0] != owner_before
        fresh[1:] = (pieces[starts[1:]] != pieces[starts[:-1]]) | (owner[1:] != owner[:-1])
        owner_before, ended = owner[-1], bool(pieces[-1] != pieces[starts[-1]])
        yield words.dictionary, np.asarray(words.indices), owner, fresh


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) over (lang, text); counts of a slice are added up before they leave the task."""
    def run(batches):
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            lang_of = np.asarray(langs.indices)
            for words, index, owner, _ in _words_of(batch.column(1)):
                keys, n = np.unique(lang_of[owner].astype(np.int64) * len(words) + index, return_counts=True)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(keys // len(words))), words.take(pa.array(keys % len(words))).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered_words(frequent: DataFrame) -> DataFrame:
    """Add `code`, from 0 in the order of (lang, word): rows are numbered inside sorted partitions, whose sizes give the offsets."""
    place = F.monotonically_increasing_id()
    rows = stored(frequent.repartitionByRange("lang", "word").sortWithinPartitions("lang", "word").select("lang", "word", "n", place.alias("_place")), "collocation-sorted")
    rows = rows.select("lang", "word", "n", F.shiftright("_place", 33).alias("_part"), F.col("_place").bitwiseAND((1 << 33) - 1).alias("_row"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return stored(rows.join(sizes, "_part").select("lang", "word", "n", (F.col("_before") + F.col("_row")).cast("int").alias("code")), "collocation-words")


def _keys(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """64-bit hashes of words in their languages, not negative."""
    def hashed(strings):
        data, ends = text_bytes(strings.cast(pa.binary()).cast(pa.string()) if strings.type == pa.binary() else strings)
        out = np.full(len(strings), np.uint64(1))
        h, owner, *_ = word_hashes(data, ends, np.ones(256, bool))
        out[owner] = h
        return out

    return (mixed(hashed(words) ^ mixed(hashed(langs) + np.uint64(7))) >> np.uint64(1)).astype(np.int64)


def _word_files(words: DataFrame):
    """Files of (key, code, lang and word as bytes), sorted by key."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_keys(batch.column(0), batch.column(1))), batch.column(2), pc.binary_join_element_wise(batch.column(0), batch.column(1), "\t")], ["key", "code", "name"])

    def build(data):
        names = data.column(2).combine_chunks().cast(pa.large_binary()) if data.num_rows else pa.array([], pa.large_binary())
        _, offsets, raw = names.buffers()
        ends = np.frombuffer(offsets, np.int64)[names.offset:names.offset + len(names) + 1]
        return {"key": np.asarray(data.column(0)), "code": np.asarray(data.column(1)), "ends": ends - ends[0], "names": np.frombuffer(raw or b"", np.uint8)[ends[0]:ends[-1]]}

    return _filed(words.select("lang", "word", "code").mapInArrow(run, "key long, code int, name string"), "words", ["key"], build)


def _codes(files, langs: pa.Array, words: pa.Array) -> np.ndarray:
    """Code of each (language, word), -1 for those that are not in the files; found by hash and then compared."""
    keys = _keys(langs, words)
    names = pc.binary_join_element_wise(langs.cast(pa.binary()), words, b"\t")
    out = np.full(len(keys), -1, np.int32)
    for first, last, path in files:
        mine = np.flatnonzero((keys >= first) & (keys <= last))
        if not len(mine):
            continue
        held = _arrays(path)
        stored_names = pa.Array.from_buffers(pa.large_binary(), len(held["key"]), [None, pa.py_buffer(held["ends"]), pa.py_buffer(held["names"])])
        at = np.searchsorted(held["key"], keys[mine])
        while len(mine):  # words of one hash lie side by side
            inside = at < len(held["key"])
            mine, at = mine[inside], at[inside]
            near = held["key"][at] == keys[mine]
            mine, at = mine[near], at[near]
            if not len(mine):
                break
            same = np.asarray(pc.equal(stored_names.take(pa.array(at)), names.take(pa.array(mine)).cast(pa.large_binary())), bool)
            out[mine[same]] = held["code"][at[same]]
            mine, at = mine[~same], at[~same] + 1
    return out


def coded_blocks(texts: DataFrame, files) -> DataFrame:
    """(codes binary): blocks of 32-bit codes, with -1 where a piece begins and for other words; nothing follows -1 -1."""
    def run(batches):
        held, n = [], 0
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            lang_of = np.asarray(langs.indices)
            for words, index, owner, fresh in _words_of(batch.column(1)):
                keys, places = np.unique(lang_of[owner].astype(np.int64) * len(words) + index, return_inverse=True)
                found = _codes(files, langs.dictionary.take(pa.array(keys // len(words))), words.take(pa.array(keys % len(words))))[places]
                codes = np.insert(found, np.flatnonzero(fresh), -1)
                twice = np.zeros(len(codes), bool)
                twice[1:] = (codes[1:] < 0) & (codes[:-1] < 0)
                held.append(codes[~twice])
                n += len(held[-1])
            if n >= BLOCK_CODES:  # whole batches only, so that no piece is cut
                yield pa.RecordBatch.from_pydict({"codes": pa.array([np.concatenate(held).tobytes()], pa.binary())})
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_pydict({"codes": pa.array([np.concatenate(held).tobytes()], pa.binary())})

    return stored(texts.mapInArrow(run, "codes binary"), "collocation-codes")


# Levels.

def _block_groups(batches, k: int):
    """Codes of several blocks at a time, with k times -1 behind each."""
    gap, held, n = np.full(k, -1, np.int32), [], 0
    for batch in batches:
        for data in batch.column(0):
            held += [np.frombuffer(data.as_buffer(), np.int32), gap]
            n += len(held[-2])
            if n >= HELD_CODES:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _walked(files, codes: np.ndarray):
    """(trie, positions, phrase at each) for every file of tries; a file is walked from the positions of its first words only."""
    at = np.flatnonzero(codes >= 0)
    if len(files) > 1:
        at = at[np.argsort(codes[at], kind="stable")]
        heads = codes[at]
    for first, last, path in files:
        mine = at if len(files) == 1 else np.sort(at[np.searchsorted(heads, first):np.searchsorted(heads, last, "right")])
        if len(mine):
            trie = _arrays(path)
            yield trie, *walk(trie, codes, mine)


def _safe_places(files, codes: np.ndarray, k: int) -> np.ndarray:
    """Positions whose first and last k-1 of k words are frequent phrases."""
    frequent = codes >= 0
    if k > 2:
        frequent = np.zeros(len(codes), bool)
        for _, at, _ in _walked(files, codes):
            frequent[at] = True
    return np.flatnonzero(frequent[:-1] & frequent[1:])


def _bucket(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = mixed(h * np.uint64(31) + codes[at + j].astype(np.uint64) + np.uint64(1))
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _merged(held):
    """Distinct keys and summed counts of several (keys, counts)."""
    keys, places = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    return keys, np.bincount(places, np.concatenate([c for _, c in held])).astype(np.int64)


def safe_buckets(blocks: DataFrame, files, k: int, least: int):
    """Files of the buckets whose count reaches `least`: no phrase of k words that is as frequent lies outside them."""
    def run(batches):
        held, n = [], 0
        for codes in _block_groups(batches, k):
            held.append(np.unique(_bucket(codes, _safe_places(files, codes, k), k), return_counts=True))
            n += len(held[-1][0])
            if n > 3 << 19:
                held = [_merged(held)]
                n = len(held[0][0])
                if n > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["bucket", "n"])
                    held, n = [], 0
        if n:
            keys, counts = _merged(held)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["bucket", "n"])

    sums = blocks.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return _filed(sums.where(F.col("n") >= least).select("bucket"), "buckets", ["bucket"], lambda data: {"bucket": np.asarray(data.column(0))})


def _columns(k: int) -> list[str]:
    return [f"c{j}" for j in range(k)]


def candidates(blocks: DataFrame, buckets, k: int) -> DataFrame:
    """Distinct phrases (c0 .. ck-1) that lie in the given buckets."""
    def run(batches):
        for codes in _block_groups(batches, k):
            inside = np.convolve(codes >= 0, np.ones(k, int))[k - 1:len(codes)] == k  # k codes from here on
            at = np.flatnonzero(inside)
            bucket = _bucket(codes, at, k)
            known = np.zeros(len(at), bool)
            for first, last, path in buckets:
                have = _arrays(path)["bucket"]
                known |= have[np.minimum(np.searchsorted(have, bucket), len(have) - 1)] == bucket
            at = at[known]
            if len(at):
                found = np.unique(np.stack([codes[at + j] for j in range(k)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], _columns(k))

    return blocks.mapInArrow(run, ", ".join(f"{c} int" for c in _columns(k))).distinct()


def trie_files(phrases: DataFrame, k: int, shape: tuple[int, int]):
    return _filed(phrases.select(_columns(k)), "phrases", _columns(k), lambda data: build_trie(np.stack([np.asarray(c) for c in data.columns], 1), *shape))


def phrase_counts(blocks: DataFrame, files, k: int) -> DataFrame:
    """(c0 .. ck-1, n): accepting states of all tries counted over all positions, added up over blocks."""
    def run(batches):
        for codes in _block_groups(batches, k):
            for trie, _, phrase in _walked(files, codes):
                n = np.bincount(phrase, minlength=len(trie["phrases"]))
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in trie["phrases"][seen].T], pa.array(n[seen], pa.int64())], [*_columns(k), "n"])

    return blocks.mapInArrow(run, ", ".join(f"{c} int" for c in _columns(k)) + ", n long").groupBy(_columns(k)).agg(F.sum("n").alias("n"))


def frequent_phrases(blocks: DataFrame, vocabulary: int, longest: int, least: int) -> list[DataFrame]:
    """Phrases of 2 .. `longest` words with their counts, where the count reaches `least`; one stored table a length."""
    bits = max(1, (vocabulary - 1).bit_length())
    per_code = -(-bits // 8)
    shape, files, out = (-(-bits // per_code), per_code), [], []
    for k in range(2, longest + 1):
        buckets = safe_buckets(blocks, files, k, least)
        tries = trie_files(candidates(blocks, buckets, k), k, shape) if buckets else []
        if not tries:
            break
        out.append(stored(phrase_counts(blocks, tries, k).where(F.col("n") >= least), f"collocation-phrases-{k}"))
        if k < longest:
            files = trie_files(out[-1], k, shape)
            if not files:
                break
    return out


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, per_lang: int = 2000, cover: int = 80) -> DataFrame:
    """The first `per_lang` phrases of each language: lang, rank, phrase, a, l, r, n, score (all counts 64 bits).

    Texts are cut at .,;:!? and line ends into pieces and those at blanks into words; a phrase is 2 to `longest` words of a piece
    that occur `least` times. A phrase's score is that of its worst cut, floor(2000000 * a / (l + r)); one that mostly (`cover`
    in a hundred) stands inside a longer phrase goes. Null languages are `und`, null texts empty. Every row counts, also repeated
    ones and those without doc_id; columns other than lang and text are not looked at. Empty tables give no rows. Scores are
    computed in decimals, so no product overflows. A word must not be longer than 2^31 bytes.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        return _collocations(spark, docs, least, longest, per_lang, cover)


def _collocations(spark, docs, least, longest, per_lang, cover):
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = stored(word_counts(texts), "collocation-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    words = numbered_words(counts.where(F.col("n") >= least))
    size = words.count()
    found = frequent_phrases(coded_blocks(texts, _word_files(words)), size, longest, least) if size else []
    if not found:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    phrases = [t.select(F.array(_columns(k)).alias("key"), F.col("n").alias("a")) for k, t in enumerate(found, 2)]
    known = words.select(F.array("code").alias("key"), F.col("n").alias("a"))
    for t in phrases:
        known = known.unionByName(t)
    all_phrases = phrases[0]
    for t in phrases[1:]:
        all_phrases = all_phrases.unionByName(t)

    key, long_ = F.col("key"), "decimal(20,0)"
    cuts = all_phrases.select("key", "a", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("cut"))
    cuts = cuts.withColumn("left", F.slice("key", F.lit(1), F.col("cut"))).withColumn("right", F.slice("key", F.col("cut") + 1, F.size("key")))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = lookup_join(cuts, known.select(key.alias(side), F.col("a").alias(name)), [side])
    score = F.expr(f"(cast(a as {long_}) * 2000000) div (cast(l as {long_}) + cast(r as {long_}))")
    worst = cuts.groupBy("key").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("w"))

    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.size("key") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size(key) - m + 1), lambda s: F.slice(key, s, m))))
    inside = all_phrases.where(F.size("key") > 2).select(F.explode(parts).alias("key"), F.col("a").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
    held = lookup_join(worst, inside, ["key"], "left").where(F.expr(f"longer is null or cast(longer as {long_}) * 100 < cast(a as {long_}) * {int(cover)}"))

    rows = held.select("key", "a", "w.score", "w.l", "w.r")
    names = words.select("code", "lang", "word")
    for j in range(longest):
        rows = rows.withColumn("code", F.get("key", F.lit(j)))
        rows = lookup_join(rows, names.select("code", F.col("word").alias(f"w{j}"), *(["lang"] if j == 0 else [])), ["code"], "left").drop("code")
    rows = rows.withColumn("phrase", F.concat_ws(" ", *[f"w{j}" for j in range(longest)]))
    # One language may hold most phrases: the first of each of 64 shares of it are found before they meet.
    def leading(df, *keys):
        order = Window.partitionBy("lang", *keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang)

    first = leading(leading(rows.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64))), "_share"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
