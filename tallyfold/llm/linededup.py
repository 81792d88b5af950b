"""Line dedup within an edit distance, with DataFrame functions alone.

A line is cut into threshold + 1 segments. Lines within the threshold share a segment up to a shift, so each line is
indexed under its segments together with its length, and probes the segments that lines as long or a little shorter
could have. What meets is verified by a banded bit-parallel edit distance.

A bucket is not expanded into all its pairs: first its earliest lines meet all others, which decides most lines of a
group of copies; only lines that are still undecided meet the earlier ones of their bucket. A large bucket is first
divided by segments of what lies outside the common one, and what is still large again, until the buckets are small or
what is left of a line is no longer than the threshold.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.tables import stored
from tallyfold.operators.joins import lookup_join

#: Rows of a table of line ids up to which it is sent to all executors (some 10 MB); beyond, both sides are shuffled.
SENT_ROWS = 300_000
#: Buckets of more lines are divided by further segments; the pairs that are found are the same at any number.
LARGE = 16


def within_edits(x: Column, y: Column, threshold: int) -> Column:
    """Whether at most `threshold` edits (code points) turn x into y.

    Bit d of word j, for the diagonals -threshold..threshold, says whether the first i + d characters of x are within
    j edits of the first i of y; each character of y moves all diagonals of a word at once.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    a, b = F.split(x, ""), F.split(y, "")
    # split() of an empty text gives one empty element
    size = lambda t: F.char_length(t)
    start = F.struct(*[F.lit(sum(1 << (d + threshold) for d in range(j + 1))).cast("long").alias(f"w{j}") for j in range(threshold + 1)])

    def step(s, p):
        c = p["c"]
        same = reduce(lambda u, v: u.bitwiseOR(v), [F.when(F.get(p["near"], F.lit(d)) == c, F.lit(1 << d)).otherwise(F.lit(0)).cast("long") for d in range(width)])
        words = [s["w0"].bitwiseAND(same)]
        for j in range(1, threshold + 1):
            before = s[f"w{j - 1}"]
            words.append(s[f"w{j}"].bitwiseAND(same).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(words[j - 1], 1)).bitwiseAND(F.lit(full).cast("long")))
        return F.struct(*[w.alias(f"w{j}") for j, w in enumerate(words)])

    # characters of x that stand within the band of each character of y
    edge = F.array(*[F.lit("").cast("string")] * threshold) if threshold else F.array().cast("array<string>")
    padded = F.concat(edge, a, edge)
    band = F.transform(b, lambda c, i: F.struct(c.alias("c"), F.slice(padded, i + 1, width).alias("near")))
    last = F.aggregate(band, start, step, lambda s: s[f"w{threshold}"])
    end = F.getbit(last, F.greatest(F.lit(0), F.least(F.lit(width - 1), size(x) - size(y) + threshold))) == 1
    short = F.greatest(size(x), size(y)) <= threshold
    return F.when(F.abs(size(x) - size(y)) > threshold, False).when(short, True).when((size(x) == 0) | (size(y) == 0), False).otherwise(end)


def _common_start(x: Column, y: Column) -> Column:
    """How many code points x and y begin with in common: lengths of falling powers of two are tried."""
    room = F.least(F.char_length(x), F.char_length(y))
    steps = F.transform(F.sequence(F.floor(F.log2(F.greatest(room, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda p: F.pow(F.lit(2), p).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda k, s: F.when((k + s <= room) & (F.substring(x, k + 1, s) == F.substring(y, k + 1, s)), k + s).otherwise(k))


def middles(x: Column, y: Column) -> Column:
    """x and y without their common beginning and then without their common end, as a struct (a, b) of the same edit distance."""
    def let(value, body):
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def turned(u, v):
        left = lambda t, k: F.reverse(F.substring(t, k + 1, F.char_length(t)))
        return let(_common_start(u, v), lambda k: F.struct(left(u, k).alias("a"), left(v, k).alias("b")))

    return let(turned(x, y), lambda m: turned(m["a"], m["b"]))


def _segment(n: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of a line of length n; the later ones are one longer where it does not divide."""
    base = F.floor(n / parts).cast("int")
    plain = F.lit(parts) - n % parts
    return F.lit(i) * base + F.greatest(F.lit(0), F.lit(i) - plain), base + F.when(F.lit(i) >= plain, 1).otherwise(0)


def segment_keys(line: Column, threshold: int, *before: Column) -> list[tuple[int, int, Column, Column, Column]]:
    """(delta, shift, key, start, length) of every segment that a line is indexed under (delta and shift 0) or probes in
    lines that are delta shorter.

    Segments it is indexed under are probed too, by lines of the same length at the same place; the rest are probes
    only: those at shifted places, and those of lines that are up to `threshold` characters shorter.
    """
    size, parts, out = F.char_length(line), threshold + 1, []
    for delta in range(threshold + 1):
        n = size - delta
        for i in range(parts):
            at, length = _segment(n, i, parts)
            for off in range(max(-i, delta - (threshold - i)), min(i, delta + threshold - i) + 1):
                start = at + off
                fits = (n > 0) & (start >= 0) & (start + length <= size)
                key = F.xxhash64(*before, n, F.lit(i), F.substring(line, start + 1, length))
                out.append((delta, off, F.when(fits, key), start, length))
    return out


def may_be_within(x: Column, y: Column, threshold: int, pieces: int) -> Column:
    """False only if no `threshold` edits turn x into y: each edit touches one of the pieces that x is cut into, and shifts
    the rest by one place at most, so all but `threshold` of them must stand in y near their place. A few substring
    searches, which spare most pairs the distance."""
    size, found = F.char_length(x), []
    for i in range(pieces):
        at, length = _segment(size, i, pieces)
        low = F.greatest(F.lit(1), at + 1 - threshold)
        found.append(F.when(F.contains(F.substring(y, low, at + 1 + length + threshold - low), F.substring(x, at + 1, length)), 1).otherwise(0))
    return reduce(lambda a, b: a + b, found) >= pieces - threshold


def _ids(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, pos, line, h1, h2, at): every line. `at` orders lines by doc_id (null last) and position, and names them.

    Its last seven digits come from the line's hash, for rows without id or with an id that other texts have too.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("pos", "line"))
    digits = lambda c, n: c.cast(f"decimal({n},0)")
    doc = digits(F.coalesce(digits(F.col("doc_id"), 19), digits(F.lit("9223372036854775808"), 19)), 19)
    hashed = text.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.concat("line", F.lit("#"))).alias("h2"))
    low = digits(F.col("pos").cast("long") * 10_000_000 + F.pmod("h1", F.lit(10_000_000)), 18)
    return hashed.select("*", digits(doc * digits(F.lit("21474836480000000"), 18) + low, 38).alias("at"))


def _victims(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(at) of the later line x of every pair (x, y) that is within the threshold."""
    named = lambda tag: texts.select(F.col("at").alias(tag), F.col("line").alias(f"{tag}_line"))
    joined = lookup_join(lookup_join(pairs, named("x"), ["x"]), named("y"), ["y"])
    # behind a generator, so that what two lines have in common is cut off once a pair
    cut = joined.select("x", F.explode(F.array(middles(F.col("x_line"), F.col("y_line")))).alias("m")).select("x", "m.a", "m.b")
    cut = cut.where(may_be_within(F.col("a"), F.col("b"), threshold, 4 * (threshold + 1)))
    return cut.where(within_edits(F.col("a"), F.col("b"), threshold)).select(F.col("x").alias("at")).distinct()


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(at, line) of the wanted lines, each from the place where it first stands."""
    return _lines(docs).join(_ids(wanted.select("at").distinct()), "at").select("at", "line").dropDuplicates(["at"])


def _outside(line: Column, start: Column, length: Column) -> Column:
    return F.concat(F.substring(line, F.lit(1), start), F.substring(line, start + length + 1, F.char_length(line)))


def _divided(wide: DataFrame, threshold: int) -> DataFrame:
    """(key, index, at, open) of the buckets that large ones, (key, index, at, open, delta, rest), are divided into.

    Lines of a bucket share a segment, so their edits lie in the rest, and the rests share a segment again. All indexed
    rests of a bucket are of one length, which each round takes down to threshold / (threshold + 1) of it at most, so the
    number of rounds is the logarithm of the longest line. A line stays in a large bucket only for the segments that many
    share, so its rows grow with the rounds and not with the bucket. Buckets without an undecided line are left out.
    """
    done = None
    while done is None or not wide.isEmpty():
        keys = segment_keys(F.col("rest"), threshold, F.col("key"))
        parts = [F.when(F.col("delta") == delta, F.struct(key.alias("key"), (F.col("index") & F.lit(off == 0)).alias("index"), _outside(F.col("rest"), start, length).alias("rest")))
                 for delta, off, key, start, length in keys]
        rows = wide.select("at", "open", "delta", F.explode(F.array_compact(F.array(*parts))).alias("part")).select("at", "open", "delta", "part.*").where("key is not null")
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.bool_or("open").alias("any_open"), F.bool_or("index").alias("any_index")).where("size > 1 and any_open and any_index")
        met = stored(lookup_join(rows, sizes.select("key", "size"), ["key"]), "line-divided")
        last = (F.col("size") <= LARGE) | (F.char_length("rest") - F.col("delta") <= threshold)
        small = met.where(last).select("key", "index", "at", "open")
        done = small if done is None else done.unionByName(small)
        wide = met.where(~last).select("key", "index", "at", "open", "delta", "rest")
    return done


def near_lines(docs: DataFrame, threshold: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Distinct lines of at least `least` characters (h1, h2, at of the first, count c), and the `at` of those near an earlier one."""
    lines = _lines(docs).where(F.char_length("line") >= least)
    keys = segment_keys(F.col("line"), threshold)
    # a line's keys follow from the line, so the smallest of a group is that of any; only numbers go through the shuffle
    distinct = lines.select("h1", "h2", "at", *[k.alias(f"k{i}") for i, (_, _, k, *_) in enumerate(keys)]).groupBy("h1", "h2").agg(
        F.min("at").alias("at"), F.count("*").alias("c"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(len(keys))])
    distinct = stored(distinct, "line-keys")
    indexed = [i for i, (delta, off, *_) in enumerate(keys) if delta == off == 0]
    rows = distinct.select("at", F.posexplode(F.array(*[f"k{i}" for i in range(len(keys))])).alias("i", "key")).where("key is not null").withColumn("index", F.col("i").isin(indexed))
    # a bucket counts if it has an indexed line and another line
    heads = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.when(F.col("index"), F.col("at"))).alias("head"), F.min("at").alias("first")).where("size > 1 and head is not null")
    met = stored(lookup_join(rows, heads, ["key"]), "line-buckets")
    pair = lambda other: (F.greatest("at", other).alias("x"), F.least("at", other).alias("y"))
    star = met.where("at <> head").select(*pair("head")).unionByName(met.where("index and at <> first").select(*pair("first")))
    star = stored(star.distinct(), "line-star")
    texts = stored(_texts(docs, met), "line-texts")
    decided = stored(_victims(star, texts, threshold), "line-decided")
    # lines that are still undecided meet the earlier lines of their bucket
    left = met.select("key", "index", "i", "size", "at").join(decided.withColumn("gone", F.lit(True)), "at", "left").withColumn("open", F.col("gone").isNull()).drop("gone")
    left = lookup_join(left, left.where("open").select("key").distinct(), ["key"])
    both = left.where(F.col("size") <= LARGE).select("key", "index", "at", "open")
    wide = lookup_join(left.where(F.col("size") > LARGE), texts, ["at"])
    of_key = lambda value: reduce(lambda c, p: c.when(F.col("i") == p[0], value(p[1])), list(enumerate(keys))[1:], F.when(F.col("i") == 0, value(keys[0])))
    rest = _outside(F.col("line"), of_key(lambda k: k[3]), of_key(lambda k: k[4]))
    wide = stored(wide.select("key", "index", "at", "open", of_key(lambda k: F.lit(k[0])).alias("delta"), rest.alias("rest")), "line-large")
    both = both.unionByName(_divided(wide, threshold))
    x, y = both.where("open").select("key", F.col("at").alias("x"), F.col("index").alias("x_index")), both.select("key", F.col("at").alias("y"), F.col("index").alias("y_index"))
    pairs = x.join(y, "key").where("y < x and (x_index or y_index)").select("x", "y").distinct().join(star, ["x", "y"], "left_anti")
    return distinct.select("h1", "h2", "at", "c"), decided.unionByName(_victims(pairs, texts, threshold)).distinct()


def dedup_lines(docs: DataFrame, threshold: int = 1, least: int = 20) -> DataFrame:
    """Documents without repeated lines: all their columns, the text without the lines dropped, n_lines and n_dropped.

    A line is a piece of text between line feeds. Of equal lines of at least `least` code points the first stays, by
    doc_id and position; a line that is within `threshold` edits of an earlier, different line is dropped with all its
    copies. Shorter lines always stay. A null text stays null (no lines); an empty one is one empty line. Rows without
    doc_id come after all others and count as one document; rows that repeat an id and its text are treated as one, so
    each keeps the same lines. All rows stay, also those that lose every line (their text is then empty). Own columns
    called n_lines or n_dropped are replaced; columns other than doc_id and text are carried along unseen.
    """
    distinct, near = near_lines(docs, threshold, least)
    out = distinct.join(near.withColumn("near", F.lit(True)), "at", "left").where("c > 1 or near").select("h1", "h2", F.col("at").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    seen = _lines(docs).where(F.char_length("line") >= least).select("doc_id", "mark", "pos", "h1", "h2", "at")
    dropped = lookup_join(seen, out, ["h1", "h2"]).where("near or at <> first")
    drops = dropped.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("_drops")).withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    marked = docs.select(*own, F.xxhash64(F.col("text").cast("string")).alias("_m"), F.col("doc_id").cast("long").alias("_d"))
    joined = marked.join(drops, (F.col("_m") == F.col("_mark")) & F.col("_d").eqNullSafe(F.col("_id")), "left")
    # behind a generator, so that the text is split once a row
    joined = joined.select("*", F.explode(F.array(F.split(F.col("text").cast("string"), "\n"))).alias("_lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drops"))
    text = F.when(F.col("_drops").isNull(), F.col("text").cast("string")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in own], F.greatest(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
                         F.greatest(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"))
