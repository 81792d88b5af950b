"""Near-duplicate documents by an inverted join over the coordinates of MinHash signatures.

Texts with the same set of shingles are one node. A node is posted under its (coordinate, value) pairs, of which only
those of its prefix count: two signatures that agree in `matches` coordinates share one of any (size - matches + 1)
of them, so the rarest suffice, and pairs that nobody else has are skipped. Candidates are counted over the whole
signature and confirmed on the full shingle sets.

A bucket is not expanded into all its pairs. First every node meets one central node of its buckets only; confirmed
links are joined into components. What is left are nodes whose bucket still holds several components: these meet the
rest of the bucket, in chunks of signatures. Nodes that are candidates there meet once more, in chunks of whole sets.
Pairs are compared inside the tasks; the rows between them grow with the nodes, also where many near texts are not linked.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.components import connected_components
from tallyfold.llm.kernels import bytes_in, lean, lower_table, mixed, runs, slices, text_bytes, word_hashes
from tallyfold.llm.tables import small_batches, stored
from tallyfold.operators.joins import lookup_join

SIGNATURE = 64
#: Rows of a chunk of signatures, and bytes of a chunk of shingle sets.
CHUNK_ROWS, CHUNK_BYTES = 512, 2 << 20
#: Rows of a table of nodes or pairs up to which it is sent to all executors (some 10 MB); beyond, both sides are shuffled.
SENT_ROWS = 300_000
_WORD = ~bytes_in((9, 13), (32, 32))
_BITS = np.uint64(1) << np.arange(SIGNATURE, dtype=np.uint64)


def _constants():
    rng = np.random.default_rng(64)
    return rng.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


_FACTORS, _SHIFTS = _constants()
_PLACES = np.random.default_rng(13).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_runs(data: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin (one entry more than texts).

    Letters A-Z count as small ones. A text of fewer words is one shingle, one without words has none.
    """
    n = len(ends) - 1
    h, doc, *_ = word_hashes(lower_table()[data], ends, _WORD)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    count = np.bincount(doc, minlength=n)
    first = np.append(True, doc[1:] != doc[:-1])
    total, full = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
    for j in range(words):
        some = max(0, len(h) - j)
        there = np.zeros(len(h), bool)
        there[:some] = doc[j:j + some] == doc[:some]
        total[:some] += np.where(there[:some], h[j:j + some] * _PLACES[j % 64], np.uint64(0))
        full = there
    short = first & (count[doc] < words)
    total = np.where(short, total + count[doc].astype(np.uint64) * _PLACES[63], total)
    keep = full | short
    value, owner = mixed(total[keep]), doc[keep]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
    value, owner = value[new], owner[new]
    return value, runs(owner, n)


def signatures(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """MinHash signature (32-bit values) of every non-empty run."""
    out = np.empty((len(begin), SIGNATURE), np.uint32)
    for k in range(SIGNATURE):
        out[:, k] = np.minimum.reduceat(((value * _FACTORS[k] + _SHIFTS[k]) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def _binaries(rows: np.ndarray) -> pa.Array:
    """Rows of a two-dimensional array as binary values."""
    size = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, key_a, key_b, sig): size, two sums over the set that identify it, and signature; null without words."""
    def run(batches):
        for batch in batches:
            data, ends = text_bytes(batch.column(1))
            for a, b in slices(ends):
                value, at = shingle_runs(data[ends[a]:ends[b]], ends[a:b + 1] - ends[a], words)
                n = np.diff(at)
                full = np.flatnonzero(n)
                keys, sig = np.zeros((2, b - a), np.int64), pa.nulls(b - a, pa.binary())
                if len(full):
                    begin = at[:-1][full]
                    keys[0, full] = np.add.reduceat(mixed(value), begin).view(np.int64)
                    keys[1, full] = np.add.reduceat(mixed(value ^ np.uint64(0x5555555555555555)), begin).view(np.int64)
                    place = np.full(b - a, -1)
                    place[full] = np.arange(len(full))
                    sig = _binaries(signatures(value, begin)).take(pa.array(place, mask=place < 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), sig], ["doc_id", "n", "key_a", "key_b", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n long, key_a long, key_b long, sig binary")


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def _shingles(docs: DataFrame, nodes: DataFrame, words: int, repeated: bool) -> DataFrame:
    """(node, n, set): full shingle sets of nodes (node, rep, key_a), computed again from their texts; `repeated`: ids may recur."""
    def run(batches):
        for batch in batches:
            data, ends = text_bytes(batch.column(3))
            for a, b in slices(ends):
                value, at = shingle_runs(data[ends[a]:ends[b]], ends[a:b + 1] - ends[a], words)
                node, key = (batch.column(i).slice(a, b - a) for i in (0, 1))
                sums = np.zeros(b - a, np.int64)
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    sums[full] = np.add.reduceat(mixed(value), at[:-1][full]).view(np.int64)
                same = np.flatnonzero(sums == np.asarray(key, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [node.take(pa.array(same)), pa.array(np.diff(at)[same].astype(np.int64)), pa.array([value[at[i]:at[i + 1]].tobytes() for i in same], pa.binary())], ["node", "n", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    found = texts.join(_sent(nodes.select("node", "rep", "key_a")), "rep").select("node", "key_a", "rep", "text").mapInArrow(lean(run), "node long, n long, set binary")
    return found.dropDuplicates(["node"]) if repeated else found


def _enough(inter, n1, n2, percent: int):
    return 100 * inter >= percent * (n1 + n2 - inter)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough. The set of a goes to b, so b should be the one that recurs."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")).join(_sent(pairs.select("a", "b")), "a")
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")).join(_sent(pairs.select("b").distinct()), "b", "left_semi")
    joined = lookup_join(left, right, ["b"])

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(bool(_enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return joined.select("a", "b", "set_a", "set_b").mapInArrow(lean(run), "a long, b long")


def _agreeing(pairs: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least `matches` coordinates."""
    left, right = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    joined = lookup_join(lookup_join(pairs.select("a", "b"), left, ["a"]), right, ["b"])

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SIGNATURE) for c in ("sig_a", "sig_b"))
            mask = pa.array((x == y).sum(1) >= matches)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(lean(run), "a long, b long")


def _postings(nodes: DataFrame, matches: int) -> DataFrame:
    """(node, token, df, central): pairs of each node's prefix that other nodes hold too.

    token is the coordinate above 32 bits of its value. central tells how often the node's coordinates occur at all.
    """
    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, SIGNATURE)
            token = (np.arange(SIGNATURE, dtype=np.int64) << 32) | sig
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0), np.int64), SIGNATURE)), pa.array(token.ravel())], ["node", "token"])

    tokens = nodes.select("node", "sig").mapInArrow(lean(run), "node long, token long")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    held = lookup_join(tokens, shared, ["token"])
    own = Window.partitionBy("node")
    ranked = held.select("*", F.count("*").over(own).alias("m"), F.sum(F.log("df")).over(own).alias("central"),
                         F.row_number().over(own.orderBy("df", "token")).alias("r"))
    prefix = SIGNATURE - matches + 1
    return ranked.where(F.col("r") <= prefix - (SIGNATURE - F.col("m"))).select("node", "token", "df", "central")


def _star_pairs(postings: DataFrame) -> DataFrame:
    """(a, b): every node a with the node b that is the most central one of most of its buckets."""
    heads = postings.groupBy("token").agg(F.max(F.struct("central", F.negative("node").alias("back"))).alias("top")).select(
        "token", F.negative("top.back").alias("head"))
    pairs = lookup_join(postings.select("token", "node"), heads, ["token"]).where("node <> head")
    often = pairs.groupBy("node", "head").agg(F.count("*").alias("c"))
    return often.groupBy("node").agg(F.max(F.struct("c", F.negative("head").alias("back"))).alias("top")).select(F.col("node").alias("a"), F.negative("top.back").alias("b"))


def _met(rows: DataFrame, *fields: str) -> DataFrame:
    """(token, probe, base): in every bucket, parts of its minor rows with chunks of all its rows; `fields` are those of an item.

    rows: (token, node, minor, chunks, probes, ...), the last two being the numbers of chunks and parts of the bucket.
    """
    spot = lambda of: F.pmod(F.xxhash64("node"), F.col(of))
    item = F.struct("node", "n", "mask", "comp", "minor", "sig", *fields)
    base = rows.groupBy("token", spot("chunks").alias("chunk")).agg(F.collect_list(item).alias("base"))
    probe = rows.where("minor").groupBy("token", "chunks", spot("probes").alias("part")).agg(F.collect_list(item).alias("probe"))
    probe = probe.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("chunk"), "probe")
    return probe.join(base, ["token", "chunk"]).select("token", "probe", "base")


def _side(items) -> dict:
    """The items of one side of a meeting, field by field."""
    out = {f: np.asarray(items.field(f).to_numpy(zero_copy_only=False)) for f in ("node", "n", "mask", "comp", "minor")}
    out["mask"] = out["mask"].astype(np.int64).view(np.uint64)
    out["sig"] = np.frombuffer(b"".join(items.field("sig").to_pylist()), np.uint32).reshape(-1, SIGNATURE)
    return out


def _meetings(batch):
    """(coordinate bit, token, probe items, base items) of every row of a batch of `_met`."""
    for i, token in enumerate(batch.column(0).to_pylist()):
        yield _BITS[token >> 32], token, batch.column(1)[i].values, batch.column(2)[i].values


def _candidates(p: dict, j: int, q: dict, coordinate, matches: int, percent: int) -> np.ndarray:
    """Places in q of the candidates that probe j has in the bucket of this coordinate.

    They are of another component, and the bucket is that of the first coordinate common to both prefixes. A pair of
    minor nodes counts once, for the smaller one.
    """
    ok = (q["comp"] != p["comp"][j]) & ~(q["minor"] & (q["node"] <= p["node"][j]))
    near = np.flatnonzero(ok & (100 * np.minimum(q["n"], p["n"][j]) >= percent * np.maximum(q["n"], p["n"][j])))
    equal = q["sig"][near] == p["sig"][j]
    many = equal.sum(1) >= matches
    near, equal = near[many], equal[many]
    common = (equal * _BITS).sum(1, dtype=np.uint64) & p["mask"][j] & q["mask"][near]
    return near[common & (~common + np.uint64(1)) == coordinate]


def _rest(postings: DataFrame, nodes: DataFrame, matches: int, percent: int) -> DataFrame:
    """(token, node, minor): nodes that take part in a candidate pair of a bucket, from buckets with several components.

    nodes: (node, n, sig, mask, comp). In a bucket all nodes outside its largest component (minor) meet all others. A task
    compares chunks of signatures, and what leaves it is a row a node and bucket, not one a pair.
    """
    rows = postings.select("token", "node").join(nodes.select("node", "comp"), "node")
    by_comp = rows.groupBy("token", "comp").agg(F.count("*").alias("c"))
    buckets = by_comp.groupBy("token").agg(F.count("*").alias("comps"), F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("top")).where("comps > 1").select(
        "token", F.col("top.comp").alias("major"), F.ceil(F.col("size") / CHUNK_ROWS).alias("chunks"), F.ceil((F.col("size") - F.col("top.c")) / CHUNK_ROWS).alias("probes"))
    members = lookup_join(postings.select("token", "node"), buckets, ["token"])
    full = lookup_join(members, nodes, ["node"]).withColumn("minor", F.col("comp") != F.col("major"))

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for coordinate, token, probe, base in _meetings(batch):
                p, q = _side(probe), _side(base)
                asks, met = np.zeros(len(p["node"]), bool), np.zeros(len(q["node"]), bool)
                for j in range(len(asks)):
                    near = _candidates(p, j, q, coordinate, matches, percent)
                    asks[j] = len(near) > 0
                    met[near] = True
                for part in (p["node"][asks], np.ones(asks.sum(), bool)), (q["node"][met], q["minor"][met]):
                    out[0].append(np.full(len(part[0]), token, np.int64))
                    out[1].append(part[0].astype(np.int64))
                    out[2].append(part[1].astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["token", "node", "minor"])

    return _met(full).mapInArrow(lean(run), "token long, node long, minor boolean").distinct()


def _rest_links(active: DataFrame, nodes: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """Links (a, b) between the nodes that take part in candidate pairs, active (token, node, minor).

    The buckets meet once more, now by chunks of whole sets, and every candidate pair is confirmed inside the task unless
    links found there connect it already. At most one link a node and meeting comes out.
    """
    size = F.sum(F.col("n") * 8 + 4 * SIGNATURE)
    sizes = lookup_join(active, nodes.select("node", "n"), ["node"]).groupBy("token").agg(
        F.ceil(size / CHUNK_BYTES).alias("chunks"), F.ceil(F.sum(F.when(F.col("minor"), F.col("n") * 8 + 4 * SIGNATURE)) / CHUNK_BYTES).alias("probes"))
    placed = lookup_join(active, sizes.where("probes > 0"), ["token"])
    full = lookup_join(sets.select("node", "set").join(_sent(placed), "node"), nodes, ["node"])

    def run(batches):
        for batch in batches:
            out = ([], [])
            for coordinate, _, probe, base in _meetings(batch):
                p, q = _side(probe), _side(base)
                words, code = np.unique(np.frombuffer(b"".join(probe.field("set").to_pylist() + base.field("set").to_pylist()), np.uint64), return_inverse=True)
                at = np.concatenate([[0], np.cumsum(np.concatenate([p["n"], q["n"]]))]).astype(np.int64)
                group, mine = np.unique(np.concatenate([p["comp"], q["comp"]]), return_inverse=True)[1], np.zeros(len(words), bool)
                k = len(p["node"])
                for j in range(k):
                    near = _candidates(p, j, q, coordinate, matches, percent)
                    own = code[at[j]:at[j + 1]]
                    mine[own] = True
                    for i in near.tolist():
                        if group[j] == group[k + i]:
                            continue
                        inter = np.count_nonzero(mine[code[at[k + i]:at[k + i + 1]]])
                        if _enough(inter, p["n"][j], q["n"][i], percent):
                            out[0].append(int(p["node"][j]))
                            out[1].append(int(q["node"][i]))
                            group[group == group[k + i]] = group[j]
                    mine[own] = False
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    return _met(full, "set").mapInArrow(lean(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, matches: int = 38) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: near-duplicate groups at a Jaccard similarity of percent / 100.

    Two documents are linked if 100 * intersection >= percent * union of their sets of `words`-word shingles (64-bit
    hashes). component_id is the smallest doc_id that a row is connected with. Null texts, empty texts and texts of blanks
    have no shingle and are linked with nothing; so is a row without doc_id (component_id null, kept true). Rows that
    repeat an id stay; equal texts are one node, so copies cost one row each. Other columns are not looked at.

    The candidate search finds a linked pair unless its 64 coordinates agree in fewer than `matches` places, for which
    the chance at similarity 0.8 exactly is 3 in 100,000, and falls fast above it.
    """
    found = stored(document_sets(docs, words), "neardup-sets")
    nodes = stored(found.where("n > 0 and doc_id is not null").groupBy("key_a", "key_b", "n").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"))
                   .withColumn("node", F.monotonically_increasing_id()), "neardup-nodes")
    postings = stored(_postings(nodes, matches), "neardup-postings")
    known = postings.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(token, 32) as int))")).alias("mask"))
    known = stored(nodes.join(known, "node"), "neardup-known")
    repeated = not found.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null").isEmpty()
    sets = stored(_shingles(docs, known, words, repeated), "neardup-shingles")
    near = lambda pairs: lookup_join(lookup_join(pairs, known.select(F.col("node").alias("a"), F.col("n").alias("n_a")), ["a"]), known.select(
        F.col("node").alias("b"), F.col("n").alias("n_b")), ["b"]).where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    links = stored(_confirmed(_agreeing(near(_star_pairs(postings)), known, matches), sets, percent), "neardup-links")
    comps = stored(connected_components(links), "neardup-components")
    with_comp = known.join(comps, "node", "left").select("node", "n", "sig", "mask", F.coalesce("component", "node").alias("comp"))
    with_comp = stored(with_comp, "neardup-grouped")
    with small_batches(docs.sparkSession):
        active = stored(_rest(postings, with_comp, matches, percent), "neardup-rest")
        more = stored(_rest_links(active, with_comp, sets, matches, percent), "neardup-more")
    if not more.isEmpty():
        # further links join whole components, so only those are connected anew
        label = lambda side: with_comp.select(F.col("node").alias(side), F.col("comp").alias(f"of_{side}"))
        joined = connected_components(lookup_join(lookup_join(more, label("a"), ["a"]), label("b"), ["b"]), "of_a", "of_b")
        joined = joined.select(F.col("node").alias("comp"), F.col("component").alias("top"))
        comps = stored(lookup_join(with_comp.select("node", "comp"), joined, ["comp"], "left").select("node", F.coalesce("top", "comp").alias("component")), "neardup-components")
    named = comps.join(nodes.select("node", "rep"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    groups = nodes.select("key_a", "key_b", "n", "node", "rep").join(lookup_join(comps, least, ["component"]).select("node", "component_id"), "node", "left")
    groups = groups.select("key_a", "key_b", "n", F.coalesce("component_id", "rep").alias("component_id"))
    out = lookup_join(found.select("doc_id", "n", "key_a", "key_b"), groups, ["key_a", "key_b", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
