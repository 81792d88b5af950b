"""Dependency order over an edge table: levels, cycles, and levels around cycles.

Every round ends in a table in the shared folder; the driver sees row counts. Joins are lookups of a node's single row, so
a node with very many neighbours is split like any other hot key.
"""

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import joins
from tallyfold.session import new_table_path

# A broadcast a round would send the driver a table of nodes as often as there are rounds.
lookup_join = partial(joins.lookup_join, strategy="merge")


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read back.

    A checkpoint keeps its plan's size estimate. Joins multiply these estimates, so over rounds their digits double, and
    planning a round would soon take longer than running it. Files tell their own size.
    """
    path = new_table_path(df.sparkSession, "rounds")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rounds of release after which finished edges are dropped.
ROUNDS_TOGETHER = 8


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("child", "parent").where("child <> parent").distinct()


def _named(df: DataFrame, **names: str) -> DataFrame:
    """Columns under new names: `_named(df, parent="node")` takes `node` as `parent`."""
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def _jumped(steps: DataFrame, merge: dict) -> tuple[DataFrame, DataFrame]:
    """Pointer jumping over (node, head, …), one row a node: rows whose head is no node, and rows that never come to such.

    Each round every row takes over its head's head, so the way doubles and the rounds grow with the logarithm of the longest
    way. `merge` says how further columns of a row and of its head (prefixed with _) are put together.
    """
    rounds = max(1, steps.count().bit_length()) + 1
    now = cut_lineage(steps.withColumn("_open", F.lit(True)))
    for _ in range(rounds):
        others = [c for c in now.columns if c not in ("node", "head", "_open")]
        over = _named(now, head="node", _head="head", **{f"_{c}": c for c in others})
        met = lookup_join(now, over, ["head"], "left")
        more = F.col("_head").isNotNull()
        now = cut_lineage(met.select(
            "node", F.coalesce("_head", "head").alias("head"), *[F.when(more, merge[c]).otherwise(F.col(c)).alias(c) for c in others], more.alias("_open")))
        if now.where("_open").isEmpty():
            break
    # A row may have taken over a head that was itself just reached: closed is whose head is no node.
    return now.where("not _open").drop("_open"), now.where("_open").drop("_open")


def _contracted(work: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Take nodes with one parent out of weighted edges: their level follows from that of the first ancestor which is none.

    Gives (edges left, (node, head, dist), nodes behind a ring of such nodes), or nothing where too few nodes have one parent.
    """
    counted = cut_lineage(work.groupBy("child").agg(F.count("*").alias("n"), F.max("parent").alias("head"), F.max("weight").alias("dist")))
    single = counted.where("n = 1").select(F.col("child").alias("node"), "head", "dist")
    n, of = counted.agg(F.count_if(F.col("n") == 1), F.count("*")).first()
    if n == 0 or n * 10 < of:
        return None
    way, ring = _jumped(single, {"dist": F.col("dist") + F.col("_dist")})
    rest = lookup_join(work, _named(single, child="node"), ["child"], "left_anti")
    moved = lookup_join(rest, _named(way, parent="node", _head="head", _dist="dist"), ["parent"], "left").select(
        "child", F.coalesce("_head", "parent").alias("parent"), (F.col("weight") + F.coalesce("_dist", F.lit(0))).alias("weight"))
    return cut_lineage(moved.groupBy("child", "parent").agg(F.max("weight").alias("weight"))), way, ring.select("node")


def dependency_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """`(node, level, blocked)`: level 0 has no parents, every other node lies one above its highest parent.

    Sorting by level puts parents before children. Nodes on a cycle, or behind one, can never be
    released: they come out once, with a null level and `blocked` true; `dependency_order` gives levels to those too.

    Nodes with one parent are contracted first, by pointer jumping, until few are left: long chains and trees cost a
    logarithmic number of rounds. Then, round by round, the nodes released last pass their children one count per edge, and
    a child whose counts reach its number of parents is released. Now and then edges of released parents leave, and the
    levels found are put together, so that neither the work nor the plan of a round grows with the rounds before.
    """
    pairs = cut_lineage(_pairs(edges))
    names = pairs.select(F.col("child").alias("node")).union(pairs.select("parent"))
    if nodes is not None:
        names = names.union(nodes.select("node"))
    names = cut_lineage(names.distinct())
    work, ways, left = pairs.withColumn("weight", F.lit(1).cast("long")), [], names
    while (found := _contracted(work)) is not None:
        work, way, ring = found
        ways.append(way)
        left = lookup_join(left, way.select("node").unionByName(ring), ["node"], "left_anti")
    parents = work.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("waiting"))
    state = cut_lineage(left.join(parents.hint("merge"), "node", "left").select("node", F.coalesce("waiting", F.lit(0)).alias("waiting"), F.lit(0).cast("long").alias("level")))
    known, recent, rounds = None, [state.where("waiting = 0").select("node", "level")], 0
    pending = state.where("waiting > 0")
    while True:
        passed = lookup_join(work, _named(recent[-1], parent="node", level="level"), ["parent"])
        arrived = passed.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("arrived"), F.max(F.col("level") + F.col("weight")).alias("reached"))
        step = cut_lineage(pending.join(arrived.hint("merge"), "node", "left").select(
            "node", (F.col("waiting") - F.coalesce("arrived", F.lit(0))).alias("waiting"), F.greatest("level", "reached").alias("level")))
        fresh, pending, rounds = step.where("waiting = 0").select("node", "level"), step.where("waiting > 0"), rounds + 1
        if fresh.isEmpty():
            break
        recent.append(fresh)
        if rounds % ROUNDS_TOGETHER == 0:
            # Edges of released parents leave, and the levels found so far become one table.
            done = reduce(DataFrame.unionByName, recent[:-1])
            work = cut_lineage(lookup_join(work, _named(done, parent="node"), ["parent"], "left_anti"))
            known, recent = cut_lineage(done if known is None else known.unionByName(done)), recent[-1:]
    known = reduce(DataFrame.unionByName, recent if known is None else [known, *recent])
    for way in reversed(ways):
        heads = _named(known, head="node", _level="level")
        known = cut_lineage(known.unionByName(lookup_join(way, heads, ["head"]).select("node", (F.col("_level") + F.col("dist")).alias("level"))))
    return names.join(known.hint("merge"), "node", "left").select("node", F.col("level").cast("int").alias("level"), F.col("level").isNull().alias("blocked"))


def _among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes."""
    inside = lookup_join(edges, _named(nodes, child="node"), ["child"], "left_semi")
    return lookup_join(inside, _named(nodes, parent="node"), ["parent"], "left_semi")


def cycle_nodes(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """Blocked nodes that lie on a cycle or between two: those that also hold up another such node.

    The same release from the children's side removes the nodes that are only behind a cycle.
    """
    core = _among(_pairs(edges), levels.where("blocked").select("node"))
    reversed_levels = dependency_levels(_named(core, child="parent", parent="child"))
    return reversed_levels.where("blocked").select("node")


def _greatest_above(edges: DataFrame, salt: int | None) -> DataFrame:
    """`(node, colour)` for every node of the edges: the greatest of the node and all nodes it depends on.

    Greatest by name, or by a hash under `salt`. Each round takes the colours of parents that changed last; and since a colour is
    the name of a node above, that node's own colour is taken as well, which doubles the way along chains and rings.
    """
    colour, name = F.col("node"), F.col("colour")
    if salt is not None:
        colour, name = F.struct(F.xxhash64("node", F.lit(salt)).alias("rank"), F.col("node").alias("name")), F.col("colour.name")
    nodes = _named(edges, node="child").union(_named(edges, node="parent")).distinct()
    now = cut_lineage(nodes.select("node", colour.alias("colour"), F.lit(True).alias("fresh")))
    while True:
        fresh = now.where("fresh")
        passed = lookup_join(edges, _named(fresh, parent="node", colour="colour"), ["parent"])
        over = lookup_join(now.withColumn("_at", name), _named(fresh, _at="node", _over="colour"), ["_at"], "left")
        met = over.select("node", F.coalesce("_over", "colour").alias("colour"), F.col("colour").alias("_own")).unionByName(
            _named(passed, node="child", colour="colour"), allowMissingColumns=True)
        best = met.groupBy("node").agg(F.max("colour").alias("colour"), F.max("_own").alias("_own"))
        now = cut_lineage(best.select("node", "colour", (F.col("colour") != F.col("_own")).alias("fresh")))
        if now.where("fresh").isEmpty():
            return now.select("node", "colour")


def _inside(edges: DataFrame, colours: DataFrame, name: str) -> DataFrame:
    """Edges whose ends have one colour, with it as `name`."""
    ends = lookup_join(edges, _named(colours, child="node", **{name: "colour"}), ["child"])
    return lookup_join(ends, _named(colours, parent="node", _other="colour"), ["parent"]).where(F.col(name) == F.col("_other")).drop("_other")


def dependency_cycles(edges: DataFrame) -> DataFrame:
    """`(node, cycle)` of the nodes that lie on a cycle; nodes that reach each other share the smallest of them as `cycle`.

    An edge from a node to itself is no cycle. Nodes of one cycle share the greatest node above and the greatest below, so edges
    between nodes that differ in either leave. A node whose greatest one above is also the greatest below lies on that one's cycle;
    what is left is coloured again, from the third time on by hashes, so that no order of the names needs many times.
    """
    left, found, times = cut_lineage(_pairs(edges)), None, 0
    while True:
        salt = None if times < 2 else times
        above = _greatest_above(left, salt)
        left = cut_lineage(_inside(left, above, "_above"))
        below = _greatest_above(_named(left, child="parent", parent="child"), salt)
        left = cut_lineage(_inside(left, below, "_below").where("_above <> _below").select("child", "parent"))
        met = lookup_join(below, _named(above, node="node", _above="colour"), ["node"]).where("colour = _above")
        here = met.select("node", (F.col("colour") if salt is None else F.col("colour.name")).alias("comp"))
        found, times = cut_lineage(here if found is None else found.unionByName(here)), times + 1
        if left.isEmpty():
            break
    least = found.groupBy("comp").agg(F.min("node").alias("cycle"), F.count("*").alias("n")).where("n > 1").drop("n")
    return lookup_join(found, least, ["comp"]).select("node", "cycle")


def dependency_order(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """`(node, level, cycle)`: every node has a level, also those on cycles and behind them; `cycle` is null off cycles.

    Levels are those of the graph in which each cycle is one node, so that sorting by level puts every node behind all it
    depends on, except for those on its own cycle, which share its level.
    """
    pairs = cut_lineage(_pairs(edges))
    names = pairs.select(F.col("child").alias("node")).union(pairs.select("parent"))
    if nodes is not None:
        names = names.union(nodes.select("node"))
    cycles = cut_lineage(dependency_cycles(pairs))
    units = cut_lineage(names.distinct().join(cycles.hint("merge"), "node", "left").select("node", "cycle", F.coalesce("cycle", "node").alias("unit")))
    ends = lookup_join(pairs, _named(units, child="node", _child="unit"), ["child"])
    between = lookup_join(ends, _named(units, parent="node", _parent="unit"), ["parent"]).select(F.col("_child").alias("child"), F.col("_parent").alias("parent"))
    levels = dependency_levels(between, _named(units, node="unit"))
    return lookup_join(units, _named(levels, unit="node", level="level"), ["unit"]).select("node", "level", "cycle")
