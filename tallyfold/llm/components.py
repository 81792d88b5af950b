"""Connected components over many machines, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.tables import stored
from tallyfold.operators.joins import lookup_join


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with m, the smallest of u and all its v; a node with many neighbours may be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return lookup_join(pairs, least, ["u"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _least_neighbour(both).where(F.col("v") > F.col("u"))
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    found = _least_neighbour(edges)
    down = found.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(found.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of the edges is connected with, itself included.

    Every round is written to the shared folder, and the driver sees only a count and a checksum of it. The number of
    rounds grows with the logarithm of the longest path, not with the data. Repeated edges and loops change nothing.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "component-edges")
    state = None
    while True:
        row = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if row[0] == 0 or tuple(row) == state:
            break
        state = tuple(row)
        now = stored(_small_star(_large_star(now)), "component-edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
