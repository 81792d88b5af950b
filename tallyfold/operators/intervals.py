"""Joins of points with ranges, whatever the height of the ranges.

A range of integers is the union of at most 2 log2(n) dyadic blocks, a block of level k being the numbers that agree but
for their last k bits. A point lies in one block of each level, so the join is an equi-join on (keys, level, block), and
neither a range nor a point is ever unfolded number by number.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCKS = """filter(flatten(transform(
 transform(sequence(0, {top}), k -> named_struct('k', k, 'l', shiftright(_low + shiftleft(1L, k) - 1L, k), 'r', shiftright(_high + 1L, k))),
 x -> array(if(x.l < x.r and x.l % 2 = 1, named_struct('level', x.k, 'block', x.l), null),
            if(x.l < x.r and x.r % 2 = 1, named_struct('level', x.k, 'block', x.r - 1L), null)))), b -> b is not null)"""


def dyadic_blocks(ranges: DataFrame, low: str, high: str, top: int = 40) -> DataFrame:
    """One row per block of each range `low` .. `high` (both included, not negative): adds _level and _block. Empty ranges give none."""
    bounded = ranges.withColumn("_low", F.col(low).cast("long")).withColumn("_high", F.col(high).cast("long"))
    blocks = bounded.withColumn("_b", F.explode(F.expr(_BLOCKS.format(top=top))))
    return blocks.withColumn("_level", F.col("_b.level")).withColumn("_block", F.col("_b.block")).drop("_b", "_low", "_high")


def height(ranges: DataFrame, low: str, high: str) -> int:
    """Numbers in the tallest range, 1 at least."""
    return max(int(ranges.agg(F.max(F.col(high).cast("long") - F.col(low).cast("long") + 1)).first()[0] or 1), 1)


def points_in_ranges(points: DataFrame, ranges: DataFrame, keys, point: str, low: str, high: str, tallest: int | None = None) -> DataFrame:
    """Inner join of points with the ranges that hold them: columns of both, keys once.

    A point probes the levels up to that of the tallest range only. That height is the one number the driver sees; a caller who has
    a bound for it saves the job that finds it.
    """
    keys = list(keys)
    tallest = tallest or height(ranges, low, high)
    top = max(tallest, 1).bit_length() - 1
    place = F.col(point).cast("long")
    blocks = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(place, k).alias("block")) for k in range(top + 1)])
    probes = points.withColumn("_b", F.explode(blocks)).withColumn("_level", F.col("_b.level")).withColumn("_block", F.col("_b.block")).drop("_b")
    return probes.join(dyadic_blocks(ranges, low, high, top), [*keys, "_level", "_block"]).drop("_level", "_block")
