"""Numbering and ordered lists that stay distributed when one key holds most rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_number_by_position(df: DataFrame, keys, position: str, name: str = "row_no", width: int = 100_000) -> DataFrame:
    """`row_number() over (partition by keys order by position)` for an integer position.

    Positions are cut into ranges of `width`; a window numbers the rows inside one range and a
    running sum over range sizes supplies the offset. No task sees more than one range of a key.
    """
    keys = list(keys)
    ranged = df.withColumn("_range", F.floor(F.col(position) / F.lit(width)))
    inside = Window.partitionBy(*keys, "_range").orderBy(position)
    numbered = ranged.withColumn("_inner", F.row_number().over(inside))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return (
        numbered.join(offsets, [*keys, "_range"])
        .withColumn(name, F.col("_inner") + F.col("_before"))
        .drop("_range", "_inner", "_before")
    )


def batch_number(df: DataFrame, keys, position: str, size: int = 1000, name: str = "batch") -> DataFrame:
    """Consecutive chunks of `size` rows per key, from 0."""
    numbered = row_number_by_position(df, keys, position, "_n")
    return numbered.withColumn(name, F.floor((F.col("_n") - 1) / size)).drop("_n")


def ordered_list_by_key(df: DataFrame, keys, position: str, value: str, sep: str = ", ", chunk: int = 1000, name: str = "items") -> DataFrame:
    """Values of a key joined in position order, one row per `chunk` values of the key.

    A key with at most `chunk` values gives one row (`part` 0); a longer list continues in parts
    1, 2, … so that no row and no task holds an unbounded list.
    """
    parts = batch_number(df, keys, position, chunk, "part")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).cast("string").alias("v"))))
    return parts.groupBy(*keys, "part").agg(
        F.array_join(F.transform(pairs, lambda x: x["v"]), sep).alias(name),
        F.count("*").alias("n_items"),
    )


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """First row of every key by `order`.

    Spark turns the filtered row number into a group limit before the exchange, so each map task
    sends at most one row per key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
