"""Joins to unique tables that keep working when one key holds a third of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(rows: DataFrame, lookup: DataFrame, keys, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """Join rows to a table that is unique on `keys`, so that AQE can split a hot key of `rows`.

    AQE splits a skewed side only when both sides of the join come straight from a shuffle. A lookup
    made by an aggregate is already partitioned by the keys, so none follows it and a hot key would
    stay in one task. Joining on a hash of the keys as well makes Spark shuffle the (small) lookup once more.
    `strategy` is a join hint for the lookup: with "merge", no lookup is ever collected by the driver for a broadcast.
    """
    keys = list(keys)
    tag = F.xxhash64(*keys)
    tagged = lookup.withColumn("_tag", tag)
    return rows.withColumn("_tag", tag).join(tagged.hint(strategy) if strategy else tagged, ["_tag", *keys], how).drop("_tag")
