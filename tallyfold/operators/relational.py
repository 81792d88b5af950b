"""Relational shapes of a catalog query: key edges, detail chains, null-aware exclusion, ordering."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.joins import lookup_join
from tallyfold.operators.numbering import ordered_list_by_key


def filter_like_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """`LIKE 'prefix%'`; pushed to the scan as a prefix filter."""
    return df.where(F.col(column).startswith(prefix))


def filter_not_in_subquery(df: DataFrame, column: str, listed: DataFrame, listed_column: str) -> DataFrame:
    """`column NOT IN (SELECT listed_column …)` with SQL nulls, without broadcasting the list.

    Spark runs a null-aware anti-join by broadcasting the subquery whatever its size. Here two
    one-row facts about the list (any null, any row) settle the null cases and the rest is an
    ordinary anti-join that Spark sizes itself.
    """
    names = listed.select(F.col(listed_column).alias("_v"))
    facts = names.agg(F.count_if(F.col("_v").isNull()).alias("nulls"), F.count("*").alias("n"))
    no_nulls = facts.select(F.col("nulls") == 0).scalar()
    is_empty = facts.select(F.col("n") == 0).scalar()
    values = names.where("_v is not null").distinct().withColumnRenamed("_v", column)
    known = lookup_join(df.where(F.col(column).isNotNull()), values, [column], "left_anti").where(no_nulls)
    unknown = df.where(F.col(column).isNull()).where(is_empty)
    return known.unionByName(unknown)


def sort_case_priority(df: DataFrame, table: str, kind: str, ranking, then=(), name: str = "priority") -> DataFrame:
    """Order by table, then by the rank of a kind; kinds that are not ranked come last.

    Name a unique column in `then` for large tables: it lets the range partitioning cut a frequent (table, rank).
    """
    rank = F.lit(len(ranking) + 1)
    for i, value in reversed(list(enumerate(ranking, 1))):
        rank = F.when(F.col(kind) == value, i).otherwise(rank)
    return df.withColumn(name, rank.cast("long")).orderBy(table, name, *then)


def inner_edge_join(left: DataFrame, right: DataFrame, on: str, child: str, parent: str) -> DataFrame:
    """Distinct `(child, parent)` pairs of two key tables that share `on`, without self references.

    Both sides are reduced to distinct (key, name) pairs first, so repeats of a key are not multiplied.
    """
    a = left.select(on, F.col(child).alias("child")).distinct()
    b = right.select(on, F.col(parent).alias("parent")).distinct()
    return a.join(b, on).where("child <> parent").select("child", "parent").distinct()


def keyed_detail_join(base: DataFrame, details, keys, position: str, value: str, chunk: int = 1000) -> DataFrame:
    """Chain of left joins `(frame, columns)` onto a base table, then an ordered list per group of keys.

    The join sides are the unique ones; a small side is broadcast only if Spark finds it below its size limit.
    """
    joined = base
    for frame, columns in details:
        joined = joined.join(frame, list(columns), "left")
    return ordered_list_by_key(joined, keys, position, value, chunk=chunk)
