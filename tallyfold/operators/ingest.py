"""Loading transaction files: target layout, first-wins deduplication, import report."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.fixed_values import OPTIONAL_INDEX_COLUMN, TARGET_LAYOUT
from tallyfold.functions.parsing import NUMBER_TYPE, is_present, locale_number, map_code, multi_format_timestamp
from tallyfold.operators.joins import lookup_join
from tallyfold.operators.numbering import first_per_key
from tallyfold.sources.tables import with_columns_present

KEY = ("service", "reference")
ORDER = ("file", "line")
ACCEPTED, DUPLICATE, MISSING_KEY = "accepted", "duplicate", "missing_key"


def drop_optional_column(df: DataFrame, name: str = OPTIONAL_INDEX_COLUMN) -> DataFrame:
    return df.drop(name)


def _typed(kind: str, value: Column, number_type: str) -> Column:
    if kind == "number":
        return locale_number(value, number_type)
    if kind == "timestamp":
        return multi_format_timestamp(value)
    text = F.nullif(value, F.lit(""))
    return map_code(text) if kind == "code" else text


def project_target_layout(raw: DataFrame, layout=TARGET_LAYOUT, keep=(), number_type: str = NUMBER_TYPE) -> DataFrame:
    """Raw headers to stored names, order and types in one projection; absent headers are null.

    Numbers are money with two decimals; name a wider `number_type` for files with finer rates.
    """
    sources = [source for source, _, _ in layout]
    present = with_columns_present(drop_optional_column(raw), [*sources, *keep])
    return present.select(
        *[_typed(kind, F.col(f"`{source}`"), number_type).alias(target) for source, target, kind in layout], *keep
    )


def key_present(keys) -> Column:
    ok = F.lit(True)
    for k in keys:
        ok = ok & is_present(F.col(k))
    return ok


def stored_keys(stored: DataFrame, keys=KEY) -> DataFrame:
    """Distinct keys of the store; the partial aggregate removes repeats before the exchange."""
    return stored.select(*keys).distinct()


def insert_if_absent(incoming: DataFrame, stored: DataFrame, keys=KEY) -> DataFrame:
    """Incoming rows whose key is not stored. A null key equals nothing, so it counts as absent."""
    return lookup_join(incoming, stored_keys(stored, keys), keys, "left_anti")


def already_stored(incoming: DataFrame, stored: DataFrame, keys=KEY) -> DataFrame:
    """Incoming rows whose key is stored."""
    return lookup_join(incoming, stored_keys(stored, keys), keys, "left_semi")


def first_wins_dedup(rows: DataFrame, keys=KEY, order=ORDER) -> DataFrame:
    """First row of every key by file and line."""
    return first_per_key(rows, keys, order)


def classify_import(incoming: DataFrame, stored: DataFrame, keys=KEY, order=ORDER, dry_run: bool = False) -> DataFrame:
    """Add `status`: accepted, duplicate (stored, or not the first of its key) or missing_key.

    Per key, one row says where the key first occurs and whether it is stored. It is built by
    aggregates that combine before the exchange, and joined back to the rows as a lookup, whose hot
    keys the skew join splits. A dry run stores nothing,
    hence repeats inside the batch pass.
    """
    keys, order = list(keys), list(order)
    keyed = incoming.where(key_present(keys))
    keyless = incoming.where(~key_present(keys)).withColumn("status", F.lit(MISSING_KEY))
    firsts = keyed.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    known = stored_keys(stored, keys).withColumn("_stored", F.lit(True))
    state = firsts.join(known, keys, "left")
    fresh = F.col("_stored").isNull()
    if not dry_run:
        fresh = fresh & (F.struct(*order) == F.col("_first"))
    judged = (
        lookup_join(keyed, state, keys)
        .withColumn("status", F.when(fresh, ACCEPTED).otherwise(DUPLICATE))
        .drop("_first", "_stored")
    )
    return judged.unionByName(keyless)


def import_errors(classified: DataFrame, keys=KEY) -> DataFrame:
    """One row per failed line: file, line, message, is_duplicate."""
    shown = [F.coalesce(F.col(k), F.lit("")) for k in keys]
    message = F.when(
        F.col("status") == DUPLICATE, F.format_string("%s with reference %s is already stored", *shown)
    ).otherwise("key field is missing")
    return classified.where(F.col("status") != ACCEPTED).select(
        "file", "line", message.alias("message"), (F.col("status") == DUPLICATE).alias("is_duplicate")
    )


def import_report(classified: DataFrame) -> DataFrame:
    """Counts per file, and over all files in the row whose `file` is null.

    The failed lines themselves are `import_errors`: a list of unknown length does not belong in one row.
    """
    status = F.col("status")
    return classified.rollup("file").agg(
        F.count("*").alias("rows_processed"),
        F.count_if(status == ACCEPTED).alias("rows_success"),
        F.count_if(status != ACCEPTED).alias("rows_failed"),
        F.count_if(status == DUPLICATE).alias("rows_duplicate"),
        F.bool_or(status == MISSING_KEY).alias("has_critical"),
    )
