"""Accounting sheets: merged cells, references, entries, nested updates.

Cells are rows `(sheet, row, col, value)` and merged ranges are rows
`(sheet, min_row, min_col, max_row, max_col)`. One sheet may hold most of the data, so no step
groups or windows by sheet alone.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.fixed_values import LABEL_LOOKAHEAD, SHEET_COLUMNS
from tallyfold.functions.parsing import is_numeric_account
from tallyfold.operators.intervals import height, points_in_ranges
from tallyfold.operators.joins import lookup_join

_REFERENCE = r"^=[$]?([A-Za-z]{1,3})[$]?([0-9]+)\z"


def anchor_values(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Merged ranges with the value of their first cell as `anchor`."""
    corner = cells.select(
        "sheet", F.col("row").alias("min_row"), F.col("col").alias("min_col"), F.col("value").alias("anchor")
    )
    return merges.join(corner, ["sheet", "min_row", "min_col"], "left")


def _fill_from_ranges(wanted: DataFrame, merges: DataFrame, cells: DataFrame, col: Column, value: str, tallest: int | None = None) -> DataFrame:
    """Replace `value` of the wanted rows (sheet, row, …) whose place (row, col) lies in a merged range.

    A range costs a few rows however tall it is; what is found is joined back to the wanted rows, which must be unique by place.
    """
    points = wanted.select("sheet", "row", col.alias("_col")).distinct()
    inside = points_in_ranges(points, anchor_values(cells, merges), ["sheet"], "row", "min_row", "max_row", tallest or height(merges, "min_row", "max_row"))
    found = inside.where(F.col("_col").between(F.col("min_col"), F.col("max_col"))).select("sheet", "row", "_col", "anchor", F.lit(True).alias("_inside"))
    filled = F.when(F.col("_inside"), F.col("anchor")).otherwise(F.col(value))
    return lookup_join(wanted.withColumn("_col", col), found, ["sheet", "row", "_col"], "left").withColumn(value, filled).select(*wanted.columns)


def merged_range_fill(cells: DataFrame, merges: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Value of every position, where a position in a merged range takes the first cell's value.

    `positions` defaults to the filled cells.
    """
    wanted = cells if positions is None else positions.join(cells, ["sheet", "row", "col"], "left")
    return _fill_from_ranges(wanted.select("sheet", "row", "col", "value"), merges, cells, F.col("col"), "value")


def column_number(letters: Column) -> Column:
    """`A` is 1, `Z` is 26, `AA` is 27."""
    digits = F.regexp_extract_all(F.upper(letters), F.lit("[A-Z]"), F.lit(0))
    return F.aggregate(digits, F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)


def cell_reference_lookup(cells: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Cells whose text is `=B7` take the value of that cell (null when it is empty); others stay.

    A cell without reference looks up itself, which keeps the join keys spread: no null key, and the
    looked-up side is unique.
    """
    source = cells if wanted is None else wanted
    letters = F.regexp_extract("value", _REFERENCE, 1)
    is_ref = F.coalesce(letters != "", F.lit(False))
    pointed = source.select(
        "sheet", "row", "col", "value", is_ref.alias("is_ref"),
        F.when(is_ref, F.regexp_extract("value", _REFERENCE, 2).try_cast("int")).otherwise(F.col("row")).alias("at_row"),
        F.when(is_ref, column_number(letters)).otherwise(F.col("col")).alias("at_col"),
    )
    target = cells.select(
        "sheet", F.col("row").alias("at_row"), F.col("col").alias("at_col"), F.col("value").alias("found")
    )
    return pointed.join(target, ["sheet", "at_row", "at_col"], "left").select(
        "sheet", "row", "col", F.when(F.col("is_ref"), F.col("found")).otherwise(F.col("value")).alias("value")
    )


def lookahead_label(cells: DataFrame, merges: DataFrame, word: str, label_col: int = SHEET_COLUMNS["label"],
                    ahead: int = LABEL_LOOKAHEAD, rows: DataFrame | None = None, tallest: int | None = None,
                    every_row: bool = False) -> DataFrame:
    """`(sheet, row, label)`: the first label containing `word` in the next `ahead` rows, for the rows where there is one.

    `rows` (sheet, row) are the rows that look, by default those with a cell. A label is a range of rows, be it merged or a
    single cell; moved up by `ahead`, it is the range of rows that can see it, so the work is a join of points with
    ranges, and no merged range is unfolded. With `every_row` all rows from 1 on look, whether they have a cell or not, and
    such a range gives its rows. A cell inside a merged range shows the range's label, not its own.
    """
    tallest = tallest or height(merges, "min_row", "max_row")
    spans = anchor_values(cells, merges).where(F.lit(label_col).between(F.col("min_col"), F.col("max_col")))
    merged = spans.where(F.contains("anchor", F.lit(word))).select("sheet", "min_row", "max_row", F.col("anchor").alias("label"))
    worded = cells.where((F.col("col") == label_col) & F.contains("value", F.lit(word))).select("sheet", "row", "value")
    covered = points_in_ranges(worded.select("sheet", "row"), spans.select("sheet", "min_row", "max_row"), ["sheet"], "row", "min_row", "max_row", tallest)
    single = worded.join(covered.select("sheet", "row"), ["sheet", "row"], "left_anti").select(
        "sheet", F.col("row").alias("min_row"), F.col("row").alias("max_row"), F.col("value").alias("label")
    )
    seen_from = merged.unionByName(single).select(
        "sheet", "min_row", "label", F.greatest(F.col("min_row") - ahead, F.lit(1 if every_row else 0)).alias("_from"), (F.col("max_row") - 1).alias("_to")
    )
    if every_row:
        seen = seen_from.where("_from <= _to").select("sheet", "min_row", "label", F.explode(F.sequence("_from", "_to")).alias("row"))
    else:
        seen = points_in_ranges((cells if rows is None else rows).select("sheet", "row").distinct(), seen_from, ["sheet"], "row", "_from", "_to", tallest + ahead)
    first = F.greatest("min_row", F.col("row") + 1)
    nearest = seen.groupBy("sheet", "row").agg(F.min(F.struct(first.alias("at"), "label")).alias("n"))
    return nearest.select("sheet", "row", "n.label")


def build_entries(cells: DataFrame, merges: DataFrame, word: str, columns=SHEET_COLUMNS) -> DataFrame:
    """One entry per row with a numeric debit or credit account: sheet, ligne, comptes, libelle.

    `comptes` holds the debit and the credit account, each if it is not empty. Amounts that are
    references are looked up first; then one grouping turns the cells of a row into columns.
    """
    is_amount = F.col("col").isin(columns["debit_amount"], columns["credit_amount"])
    points = is_amount & F.coalesce(F.col("value").rlike(_REFERENCE), F.lit(False))
    resolved = cell_reference_lookup(cells, cells.where(points))
    used = cells.where(F.col("col").isin(*columns.values()) & ~points).unionByName(resolved)
    by_row = used.groupBy("sheet", "row").agg(
        *[F.max(F.when(F.col("col") == number, F.col("value"))).alias(name) for name, number in columns.items()]
    )
    chosen = by_row.where(is_numeric_account(F.col("debit")) | is_numeric_account(F.col("credit")))
    tallest = height(merges, "min_row", "max_row")
    ahead = lookahead_label(cells, merges, word, columns["label"], rows=chosen, tallest=tallest).withColumnRenamed("label", "libelle")
    titled = _fill_from_ranges(
        chosen.join(ahead, ["sheet", "row"], "left"), merges, cells, F.lit(columns["label"]), "label", tallest
    )

    def account(number, amount):
        record = F.struct(
            F.col(number).alias("numero"), F.lit(number).alias("sens"), F.col("label").alias("intitule"),
            F.col(amount).alias("montant"), F.lit("").alias("formule"),
        )
        return F.when(F.coalesce(number, F.lit("")) != "", record)

    both = F.array(account("debit", "debit_amount"), account("credit", "credit_amount"))
    return titled.select(
        "sheet", F.col("row").alias("ligne"), F.filter(both, lambda a: a.isNotNull()).alias("comptes"), "libelle"
    )


def entry_documents(entries: DataFrame, rows_per_document: int = 1000) -> DataFrame:
    """Entries packed as `{sheet: [entry, …]}` maps of a bounded range of sheet rows: sheet, part, doc."""
    packed = entries.groupBy("sheet", F.floor(F.col("ligne") / rows_per_document).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("ligne", "comptes", "libelle"))).alias("list")
    )
    return packed.select("sheet", "part", F.create_map("sheet", "list").alias("doc"))


def _amount_matches(account: Column, amount: str) -> Column:
    return F.coalesce(F.lower(account["montant"]) == amount.lower(), F.lit(False))


def update_nested_by_match(documents: DataFrame, amount: str, formula: str, column: str = "doc") -> DataFrame:
    """Set `formule` in every account record whose amount equals `amount` in any letter case."""
    def set_formula(account):
        chosen = F.when(_amount_matches(account, amount), F.lit(formula)).otherwise(account["formule"])
        return account.withField("formule", chosen)

    def in_entry(entry):
        return entry.withField("comptes", F.transform(entry["comptes"], set_formula))

    return documents.withColumn(column, F.transform_values(column, lambda _, entries: F.transform(entries, in_entry)))


def count_nested_updates(documents: DataFrame, amount: str, column: str = "doc") -> DataFrame:
    """How many account records `update_nested_by_match` sets."""
    accounts = F.flatten(F.transform(F.flatten(F.map_values(column)), lambda e: e["comptes"]))
    hits = F.size(F.filter(accounts, lambda a: _amount_matches(a, amount)))
    return documents.select(hits.alias("hits")).agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("updates"))
