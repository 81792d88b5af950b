"""Queries of accounting sheets."""

from pyspark.sql import functions as F

from tallyfold.operators import ledger
from tallyfold.plans.fixtures import duck, frame
from tallyfold.plans.registry import query
from tallyfold.session import new_table_path
from tallyfold.sources import documents

WORD, AMOUNT, FORMULA = "Deposit", "net amount", "L06"


def grid(spark, sf):
    return frame(spark, sf, "cells"), frame(spark, sf, "merges")


def entries(spark, sf):
    return ledger.build_entries(*grid(spark, sf), WORD)


_FILLED = """anchored as (select m.*, c.value as anchor from merges m left join cells c on c.sheet = m.sheet and c.row = m.min_row and c.col = m.min_col)"""


@query(
    "merged_range_fill",
    duck(["cells", "merges"], """select c.sheet, c.row, c.col, case when a.sheet is not null then a.anchor else c.value end as value
from cells c left join places a on a.sheet = c.sheet and a.row = c.row and a.col = c.col""",
         _FILLED + """, places as materialized (select sheet, unnest(range(min_row, max_row + 1)) as row, min_col as col, anchor from anchored)"""),
)
def merged_range_fill(spark, sf):
    return ledger.merged_range_fill(*grid(spark, sf)).select("sheet", "row", "col", "value")


_REF = r"'^=[$]?([A-Za-z]{1,3})[$]?([0-9]+)$'"
_RESOLVED = rf"""pointing as materialized (select sheet, row, col, try_cast(regexp_extract(value, {_REF}, 2) as int) as at_row, ascii(upper(regexp_extract(value, {_REF}, 1))) - 64 as at_col
 from cells where regexp_matches(value, {_REF})),
 resolved as (select sheet, row, col, value from cells where not coalesce(regexp_matches(value, {_REF}), false)
 union all select p.sheet, p.row, p.col, t.value from pointing p left join cells t on t.sheet = p.sheet and t.row = p.at_row and t.col = p.at_col)"""


@query("cell_reference_lookup", duck("cells", "select sheet, row, col, value from resolved", _RESOLVED))
def cell_reference_lookup(spark, sf):
    return ledger.cell_reference_lookup(frame(spark, sf, "cells"))


_AHEAD = _FILLED + f""", spots as (select sheet, unnest(range(min_row, max_row + 1)) as spot, anchor as label from anchored where min_col <= 4 and max_col >= 4),
 labels4 as (select sheet, spot, label from spots union all select sheet, row, value from cells c where col = 4
  and not exists (select 1 from spots s where s.sheet = c.sheet and s.spot = c.row)),
 seen as (select sheet, spot - d as row, spot, label from labels4, (values (1), (2), (3), (4)) v(d) where contains(label, '{WORD}')),
 ahead as (select sheet, row, arg_min(label, spot) as label from seen where row > 0 group by 1, 2)"""


@query("lookahead_label", duck(["cells", "merges"], "select sheet, cast(row as int) as row, label from ahead", _AHEAD))
def lookahead_label(spark, sf):
    return ledger.lookahead_label(*grid(spark, sf), WORD, every_row=True)


_ENTRIES = _AHEAD + f""", {_RESOLVED}, acc as (select sheet, row, max(value) filter (where col = 2) as debit, max(value) filter (where col = 3) as credit from cells group by 1, 2),
 amt as (select sheet, row, max(value) filter (where col = 5) as d, max(value) filter (where col = 6) as c from resolved group by 1, 2),
 rows4 as (select a.*, amt.d, amt.c, case when s.sheet is not null then s.label else t.value end as title, h.label as libelle
  from acc a left join amt on amt.sheet = a.sheet and amt.row = a.row left join spots s on s.sheet = a.sheet and s.spot = a.row
  left join cells t on t.sheet = a.sheet and t.row = a.row and t.col = 4 left join ahead h on h.sheet = a.sheet and h.row = a.row
  where regexp_matches(coalesce(debit, ''), '^[0-9]*[1-9][0-9]*$') or regexp_matches(coalesce(credit, ''), '^[0-9]*[1-9][0-9]*$')),
 flat as (select sheet, row as ligne, debit as numero, 'debit' as sens, title as intitule, d as montant, libelle from rows4 where coalesce(debit, '') <> ''
  union all select sheet, row, credit, 'credit', title, c, libelle from rows4 where coalesce(credit, '') <> '')"""
_FIELDS = ["sheet", "ligne", "numero", "sens", "intitule", "montant", "libelle"]


@query("build_entries", duck(["cells", "merges"], f"select {', '.join(_FIELDS)} from flat", _ENTRIES))
def build_entries(spark, sf):
    return entries(spark, sf).select("sheet", "ligne", F.explode("comptes").alias("c"), "libelle").select(
        "sheet", "ligne", "c.numero", "c.sens", "c.intitule", "c.montant", "libelle"
    )


def _flat_documents(docs):
    listed = docs.select(F.explode("doc").alias("sheet", "entries")).select("sheet", F.explode("entries").alias("e"))
    return listed.select("sheet", "e.ligne", F.explode("e.comptes").alias("c"), "e.libelle").select(
        "sheet", "ligne", "c.numero", "c.sens", "c.montant", "c.formule", "libelle"
    )


_UPDATED = f"select sheet, ligne, numero, sens, montant, case when lower(montant) = '{AMOUNT}' then '{FORMULA}' else '' end as formule, libelle from flat"


@query("update_nested_by_match", duck(["cells", "merges"], _UPDATED, _ENTRIES))
def update_nested_by_match(spark, sf):
    return _flat_documents(ledger.update_nested_by_match(ledger.entry_documents(entries(spark, sf)), AMOUNT, FORMULA))


@query("count_nested_updates", duck(["cells", "merges"], f"select count(*) as updates from flat where lower(montant) = '{AMOUNT}'", _ENTRIES))
def count_nested_updates(spark, sf):
    return ledger.count_nested_updates(ledger.entry_documents(entries(spark, sf)), AMOUNT)


@query("scan_json_nested", duck(["cells", "merges"], "select sheet, ligne, numero, sens, montant, '' as formule, libelle from flat", _ENTRIES))
def scan_json_nested(spark, sf):
    """Nested documents written as JSON text and read back with the explicit schema."""
    path = new_table_path(spark, "ledger")
    docs = ledger.entry_documents(entries(spark, sf))
    docs.select(F.to_json("doc", {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return _flat_documents(documents.scan_json_nested(spark, path, one_per_file=False))
