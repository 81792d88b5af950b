"""Input tables of the registered queries, derived from the given tables.

Each text runs in Spark and in DuckDB: table names and date formats are filled in per engine, and
everything else is common SQL.
"""

from pyspark.sql import DataFrame, SparkSession

from tallyfold.fixed_values import TARGET_LAYOUT

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_FORMATS = {
    "dmy": ("dd-MM-yyyy HH:mm:ss", "%d-%m-%Y %H:%M:%S"),
    "ymd": ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    "slash": ("dd/MM/yyyy HH:mm", "%d/%m/%Y %H:%M"),
    "dmy1": ("d-M-yyyy H:m:s", "%-d-%-m-%Y %-H:%-M:%-S"),
    "slash1": ("d/M/yyyy H:m", "%-d/%-m/%Y %-H:%-M"),
    "month": ("yyyyMM", "%Y%m"),
}

_PRICE = "cast(cast(o_totalprice as decimal(18,2)) as string)"
_SERVICE = (
    "case o_orderkey % 5 when 0 then 'ENVOI CASH' when 1 then 'PAIEMENT CASH' "
    "when 2 then 'CORRIDOR ENVOI' when 3 then 'PAIEMENT CORRIDOR' end"
)
_REFERENCE = "concat('R', cast(o_orderkey % 12000 as string))"
_GROUP = "case o_custkey % 3 when 0 then 'GROUP A' when 1 then 'GROUP B' else 'GROUP C' end"
_COMPANY = "concat('Agence ', n_name)"
_STATUS = "case o_orderstatus when 'F' then 'CANCELLED' when 'O' then 'CONFIRMED' end"
_AMOUNT = (
    f"case when o_orderkey % 50 = 0 then 'n/a' else replace({_PRICE}, '.', "
    "case when o_orderkey % 2 = 0 then ',' else '.' end) end"
)
_TO_RECEIVE = (
    "case when o_orderkey % 40 = 1 then '' else cast(cast(cast(o_totalprice as decimal(18,2)) "
    "- cast(o_custkey % 90 as decimal(18,2)) as decimal(18,2)) as string) end"
)
_COMMISSION = "concat(cast(o_custkey % 7 as string), '.', cast(10 + o_custkey % 90 as string))"
_DATE = (
    "case o_orderkey % 4 when 0 then {dmy} when 1 then {ymd} when 2 then {slash} else 'bad' end"
)
_FILE = "concat('tx_', {month}, '.csv')"
_JOINED = "{orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey"

_EXTENSION = (
    "case doc_id % 6 when 0 then '.py' when 1 then '.JS' when 2 then '.sql' when 3 then '.txt' when 4 then '.tar.gz' else '' end"
)


def _raw_columns() -> str:
    """All 57 raw headers: known transaction fields where there are some, else text made from the keys."""
    known = {
        "service": _SERVICE, "reference": _REFERENCE, "groupe": _GROUP, "compagnie": _COMPANY, "statut": _STATUS,
        "montant": _AMOUNT, "montant_a_percevoir": _TO_RECEIVE, "commission_partenaire": _COMMISSION,
        "date_transaction": _DATE,
    }
    out = []
    for i, (source, target, kind) in enumerate(TARGET_LAYOUT):
        if target in known:
            expr = known[target]
        elif kind == "number":
            expr = (
                f"case when (o_orderkey + {i}) % 9 = 0 then 'n/a' else replace(cast(cast(cast(o_totalprice as decimal(18,2)) "
                f"+ cast({i} as decimal(18,2)) as decimal(18,2)) as string), '.', "
                f"case when (o_orderkey + {i}) % 2 = 0 then ',' else '.' end) end"
            )
        elif kind == "timestamp":
            expr = f"case (o_orderkey + {i}) % 4 when 0 then {{dmy}} when 1 then {{ymd}} when 2 then {{slash}} end"
        elif kind == "code":
            expr = "case o_orderkey % 3 when 0 then 'CONFIRMED' when 1 then 'CREATED' else 'PENDING' end"
        else:
            expr = f"case when (o_orderkey + {i}) % 7 = 0 then null else concat('{target} ', cast(o_custkey as string)) end"
        out.append(f"{expr} as {{q}}{source}{{q}}")
    return ",\n ".join(out)


TEMPLATES = {
    "tx": f"""select o_orderkey as src_row, {_FILE} as file, o_orderkey + 2 as line, {_SERVICE} as service,
 {_REFERENCE} as reference, {_GROUP} as groupe, {_COMPANY} as compagnie, n_name as pays, {_STATUS} as statut,
 case o_custkey % 4 when 0 then 'EUR' when 1 then 'USD' when 2 then 'XAF' end as devise_source,
 {_AMOUNT} as montant, {_TO_RECEIVE} as a_percevoir, {_COMMISSION} as commission, {_DATE} as date_txt, o_orderdate as day
from {_JOINED}""",
    "raw_tx": f"""select o_orderkey as src_row, {_FILE} as file, 'x' as {{q}}#{{q}},
 {_raw_columns()}
from {_JOINED}""",
    "numbers": f"""select o_orderkey as src_row, case o_orderkey % 17
 when 0 then replace({_PRICE}, '.', ',') when 1 then {_PRICE} when 2 then concat('  ', {_PRICE}, ' ')
 when 3 then concat({_PRICE}, 'e3') when 4 then 'nan' when 5 then '1_000' when 6 then concat('1,', {_PRICE})
 when 7 then 'abc' when 8 then '' when 10 then concat('-', {_PRICE}) when 11 then concat('+', cast(o_custkey as string))
 when 12 then '.5' when 13 then '5.' when 14 then '1e3' when 15 then concat({_PRICE}, '9') when 16 then '99999999999999999.5' end as txt
from {{orders}}""",
    "dates": """select o_orderkey as src_row, case o_orderkey % 10 when 0 then {dmy} when 1 then {ymd} when 2 then {slash}
 when 3 then {dmy1} when 4 then {slash1} when 5 then 'bad' when 6 then '31-02-2025 00:00:00' when 7 then ''
 when 8 then concat({ymd}, '.5') end as txt
from {orders}""",
    "contacts": """select c_custkey as id,
 case c_nationkey % 4 when 0 then 'FRANCE' when 1 then 'BELGIQUE' when 2 then 'ALLEMAGNE' else 'ITALIE' end as pays,
 case c_custkey % 5 when 0 then concat('33', cast(100000000 + c_custkey * 7919 as string)) when 1 then 'none'
  when 2 then concat('33', cast(c_custkey as string)) when 3 then '' end as telephone1,
 case c_custkey % 9 when 0 then concat('0', cast(100000000 + c_custkey * 7919 as string))
  when 1 then cast(100000000 + c_custkey * 7919 as string) when 2 then concat('0033', cast(100000000 + c_custkey * 7919 as string))
  when 3 then concat('00330', cast(100000000 + c_custkey * 7919 as string)) when 4 then concat('+33', cast(100000000 + c_custkey * 7919 as string))
  when 5 then ' 12 ' when 6 then concat('33', cast(100000000 + c_custkey * 7919 as string)) when 7 then '' end as telephone2
from {customer}""",
    "screening": """select c_custkey as id_num,
 case when c_custkey % 11 = 0 then concat('X', cast(c_custkey as string)) when c_custkey % 13 = 0 then '' else cast(c_custkey as string) end as id_unique,
 case c_nationkey % 3 when 0 then 'Potential risk' when 1 then 'Clear' end as status_a,
 case c_custkey % 4 when 0 then 'Potential risk' else 'Clear' end as status_b
from {customer}""",
    "fees": """select case when o_orderkey % 31 <> 0 then cast(year(o_orderdate) as int) end as yr,
 case when o_orderkey % 29 = 0 then 'inconnu' when o_orderkey % 37 <> 0 then case month(o_orderdate)
  when 1 then 'janvier' when 2 then 'février' when 3 then 'mars' when 4 then 'avril' when 5 then 'mai' when 6 then 'juin'
  when 7 then 'juillet' when 8 then 'août' when 9 then 'septembre' when 10 then 'octobre' when 11 then 'novembre' else 'décembre' end end as month_name,
 case when o_orderkey % 29 <> 0 then cast(o_totalprice as decimal(18,2)) end as fee
from {orders}""",
    "sheet_rows": f"""select concat('S', cast(o_custkey % 10 as string)) as sheet, cast(o_orderkey + 1 as int) as row_no,
 case when o_orderkey % 3 = 0 then cast(600000 + o_custkey as string) when o_orderkey % 7 = 0 then 'total' end as debit,
 case when o_orderkey % 4 = 0 then case when o_orderkey % 8 = 0 then '000' else cast(700000 + o_custkey as string) end end as credit,
 case when o_orderkey % 5 = 0 then concat('Deposit ', cast(o_orderkey as string)) when o_orderkey % 5 = 1 then 'Other' end as label,
 case when o_orderkey % 9 = 0 then concat('=F', cast(o_orderkey + 1 as string)) when o_orderkey % 10 = 4 then '=SUM(A1:A9)'
  when o_orderkey % 10 = 3 then 'Net Amount' else {_PRICE} end as debit_amount,
 case when o_orderkey % 11 <> 0 then {_PRICE} end as credit_amount
from {{orders}}""",
    "cells": """select sheet, row_no as {q}row{q}, 2 as col, debit as value from sheet_rows where debit is not null
union all select sheet, row_no, 3, credit from sheet_rows where credit is not null
union all select sheet, row_no, 4, label from sheet_rows where label is not null
union all select sheet, row_no, 5, debit_amount from sheet_rows where debit_amount is not null
union all select sheet, row_no, 6, credit_amount from sheet_rows where credit_amount is not null""",
    "merges": """select sheet, row_no as min_row, 4 as min_col, row_no + 2 as max_row, 4 as max_col
from sheet_rows where row_no % 6 = 0""",
    "files": f"""select doc_id, concat(case when doc_id % 50 = 0 then '' else concat('/', lang, '/', case source when 'src3' then 'env3'
 when 'src5' then 'node_modules' when 'src7' then 'data' else source end) end, '/f', cast(doc_id as string), {_EXTENSION}) as path,
 cast(n_chars as bigint) as size, text
from {{documents}}""",
    "edges": """select p_partkey as child, cast(floor(p_partkey / 2) as bigint) as parent from {part} where p_partkey > 0
union all select p_partkey, cast(floor(p_partkey / 3) as bigint) from {part} where p_partkey > 0""",
    "loops": """select child, parent from edges where child <> parent
union all select cast(p_partkey + 1 as bigint), cast(p_partkey as bigint) from {part} where floor(p_partkey / 5) % 3 = 0 and p_partkey % 5 < 4
union all select cast(p_partkey - 4 as bigint), cast(p_partkey as bigint) from {part} where floor(p_partkey / 5) % 3 = 0 and p_partkey % 5 = 4 and p_partkey > 4
union all select cast(floor(p_partkey / 2) as bigint), cast(p_partkey as bigint) from {part} where p_partkey % 97 = 0 and p_partkey > 0""",
    "payments": """select cast(floor(o_orderkey / 500) as bigint) as k, o_orderkey, concat('E', cast(o_orderkey % 5000 as string)) as reference,
 cast(o_totalprice as decimal(18,2)) as amount
from {orders}""",
}
# Tables a template builds on.
NEEDS = {"cells": ("sheet_rows",), "merges": ("sheet_rows",), "loops": ("edges",)}


def _fill(name: str, spark: bool, sf_dir: str = "") -> str:
    return _filled(TEMPLATES[name], spark, sf_dir)


def _filled(text: str, spark: bool, sf_dir: str = "") -> str:
    marks = {t: f"parquet.`{sf_dir}/{t}.parquet`" if spark else t for t in TABLES}
    for key, (java, posix) in _FORMATS.items():
        marks[key] = f"date_format(o_orderdate, '{java}')" if spark else f"strftime(o_orderdate, '{posix}')"
    marks["q"] = "`" if spark else '"'
    return text.format(**marks)


def _needed(names) -> list:
    out = []
    for n in names:
        for m in (*NEEDS.get(n, ()), n):
            if m not in out:
                out.append(m)
    return out


def _ctes(names, spark: bool, sf_dir: str = "") -> str:
    return ",\n".join(f"{n} as ({_fill(n, spark, sf_dir)})" for n in _needed(names))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Fixture as a Spark plan over the Parquet tables."""
    if name == "cells":
        # One pass over the rows where the common SQL text takes a union of five.
        names = ("debit", "credit", "label", "debit_amount", "credit_amount")
        stacked = ", ".join(f"{i}, {n}" for i, n in enumerate(names, 2))
        return frame(spark, sf_dir, "sheet_rows").selectExpr(
            "sheet", "row_no as row", f"stack(5, {stacked}) as (col, value)"
        ).where("value is not null")
    return spark.sql(f"with {_ctes([name], True, sf_dir)}\nselect * from {name}")


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`raw_tx` without its index column, in source order and packed by ranges of it. What is shuffled are the columns that rows are made of."""
    source = f"select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, n_name, {_FILE} as file\nfrom {_JOINED}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = spark.sql(_filled(source, True, sf_dir)).repartitionByRange(parts, "file", "o_orderkey").sortWithinPartitions("file", "o_orderkey")
    return spark.sql(_filled(f"select file,\n {_raw_columns()}\nfrom {{{{rows}}}}", True, sf_dir), rows=ordered)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duck(names, body: str, extra: str = "") -> str:
    """Oracle text: fixture CTEs, further CTEs, then the query."""
    names = [names] if isinstance(names, str) else names
    parts = [p for p in (_ctes(names, False), extra) if p]
    return f"with {', '.join(parts)}\n{body}"
