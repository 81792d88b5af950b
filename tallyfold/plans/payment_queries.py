"""Queries of payment messages, built as text from `orders` and parsed back."""

from pyspark.sql import functions as F

from tallyfold.fixed_values import PAYMENT_NAMESPACE
from tallyfold.operators import payments, render
from tallyfold.plans.fixtures import duck, frame
from tallyfold.plans.registry import query
from tallyfold.plans.settle_queries import doubles
from tallyfold.session import new_table_path
from tallyfold.sources import documents

# What is wrong with message k, by k % 10: 2 control sum off by one, 4 text after the root, 6 no control sum,
# 7 another message version, 8 a non-numeric amount.
_GOOD = "k % 10 not in (4, 7, 8)"


def messages(spark, sf):
    """One message per 500 orders: file, value."""
    pay = frame(spark, sf, "payments")
    k = F.col("k") % 10
    line = F.format_string(
        '<CdtTrfTxInf><PmtId><EndToEndId>%s</EndToEndId></PmtId><Amt><InstdAmt Ccy="EUR">%s</InstdAmt></Amt></CdtTrfTxInf>',
        "reference", F.when((k == 8) & (F.col("o_orderkey") % 500 == 3), "x").otherwise(F.col("amount").cast("string")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("x"))))
    packed = pay.groupBy("k").agg(
        (F.sum("amount") + F.when(k == 2, 1).otherwise(0)).cast("decimal(28,2)").alias("ctrl"),
        F.array_join(F.transform(ordered, lambda r: r["x"]), "").alias("body"),
    )
    namespace = F.when(k == 7, PAYMENT_NAMESPACE.replace(".09", ".03")).otherwise(PAYMENT_NAMESPACE)
    return packed.select(
        F.concat(F.lit("f"), F.col("k").cast("string"), F.lit(".xml")).alias("file"),
        F.concat(
            F.lit('<?xml version="1.0"?><Document xmlns="'), namespace, F.lit('"><CstmrCdtTrfInitn><GrpHdr>'),
            F.when(k == 6, "").otherwise(F.concat(F.lit("<CtrlSum>"), F.col("ctrl").cast("string"), F.lit("</CtrlSum>"))),
            F.lit("</GrpHdr><PmtInf>"), F.col("body"), F.lit("</PmtInf></CstmrCdtTrfInitn></Document>"),
            F.when(k == 4, "<oops").otherwise("\n"),
        ).alias("value"),
    )


def parsed(spark, sf):
    return payments.parse_messages(messages(spark, sf))


_PER_FILE = """pf as (select k, concat('f', cast(k as varchar), '.xml') as file,
 case when k % 10 = 7 then 0 else count(*) end as n, case when k % 10 = 7 then 0 else sum(amount) end as total,
 case when k % 10 in (6, 7) then 0 else sum(amount) + case when k % 10 = 2 then 1 else 0 end end as ctrl_sum, k % 10 in (6, 7) as ctrl_missing
 from payments where k % 10 not in (4, 8) group by k)"""


@query("scan_payment_xml", duck("payments", f"select concat('f', cast(k as varchar), '.xml') as file, reference, cast(amount as double) as amount from payments where {_GOOD}"))
def scan_payment_xml(spark, sf):
    return doubles(payments.scan_payment_xml(messages(spark, sf)), "amount")


@query(
    "flatten_message",
    duck("payments", f"""select concat('f', cast(k as varchar), '.xml') as file, cast(row_number() over (partition by k order by o_orderkey) - 1 as int) as ord,
 reference, cast(amount as double) as amount from payments where {_GOOD}"""),
)
def flatten_message(spark, sf):
    return doubles(payments.flatten_message(parsed(spark, sf)), "amount")


@query(
    "rejected_files",
    duck("payments", """select distinct concat('f', cast(k as varchar), '.xml') as file,
 case when k % 10 = 4 then 'not well formed' else 'amount, reference or control sum unusable' end as reason from payments where k % 10 in (4, 8)"""),
)
def rejected_files(spark, sf):
    return payments.rejected_files(parsed(spark, sf))


@query(
    "reconcile_control_sum",
    duck("payments", """select file, n, cast(total as double) as total, cast(ctrl_sum as double) as ctrl_sum, ctrl_missing,
 cast(total - ctrl_sum as double) as difference, total <> ctrl_sum as has_gap from pf""", _PER_FILE),
)
def reconcile_control_sum(spark, sf):
    return doubles(payments.reconcile_control_sum(parsed(spark, sf)), "total", "ctrl_sum", "difference")


@query(
    "reconcile_summary",
    duck("payments", """select count(*) as files, cast(coalesce(sum(n), 0) as bigint) as n, cast(coalesce(sum(total), 0) as double) as total,
 cast(coalesce(sum(ctrl_sum), 0) as double) as ctrl_sum, cast(coalesce(sum(total - ctrl_sum), 0) as double) as difference,
 count(*) filter (where total <> ctrl_sum) as files_with_gap, coalesce(sum(total - ctrl_sum), 0) = 0 as balanced_net from pf""", _PER_FILE),
)
def reconcile_summary(spark, sf):
    summary = payments.reconcile_summary(payments.reconcile_control_sum(parsed(spark, sf)))
    return doubles(summary, "total", "ctrl_sum", "difference")


@query("gap_files", duck("payments", "select file, cast(total - ctrl_sum as double) as difference from pf where total <> ctrl_sum", _PER_FILE))
def gap_files(spark, sf):
    return doubles(payments.gap_files(payments.reconcile_control_sum(parsed(spark, sf))), "difference")


# References are read from every well-formed file of the right version, also when an amount is unusable.
_OCC = "occ as (select reference, count(*) as occurrences from payments where k % 10 not in (4, 7) group by 1)"


def occurrences(spark, sf):
    return payments.reference_occurrences(payments.message_references(parsed(spark, sf)))


@query("reference_occurrences", duck("payments", "select reference, occurrences from occ", _OCC))
def reference_occurrences(spark, sf):
    return occurrences(spark, sf)


@query("reference_totals", duck("payments", """select cast(coalesce(sum(occurrences), 0) as bigint) as found, count(*) as distinct_references,
 count(*) filter (where occurrences > 1) as duplicated_references from occ""", _OCC))
def reference_totals(spark, sf):
    return payments.reference_totals(occurrences(spark, sf))


@query("quoted_reference_list", duck("payments", """select reference, concat('''', reference, '''', case when reference = (select max(reference) from occ) then '' else ',' end) as line from occ""", _OCC))
def quoted_reference_list(spark, sf):
    return render.quoted_reference_list(occurrences(spark, sf))


@query("separator_except_last", "select c_custkey, concat(c_name, case when c_custkey = (select max(c_custkey) from customer) then '' else ';' end) as line from customer")
def separator_except_last(spark, sf):
    names = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name")
    lines = render.with_separator(names, "c_custkey", F.col("c_name"), ";")
    return lines.select("c_custkey", "line")


@query("duplicate_reference_lines", duck("payments", """select reference, concat('''', reference, ''' : ', cast(occurrences as varchar), ' occurrences') as line
from occ where occurrences > 1""", _OCC))
def duplicate_reference_lines(spark, sf):
    return render.duplicate_reference_lines(occurrences(spark, sf))


@query(
    "decimal_array_literal",
    duck("payments", """select file, cast(ord as int) as ord, case when ord = -1 then 'BigDecimal[] valeurs = {' when ord = n then '};'
 else concat('    new BigDecimal("', amount, '")', case when ord < n - 1 then ',' else '' end) end as line from
 (select file, ord, amount, n from good union all select distinct file, -1, null, n from good union all select distinct file, n, null, n from good)""",
         f"""good as (select concat('f', cast(k as varchar), '.xml') as file, row_number() over (partition by k order by o_orderkey) - 1 as ord,
 count(*) over (partition by k) as n, cast(amount as varchar) as amount from payments where {_GOOD})"""),
)
def decimal_array_literal(spark, sf):
    rows = payments.flatten_message(parsed(spark, sf))
    return render.decimal_array_literal(rows.select("file", "ord", F.col("amount").cast("decimal(28,2)").cast("string").alias("amount")))


def _in_parts(spark, sf):
    """The messages as files, read back in pieces."""
    path = new_table_path(spark, "pain")
    messages(spark, sf).withColumnRenamed("file", "name").write.partitionBy("name").text(path)
    parts = documents.scan_payment_parts(spark, f"{path}/*")
    return payments.parse_message_parts(parts.withColumn("file", F.regexp_extract("file", r"name=([^/]*)/", 1)))


@query("scan_payment_parts", duck("payments", f"select concat('f', cast(k as varchar), '.xml') as file, reference, cast(amount as double) as amount from payments where {_GOOD}"))
def scan_payment_parts(spark, sf):
    return doubles(_in_parts(spark, sf)[1].select("file", "reference", "amount"), "amount")


@query(
    "reconcile_parts",
    duck("payments", """select file, n, cast(total as double) as total, cast(ctrl_sum as double) as ctrl_sum, ctrl_missing,
 cast(total - ctrl_sum as double) as difference, total <> ctrl_sum as has_gap from pf""", _PER_FILE),
)
def reconcile_parts(spark, sf):
    return doubles(payments.reconcile_parts(*_in_parts(spark, sf)), "total", "ctrl_sum", "difference")
