"""Queries of settlement totals."""

from pyspark.sql import functions as F

from tallyfold.functions.parsing import locale_number, plain_number
from tallyfold.operators import ingest, settle
from tallyfold.plans import sql_text as q
from tallyfold.plans.fixtures import duck, frame
from tallyfold.plans.registry import query

GROUP, RECEIVER, CORRIDOR, CANCELLED = "GROUP A", "GROUP B", "CORRIDOR", "CANCELLED"
LABELS = ("Receiving group - total", "Group - sends", "Group - payments", "Corridor - valid", "Corridor - cancelled")
COUNTRIES = ("NATION_1", "nation_15", "NATION_7", "NATION_22", "ATLANTIS")
YEARS = tuple(range(1995, 2002))
PIVOTED = YEARS[:-2]  # the last two are summed as other years


def typed(spark, sf, number=locale_number):
    tx = frame(spark, sf, "tx")
    return tx.select(
        "src_row", "file", "line", "service", "reference", "groupe", "compagnie", "pays", "statut", "devise_source",
        number(F.col("montant")).alias("montant"), number(F.col("a_percevoir")).alias("montant_a_percevoir"),
        number(F.col("commission")).alias("commission_partenaire"),
    )


def view(spark, sf):
    return typed(spark, sf).withColumns({
        "type_operation": settle.operation_type(F.col("service")),
        "montant_total": F.col("montant") + F.col("commission_partenaire"),
    })


def doubles(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


_SENDS = "groupe = 'GROUP A' and service like '%ENVOI%' and statut is distinct from 'CANCELLED'"
_PAYS = "groupe = 'GROUP A' and service like '%PAIEMENT%'"
_NET = "service like '%CORRIDOR%'"


def _net(where):
    return (
        f"cast(coalesce(sum(montant) filter (where {where}), 0) + coalesce(sum(commission_partenaire) filter (where {where}), 0) as double)"
    )


_VALID, _BAD = f"{_NET} and statut is distinct from 'CANCELLED'", f"{_NET} and statut = 'CANCELLED'"


@query(
    "recap_union",
    duck("tx", "select cast(1 as bigint) as pos, 'Receiving group - total' as operation, c0 as montant from r "
         "union all select 2, 'Group - sends', c1 from r union all select 3, 'Group - payments', c2 from r "
         "union all select 4, 'Corridor - valid', c3 from r union all select 5, 'Corridor - cancelled', c4 from r",
         q.TYPED + f""", first as (select * from (select *, row_number() over (partition by service, reference order by file, line) as n
 from typed where service is not null) where n = 1),
 r as (select {q.total('montant_a_percevoir', "groupe = 'GROUP B'")} as c0, {q.total('montant', _SENDS)} as c1,
 {q.total('montant_a_percevoir', _PAYS)} as c2, {_net(_VALID)} as c3, {_net(_BAD)} as c4 from first)"""),
)
def recap_union(spark, sf):
    """Flagship: parse, keep the first row of every key, one conditional aggregate, five labelled totals."""
    rows = typed(spark, sf).where("service is not null and reference is not null")
    kept = ingest.first_wins_dedup(rows)
    return doubles(settle.recap_union(kept, GROUP, CORRIDOR, RECEIVER, CANCELLED, LABELS), "montant")


@query("total_or_zero", duck("tx", f"select {q.total('montant_a_percevoir')} as total, "
       f"""{q.total('montant', "type_operation = 'NONE'")} as nothing from v""", q.VIEW))
def total_or_zero(spark, sf):
    v = view(spark, sf)
    all_rows = settle.total_or_zero(v, "montant_a_percevoir")
    none = settle.total_or_zero(v, "montant", F.col("type_operation") == "NONE", "nothing").scalar()
    return doubles(all_rows.withColumn("nothing", none), "total", "nothing")


@query(
    "totals_by_country",
    duck("tx", f"""select type_operation, pays, {q.total('montant_total')} as total from v where type_operation = 'ENVOI' group by 1, 2
union all select type_operation, pays, {q.total('montant_a_percevoir')} from v where type_operation = 'PAIEMENT' group by 1, 2""", q.VIEW),
)
def totals_by_country(spark, sf):
    return doubles(settle.totals_by_country(view(spark, sf)), "total")


_CUR = ", ".join(
    f"count(*) filter (where {w}) as n_{s}, " + ", ".join(
        f"{q.total(c, w)} as {n}_{s}" for n, c in (("montant", "montant"), ("commission", "commission_partenaire"), ("total", "montant_total")))
    for s, w in (("valid", "statut <> 'CANCELLED'"), ("cancelled", "statut = 'CANCELLED'"))
)


@query("totals_by_currency", duck("tx", f"select coalesce(devise_source, '-') as devise_source, {_CUR} from v where statut is not null group by devise_source", q.VIEW))
def totals_by_currency(spark, sf):
    out = settle.totals_by_currency(view(spark, sf), CANCELLED)
    money = [c for c in out.columns if c.startswith(("montant_", "commission_", "total_"))]
    return doubles(out, *money).withColumn("devise_source", F.coalesce("devise_source", F.lit("-")))


@query(
    "country_settlement",
    duck("tx", """select e.pays, e.total_envois, p.total_paiements
from (select pays, cast(coalesce(sum(montant_total), 0) as double) as total_envois from v where type_operation = 'ENVOI' group by 1) e
left join (select pays, cast(coalesce(sum(montant_a_percevoir), 0) as double) as total_paiements from v where type_operation = 'PAIEMENT' group by 1) p
on e.pays = p.pays""", q.VIEW),
)
def country_settlement(spark, sf):
    return doubles(settle.country_settlement(view(spark, sf)), "total_envois", "total_paiements")


@query("partner_totals", duck("tx", f"select {q.total('montant', _SENDS)} as sends, {q.total('montant_a_percevoir', _PAYS)} as payments from typed", q.TYPED_PLAIN))
def partner_totals(spark, sf):
    return doubles(settle.partner_totals(typed(spark, sf, plain_number), GROUP, CANCELLED), "sends", "payments")


@query("corridor_net", duck("tx", f"select {_net(_VALID)} as valid, {_net(_BAD)} as cancelled from typed", q.TYPED_PLAIN))
def corridor_net(spark, sf):
    return doubles(settle.corridor_net(typed(spark, sf, plain_number), CORRIDOR, CANCELLED), "valid", "cancelled")


_LIST = ", ".join(f"('{c}')" for c in COUNTRIES)


@query(
    "country_contains_totals",
    duck("tx", f"""select country, {q.total('montant', _SENDS)} as sends, {q.total('montant_a_percevoir', _PAYS)} as payments
from (values {_LIST}) c(country) left join typed on contains(lower(compagnie), lower(country)) group by 1""", q.TYPED_PLAIN),
)
def country_contains_totals(spark, sf):
    out = settle.country_contains_totals(typed(spark, sf, plain_number), COUNTRIES, GROUP, CANCELLED)
    return doubles(out, "sends", "payments")


_MONTHLY = "monthly as (select yr, month_name, coalesce(sum(fee), 0) as total_fees from fees where yr is not null and month_name is not null group by 1, 2)"


@query("fees_by_month", duck("fees", "select yr, month_name, cast(total_fees as double) as total_fees from monthly", _MONTHLY))
def fees_by_month(spark, sf):
    return doubles(settle.fees_by_month(frame(spark, sf, "fees")), "total_fees")


@query("sort_calendar_month", duck("fees", f"""select yr, month_name, coalesce({q.MONTH_CASE}, 99) as month_no, cast(total_fees as double) as total_fees
from monthly order by yr, 3""", _MONTHLY))
def sort_calendar_month(spark, sf):
    monthly = doubles(settle.fees_by_month(frame(spark, sf, "fees")), "total_fees")
    ordered = settle.sort_calendar_month(monthly)
    return ordered.select("yr", "month_name", F.coalesce("month_no", F.lit(99)).cast("int").alias("month_no"), "total_fees")


@query(
    "fees_year_pivot",
    duck("fees", f"select {q.MONTH_CASE} as month_no, month_name, "
         + ", ".join(f"cast(sum(total_fees) filter (where yr = {y}) as double) as y{y}" for y in PIVOTED) + ", cast(sum(total_fees) filter (where yr not in (" + ", ".join(map(str, PIVOTED)) + ")) as double) as other_years"
         + f" from monthly where {q.MONTH_CASE} is not null group by 1, 2", _MONTHLY),
)
def fees_year_pivot(spark, sf):
    wide = settle.fees_year_pivot(settle.fees_by_month(frame(spark, sf, "fees")), PIVOTED)
    return doubles(wide, *[f"y{y}" for y in PIVOTED], "other_years").withColumn("month_no", F.col("month_no").cast("int"))
