"""Settlement totals by partner, country, currency and month."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.fixed_values import MONTH_NAMES
from tallyfold.session import constant_rows

SEND, PAY = "ENVOI", "PAIEMENT"
MONEY = "decimal(38,10)"


def contains_word(text: Column, word: str, ignore_case: bool = False) -> Column:
    """Substring test; null is false."""
    if ignore_case:
        text, word = F.lower(text), word.lower()
    return F.coalesce(F.contains(text, F.lit(word)), F.lit(False))


def filter_contains(df: DataFrame, column: str, word: str, ignore_case: bool = False) -> DataFrame:
    return df.where(contains_word(F.col(column), word, ignore_case))


def filter_in_list(df: DataFrame, column: str, values) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def differs(column: Column, value) -> Column:
    """`!=` that keeps nulls."""
    return ~column.eqNullSafe(F.lit(value))


def filter_not_equal(df: DataFrame, column: str, value, keep_nulls: bool = True) -> DataFrame:
    return df.where(differs(F.col(column), value) if keep_nulls else F.col(column) != F.lit(value))


def operation_type(service: Column, send: str = SEND, pay: str = PAY) -> Column:
    return F.when(contains_word(service, send), send).when(contains_word(service, pay), pay)


def total(amount: Column, where: Column | None = None) -> Column:
    """Sum that is 0 when nothing was added."""
    value = amount if where is None else F.when(where, amount)
    return F.coalesce(F.sum(value), F.lit(0)).cast(MONEY)


def total_or_zero(df: DataFrame, column: str, where: Column | None = None, name: str = "total") -> DataFrame:
    return df.agg(total(F.col(column), where).alias(name))


def totals_by_country(view: DataFrame) -> DataFrame:
    """Sum per country and operation type: sends of the full total, payments of the amount to receive."""
    send = F.col("type_operation") == SEND
    amount = F.when(send, F.col("montant_total")).otherwise(F.col("montant_a_percevoir"))
    return (
        view.where(F.col("type_operation").isin(SEND, PAY))
        .groupBy("type_operation", "pays")
        .agg(total(amount).alias("total"))
    )


def country_settlement(view: DataFrame, how: str = "left") -> DataFrame:
    """Sends and payments side by side per country, in one pass over the view.

    `left` keeps countries with a send (a country without payments shows null), `full_outer`
    every country of the view.
    """
    send, pay = F.col("type_operation") == SEND, F.col("type_operation") == PAY

    def side(flag, column):
        return F.when(F.count_if(flag) > 0, total(F.col(column), flag))

    sides = (
        view.where(F.col("pays").isNotNull() & (send | pay))
        .groupBy("pays")
        .agg(side(send, "montant_total").alias("total_envois"), side(pay, "montant_a_percevoir").alias("total_paiements"))
    )
    return sides.where("total_envois is not null") if how == "left" else sides


def totals_by_currency(view: DataFrame, cancelled: str) -> DataFrame:
    """Count and three sums per currency for valid and for cancelled rows; rows without status count in neither."""
    bad, good = F.col("statut") == cancelled, F.col("statut") != cancelled

    def block(flag, suffix):
        return [
            F.count_if(flag).alias(f"n_{suffix}"),
            total(F.col("montant"), flag).alias(f"montant_{suffix}"),
            total(F.col("commission_partenaire"), flag).alias(f"commission_{suffix}"),
            total(F.col("montant_total"), flag).alias(f"total_{suffix}"),
        ]

    return view.where(F.col("statut").isNotNull()).groupBy("devise_source").agg(
        *block(good, "valid"), *block(bad, "cancelled")
    )


def _partner_sums(group: str, cancelled: str):
    service, mine = F.col("service"), F.col("groupe") == group
    sends = mine & contains_word(service, SEND) & differs(F.col("statut"), cancelled)
    pays = mine & contains_word(service, PAY)
    return total(F.col("montant"), sends), total(F.col("montant_a_percevoir"), pays)


def _corridor_sums(word: str, cancelled: str):
    mine = contains_word(F.col("service"), word)
    good, bad = mine & differs(F.col("statut"), cancelled), mine & (F.col("statut") == cancelled)

    def net(flag):
        return (total(F.col("montant"), flag) + total(F.col("commission_partenaire"), flag)).cast(MONEY)

    return net(good), net(bad)


def partner_totals(tx: DataFrame, group: str, cancelled: str) -> DataFrame:
    """Sends (not cancelled) and payments (any status) of one group."""
    sends, pays = _partner_sums(group, cancelled)
    return tx.agg(sends.alias("sends"), pays.alias("payments"))


def corridor_net(tx: DataFrame, word: str, cancelled: str) -> DataFrame:
    """Amount plus commission of one corridor, valid and cancelled apart."""
    good, bad = _corridor_sums(word, cancelled)
    return tx.agg(good.alias("valid"), bad.alias("cancelled"))


def recap_union(tx: DataFrame, group: str, corridor: str, receiving_group: str, cancelled: str, labels) -> DataFrame:
    """Five labelled totals, from one aggregate over the transactions."""
    sends, pays = _partner_sums(group, cancelled)
    good, bad = _corridor_sums(corridor, cancelled)
    received = total(F.col("montant_a_percevoir"), F.col("groupe") == receiving_group)
    row = tx.agg(*[c.alias(f"c{i}") for i, c in enumerate((received, sends, pays, good, bad))])
    pairs = F.array(*[
        F.struct(F.lit(i + 1).cast("long").alias("pos"), F.lit(label).alias("operation"), F.col(f"c{i}").alias("montant"))
        for i, label in enumerate(labels)
    ])
    return row.select(F.inline(pairs))


def country_contains_totals(tx: DataFrame, countries, group: str, cancelled: str) -> DataFrame:
    """Sends and payments of one group for every listed country that the company name contains.

    Each row is fanned out to its matching countries by an expression, summed before the exchange,
    and the short list joined last so that countries without rows show 0.
    """
    names = list(countries)
    send, pay = contains_word(F.col("service"), SEND), contains_word(F.col("service"), PAY)
    company = F.lower("compagnie")
    matches = F.array_compact(F.array(*[F.when(F.contains(company, F.lit(n.lower())), n) for n in names]))
    sums = (
        tx.where((F.col("groupe") == group) & (send | pay))
        .select(F.explode(matches).alias("country"), "montant", "montant_a_percevoir", "statut",
                send.alias("is_send"), pay.alias("is_pay"))
        .groupBy("country")
        .agg(total(F.col("montant"), F.col("is_send") & differs(F.col("statut"), cancelled)).alias("sends"),
             total(F.col("montant_a_percevoir"), F.col("is_pay")).alias("payments"))
    )
    listed = constant_rows(tx.sparkSession, "country string", [(n,) for n in names])
    zero = F.lit(0).cast(MONEY)
    return listed.join(sums, "country", "left").select(
        "country", F.coalesce("sends", zero).alias("sends"), F.coalesce("payments", zero).alias("payments")
    )


def month_position(name: Column, months=MONTH_NAMES) -> Column:
    """Calendar position of a month name; null for an unknown one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, months)), name), F.lit(0))


def fees_by_month(fees: DataFrame) -> DataFrame:
    """Sum per year and month name, 0 where all fees are null; rows without year or month are dropped."""
    return fees.where("yr is not null and month_name is not null").groupBy("yr", "month_name").agg(
        F.coalesce(F.sum("fee"), F.lit(0)).cast(MONEY).alias("total_fees")
    )


def sort_calendar_month(monthly: DataFrame, months=MONTH_NAMES) -> DataFrame:
    """Year, then month by the calendar; unknown names last within the year."""
    position = month_position(F.col("month_name"), months)
    return monthly.withColumn("month_no", position).orderBy("yr", F.col("month_no").asc_nulls_last())


def fees_year_pivot(monthly: DataFrame, years, months=MONTH_NAMES) -> DataFrame:
    """Months as rows in calendar order, the given years as columns and the rest as `other_years`; a missing cell is null."""
    known = monthly.withColumn("month_no", month_position(F.col("month_name"), months)).where("month_no is not null")
    cells = [F.sum(F.when(F.col("yr") == y, F.col("total_fees"))).alias(f"y{y}") for y in years]
    other = F.sum(F.when(~F.col("yr").isin(list(years)), F.col("total_fees"))).alias("other_years")
    return known.groupBy("month_no", "month_name").agg(*cells, other).orderBy("month_no")
