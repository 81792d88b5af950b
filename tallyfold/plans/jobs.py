"""Whole jobs: folder in, tables out. Each is one lazy plan per result; the writers are in `sources.sinks`."""

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.fixed_values import TARGET_LAYOUT
from tallyfold.functions.naming import base_name, file_category
from tallyfold.functions.parsing import is_numeric_id, locale_number, plain_number
from tallyfold.functions.phones import normalise_phones, phone_pick_valid
from tallyfold.operators import contacts, corpus, ingest, ledger, payments, render, settle
from tallyfold.session import apply_plan_settings
from tallyfold.sources import documents, sinks, tables


@dataclass(frozen=True)
class Partners:
    """Names a settlement depends on; they belong to the caller."""

    group: str
    receiving_group: str
    country_group: str
    corridor: str
    cancelled: str
    countries: tuple = ()


def preview_import(spark: SparkSession, folder: str, stored: DataFrame, layout=TARGET_LAYOUT, dry_run: bool = True) -> DataFrame:
    """Rows of a folder of raw files with their target columns and import status; nothing is written.

    `import_report` and `import_errors` summarise it. The loading form is `stream_drop_folder`.
    """
    apply_plan_settings(spark)
    raw = tables.scan_csv_numbered(spark, folder)
    typed = ingest.project_target_layout(raw, layout, keep=("file", "line"))
    return ingest.classify_import(typed, stored, dry_run=dry_run)


def transactions_csv(spark: SparkSession, path) -> DataFrame:
    """Raw transactions with the settlement columns; numbers with a comma are not numbers here."""
    names = {"Groupe": "groupe", "Service": "service", "Statut": "statut", "Compagnie": "compagnie"}
    money = {"Montant": "montant", "Montant à percevoir": "montant_a_percevoir", "Commission Partenaire": "commission_partenaire"}
    raw = tables.scan_csv_text(spark, path, wanted=[*names, *money])
    return raw.select(
        *[F.col(s).alias(t) for s, t in names.items()], *[plain_number(F.col(s)).alias(t) for s, t in money.items()]
    )


def day_close(tx: DataFrame, p: Partners) -> dict[str, DataFrame]:
    """Sections of the day's closing: partner sends and payments, countries, corridor."""
    pair = "stack(2, '{0}', {1}, '{2}', {3}) as (kind, amount)"
    return {
        "partner": settle.partner_totals(tx, p.group, p.cancelled).selectExpr(pair.format("sends", "sends", "payments", "payments")),
        "countries": settle.country_contains_totals(tx, p.countries, p.country_group, p.cancelled),
        "corridor": settle.corridor_net(tx, p.corridor, p.cancelled).selectExpr(pair.format("valid", "valid", "cancelled", "cancelled")),
    }


def settlement_view(stored: DataFrame, country: str = "destination") -> DataFrame:
    """Stored transactions in the shape the recap reads: operation type, country, full amount."""
    return stored.withColumns({
        "type_operation": settle.operation_type(F.col("service")), "pays": F.col(country),
        "montant_total": F.col("montant") + F.col("commission_partenaire"),
    })


def day_recap(view: DataFrame, p: Partners, labels) -> dict[str, DataFrame]:
    """Sections of the daily recap: five labelled totals, countries, currencies valid and cancelled."""
    mine = view.where(F.col("groupe") == p.country_group)
    corridor = view.where(settle.contains_word(F.col("service"), p.corridor))
    currency = settle.totals_by_currency(corridor, p.cancelled)
    sides = {s: [c for c in currency.columns if c.endswith(f"_{s}")] for s in ("valid", "cancelled")}
    return {
        "recap": settle.recap_union(view, p.group, p.corridor, p.receiving_group, p.cancelled, labels),
        "countries": settle.country_settlement(mine),
        "corridor_valid": currency.where("n_valid > 0").select("devise_source", *sides["valid"]),
        "corridor_cancelled": currency.where("n_cancelled > 0").select("devise_source", *sides["cancelled"]),
    }


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    """One folder per section, each with its own columns."""
    for name, df in sections.items():
        sinks.sink_csv(df, f"{path}/sheet={name}")


def reconcile_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Control-sum report over a folder of payment messages."""
    apply_plan_settings(spark)
    messages = payments.parse_messages(documents.scan_payment_folder(spark, folder))
    per_file = payments.reconcile_control_sum(messages)
    return {
        "files": per_file, "summary": payments.reconcile_summary(per_file), "gaps": payments.gap_files(per_file),
        "rejected": payments.rejected_files(messages), "payments": payments.flatten_message(messages),
    }


def reference_lists(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Distinct references as a quoted list, the repeated ones with their count, and totals."""
    messages = payments.parse_messages(documents.scan_payment_folder(spark, folder))
    found = payments.reference_occurrences(payments.message_references(messages))
    return {
        "list": render.quoted_reference_list(found), "duplicates": render.duplicate_reference_lines(found),
        "totals": payments.reference_totals(found),
    }


def screening_changes(customers: DataFrame, key: str, status_a: str, status_b: str, risk: str) -> DataFrame:
    """Customers with a numeric identifier, routed by status, as segment changes."""
    valid = customers.where(is_numeric_id(F.col(key)))
    return contacts.segment_changes(contacts.route_screening(valid, status_a, status_b, risk), key)


def phone_changes(customers: DataFrame, country: str, columns=("telephone1", "telephone2")) -> DataFrame:
    """Normalised numbers of one country, rows with a valid one, as contact changes."""
    mine = settle.filter_in_list(customers, "pays", [country])
    return contacts.contact_changes(phone_pick_valid(normalise_phones(mine, columns), *columns), "id", *columns)


def ledger_documents(cells: DataFrame, merges: DataFrame, word: str, amount: str | None = None, formula: str = "") -> DataFrame:
    """Nested entries of a workbook, with one formula set if asked for."""
    docs = ledger.entry_documents(ledger.build_entries(cells, merges, word))
    return docs if amount is None else ledger.update_nested_by_match(docs, amount, formula)


def relative_files(spark: SparkSession, folder: str) -> DataFrame:
    """A folder's files with their path below it."""
    scheme = r"^([A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?)?"
    root = "/" + re.sub(scheme, "", folder).strip("/")
    below = F.regexp_replace("path", rf"{scheme}\Q{root}\E/+", "/")
    return documents.scan_corpus(spark, folder).withColumn("path", below)


def corpus_report(files: DataFrame, root: str) -> dict[str, DataFrame]:
    """Lines by extension, sizes by top entry, tokens, tree listing and bundle of a file corpus."""
    sizes = corpus.size_by_top_entry(files)
    return {
        "lines": corpus.sort_lines_desc(corpus.lines_by_extension(files)), "totals": corpus.corpus_totals(files),
        "sizes": corpus.sort_dirs_then_size(sizes), "size_totals": corpus.size_totals(sizes),
        "tokens": corpus.token_totals(corpus.tokens_by_file(files)), "tree": corpus.path_tree(files, root),
        "bundle": corpus.bundle_lines(files),
    }


def tidy_plan(incoming: DataFrame, present: DataFrame) -> DataFrame:
    """Where the files of a folder would go: category folder and free name. `present` is `(category, name)`."""
    named = file_category(incoming).withColumn("name", base_name(F.col("path")))
    return corpus.collision_suffix(named.select("path", "category", "name"), present)


def translation_entries(files: DataFrame) -> DataFrame:
    """Quoted strings of a source tree as `(lang, key, text)`."""
    strings = corpus.union_distinct(corpus.extract_quoted_strings(files))
    return corpus.translation_entries(corpus.last_wins_dictionary(strings))


def fee_table(fees_csv: DataFrame, years) -> DataFrame:
    """Monthly fees by year from a text table `année, mois, total_frais`."""
    fees = fees_csv.select(
        F.col("`année`").try_cast("int").alias("yr"), F.col("mois").alias("month_name"), locale_number(F.col("total_frais")).alias("fee")
    )
    return settle.fees_year_pivot(settle.fees_by_month(fees), years)
