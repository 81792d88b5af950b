"""Operators on small edge tables, against brute force where there is a rule to state."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import contacts, corpus, graph, ingest, ledger, numbering, payments, relational, render, settle
from tallyfold.sources import documents, sinks, tables

NS = "urn:iso:std:iso:20022:tech:xsd:pain.001.001.09"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- ingest

def batch(spark):
    return spark.createDataFrame(
        [("a.csv", 2, "S", "1"), ("a.csv", 3, "S", "1"), ("b.csv", 2, "S", "1"), ("b.csv", 3, "S", "9"), ("b.csv", 4, None, "2"),
         ("b.csv", 5, "S", ""), ("a.csv", 4, "T", "1"), ("b.csv", 6, "T", None)],
        "file string, line int, service string, reference string",
    )


def stored(spark):
    return spark.createDataFrame([("S", "9"), ("S", "9"), ("S", "8")], "service string, reference string")


def test_classify_import(spark):
    got = {(r.file, r.line): r.status for r in ingest.classify_import(batch(spark), stored(spark)).collect()}
    assert got == {
        ("a.csv", 2): "accepted", ("a.csv", 3): "duplicate", ("b.csv", 2): "duplicate", ("b.csv", 3): "duplicate",
        ("b.csv", 4): "missing_key", ("b.csv", 5): "missing_key", ("a.csv", 4): "accepted", ("b.csv", 6): "missing_key",
    }


def test_dry_run_passes_repeats_of_the_batch(spark):
    got = {(r.file, r.line): r.status for r in ingest.classify_import(batch(spark), stored(spark), dry_run=True).collect()}
    assert got[("a.csv", 3)] == got[("b.csv", 2)] == "accepted"
    assert got[("b.csv", 3)] == "duplicate"


def test_report_adds_up(spark):
    judged = ingest.classify_import(batch(spark), stored(spark))
    report = {r.file: r for r in ingest.import_report(judged).collect()}
    assert report[None].rows_processed == 8 and report[None].rows_success == 2
    assert report[None].rows_failed == sum(r.rows_failed for f, r in report.items() if f)
    assert report["a.csv"].has_critical is False and report["b.csv"].has_critical is True
    assert ingest.import_errors(judged).where("is_duplicate").count() == 3


def test_insert_if_absent_keeps_null_keys(spark):
    fresh = ingest.insert_if_absent(batch(spark), stored(spark))
    assert fresh.count() == 7 and ingest.already_stored(batch(spark), stored(spark)).count() == 1


def test_missing_headers_become_null(spark):
    raw = spark.createDataFrame([("1", "2,5", "x")], "`#` string, Montant string, Service string")
    out = ingest.project_target_layout(raw).first()
    assert float(out.montant) == 2.5 and out.service == "x" and out.reference is None and len(out) == 57


# --- hot keys: one key holds a third of all rows

def hot(spark, n=60_000):
    return spark.range(n).select(
        F.lit("f").alias("file"), F.col("id").alias("line"), F.lit("S").alias("service"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("reference"),
    )


def test_hot_key_dedup_and_report(spark):
    judged = ingest.classify_import(hot(spark), stored(spark))
    got = dict(rows(judged.groupBy("status").count()))
    # 40,000 own keys and the hot one, less key 8, which is stored (9 is a multiple of 3, hence no key here).
    assert got == {"accepted": 40_000, "duplicate": 20_000}


@pytest.mark.parametrize("how", ["insert", "classify", "not_in"])
def test_hot_key_is_split_by_the_skew_join(spark, how):
    lowered = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50000", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in lowered}
    for k, v in lowered.items():
        spark.conf.set(k, v)
    try:
        data = hot(spark, 400_000).withColumn("pad", F.sha2(F.col("line").cast("string"), 256)).repartition(16)
        other = spark.range(300_000, 700_000).select(F.lit("S").alias("service"), F.col("id").cast("string").alias("reference"))
        if how == "insert":
            out = ingest.insert_if_absent(data, other)
        elif how == "classify":
            out = ingest.classify_import(data, other)
        else:
            out = relational.filter_not_in_subquery(data, "reference", other, "reference")
        n = out.count() if how != "classify" else out.where("status = 'accepted'").count()
        df = out.agg(F.bit_xor(F.xxhash64("pad")))
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
        fresh = 400_000 - sum(1 for i in range(300_000, 400_000) if i % 3)
        assert n == (fresh if how != "classify" else fresh - 133_334 + 1)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_key_row_numbers(spark):
    data = hot(spark).select("reference", "line")
    numbered = numbering.row_number_by_position(data, ["reference"], "line", width=1000)
    assert numbered.where("reference = 'hot' and row_no <> line / 3 + 1").count() == 0
    assert numbered.where("reference <> 'hot' and row_no <> 1").count() == 0


def test_long_list_continues_in_parts(spark):
    parts = numbering.ordered_list_by_key(hot(spark, 9000).where("reference = 'hot'"), ["reference"], "line", "line", chunk=1000)
    got = {r.part: r for r in parts.collect()}
    assert sorted(got) == [0, 1, 2] and all(r.n_items == 1000 for r in got.values())
    assert got[1]["items"].split(", ")[0] == "3000"


# --- settlement

def test_sums_over_nothing_are_zero(spark):
    empty = spark.createDataFrame([], "service string, groupe string, statut string, montant decimal(18,2), montant_a_percevoir decimal(18,2), commission_partenaire decimal(18,2), compagnie string")
    assert [float(v) for v in settle.partner_totals(empty, "G", "X").first()] == [0.0, 0.0]
    assert [float(v) for v in settle.corridor_net(empty, "C", "X").first()] == [0.0, 0.0]
    got = settle.country_contains_totals(empty, ["A", "B"], "G", "X").collect()
    assert sorted((r.country, float(r.sends), float(r.payments)) for r in got) == [("A", 0.0, 0.0), ("B", 0.0, 0.0)]


def test_country_settlement_sides(spark):
    view = spark.createDataFrame(
        [("ENVOI", "A", 1.0, 9.0), ("ENVOI", "A", None, 9.0), ("PAIEMENT", "B", 5.0, 2.0), ("ENVOI", "C", 3.0, 0.0), ("PAIEMENT", "C", 3.0, None)],
        "type_operation string, pays string, montant_total double, montant_a_percevoir double",
    )
    left = {r.pays: (r.total_envois, r.total_paiements) for r in settle.country_settlement(view).collect()}
    assert {k: tuple(None if x is None else float(x) for x in v) for k, v in left.items()} == {"A": (1.0, None), "C": (3.0, 0.0)}
    assert {r.pays for r in settle.country_settlement(view, "full_outer").collect()} == {"A", "B", "C"}


def test_row_matches_several_countries(spark):
    tx = spark.createDataFrame(
        [("ENVOI", "G", None, "Bureau NIGERIA", 2.0, 0.0), ("PAIEMENT", "G", "X", "niger", 0.0, 4.0), ("ENVOI", "G", "X", "niger", 1.0, 0.0), ("ENVOI", "H", None, "niger", 8.0, 0.0), ("ENVOI", "G", None, None, 8.0, 0.0)],
        "service string, groupe string, statut string, compagnie string, montant double, montant_a_percevoir double",
    )
    got = {r.country: (float(r.sends), float(r.payments)) for r in settle.country_contains_totals(tx, ["NIGER", "NIGERIA"], "G", "X").collect()}
    assert got == {"NIGER": (2.0, 4.0), "NIGERIA": (2.0, 0.0)}


def test_months_sort_by_the_calendar(spark):
    monthly = spark.createDataFrame([(2024, "août", 1.0), (2024, "avril", 2.0), (2024, "??", 3.0), (2023, "décembre", 4.0)], "yr int, month_name string, total_fees double")
    assert [r.month_name for r in settle.sort_calendar_month(monthly).collect()] == ["décembre", "avril", "août", "??"]
    assert [(r.month_name, r.y2024, r.other_years) for r in settle.fees_year_pivot(monthly, [2024]).collect()] == [("avril", 2.0, None), ("août", 1.0, None), ("décembre", None, 4.0)]
    wide = settle.fees_year_pivot(monthly, [2023, 2024]).collect()
    assert [(r.month_name, r.y2023, r.y2024) for r in wide] == [("avril", None, 2.0), ("août", None, 1.0), ("décembre", 4.0, None)]


# --- payment messages

PAY = '<CdtTrfTxInf><PmtId><EndToEndId>{r}</EndToEndId></PmtId><Amt><InstdAmt Ccy="EUR">{a}</InstdAmt></Amt></CdtTrfTxInf>'


def message(pays, ctrl="<CtrlSum>3.00</CtrlSum>", block="", ns=NS):
    return f'<Document xmlns="{ns}"><CstmrCdtTrfInitn><GrpHdr>{ctrl}</GrpHdr><PmtInf>{block}{pays}</PmtInf></CstmrCdtTrfInitn></Document>'


TWO = PAY.format(r="E1", a="1.00") + PAY.format(r="E2", a="2.00")
GOOD = message(TWO)
PREFIXED = GOOD.replace("<", "<p:").replace("<p:/", "</p:").replace("xmlns=", "xmlns:p=")
MESSAGES = {
    "good": GOOD, "declared": '<?xml version="1.0" encoding="UTF-8"?>\n' + GOOD + "\n", "prefixed": PREFIXED, "comment_after": GOOD + "<!-- end -->\n",
    "other_version": message(TWO, ns=NS.replace(".09", ".03")), "no_ctrl": message(TWO, ctrl=""), "empty_ctrl": message(TWO, ctrl="<CtrlSum/>"),
    "ctrl_in_block": message(TWO, ctrl="", block="<CtrlSum>3.00</CtrlSum>"), "bad_ctrl": message(TWO, ctrl="<CtrlSum>x</CtrlSum>"),
    "truncated": GOOD[:-30], "junk_before": "x" + GOOD, "junk_after": GOOD + "junk", "two_roots": GOOD + GOOD, "empty": "",
    "mismatch": GOOD.replace("</GrpHdr>", "</GrpHd>"), "ampersand": GOOD.replace("E1", "E&1"),
    "bad_amount": message(TWO.replace("2.00", "2,00")), "empty_amount": message(TWO.replace("2.00", "")),
    "empty_reference": message(TWO.replace("E2", "")), "missing_reference": message(TWO.replace("<EndToEndId>E2</EndToEndId>", "")),
    "no_payments": message("", ctrl="<CtrlSum>0</CtrlSum>"), "gap": message(TWO, ctrl="<CtrlSum>2.50</CtrlSum>"),
    "big": message(PAY.format(r="B", a="123456789.01") + PAY.format(r="C", a="0.02"), ctrl="<CtrlSum>123456789.03</CtrlSum>"),
}


@pytest.fixture(scope="module")
def parsed(spark):
    files = spark.createDataFrame(list(MESSAGES.items()), "file string, value string")
    return payments.parse_messages(files)


def test_message_isolation(parsed):
    state = {r.file: (r.well_formed, r.complete) for r in parsed.collect()}
    broken = {"truncated", "junk_before", "junk_after", "two_roots", "empty", "mismatch", "ampersand"}
    unusable = {"bad_ctrl", "bad_amount", "empty_amount", "missing_reference"}
    assert {f for f, s in state.items() if not s[0]} == broken
    assert {f for f, s in state.items() if s[0] and not s[1]} == unusable
    assert {r.file for r in payments.rejected_files(parsed).collect()} == broken | unusable


def test_message_sums(parsed):
    got = {r.file: (r.n, float(r.total), float(r.ctrl_sum), r.ctrl_missing, r.has_gap) for r in payments.reconcile_control_sum(parsed).collect()}
    ok = (2, 3.0, 3.0, False, False)
    for f in ("good", "declared", "prefixed", "comment_after", "ctrl_in_block", "empty_reference"):
        assert got[f] == ok, f
    assert got["other_version"] == (0, 0.0, 0.0, True, False)
    assert got["no_ctrl"] == got["empty_ctrl"] == (2, 3.0, 0.0, True, True)
    assert got["no_payments"] == (0, 0.0, 0.0, False, False)
    assert got["gap"] == (2, 3.0, 2.5, False, True)
    assert got["big"][1] == 123456789.03 and not got["big"][4]


def test_opposite_gaps_cancel_in_the_net(spark):
    files = spark.createDataFrame([("a", message(TWO, "<CtrlSum>2</CtrlSum>")), ("b", message(TWO, "<CtrlSum>4</CtrlSum>"))], "file string, value string")
    per_file = payments.reconcile_control_sum(payments.parse_messages(files))
    s = payments.reconcile_summary(per_file).first()
    assert s.balanced_net and s.files_with_gap == 2 and [r.file for r in payments.gap_files(per_file).collect()] == ["a", "b"]


def test_references(parsed):
    refs = payments.message_references(parsed)
    # Unusable amounts do not hide the references of a well-formed file.
    assert refs.where("file = 'bad_amount'").count() == 2
    assert refs.where("file = 'empty_reference' and reference is null").count() == 1


def test_payment_folder_is_scanned_in_any_case(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.XML").write_text(GOOD)
    (tmp_path / "sub" / "b.xml").write_text(GOOD)
    (tmp_path / "c.txt").write_text(GOOD)
    got = payments.scan_payment_xml(documents.scan_payment_folder(spark, str(tmp_path)))
    assert got.count() == 4 and got.select("file").distinct().count() == 2


# --- ledger

def random_sheet(seed):
    rnd = random.Random(seed)
    cells, merges, taken = {}, [], set()
    for row in range(1, 90):
        for col in (2, 3, 4, 5, 6):
            if rnd.random() < 0.6:
                options = {2: ["600", "0", "x", "70"], 3: ["700", "00", "y"], 4: ["Deposit a", "Other", "Deposit b"],
                           5: ["1.5", f"=F{rnd.randint(1, 95)}", "=SUM(A1)", "Net"], 6: ["2.5", f"=$E${rnd.randint(1, 95)}"]}
                cells[(row, col)] = rnd.choice(options[col])
    for _ in range(12):
        top, height = rnd.randint(1, 80), rnd.randint(1, 40 if seed % 2 else 4)
        area = {(r, 4) for r in range(top, top + height)}
        if not area & taken:
            taken |= area
            merges.append((top, 4, top + height - 1, 4))
    return cells, merges


def expected_entries(cells, merges):
    import re

    def merged(row, col):
        for a, b, c, d in merges:
            if a <= row <= c and b <= col <= d:
                return cells.get((a, b))
        return cells.get((row, col))

    def resolved(row, col):
        v = cells.get((row, col))
        m = re.fullmatch(r"=[$]?([A-Z])[$]?([0-9]+)", v or "")
        return cells.get((int(m[2]), ord(m[1]) - 64)) if m else v

    def numeric(v):
        return bool(v) and v.replace("0", "").isdigit()

    last = max([r for r, _ in cells] + [m[2] for m in merges])
    out = []
    for row in range(1, last + 1):
        debit, credit = cells.get((row, 2)), cells.get((row, 3))
        if not (numeric(debit) or numeric(credit)):
            continue
        label = next((merged(i, 4) for i in range(row + 1, min(row + 5, last + 1)) if "Deposit" in (merged(i, 4) or "")), None)
        accounts = [(n, s, merged(row, 4), resolved(row, c)) for n, s, c in ((debit, "debit", 5), (credit, "credit", 6)) if n]
        out.append((row, accounts, label))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_entries_against_brute_force(spark, seed):
    cells, merges = random_sheet(seed)
    c = spark.createDataFrame([("S", r, k, v) for (r, k), v in cells.items()], "sheet string, row int, col int, value string")
    m = spark.createDataFrame([("S", *x) for x in merges], "sheet string, min_row int, min_col int, max_row int, max_col int")
    got = [(r.ligne, [(a.numero, a.sens, a.intitule, a.montant) for a in r.comptes], r.libelle) for r in ledger.build_entries(c, m, "Deposit").orderBy("ligne").collect()]
    assert got == expected_entries(cells, merges)


def test_column_letters(spark):
    got = spark.createDataFrame([("A",), ("z",), ("AA",), ("XFD",)], "v string").select(ledger.column_number(F.col("v"))).collect()
    assert [r[0] for r in got] == [1, 26, 27, 16384]


def test_update_in_any_letter_case(spark):
    doc = '{"S":[{"ligne":1,"comptes":[{"numero":"1","sens":"debit","intitule":null,"montant":"NET","formule":""},{"numero":"2","sens":"credit","intitule":null,"montant":null,"formule":""}],"libelle":null}]}'
    docs = spark.createDataFrame([(doc,)], "v string").select(F.from_json("v", documents.LEDGER_SCHEMA).alias("doc"))
    new = ledger.update_nested_by_match(docs, "net", "L1").first().doc["S"][0].comptes
    assert [a.formule for a in new] == ["L1", ""] and ledger.count_nested_updates(docs, "net").first().updates == 1


# --- corpus

def files(spark, paths, text="a\nb"):
    return spark.createDataFrame([(p, len(text), text) for p in paths], "path string, size long, text string")


def test_ignored_directories_by_substring_and_by_name(spark):
    f = files(spark, ["/environment/a.py", "/src/a.py", "/src/env/b.py", "/data/c.py", "/database/d.py", "/src/bin.py"])
    assert rows(corpus.filter_corpus_files(f).select("path")) == [("/data/c.py",), ("/database/d.py",), ("/src/a.py",), ("/src/bin.py",)]
    assert ("/data/c.py",) not in rows(corpus.filter_excluded_dirs_exact(f).select("path"))
    assert ("/database/d.py",) in rows(corpus.filter_excluded_dirs_exact(f).select("path"))


def test_large_files_are_not_counted(spark):
    f = spark.createDataFrame([("/a.py", 10 * 1024 * 1024, "x"), ("/b.py", 10 * 1024 * 1024 + 1, "x")], "path string, size long, text string")
    assert corpus.lines_by_extension(f).first().files == 1
    assert tuple(corpus.corpus_totals(f).first()) == (2, 1, 1, 1)  # the last: left out for its size


def test_tree_order(spark, tmp_path):
    f = files(spark, ["/b.txt", "/z/y.txt", "/a/n/q.txt", "/a/m.txt", "/data/no.txt"])
    tree = corpus.path_tree(f, "root")
    assert [r.line for r in tree.orderBy("sort_key").collect()] == [
        "+--root", "  +--a", "    +--n", "      +--q.txt", "    +--m.txt", "  +--z", "    +--y.txt", "  +--b.txt"]
    sinks.sink_lines(tree, str(tmp_path / "tree"), ["sort_key"])
    parts = sorted((tmp_path / "tree").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines()[:3] == ["+--root", "  +--a", "    +--n"]


def test_bundle(spark):
    got = corpus.bundle_lines(files(spark, ["/a"], "x\ny\n")).orderBy("ord").collect()
    assert [r.line for r in got] == ["// /a", "x", "y", ""]
    assert [r.line for r in corpus.bundle_lines(files(spark, ["/a"]), with_content=False).collect()] == ["// /a"]


def test_collision_suffix_fills_gaps(spark):
    incoming = spark.createDataFrame([("C", n) for n in ["a.txt", "b.txt", "c", "d.txt", "d (1).txt", ".x"]], "category string, name string")
    present = spark.createDataFrame(
        [("C", n) for n in ["a.txt", "a (1).txt", "a (3).txt", "c", "d.txt", ".x"]] + [("D", "b.txt")], "category string, name string")
    got = {r.name: r.target_name for r in corpus.collision_suffix(incoming, present).collect()}
    assert got == {"a.txt": "a (2).txt", "b.txt": "b.txt", "c": "c (1)", "d.txt": "d (2).txt", "d (1).txt": "d (1).txt", ".x": ".x (1)"}


def test_directories_keep_their_whole_name(spark):
    incoming = spark.createDataFrame([("", "v1.2"), ("", "new")], "category string, name string")
    present = spark.createDataFrame([("", "v1.2"), ("", "v1.2 (1)"), ("", "v1 (2).2")], "category string, name string")
    got = {r.name: r.target_name for r in corpus.collision_suffix(incoming, present, whole_names=True).collect()}
    assert got == {"v1.2": "v1.2 (2)", "new": "new"}


def test_last_string_wins_and_json_lines(spark, tmp_path):
    strings = spark.createDataFrame([("Été x",), ("été-x",), ("b",), ("b",)], "string string")
    entries = corpus.translation_entries(corpus.last_wins_dictionary(corpus.union_distinct(strings)))
    assert rows(entries) == [("en", "b", ""), ("en", "été_x", ""), ("fr", "b", "b"), ("fr", "été_x", "été-x")]
    doc = corpus.translation_map(entries).collect()
    assert len(doc) == 1 and doc[0].doc == {"fr": {"b": "b", "été_x": "été-x"}, "en": {"b": "", "été_x": ""}}
    assert sum(len(r.doc["fr"]) for r in corpus.translation_map(entries, shards=2).collect()) == 2
    body = entries.where("lang = 'fr'").select(F.col("lang").alias("section"), "key", F.concat(F.lit('"'), "text", F.lit('"')).alias("body"))
    lines = sinks.json_document_lines(body, "key", "body")
    import json

    assert json.loads("\n".join(r.line for r in lines.orderBy("section", "part", "key").collect())) == {"b": "b", "été_x": "été-x"}


# --- relational, graph, rendering

def test_not_in_with_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    lists = {"plain": [(1,)], "null": [(1,), (None,)], "empty": []}
    for name, values in lists.items():
        listed = spark.createDataFrame(values, "v int")
        df.createOrReplaceTempView("d")
        listed.createOrReplaceTempView("l")
        assert rows(relational.filter_not_in_subquery(df, "k", listed, "v")) == rows(spark.sql("select * from d where k not in (select v from l)")), name


def test_edges_leave_out_self_references(spark):
    a = spark.createDataFrame([("c1", "orders"), ("c2", "nation")], "c string, t string")
    b = spark.createDataFrame([("c1", "customer"), ("c2", "nation")], "c string, t string")
    assert rows(relational.inner_edge_join(a, b, "c", "t", "t")) == [("orders", "customer")]


EDGES = [("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "supplier")]


def test_levels(spark):
    edges = spark.createDataFrame(EDGES + [("x", "x")], "child string, parent string")
    nodes = spark.createDataFrame([("alone",), ("x",)], "node string")
    got = {r.node: r.level for r in graph.dependency_levels(edges, nodes).collect()}
    assert got == {"region": 0, "alone": 0, "x": 0, "nation": 1, "customer": 2, "supplier": 2, "orders": 3, "lineitem": 4}


def test_cycles_come_out_once_and_flagged(spark):
    edges = spark.createDataFrame(EDGES + [("p", "q"), ("q", "p"), ("behind", "p"), ("q", "region")], "child string, parent string")
    levels = graph.dependency_levels(edges)
    got = levels.collect()
    assert len(got) == len({r.node for r in got}) == 9
    assert {r.node for r in got if r.blocked} == {"p", "q", "behind"} and all(r.level is None for r in got if r.blocked)
    assert {r.node for r in graph.cycle_nodes(edges, levels).collect()} == {"p", "q"}


def test_levels_against_brute_force(spark):
    rnd = random.Random(5)
    pairs = {(a, b) for a, b in ((rnd.randint(1, 60), rnd.randint(1, 60)) for _ in range(120)) if a > b}
    parents = collections.defaultdict(set)
    for a, b in pairs:
        parents[a].add(b)
    level = {}
    for n in sorted({x for p in pairs for x in p}):
        level[n] = max((level[p] + 1 for p in parents[n]), default=0)
    edges = spark.createDataFrame(sorted(pairs), "child long, parent long")
    assert {r.node: r.level for r in graph.dependency_levels(edges).collect()} == level


def test_insert_batches(spark):
    df = spark.range(2500).select("id", F.when(F.col("id") % 2 == 0, "x'y").alias("t"))
    got = {r.batch: r for r in render.batch_inserts(df, "t1", "id").collect()}
    assert sorted(got) == [0, 1, 2] and got[2].n_rows == 500
    assert got[0].line.startswith("INSERT INTO t1 (id, t) VALUES\n(0, 'x''y'),\n(1, NULL),\n") and got[0].line.endswith("(999, NULL);")


def test_case_priority_order(spark):
    df = spark.createDataFrame([("b", "FK"), ("a", "X"), ("a", "PK"), ("a", "U")], "t string, k string")
    assert [(r.t, r.k) for r in relational.sort_case_priority(df, "t", "k", ["PK", "U", "FK"]).collect()] == [("a", "PK"), ("a", "U"), ("a", "X"), ("b", "FK")]


def test_routes_cover_all_rows(spark):
    df = spark.createDataFrame([(1, "R", "R"), (2, "R", "c"), (3, None, "R"), (4, None, "c"), (5, "r", None)], "id int, a string, b string")
    routed = contacts.route_screening(df, "a", "b", "R")
    assert rows(routed.select("id", "route")) == [(1, "A"), (1, "B"), (2, "A"), (3, "B"), (4, "NONE"), (5, "NONE")]
    assert tuple(contacts.screening_overlap(df, "a", "b", "R").first()) == (2, 2, 1)


# --- files

def test_quoted_breaks_are_found(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x\n"a ""b"" c"\n')
    assert not tables.has_quoted_breaks(spark, str(tmp_path))
    (tmp_path / "b.csv").write_text('x\n"a\nb"\n')
    assert tables.has_quoted_breaks(spark, str(tmp_path))


def test_csv_header_mismatch_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n3,4\n")
    with pytest.raises(Exception):
        tables.scan_csv_text(spark, str(tmp_path)).collect()
    both = tables.union_all_files([tables.scan_csv_text(spark, str(tmp_path / n)) for n in ("a.csv", "b.csv")])
    assert rows(both.select("x", "y")) == [("1", "2"), ("4", "3")]


def test_csv_subset_of_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,Dev. Src\n1,2,3\n")
    got = tables.scan_csv_text(spark, str(tmp_path), wanted=["Dev. Src", "y", "none"])
    assert rows(got) == [("3", "2", None)]


def test_csv_lines_across_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("v\n" + "".join(f"row {i}\n" for i in range(60_000)))
    (tmp_path / "small.csv").write_text("v\nrow 0\nrow 1\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64 * 1024)
    try:
        df = tables.scan_csv_numbered(spark, str(tmp_path), multi_line=False)
        assert df.select(F.spark_partition_id()).distinct().count() > 4
        wrong = df.where(F.col("line") != F.regexp_extract("v", r"row (\d+)", 1).cast("long") + 2)
        assert wrong.count() == 0 and df.count() == 60_002
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quoted_csv_bytes(spark, tmp_path):
    sinks.sink_csv_quoted(spark.createDataFrame([('a"b', " x ")], "p string, q string").coalesce(1), str(tmp_path / "o"))
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("part-*"))
    assert text == '"p";"q"\n"a""b";" x "\n'
