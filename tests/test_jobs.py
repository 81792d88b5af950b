"""Whole jobs on small folders."""

from test_operators import GOOD, TWO, message

from tallyfold.operators import ingest
from tallyfold.plans import jobs
from tallyfold.sources import sinks, tables

P = jobs.Partners("GA", "GB", "GC", "COR", "Annulé", ("MALI", "TOGO"))
TX = """Groupe,Service,Statut,Compagnie,Montant,Montant à percevoir,Commission Partenaire
GA,ENVOI X,,A,10.5,1,0
GA,ENVOI X,Annulé,A,99,1,0
GA,PAIEMENT X,Annulé,A,1,7,0
GC,ENVOI X,ok,Mali Nord,3,0,0
GC,PAIEMENT X,ok,Mali Nord,0,4,0
GB,COR,ok,A,5,2,0.5
GB,COR,Annulé,A,"6,5",,0.25
"""


def test_day_close(spark, tmp_path):
    (tmp_path / "tx.csv").write_text(TX)
    sections = jobs.day_close(jobs.transactions_csv(spark, str(tmp_path / "tx.csv")), P)
    got = {n: {r[0]: tuple(float(x) for x in r[1:]) for r in df.collect()} for n, df in sections.items()}
    assert got == {
        "partner": {"sends": (10.5,), "payments": (7.0,)}, "countries": {"MALI": (3.0, 4.0), "TOGO": (0.0, 0.0)},
        "corridor": {"valid": (5.5,), "cancelled": (0.25,)},
    }
    jobs.write_sections(sections, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"sheet=partner", "sheet=countries", "sheet=corridor"}


def test_day_recap(spark):
    stored = spark.createDataFrame(
        [("GC", "ENVOI", "ok", "ML", "EUR", 3.0, 1.0, 0.5), ("GC", "PAIEMENT", "ok", "ML", "EUR", 0.0, 2.0, 0.0), ("GB", "COR", "ok", "TG", "XAF", 5.0, 4.0, 1.0), ("GB", "COR", "Annulé", "TG", "USD", 7.0, 0.0, 1.0)],
        "groupe string, service string, statut string, destination string, devise_source string, montant double, montant_a_percevoir double, commission_partenaire double")
    out = jobs.day_recap(jobs.settlement_view(stored), P, ["a", "b", "c", "d", "e"])
    assert [float(r.montant) for r in out["recap"].orderBy("pos").collect()] == [4.0, 0.0, 0.0, 6.0, 8.0]
    assert [(r.pays, float(r.total_envois), float(r.total_paiements)) for r in out["countries"].collect()] == [("ML", 3.5, 2.0)]
    assert [r.devise_source for r in out["corridor_valid"].collect()] == ["XAF"]
    assert [(r.devise_source, r.n_cancelled) for r in out["corridor_cancelled"].collect()] == [("USD", 1)]


def test_preview_reports_without_writing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("#,Service,Reférence,Montant\n1,S,1,2\n2,S,1,3\n3,,4,5\n")
    empty = spark.createDataFrame([], "service string, reference string")
    report = ingest.import_report(jobs.preview_import(spark, str(tmp_path), empty)).where("file is null").first()
    assert (report.rows_processed, report.rows_success, report.rows_failed) == (3, 2, 1)
    strict = ingest.import_report(jobs.preview_import(spark, str(tmp_path), empty, dry_run=False)).where("file is null").first()
    assert (strict.rows_success, strict.rows_duplicate) == (1, 1)


def test_payment_folder(spark, tmp_path):
    for name, text in {"a.xml": GOOD, "b.xml": message(TWO, "<CtrlSum>9</CtrlSum>"), "c.xml": GOOD[:-5]}.items():
        (tmp_path / name).write_text(text)
    out = jobs.reconcile_folder(spark, str(tmp_path))
    s = out["summary"].first()
    assert (s.files, s.n, s.files_with_gap, s.balanced_net) == (2, 4, 1, False)
    assert out["rejected"].count() == 1 and out["gaps"].count() == 1 and out["payments"].count() == 4
    lists = jobs.reference_lists(spark, str(tmp_path))
    assert [r.line for r in lists["list"].orderBy("reference").collect()] == ["'E1',", "'E2'"]
    assert [r.line for r in lists["duplicates"].orderBy("reference").collect()] == ["'E1' : 2 occurrences", "'E2' : 2 occurrences"]
    assert tuple(lists["totals"].first()) == (4, 2, 2)


def test_customer_chains(spark):
    people = spark.createDataFrame([("1", "R", "R"), ("x", "R", "c"), ("2", "c", None)], "k string, a string, b string")
    got = sorted((r.id, r.code2) for r in jobs.screening_changes(people, "k", "a", "b", "R").collect())
    assert got == [("1", "BLACKLIST"), ("1", "PPE"), ("2", "RAS")]
    phones = spark.createDataFrame([(1, "FRANCE", "0612345678", ""), (2, "FRANCE", "x", "+33612345678"), (3, "FRANCE", "x", None), (4, "ITALIE", "0612345678", "")], "id int, pays string, telephone1 string, telephone2 string")
    assert [r.line for r in jobs.phone_changes(phones, "FRANCE").orderBy("id").collect()] == [
        "UPDATE SENDER SET SEN_PHONE_NUMBER1='33612345678' WHERE SEN_ID=1;",
        "UPDATE SENDER SET SEN_PHONE_NUMBER1='33612345678', SEN_PHONE_NUMBER2='33612345678' WHERE SEN_ID=2;"]


def test_corpus_folder(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "build").mkdir()
    (root / "src" / "a.js").write_text("const t = 'Bon jour';\nlet u = \"Bon-jour\"\n")
    (root / "build" / "b.js").write_text("x\n")
    (root / "c.txt").write_text("one two\n")
    files = jobs.relative_files(spark, str(root)).cache()
    out = jobs.corpus_report(files, "proj")
    assert [tuple(r) for r in out["lines"].collect()] == [(".js", 1, 2)]
    assert tuple(out["totals"].first()) == (2, 1, 2, 0)
    assert [(r.name, r.is_dir) for r in out["sizes"].collect()] == [("src", True), ("build", True), ("c.txt", False)]
    assert [r.line for r in out["tree"].orderBy("sort_key").collect()] == ["+--proj", "  +--build", "    +--b.js", "  +--src", "    +--a.js", "  +--c.txt"]
    assert out["tokens"].first().files == 3
    entries = {(r.lang, r.key): r.text for r in jobs.translation_entries(files).collect()}
    assert entries == {("fr", "bon_jour"): "Bon-jour", ("en", "bon_jour"): ""}


def test_paths_with_odd_characters(spark, tmp_path):
    root = tmp_path / "a+b (c)"
    (root / "d é%").mkdir(parents=True)
    (root / "d é%" / "x y+z.txt").write_text("t")
    inner = root / str(root).strip("/")
    inner.mkdir(parents=True)
    (inner / "r.txt").write_text("t")
    got = sorted(r.path for r in jobs.relative_files(spark, str(root)).collect())
    assert got == sorted(["/d é%/x y+z.txt", f"{root}/r.txt"])


def test_tidy_plan(spark):
    incoming = spark.createDataFrame([("/in/a.pdf",), ("/in/b.pdf",)], "path string")
    present = spark.createDataFrame([("Documents/PDF", "a.pdf")], "category string, name string")
    got = sorted((r.path, r.category, r.target_name) for r in jobs.tidy_plan(incoming, present).collect())
    assert got == [("/in/a.pdf", "Documents/PDF", "a (1).pdf"), ("/in/b.pdf", "Documents/PDF", "b.pdf")]


def test_fee_table(spark, tmp_path):
    (tmp_path / "f.csv").write_text('année,mois,total_frais\n2024,mars,"1,5"\n2024,mars,2\n2023,avril,4\n,mars,9\n')
    out = jobs.fee_table(tables.scan_csv_text(spark, str(tmp_path / "f.csv")), [2023, 2024]).collect()
    assert [(r.month_name, r.y2023 and float(r.y2023), r.y2024 and float(r.y2024)) for r in out] == [("mars", None, 3.5), ("avril", 4.0, None)]


def test_nested_document(spark, tmp_path):
    cells = spark.createDataFrame([("S", 1, 2, "600"), ("S", 1, 5, "Net"), ("S", 2, 4, "Deposit é")], "sheet string, row int, col int, value string")
    merges = spark.createDataFrame([], "sheet string, min_row int, min_col int, max_row int, max_col int")
    docs = jobs.ledger_documents(cells, merges, "Deposit", "NET", "L06")
    sinks.sink_json(docs.select("doc"), str(tmp_path / "o"))
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("part-*"))
    assert text == '{"doc":{"S":[{"ligne":1,"comptes":[{"numero":"600","sens":"debit","intitule":null,"montant":"Net","formule":"L06"}],"libelle":"Deposit é"}]}}\n'
