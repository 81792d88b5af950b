"""Messages read in pieces against the reader that takes each file whole."""

import pytest
from pyspark.sql import functions as F

from tallyfold.fixed_values import PAYMENT_NAMESPACE
from tallyfold.operators import payments
from tallyfold.sources import documents

HEAD = f'<?xml version="1.0"?>\n<Document xmlns="{PAYMENT_NAMESPACE}">\n<CstmrCdtTrfInitn><GrpHdr><CtrlSum>%s</CtrlSum></GrpHdr>'
TAIL = "</CstmrCdtTrfInitn></Document>\n"


def pay(i, amount="1.50"):
    return f'<CdtTrfTxInf><PmtId><EndToEndId>E{i}</EndToEndId></PmtId><Amt><InstdAmt Ccy="EUR">{amount}</InstdAmt></Amt></CdtTrfTxInf>\n'


def block(rows, ctrl=None):
    return f"<PmtInf>{'' if ctrl is None else f'<CtrlSum>{ctrl}</CtrlSum>'}{''.join(rows)}</PmtInf>"


MANY = [pay(i) for i in range(60)]
GOOD = HEAD % "90.00" + block(MANY) + TAIL
FILES = {
    "good": GOOD,
    "two blocks": HEAD % "9" + block(MANY[:3], "4.5") + block(MANY[3:6], "4.5") + TAIL,
    "sum in a later block": GOOD.replace("<GrpHdr><CtrlSum>90.00</CtrlSum></GrpHdr>", "").replace(block(MANY), block(MANY[:4]) + block(MANY[4:], "7")),
    "empty sum first": (HEAD % "") + block(MANY[:2], "3") + TAIL,
    "one": HEAD % "1.5" + block([pay(1)]) + TAIL,
    "none": HEAD % "0" + TAIL,
    "gap": HEAD % "1" + block(MANY[:4]) + TAIL,
    "bad sum": HEAD % "x" + block(MANY[:4]) + TAIL,
    "bad amount": HEAD % "1" + block([*MANY[:4], pay(9, "x"), *MANY[5:9]]) + TAIL,
    "no reference": HEAD % "1" + block([pay(1), pay(2).replace("E2", ""), pay(3)]) + TAIL,
    "other version": GOOD.replace(".09", ".03"),
    "prefixed": GOOD.replace("<", "<p:").replace("<p:/", "</p:").replace("<p:?", "<?").replace("xmlns=", "xmlns:p="),
    "truncated in a payment": GOOD[:1500],
    "truncated behind a payment": GOOD[:GOOD.index("</CdtTrfTxInf>", 1500) + len("</CdtTrfTxInf>")],
    "truncated before the end": GOOD[:-20],
    "wrong tag in the middle": GOOD.replace("<EndToEndId>E30</EndToEndId>", "<EndToEndId>E30</EndToEnd>"),
    "block closed twice": GOOD.replace(MANY[30], MANY[30] + "</PmtInf>"),
    "message closed early": HEAD % "1" + block(MANY[:5]) + TAIL + block(MANY[5:8]) + TAIL,
    "bare ampersand": GOOD.replace("E41", "E&41"),
    "text after the root": GOOD + "x",
    "empty": "",
}


def test_equals_whole_files(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / f"{name}.xml").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        parts = documents.scan_payment_parts(spark, str(tmp_path)).withColumn("file", F.regexp_extract("file", r"/([^/]*)[.]xml", 1)).withColumn("file", F.replace("file", F.lit("%20"), F.lit(" "))).cache()
        assert parts.select("block").distinct().count() > 5  # several splits a file
        heads, rows = payments.parse_message_parts(parts)
        per_file = {tuple(r) for r in payments.reconcile_parts(heads, rows).collect()}
        got = {r.file: (r.well_formed, r.complete) for r in heads.collect()}
        flat = sorted(((r.file, r.reference, r.amount) for r in rows.collect()), key=repr)
        order = [r.reference for r in rows.where("file = 'good'").orderBy("block", "at", "ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = payments.parse_messages(spark.createDataFrame(list(FILES.items()), "file string, value string")).cache()
    want = {r.file: (r.well_formed, r.complete) for r in whole.collect()}
    got.setdefault("empty", (False, False))  # no piece at all
    assert got == want
    assert per_file == {tuple(r) for r in payments.reconcile_control_sum(whole).collect()}
    assert flat == sorted(((r.file, r.reference, r.amount) for r in payments.flatten_message(whole).collect()), key=repr)
    assert order == [f"E{i}" for i in range(60)]


@pytest.mark.parametrize("n", [20_000])
def test_a_large_message(spark, tmp_path, n):
    """No row holds more than a payment, and many tasks share the file."""
    (tmp_path / "m.xml").write_text(HEAD % f"{n * 1.5:.2f}" + block([pay(i) for i in range(n)]) + TAIL)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        parts = documents.scan_payment_parts(spark, str(tmp_path))
        assert parts.rdd.getNumPartitions() > 8 and parts.agg(F.max(F.length("value"))).first()[0] < 500
        heads, rows = payments.parse_message_parts(parts)
        row = payments.reconcile_parts(heads, rows).first()
        assert (row.n, float(row.total), row.has_gap) == (n, n * 1.5, False)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_piece_is_parsed_again(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FILES["good"])
    heads, rows = payments.parse_message_parts(documents.scan_payment_parts(spark, str(tmp_path)))
    for df in (heads, rows, payments.reconcile_parts(heads, rows)):
        assert "from_xml" not in df._jdf.queryExecution().optimizedPlan().toString().lower().replace("xmltostructs", "from_xml")
    assert rows.count() == 60
