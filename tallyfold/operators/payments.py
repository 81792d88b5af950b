"""Payment messages: parsing with per-file error isolation, flattening, control sums."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.fixed_values import PAYMENT_NAMESPACE
from tallyfold.operators.joins import lookup_join
from tallyfold.session import cut_lineage

AMOUNT = "decimal(28,5)"
_PAYMENT = "struct<PmtId: struct<EndToEndId: string>, Amt: struct<InstdAmt: struct<_VALUE: string, _Ccy: string>>>"
MESSAGE_SCHEMA = (
    "struct<CstmrCdtTrfInitn: struct<GrpHdr: struct<CtrlSum: string>, "
    f"PmtInf: array<struct<CtrlSum: string, CdtTrfTxInf: array<{_PAYMENT}>>>>, _broken: string>"
)
# The text must end in exactly one closing root tag, followed by blanks and comments only.
_TAIL = r"(?s)</([A-Za-z_][A-Za-z0-9_.-]*:)?Document>\s*(<!--.*?-->\s*)*\z"
_CLOSING_ROOT = r"</([A-Za-z_][A-Za-z0-9_.-]*:)?Document>"
_AMOUNT_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)\z"
# What may stand before the root element: declarations, comments, a document type, blanks.
_PROLOG = r"(?s)\A\x{FEFF}?(?:<[?].*?[?]>|<!--.*?-->|<!DOCTYPE[^>]*>|\s++)*+"


def _root_namespace(text: Column, namespace: str) -> Column:
    """Whether the first element is the root in the namespace, through its own prefix or the default one."""
    exact = namespace.replace(".", "[.]")
    plain = text.rlike(rf"{_PROLOG}<Document(\s[^>]*)?\sxmlns\s*=\s*[\"']{exact}[\"']")
    prefixed = text.rlike(rf"{_PROLOG}<([A-Za-z_][A-Za-z0-9_.-]*):Document(\s[^>]*)?\sxmlns:\1\s*=\s*[\"']{exact}[\"']")
    return plain | prefixed


def _amount(text: Column) -> Column:
    return F.when(text.rlike(_AMOUNT_TEXT), text.try_cast(AMOUNT))


def _once(df: DataFrame, keep, **columns: Column) -> DataFrame:
    """Computed columns behind a generator, so that later filters and projections reuse the values.

    A plain projection would be merged into every place that uses its columns, and the parse repeated there.
    """
    fields = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline(F.array(fields)))


def _bodies(files: DataFrame, keep, right_version: Column) -> DataFrame:
    """Documents (`value`) parsed: the kept columns, well_formed, ctrl_found (raw text, null without one), payments."""
    text = F.col("value")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "ignoreNamespace": "true"}
    one_document = text.rlike(_TAIL) & (F.regexp_count(text, F.lit(_CLOSING_ROOT)) == 1)
    parsed = _once(files, keep, m=F.from_xml(text, MESSAGE_SCHEMA, options), one_document=one_document, right_version=right_version)
    well_formed = F.coalesce(F.col("m").isNotNull() & F.col("m._broken").isNull() & F.col("one_document"), F.lit(False))
    body = F.when(well_formed & F.col("right_version"), F.col("m.CstmrCdtTrfInitn"))
    head = parsed.select(*keep, well_formed.alias("well_formed"), body.alias("body"))
    blocks = F.coalesce(F.col("body.PmtInf"), F.array())
    block_sums = F.transform(blocks, lambda b: b["CtrlSum"])
    found = F.coalesce(F.col("body.GrpHdr.CtrlSum"), F.get(F.filter(block_sums, lambda s: s.isNotNull()), F.lit(0)))
    nested = F.transform(
        F.flatten(F.transform(blocks, lambda b: F.coalesce(b["CdtTrfTxInf"], F.array()))),
        lambda p: F.struct(
            p["PmtId"]["EndToEndId"].alias("reference"),
            _amount(F.nullif(p["Amt"]["InstdAmt"]["_VALUE"], F.lit(""))).alias("amount"),
        ),
    )
    return _once(head, [*keep, "well_formed"], ctrl_found=found, payments=nested)


def _verdicts(ctrl_found: Column) -> dict[str, Column]:
    """From the control sum's text: whether it is unusable, its value, whether it is missing."""
    ctrl_text = F.nullif(ctrl_found, F.lit(""))
    ctrl = _amount(ctrl_text)
    return {"bad": ctrl_text.isNotNull() & ctrl.isNull(), "ctrl_sum": F.coalesce(ctrl, F.lit(0).cast(AMOUNT)), "ctrl_missing": ctrl_text.isNull()}


def _unusable(p: Column) -> Column:
    return p["amount"].isNull() | p["reference"].isNull()


def _plain_reference(payments: str) -> Column:
    """An empty reference element stays a payment without reference."""
    return F.transform(payments, lambda p: p.withField("reference", F.nullif(p["reference"], F.lit(""))))


def parse_messages(files: DataFrame, namespace: str = PAYMENT_NAMESPACE) -> DataFrame:
    """`(file, value)` to one row per file: well_formed, complete, ctrl_sum, ctrl_missing, payments.

    A file that is not one well-formed document yields no payments and `well_formed` false, and a
    file with a missing or non-numeric amount, a missing reference or a non-numeric control sum has
    `complete` false. Another message version is well formed and has no payments.
    """
    flat = _bodies(files, ["file"], _root_namespace(F.col("value"), namespace))
    verdict = _verdicts(F.col("ctrl_found"))
    return flat.select(
        "file",
        "well_formed",
        (F.col("well_formed") & ~verdict["bad"] & ~F.exists("payments", _unusable)).alias("complete"),
        verdict["ctrl_sum"].alias("ctrl_sum"),
        verdict["ctrl_missing"].alias("ctrl_missing"),
        _plain_reference("payments").alias("payments"),
    )


def parse_message_parts(parts: DataFrame, namespace: str = PAYMENT_NAMESPACE) -> tuple[DataFrame, DataFrame]:
    """Messages of any size, from their pieces `(file, block, at, value)` between payment ends (`sources.documents.scan_payment_parts`).

    Gives one row per file (well_formed, complete, ctrl_sum, ctrl_missing) and one per payment of the complete ones (file, block, at,
    ord, reference, amount; in document order). Each piece is completed to a small document: those behind the first are
    put into a message and a block, those before the last are closed. If every such document is well formed, each piece leads from
    inside a block to inside a block, the first from the beginning and the last to the end, hence so is the file; a truncated one is
    not, and gives one row and no payment. Payments must stand directly in blocks, as the message's schema has it. No
    row holds more than a payment and what stands between two.
    """
    opening = f'<Document xmlns="{namespace}"><CstmrCdtTrfInitn><PmtInf>'
    closing = "</CdtTrfTxInf></PmtInf></CstmrCdtTrfInitn></Document>"
    place = F.struct("block", "at")
    ends = parts.groupBy("file").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    placed = lookup_join(parts, ends, ["file"])
    first, last = place == F.col("_first"), place == F.col("_last")
    whole = placed.select(
        "file", "block", "at", first.alias("is_first"),
        F.concat(F.when(first, "").otherwise(opening), F.col("value"), F.when(last, "").otherwise(closing)).alias("value"))
    # Whether the file is of the right version is seen in its first piece only; the pieces put into a message are.
    # Heads and payments both come from the parsed pieces, so these are kept and no piece is parsed twice.
    right = F.when(F.col("is_first"), F.coalesce(_root_namespace(F.col("value"), namespace), F.lit(False)))
    marked = _once(whole, ["file", "block", "at", "value", "is_first"], right=right)
    found = cut_lineage(_once(_bodies(marked, ["file", "block", "at", "is_first", "right"], F.col("right") | ~F.col("is_first")),
                              ["file", "block", "at", "is_first", "right", "well_formed", "ctrl_found"], payments=F.col("payments")))
    versions = found.where("is_first").select("file", "right")
    found = found.drop("right")
    known = lookup_join(found, versions, ["file"])
    heads = known.groupBy("file").agg(
        F.bool_and("well_formed").alias("well_formed"), F.first("right").alias("right"),
        F.bool_or(F.exists("payments", _unusable)).alias("_gap"),
        F.min(F.when(F.col("ctrl_found").isNotNull(), F.struct("block", "at", "ctrl_found"))).alias("_ctrl"))
    of_file = F.when(F.col("well_formed") & F.col("right"), F.col("_ctrl.ctrl_found"))
    verdict = _verdicts(of_file)
    usable = F.col("well_formed") & ~(F.col("right") & (verdict["bad"] | F.col("_gap")))
    heads = heads.select("file", "well_formed", usable.alias("complete"), verdict["ctrl_sum"].alias("ctrl_sum"), verdict["ctrl_missing"].alias("ctrl_missing"), "right")
    good = heads.where("complete and right").select("file")
    rows = lookup_join(found.where(F.size("payments") > 0), good, ["file"], "left_semi").select(
        "file", "block", "at", F.posexplode(_plain_reference("payments")).alias("ord", "p")).select("file", "block", "at", "ord", "p.reference", "p.amount")
    return heads.drop("right"), rows


def reconcile_parts(heads: DataFrame, payments: DataFrame) -> DataFrame:
    """`reconcile_control_sum` for messages read in pieces; sums are combined before the shuffle."""
    sums = payments.groupBy("file").agg(F.count("*").alias("n"), F.sum("amount").cast(AMOUNT).alias("total"))
    joined = heads.where("complete").join(sums, "file", "left").select(
        "file", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0).cast(AMOUNT)).alias("total"), "ctrl_sum", "ctrl_missing")
    difference = (F.col("total") - F.col("ctrl_sum")).cast(AMOUNT)
    return joined.withColumn("difference", difference).withColumn("has_gap", F.col("difference") != 0)


def rejected_files(messages: DataFrame) -> DataFrame:
    """Files that do not count, with the reason."""
    reason = F.when(~F.col("well_formed"), "not well formed").otherwise("amount, reference or control sum unusable")
    return messages.where(~F.col("complete")).select("file", reason.alias("reason"))


def flatten_message(messages: DataFrame) -> DataFrame:
    """One row per payment of a complete file: file, ord (from 0, document order), reference, amount."""
    return messages.where("complete").select("file", F.posexplode("payments").alias("ord", "p")).select(
        "file", "ord", "p.reference", "p.amount"
    )


def scan_payment_xml(files: DataFrame, namespace: str = PAYMENT_NAMESPACE) -> DataFrame:
    return flatten_message(parse_messages(files, namespace)).select("file", "reference", "amount")


def message_references(messages: DataFrame) -> DataFrame:
    """References of every well-formed file, whether or not its amounts are usable."""
    return messages.where("well_formed").select("file", F.explode("payments").alias("p")).select("file", "p.reference")


def reconcile_control_sum(messages: DataFrame) -> DataFrame:
    """Per complete file: payments, total, control sum, difference, gap flag. No exchange: a file is a row."""
    zero = F.lit(0).cast(AMOUNT)
    total = F.aggregate("payments", zero, lambda acc, p: (acc + p["amount"]).cast(AMOUNT))
    sums = messages.where("complete").select(
        "file", F.size("payments").cast("long").alias("n"), total.alias("total"), "ctrl_sum", "ctrl_missing"
    )
    difference = (F.col("total") - F.col("ctrl_sum")).cast(AMOUNT)
    return sums.withColumn("difference", difference).withColumn("has_gap", F.col("difference") != 0)


def reconcile_summary(per_file: DataFrame) -> DataFrame:
    """Totals over all files. `balanced_net` looks at the net difference, in which opposite gaps cancel."""
    def over_all(column):
        return F.coalesce(F.sum(column), F.lit(0)).cast("decimal(38,5)").alias(column)

    return per_file.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        over_all("total"), over_all("ctrl_sum"), over_all("difference"),
        F.count_if("has_gap").alias("files_with_gap"),
    ).withColumn("balanced_net", F.col("difference") == 0)


def gap_files(per_file: DataFrame) -> DataFrame:
    """Files with a gap, sorted; as rows, because their number is not bounded."""
    return per_file.where("has_gap").select("file", "difference").orderBy("file")


def reference_occurrences(references: DataFrame) -> DataFrame:
    """Count per reference; duplicates are the rows with a count above 1."""
    return references.groupBy("reference").agg(F.count("*").alias("occurrences"))


def reference_totals(occurrences: DataFrame) -> DataFrame:
    return occurrences.agg(
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("found"),
        F.count("*").alias("distinct_references"),
        F.count_if(F.col("occurrences") > 1).alias("duplicated_references"),
    )
