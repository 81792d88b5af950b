"""Queries of scans, loading, sinks and the drop folder."""

from pyspark.sql import functions as F

from tallyfold.fixed_values import TARGET_LAYOUT
from tallyfold.operators import ingest, numbering
from tallyfold.plans import sql_text as q
from tallyfold.plans.fixtures import duck, frame, raw_files, table
from tallyfold.plans.registry import query
from tallyfold.plans.settle_queries import doubles, typed
from tallyfold.session import new_table_path
from tallyfold.sources import documents, key_store, sinks, split_csv, tables
from tallyfold.streaming.drop_folder import stream_drop_folder as load_folder

# The store holds what was loaded before this day.
CUT = "1996-07-01"
_STORED, _NEW = f"day < timestamp '{CUT} 00:00:00'", f"day >= timestamp '{CUT} 00:00:00'"
_KEYS = f"""stored as (select service, reference from tx where {_STORED}),
 incoming as (select file, line, service, reference from tx where {_NEW})"""
_JUDGED = _KEYS + """, judged as (select file, line, service, reference, case when service is null or reference is null then 'missing_key'
 when exists (select 1 from stored s where s.service = i.service and s.reference = i.reference) then 'duplicate'
 when row_number() over (partition by service, reference order by file, line) > 1 then 'duplicate' else 'accepted' end as status from incoming i)"""


def incoming_and_stored(spark, sf):
    tx = frame(spark, sf, "tx").select("file", "line", "service", "reference", "day")
    limit = F.lit(CUT).cast("timestamp_ntz")
    return tx.where(F.col("day") >= limit).drop("day"), tx.where(F.col("day") < limit).select("service", "reference")


def judged(spark, sf, dry_run=False):
    return ingest.classify_import(*incoming_and_stored(spark, sf), dry_run=dry_run)


def _target(kind, source):
    name = f'"{source}"'
    if kind == "number":
        return f"cast({q.locale(name)} as double)"
    if kind == "timestamp":
        return q.stamp_text(name)
    return f"nullif({name}, '')"


_LAYOUT_SQL = ", ".join(f"{_target(kind, source)} as {target}" for source, target, kind in TARGET_LAYOUT)


def _readable(df):
    """Decimals as doubles and timestamps as text, for the comparison."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        col = F.col(f.name)
        if kind == "decimal":
            col = col.cast("double")
        elif kind.startswith("timestamp"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        out.append(col.alias(f.name))
    return df.select(*out)


@query("project_target_layout", duck("raw_tx", f"select src_row, {_LAYOUT_SQL} from raw_tx"))
def project_target_layout(spark, sf):
    return _readable(ingest.project_target_layout(frame(spark, sf, "raw_tx"), keep=("src_row",)))


@query("insert_if_absent", duck("tx", """select file, line, service, reference from incoming i
where not exists (select 1 from stored s where s.service = i.service and s.reference = i.reference)""", _KEYS))
def insert_if_absent(spark, sf):
    return ingest.insert_if_absent(*incoming_and_stored(spark, sf)).select("file", "line", "service", "reference")


@query("already_stored", duck("tx", """select file, line, service, reference from incoming i
where exists (select 1 from stored s where s.service = i.service and s.reference = i.reference)""", _KEYS))
def already_stored(spark, sf):
    return ingest.already_stored(*incoming_and_stored(spark, sf)).select("file", "line", "service", "reference")


@query(
    "first_wins_dedup",
    duck("tx", """select service, reference, file, line, pays, cast(montant as double) as montant from
 (select *, row_number() over (partition by service, reference order by file, line) as n from typed where service is not null) where n = 1""", q.TYPED),
)
def first_wins_dedup(spark, sf):
    kept = ingest.first_wins_dedup(typed(spark, sf).where("service is not null"))
    return doubles(kept.select("service", "reference", "file", "line", "pays", "montant"), "montant")


@query("classify_import", duck("tx", "select file, line, service, reference, status from judged", _JUDGED))
def classify_import(spark, sf):
    return judged(spark, sf).select("file", "line", "service", "reference", "status")


@query(
    "classify_import_dry_run",
    duck("tx", """select file, line, service, reference, case when service is null or reference is null then 'missing_key'
 when exists (select 1 from stored s where s.service = i.service and s.reference = i.reference) then 'duplicate' else 'accepted' end as status
from incoming i""", _KEYS),
)
def classify_import_dry_run(spark, sf):
    return judged(spark, sf, dry_run=True).select("file", "line", "service", "reference", "status")


@query(
    "import_report",
    duck("tx", """select coalesce(file, 'ALL') as file, count(*) as rows_processed, count(*) filter (where status = 'accepted') as rows_success,
 count(*) filter (where status <> 'accepted') as rows_failed, count(*) filter (where status = 'duplicate') as rows_duplicate,
 bool_or(status = 'missing_key') as has_critical from judged group by rollup (file)""", _JUDGED),
)
def import_report(spark, sf):
    return ingest.import_report(judged(spark, sf)).withColumn("file", F.coalesce("file", F.lit("ALL")))


@query(
    "import_errors",
    duck("tx", """select file, line, case when status = 'duplicate' then concat(coalesce(service, ''), ' with reference ', coalesce(reference, ''), ' is already stored')
 else 'key field is missing' end as message, status = 'duplicate' as is_duplicate from judged where status <> 'accepted'""", _JUDGED),
)
def import_errors(spark, sf):
    return ingest.import_errors(judged(spark, sf))


def _write_by_file(df, path):
    """One CSV file per `file` folder, rows in source order."""
    ordered = df.repartition("file").sortWithinPartitions("file", "src_row")
    ordered.drop("src_row").write.partitionBy("file").options(header=True, escape='"').csv(path)


def _folder_name(path):
    return F.regexp_extract(path, r"file=([^/]*)/", 1)


@query(
    "source_line_number",
    duck("tx", "select file, service, reference, montant, row_number() over (partition by file order by src_row) + 1 as line from tx"),
)
def source_line_number(spark, sf):
    """Write the transactions as one CSV per file, then number the scanned lines."""
    path = new_table_path(spark, "lines")
    _write_by_file(frame(spark, sf, "tx").select("src_row", "file", "service", "reference", "montant"), path)
    scanned = tables.scan_csv_text(spark, f"{path}/*", multi_line=False)
    return tables.with_source_line(scanned).withColumn("file", _folder_name(F.col("file")))


@query("scan_csv_text", "select cast(doc_id as varchar) as doc_id, text, lang, true as extra_is_null from documents")
def scan_csv_text(spark, sf):
    """Texts with quotes and line breaks through a CSV file and back; a column the file lacks is null."""
    path = new_table_path(spark, "csv")
    sinks.sink_csv(table(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    back = tables.scan_csv_text(spark, path, wanted=["doc_id", "text", "lang", "extra"])
    return back.select("doc_id", "text", "lang", F.col("extra").isNull().alias("extra_is_null"))


@query("scan_split_csv", "select cast(doc_id as varchar) as doc_id, text, lang, cast(row_number() over (partition by lang order by doc_id) + 1 as bigint) as line from documents")
def scan_split_csv(spark, sf):
    """Texts with quotes and line breaks in one CSV table a language, read in splits, with the numbers of their records.

    A language's table is written by many tasks: its part files, in name order, are the table in the order of doc_id.
    """
    path = new_table_path(spark, "csv")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text").withColumn("folder", F.col("lang"))
    ordered = docs.repartitionByRange("folder", "doc_id").sortWithinPartitions("folder", "doc_id")
    ordered.write.partitionBy("folder").options(header=True, escape='"').csv(path)
    rows = split_csv.scan_split_csv(spark, f"{path}/*").withColumn("folder", F.regexp_extract("file", r"folder=([^/]*)/", 1))
    return split_csv.number_on(rows, "folder").select("doc_id", "text", "lang", "line")


@query("sink_csv", duck("contacts", "select cast(id as varchar) as id, pays, nullif(telephone1, '') as telephone1, nullif(telephone2, '') as telephone2 from contacts"))
def sink_csv(spark, sf):
    path = new_table_path(spark, "csv")
    sinks.sink_csv(frame(spark, sf, "contacts"), path)
    return tables.scan_csv_text(spark, path)


@query("sink_csv_quoted", """select concat('"', name, '";"', n, '"') as line from (select c_name as name, cast(c_custkey as varchar) as n from customer)
union all select distinct '"c_name";"c_custkey"' from customer""")
def sink_csv_quoted(spark, sf):
    path = new_table_path(spark, "csvq")
    sinks.sink_csv_quoted(table(spark, sf, "customer").select("c_name", "c_custkey"), path)
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    head = F.col("line") == '"c_name";"c_custkey"'  # each part of the file has one
    return lines.where(~head).unionByName(lines.where(head).distinct())


@query("sink_append_absent", duck("tx", """select service, reference from stored union all select service, reference from judged where status = 'accepted'""", _JUDGED))
def sink_append_absent(spark, sf):
    """The earlier transactions fill a bucketed store; of the later ones what is new is added."""
    store, incoming = filled_store(spark, sf)
    store.append_absent(incoming)
    return store.rows().select("service", "reference")


def filled_store(spark, sf):
    incoming, stored = incoming_and_stored(spark, sf)
    store = key_store.create_store(spark, new_table_path(spark, "store"), "service string, reference string, file string, line long", buckets=8, blocks=4)
    store.append(stored.select("service", "reference", F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line")))
    return store, incoming


@query("classify_against_store", duck("tx", "select file, line, service, reference, status from judged", _JUDGED))
def classify_against_store(spark, sf):
    """The import's verdicts, with the store asked through its filters and only the buckets that the delivery hits."""
    store, incoming = filled_store(spark, sf)
    return store.classify(incoming).select("file", "line", "service", "reference", "status")


@query("deliveries_by_year", duck("tx", """select substr(file, 4, 4) as year, count(*) as rows_processed, count(*) filter (where status = 'accepted') as rows_success from (
 select file, case when service is null or reference is null then 'missing_key'
  when row_number() over (partition by service, reference order by file, line) > 1 then 'duplicate' else 'accepted' end as status
 from tx) group by 1"""))
def deliveries_by_year(spark, sf):
    """One delivery a year into one store, each checked against all before it."""
    tx = frame(spark, sf, "tx").select("service", "reference", "file", "line").withColumn("year", F.substring("file", 4, 4))
    store = key_store.create_store(spark, new_table_path(spark, "store"), "service string, reference string, file string, line long", buckets=4, blocks=8)
    out = None
    for year in [r[0] for r in tx.select("year").distinct().orderBy("year").collect()]:
        judged_rows = store.append_absent(tx.where(F.col("year") == year))
        out = judged_rows if out is None else out.unionByName(judged_rows)
    return out.groupBy("year").agg(F.count("*").alias("rows_processed"), F.count_if(F.col("status") == ingest.ACCEPTED).alias("rows_success"))


@query("sink_json", "select doc_id, lang, text, case when doc_id % 3 = 0 then null else source end as source from documents")
def sink_json(spark, sf):
    path = new_table_path(spark, "json")
    docs = table(spark, sf, "documents").withColumn("source", F.when(F.col("doc_id") % 3 != 0, F.col("source")))
    sinks.sink_json(docs.select("doc_id", "lang", "text", "source"), path)
    return spark.read.schema("doc_id long, lang string, text string, source string").json(path)


@query("sink_lines", "select concat(c_name, ' ', cast(c_custkey as varchar)) as line from customer")
def sink_lines(spark, sf):
    path = new_table_path(spark, "lines")
    named = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" "), F.col("c_custkey").cast("string")).alias("line"))
    sinks.sink_lines(named, path, ["c_custkey"])
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("sink_sections", duck("contacts", "select pays as sheet, count(*) as n, count(distinct id) as ids from contacts group by 1"))
def sink_sections(spark, sf):
    path = new_table_path(spark, "sections")
    sinks.sink_sections(frame(spark, sf, "contacts").withColumnRenamed("pays", "sheet"), path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy("sheet").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("scan_name_list", "select trim(c_name) as name from customer")
def scan_name_list(spark, sf):
    path = new_table_path(spark, "names")
    padded = table(spark, sf, "customer").select(
        F.explode(F.array(F.concat(F.lit("  "), "c_name", F.lit(" \t")), F.lit("   "), F.lit(""))).alias("value")
    )
    padded.write.text(path)
    return documents.scan_name_list(spark, path)


@query(
    "scan_corpus",
    "select lang, cast(sum(octet_length(encode(text)) + 1) as bigint) as bytes, cast(sum(length(text) + 1) as bigint) as chars from documents group by 1",
)
def scan_corpus(spark, sf):
    """Texts written to a folder tree of bounded files, walked back with sizes and whole contents."""
    path = new_table_path(spark, "corpus")
    docs = table(spark, sf, "documents").select("lang", "source", "text")
    docs.write.partitionBy("lang", "source").option("maxRecordsPerFile", 100).text(path)
    walked = documents.scan_corpus(spark, path, "*.txt").withColumn("lang", F.regexp_extract("path", "lang=([^/]*)/", 1))
    return walked.groupBy("lang").agg(F.sum("size").alias("bytes"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(
    "scan_inventory",
    "select lang, cast(sum(octet_length(encode(text)) + 1) as bigint) as bytes, true as dated from documents group by 1",
)
def scan_inventory(spark, sf):
    """Sizes of a written folder tree without reading a byte of its files."""
    path = new_table_path(spark, "inventory")
    table(spark, sf, "documents").select("lang", "source", "text").write.partitionBy("lang", "source").option("maxRecordsPerFile", 100).text(path)
    seen = documents.scan_inventory(spark, path, "*.txt").withColumn("lang", F.regexp_extract("path", "lang=([^/]*)/", 1))
    return seen.groupBy("lang").agg(F.sum("size").alias("bytes"), F.bool_and(F.col("modified").isNotNull()).alias("dated"))


@query("union_all_files", "select 'customer' as kind, c_name as name, c_mktsegment as segment from customer union all select 'supplier', s_name, null from supplier")
def union_all_files(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return tables.union_all_files([a, b])


@query("scan_cells", duck(["cells"], "select sheet, row, col, value from cells"))
def scan_cells(spark, sf):
    path = new_table_path(spark, "cells")
    frame(spark, sf, "cells").write.parquet(path)
    return tables.scan_cells(spark, path)


@query("scan_fee_sheet", duck("fees", "select yr, month_name, cast(fee as double) as fee from fees"))
def scan_fee_sheet(spark, sf):
    path = new_table_path(spark, "fees")
    frame(spark, sf, "fees").write.parquet(path)
    return doubles(tables.scan_fee_sheet(spark, path), "fee")


_FIRST = """first as (select *, row_number() over (partition by "Service", "Reférence" order by file, src_row) as n from raw_tx
 where coalesce("Service", '') <> '' and coalesce("Reférence", '') <> '')"""


@query("stream_drop_folder", duck("raw_tx", f"select file, {_LAYOUT_SQL} from first where n = 1", _FIRST))
def stream_drop_folder(spark, sf):
    """Raw files dropped in a folder, loaded by the stream in two runs; the second finds nothing new."""
    drop, state = new_table_path(spark, "drop"), new_table_path(spark, "state")
    # Part files in source order, each written by a task of its own, packed: a month is never in one task.
    raw_files(spark, sf).write.partitionBy("file").options(header=True, escape='"', compression="gzip").csv(drop)
    headers = [source for source, _, _ in TARGET_LAYOUT]
    for _ in range(2):
        load_folder(spark, f"{drop}/*", state, headers=headers)
    stored = spark.read.parquet(f"{state}/store").drop("batch", "line")
    return _readable(stored.withColumn("file", _folder_name(F.col("file"))))


@query(
    "batch_number",
    "select o_custkey % 3 as grp, o_orderkey, cast(floor((row_number() over (partition by o_custkey % 3 order by o_orderkey) - 1) / 1000) as bigint) as batch from orders",
)
def batch_number(spark, sf):
    orders = table(spark, sf, "orders").select((F.col("o_custkey") % 3).alias("grp"), "o_orderkey")
    return numbering.batch_number(orders, ["grp"], "o_orderkey")
