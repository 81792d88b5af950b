"""Queries of single-row expressions and filters."""

from pyspark.sql import functions as F

from tallyfold.fixed_values import FILE_CATEGORIES, OTHER_CATEGORY
from tallyfold.functions import literals, naming, parsing, phones, texts
from tallyfold.operators import contacts, corpus, ingest, settle
from tallyfold.plans import sql_text as q
from tallyfold.plans.fixtures import duck, frame, table
from tallyfold.plans.registry import query

_ID = "case when o_orderkey % 7 = 0 then concat('R', cast(o_orderkey as string)) when o_orderkey % 7 = 1 then '' else cast(o_custkey * 1000 as string) end"
_ACCOUNT = (
    "case o_orderkey % 5 when 0 then '000' when 1 then cast(o_custkey as string) when 2 then '' "
    "when 3 then concat(cast(o_custkey as string), 'a') end"
)
_EXT = r"lower(regexp_extract(path, '[^./][^/]*([.][^./]*)$', 1))"
_PHONE = """case when regexp_matches(trim({p}), '^0[1-9].{{8}}$') then concat('33', substr(trim({p}), 2))
 when regexp_matches(trim({p}), '^[1-9].{{8}}$') then concat('33', trim({p}))
 when regexp_matches(trim({p}), '^0033.{{9}}$') then concat('33', substr(trim({p}), 5))
 when regexp_matches(trim({p}), '^00330[1-9].{{8}}$') then concat('33', substr(trim({p}), 6))
 when regexp_matches(trim({p}), '^[+]33.{{9}}$') then concat('33', substr(trim({p}), 4)) else trim({p}) end"""


def _valid(column):
    return f"coalesce(length({column}) = 11 and {column} like '33%' and substr({column}, 3, 1) between '1' and '9', false)"


@query("drop_optional_column", duck("raw_tx", 'select src_row, "Service" as service, false as has_index from raw_tx'))
def drop_optional_column(spark, sf):
    raw = ingest.drop_optional_column(frame(spark, sf, "raw_tx"))
    return raw.select("src_row", F.col("Service").alias("service"), F.lit("#" in raw.columns).alias("has_index"))


@query("parse_locale_number", duck("numbers", f"select src_row, cast({q.locale('txt')} as double) as val from numbers"))
def parse_locale_number(spark, sf):
    return frame(spark, sf, "numbers").select("src_row", parsing.locale_number(F.col("txt")).cast("double").alias("val"))


@query("parse_plain_number", duck("numbers", f"select src_row, cast({q.plain('txt')} as double) as val from numbers"))
def parse_plain_number(spark, sf):
    return frame(spark, sf, "numbers").select("src_row", parsing.plain_number(F.col("txt")).cast("double").alias("val"))


@query("parse_multi_format_ts", duck("dates", f"select src_row, {q.stamp_text('txt')} as ts from dates"))
def parse_multi_format_ts(spark, sf):
    ts = parsing.multi_format_timestamp(F.col("txt"))
    return frame(spark, sf, "dates").select("src_row", naming.time_text(ts).alias("ts"))


@query(
    "map_code_default_self",
    "select o_orderkey, case o_orderstatus when 'F' then 'CANCELLED' when 'O' then 'CONFIRMED' else o_orderstatus end as code from orders",
)
def map_code_default_self(spark, sf):
    code = parsing.map_code(F.col("o_orderstatus"), {"F": "CANCELLED", "O": "CONFIRMED"})
    return table(spark, sf, "orders").select("o_orderkey", code.alias("code"))


@query("normalise_phone", duck("contacts", f"select id, {_PHONE.format(p='telephone2')} as phone from contacts"))
def normalise_phone(spark, sf):
    return phones.normalise_phones(frame(spark, sf, "contacts"), ["telephone2"]).select("id", F.col("telephone2").alias("phone"))


@query("phone_is_valid", duck("contacts", f"select id, {_valid('telephone1')} as ok1, {_valid('telephone2')} as ok2 from contacts"))
def phone_is_valid(spark, sf):
    return frame(spark, sf, "contacts").select(
        "id", phones.phone_is_valid(F.col("telephone1")).alias("ok1"), phones.phone_is_valid(F.col("telephone2")).alias("ok2")
    )


@query(
    "phone_pick_valid",
    duck("contacts", f"select id, case when {_valid('telephone1')} then telephone1 else telephone2 end as telephone1, telephone2 "
                     f"from contacts where {_valid('telephone1')} or {_valid('telephone2')}"),
)
def phone_pick_valid(spark, sf):
    return phones.phone_pick_valid(frame(spark, sf, "contacts")).select("id", "telephone1", "telephone2")


@query("id_is_numeric", f"select o_orderkey, regexp_matches({_ID}, '^[0-9]+$') as ok from orders")
def id_is_numeric(spark, sf):
    orders = table(spark, sf, "orders").withColumn("id", F.expr(_ID))
    return orders.select("o_orderkey", parsing.is_numeric_id(F.col("id")).alias("ok"))


@query("account_is_numeric", f"select o_orderkey, coalesce(regexp_matches({_ACCOUNT}, '^[0-9]*[1-9][0-9]*$'), false) as ok from orders")
def account_is_numeric(spark, sf):
    orders = table(spark, sf, "orders").withColumn("account", F.expr(_ACCOUNT))
    return orders.select("o_orderkey", parsing.is_numeric_account(F.col("account")).alias("ok"))


@query("safe_filename", r"""select page_id, translate(trim(url), '<>:"/\|?*', '_________') as name from pages""")
def safe_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", naming.safe_filename(F.col("url")).alias("name"))


@query("safe_name_alnum", r"select doc_id, concat('Invitation_', trim(regexp_replace(text, '[^\p{L}\p{N} _-]', '', 'g')), '.pdf') as name from documents")
def safe_name_alnum(spark, sf):
    return table(spark, sf, "documents").select("doc_id", naming.safe_name(F.col("text"), "Invitation_", ".pdf").alias("name"))


@query("slug_key", "select doc_id, trim(translate(lower(text), ' -/''\"', '___'), '_') as key from documents")
def slug_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", naming.slug_key(F.col("text")).alias("key"))


@query("file_extension", duck("files", f"select doc_id, {_EXT} as ext, "
       "regexp_extract(path, '([^./]*)$', 1) as raw_ext from files"))
def file_extension(spark, sf):
    path = F.col("path")
    return frame(spark, sf, "files").select("doc_id", naming.file_extension(path).alias("ext"), naming.raw_extension(path).alias("raw_ext"))


@query("file_category", duck("files", f"select doc_id, case {_EXT} " + " ".join(
    f"when '{e}' then '{c}'" for e, c in FILE_CATEGORIES) + f" else '{OTHER_CATEGORY}' end as category from files"))
def file_category(spark, sf):
    return naming.file_category(frame(spark, sf, "files")).select("doc_id", "category")


@query(
    "bytes_to_mb",
    "select event_id, cast(round_even(cast(event_id * event_id * 2731 as decimal(18,0)) * cast('0.00000095367431640625' as decimal(20,20)), 2) as decimal(20,2)) :: varchar as mb, "
    "strftime(ts, '%Y-%m-%d %H:%M:%S') as modified from events",
)
def bytes_to_mb(spark, sf):
    size = (F.col("event_id") * F.col("event_id") * 2731).alias("size")
    return table(spark, sf, "events").select("event_id", "ts", size).select(
        "event_id", naming.mb_text(F.col("size")).alias("mb"), naming.time_text(F.col("ts")).alias("modified")
    )


@query(
    "sql_literal",
    r"""select o_orderkey,
 case when o_orderstatus = 'F' then 'NULL' else concat('''', replace(concat(o_orderpriority, '''s'), '''', ''''''), '''') end as txt,
 concat('''', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '''') as ts, concat('''', cast(cast(o_orderdate as date) as varchar), '''') as dt,
 case when o_totalprice > 200000 then 'TRUE' else 'FALSE' end as flag, concat('''\x', lower(hex(encode(o_orderpriority))), '''') as bytes,
 cast(cast(o_totalprice as decimal(18,2)) as varchar) as num from orders""",
)
def sql_literal(spark, sf):
    typed = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "F", F.concat("o_orderpriority", F.lit("'s"))).alias("txt"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderdate").cast("date").alias("dt"),
        (F.col("o_totalprice") > 200000).alias("flag"), F.encode("o_orderpriority", "UTF-8").alias("bytes"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("num"),
    )
    return typed.select(
        "o_orderkey",
        *[literals.sql_literal(F.col(f.name), f.dataType).alias(f.name) for f in typed.schema.fields[1:]],
    )


_STRINGS = """parts as (select doc_id, trim(s) as string from (select doc_id, unnest(list_concat(regexp_extract_all(text, '''([^'']*)''', 1),
 list_concat(regexp_extract_all(text, '"([^"]*)"', 1), regexp_extract_all(text, '`([^`]*)`', 1)))) as s
 from (select doc_id, text from documents union all select page_id, html from pages))),
strings as (select doc_id, string from parts where length(string) > 1 and not regexp_matches(string, '^(http|www|/|[.]|@)'))"""


def _sources(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return docs.unionByName(table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text")))


@query("extract_quoted_strings", f"with {_STRINGS} select cast(doc_id as varchar) as path, string from strings")
def extract_quoted_strings(spark, sf):
    return corpus.extract_quoted_strings(_sources(spark, sf), None)


@query("union_distinct", f"with {_STRINGS} select distinct string from strings")
def union_distinct(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("").alias("path"), "text")
    pages = table(spark, sf, "pages").select(F.lit("").alias("path"), F.col("html").alias("text"))
    return corpus.union_distinct(corpus.extract_quoted_strings(docs, None), corpus.extract_quoted_strings(pages, None))


@query("sort_code_point", f"with {_STRINGS} select distinct string from strings order by string")
def sort_code_point(spark, sf):
    return corpus.sort_code_point(corpus.extract_quoted_strings(_sources(spark, sf), None))


_DICTIONARY = _STRINGS + """, dict as (select trim(translate(lower(string), ' -/''"', '___'), '_') as key, max(string) as text from strings group by 1)"""


@query("last_wins_dictionary", f"with {_DICTIONARY} select key, text from dict")
def last_wins_dictionary(spark, sf):
    return corpus.last_wins_dictionary(corpus.extract_quoted_strings(_sources(spark, sf), None))


@query("translation_map", f"with {_DICTIONARY} select 'fr' as lang, key, text from dict union all select 'en', key, '' from dict")
def translation_map(spark, sf):
    words = corpus.last_wins_dictionary(corpus.extract_quoted_strings(_sources(spark, sf), None))
    nested = corpus.translation_map(corpus.translation_entries(words))
    return nested.select(F.explode("doc").alias("lang", "texts")).select("lang", F.explode("texts").alias("key", "text"))


def _clean(expr):
    text = f"regexp_replace({expr}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return f"trim(regexp_replace({text}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


_ANCHOR = """'(?s)<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>'"""


def _inside(tag: str, source: str) -> str:
    """CTE text: content of the first element of that name per page, by a running sum over all tags and texts in order."""
    return f"""{tag}_tokens as (select page_id, i, t, case when starts_with(t, '<{tag}') then 1 when starts_with(t, '</{tag}') then -1 else 0 end as step
  from (select page_id, unnest(tokens) as t, generate_subscripts(tokens, 1) as i from (select page_id, regexp_extract_all(html, '<[^>]*>|[^<]+|<') as tokens from {source}))),
 {tag}_depth as (select *, sum(step) over (partition by page_id order by i) as depth from {tag}_tokens),
 {tag}_first as (select page_id, min(i) as a from {tag}_depth where step = 1 group by 1),
 {tag}_last as (select f.page_id, a, min(i) as z from {tag}_first f join {tag}_depth d on d.page_id = f.page_id and d.i > f.a and d.depth = 0 and d.step = -1 group by 1, 2),
 {tag}_body as (select l.page_id, coalesce(string_agg(t, '' order by i) filter (where i > a and i < z), '') as body from {tag}_last l join {tag}_tokens t on t.page_id = l.page_id group by 1)"""


def _page_oracle(source: str, extra: str = "") -> str:
    return f"""with {extra}{_inside('nav', source)}, {_inside('h1', source)}, {_inside('article', source)},
 l as (select page_id, unnest(regexp_extract_all(body, {_ANCHOR}, 2)) as t, unnest(regexp_extract_all(body, {_ANCHOR}, 1)) as href,
  generate_subscripts(regexp_extract_all(body, {_ANCHOR}, 1), 1) as i from nav_body)
select m.page_id, coalesce({_clean('h.body')}, '') as title, coalesce({_clean('a.body')}, '') as body,
 coalesce((select string_agg(concat({_clean('t')}, '|', href), ';' order by i) from l where l.page_id = m.page_id), '') as links
from {source} m left join h1_body h on h.page_id = m.page_id left join article_body a on a.page_id = m.page_id"""


def _page_fields(pages):
    html = F.col("html")
    pairs = F.transform(texts.page_links(html), lambda a: F.concat(a["title"], F.lit("|"), a["href"]))
    return pages.select(
        "page_id", texts.page_title(html).alias("title"), texts.page_body(html).alias("body"), F.array_join(pairs, ";").alias("links")
    )


@query("page_fields", _page_oracle("pages"))
def page_fields(spark, sf):
    return _page_fields(table(spark, sf, "pages"))


_NESTED = (("</nav>", '<nav class="sub"><a href="/in">in</a></nav><a href="/last">last</a></nav>'),
           ("</article>", "<article><p>inner</p></article><p>after it</p></article><article>another</article>"))


@query("page_fields_nested", _page_oracle("nested", "nested as (select page_id, replace(replace(html, '{}', '{}'), '{}', '{}') as html from pages), ".format(*_NESTED[0], *_NESTED[1])))
def page_fields_nested(spark, sf):
    """Menus within menus and articles within articles: the block ends at the closing tag that matches."""
    html = F.col("html")
    for old, new in _NESTED:
        html = F.replace(html, F.lit(old), F.lit(new))
    return _page_fields(table(spark, sf, "pages").select("page_id", html.alias("html")))


@query("filter_in_list", duck("contacts", "select id, pays from contacts where pays in ('FRANCE', 'BELGIQUE', 'ALLEMAGNE')"))
def filter_in_list(spark, sf):
    return settle.filter_in_list(frame(spark, sf, "contacts"), "pays", ["FRANCE", "BELGIQUE", "ALLEMAGNE"]).select("id", "pays")


@query(
    "filter_contains",
    duck("tx", "select src_row, service, compagnie from tx where service like '%ENVOI%' and lower(compagnie) like '%nation\\_1%' escape '\\'"),
)
def filter_contains(spark, sf):
    sends = settle.filter_contains(frame(spark, sf, "tx"), "service", "ENVOI")
    return settle.filter_contains(sends, "compagnie", "nation_1", ignore_case=True).select("src_row", "service", "compagnie")


@query("filter_not_equal_null_kept", duck("tx", "select src_row, statut from tx where statut is distinct from 'CANCELLED'"))
def filter_not_equal_null_kept(spark, sf):
    return settle.filter_not_equal(frame(spark, sf, "tx"), "statut", "CANCELLED").select("src_row", "statut")


@query("filter_not_equal_sql", duck("tx", "select src_row, statut from tx where statut <> 'CANCELLED'"))
def filter_not_equal_sql(spark, sf):
    return settle.filter_not_equal(frame(spark, sf, "tx"), "statut", "CANCELLED", keep_nulls=False).select("src_row", "statut")


@query("filter_key_present", duck("screening", "select id_num, id_unique from screening where coalesce(id_unique, '') <> ''"))
def filter_key_present(spark, sf):
    return contacts.filter_key_present(frame(spark, sf, "screening"), "id_unique").select("id_num", "id_unique")
