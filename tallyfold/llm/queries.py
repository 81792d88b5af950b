"""Registered queries of the operators for training data, and their SQL where it can say the same."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.tables import table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def llm_query(key: str, oracle: str | None = None):
    def keep(fn):
        LLM_QUERIES[key] = fn
        if oracle:
            LLM_ORACLES[key] = oracle
        return fn

    return keep


@llm_query("op1_topk", """
    with v as (select vec_id, [floor(256 * x::double) for x in embedding] as e from embeddings
               where embedding is not null and vec_id is not null
                 and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0)
    select q.vec_id as query_id, cast(row_number() over (partition by q.vec_id order by list_dot_product(q.e, c.e) desc, c.vec_id) as integer) as rank,
           c.vec_id as vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
    from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
    qualify rank <= 5""")
def op1(spark, sf_dir):
    from tallyfold.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


@llm_query("op2_secrets")
def op2(spark, sf_dir):
    from tallyfold.llm.credentials import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


@llm_query("op3_neardup", """
    with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') as w from documents),
         s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] end) as s from w),
         c as (select s, min(doc_id) as rep, len(s) as n from (select doc_id, list_sort(s) as s from s) where len(s) > 0 group by s),
         t as (select rep, unnest(s) as g from c),
         l as (select a.rep as a, b.rep as b, count(*) as i from t a join t b on a.g = b.g and a.rep < b.rep group by all),
         e as (select a, b from l join c x on x.rep = a join c y on y.rep = b where 100 * i >= 80 * (x.n + y.n - i)),
         r as (with recursive r(a, b) as (select rep, rep from c union select r.a, e.b from r join (select a, b from e union all select b, a from e) e on e.a = r.b) select * from r),
         g as (select a as rep, min(b) as component_id from r group by a)
    select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(g.component_id, s.doc_id) as component_id, s.doc_id = coalesce(g.component_id, s.doc_id) as kept
    from (select doc_id, list_sort(s) as s from s) s left join c on c.s = s.s and len(s.s) > 0 left join g on g.rep = c.rep""")
def op3(spark, sf_dir):
    from tallyfold.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@llm_query("op4_decontamination", f"""
    with d as (select doc_id, {_WORDS_SQL} as w from documents),
         b as (select item_id, {_WORDS_SQL} as w from benchmark),
         v as (select distinct item_id, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') as k, least(13, len(w)) as n
               from (select item_id, w, unnest(range(1, greatest(2, len(w) - 11))) as p from b where len(w) > 0)),
         z as (select distinct n from v),
         o as (select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, z where len(w) >= n)),
         h as (select o.doc_id, o.p, o.n, v.item_id from o join v on o.k = v.k and o.n = v.n),
         c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from h) group by doc_id),
         i as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id)
    select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
    from d left join c using (doc_id) left join i using (doc_id)""")
def op4(spark, sf_dir):
    from tallyfold.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_mark")


@llm_query("op5_linededup", r"""
    with l as (select doc_id, pos, line from (select doc_id, string_split(text, chr(10)) as a, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos, unnest(string_split(text, chr(10))) as line
               from documents where text is not null)),
         u as (select line, length(line) as n, min((doc_id, pos)) as at from l where length(line) >= 20 group by line),
         p as (select x.line as x, y.line as y, x.n as xn, y.n as yn from u x join u y on left(x.line, 10) = left(y.line, 10) and abs(x.n - y.n) <= 1 and y.at < x.at
               union select x.line, y.line, x.n, y.n from u x join u y on right(x.line, 10) = right(y.line, 10) and abs(x.n - y.n) <= 1 and y.at < x.at),
         h as (select x, y, xn, yn, case when xn > yn then y else x end as s, case when xn > yn then x else y end as t from p
               where left(x, least(xn, yn) // 2) = left(y, least(xn, yn) // 2) or right(x, least(xn, yn) // 2) = right(y, least(xn, yn) // 2)),
         near as (select distinct x from h where len([k for k in range(0, length(s) + 1) if left(s, k) = left(t, k)
                  and substr(t, k + 2) = (case when xn = yn then substr(s, k + 2) else substr(s, k + 1) end)]) > 0),
         f as (select l.*, length(line) >= 20 and (line in (select x from near) or (l.doc_id, l.pos) <> u.at) as gone from l left join u using (line)),
         g as (select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, string_agg(case when gone then null else line end, chr(10) order by pos) as text from f group by doc_id)
    select d.doc_id, case when d.text is null then null else coalesce(g.text, '') end as text, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped
    from documents d left join g using (doc_id)""")
def op5(spark, sf_dir):
    from tallyfold.llm.linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@llm_query("op6_langid")
def op6(spark, sf_dir):
    from tallyfold.llm.langid import identify_languages

    return identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "n_langs")


@llm_query("op7_packing")
def op7(spark, sf_dir):
    import public_tokenizers

    from tallyfold.llm.packing import pack_sequences

    return pack_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


@llm_query("op8_warc", """
    with p as (select page_id, coalesce(html, '') as body from pages),
         d as (select page_id, octet_length(encode(body)) as payload_bytes, sha1(body) as h from p),
         k as (select *, max(page_id) over (partition by h, payload_bytes) as keeper from d),
         b as (select *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + cast((cast('0x' || substr(h, 1 + 5 * (i // 4), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as integer), 1) for i in range(0, 32)], '') as digest from k)
    select page_id, cast(payload_bytes as bigint) as payload_bytes, digest as payload_digest,
           case when page_id = keeper then 'response' else 'revisit' end as record_type,
           case when page_id = keeper then null else keeper end as refers_to
    from b""")
def op8(spark, sf_dir):
    from tallyfold.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@llm_query("op9_toxicity")
def op9(spark, sf_dir):
    from tallyfold.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@llm_query("op10_quality")
def op10(spark, sf_dir):
    from tallyfold.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@llm_query("op11_tokenfiles")
def op11(spark, sf_dir):
    import public_tokenizers

    from tallyfold.llm.tokenfiles import token_file_round_trip

    return token_file_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@llm_query("op12_whitening")
def op12(spark, sf_dir):
    from tallyfold.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


@llm_query("op13_collocations", """
    with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
         w as (select lang, regexp_extract_all(piece, '[^ \\x09]+') as w from p),
         g as (select lang, unnest(flatten([[w[i:i + k - 1] for i in range(1, len(w) - k + 2)] for k in range(1, 5)])) as g from w),
         f as (select lang, g, count(*) as f from g group by all having count(*) >= 30),
         n as (select lang, sum(len(w))::bigint as n from w group by lang),
         c as (select lang, g, f as a, unnest(range(1, len(g))) as k from f where len(g) > 1),
         s as (select c.lang, c.g, c.a, c.k, l.f as l, r.f as r, ((c.a::hugeint * 2000000) // (l.f + r.f))::bigint as score
               from c join f l on l.lang = c.lang and l.g = c.g[1:c.k] join f r on r.lang = c.lang and r.g = c.g[c.k + 1:]),
         m as (select lang, g, any_value(a) as a, min({'score': score, 'k': k, 'l': l, 'r': r}) as b from s group by lang, g),
         i as (select lang, unnest(flatten([[g[x:x + k - 1] for x in range(1, len(g) - k + 2)] for k in range(2, len(g))])) as g, f from f where len(g) > 2),
         h as (select lang, g, max(f) as longer from i group by lang, g),
         o as (select m.lang, array_to_string(m.g, ' ') as phrase, m.a, m.b.l as l, m.b.r as r, m.b.score as score
               from m left join h on h.lang = m.lang and h.g = m.g where h.longer is null or 100 * h.longer < 80 * m.a)
    select o.lang, row_number() over (partition by o.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n.n, score
    from o join n on n.lang = o.lang qualify rank <= 2000""")
def op13(spark, sf_dir):
    from tallyfold.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))
