"""Queries of file and text corpora."""

from pyspark.sql import functions as F

from tallyfold.fixed_values import CODE_EXTENSIONS, FILE_CATEGORIES, IGNORED_DIR_WORDS, OTHER_CATEGORY, TREE_EXCLUDED
from tallyfold.functions import naming
from tallyfold.operators import corpus
from tallyfold.plans.fixtures import duck, frame, table
from tallyfold.plans.registry import query

_EXT = r"lower(regexp_extract(path, '[^./][^/]*([.][^./]*)$', 1))"
_DIRS = "list_slice(list_filter(string_split(path, '/'), lambda x: x <> ''), 1, -2)"
_IGNORED = f"len(list_filter({_DIRS}, lambda d: " + " or ".join(f"contains(d, '{w}')" for w in IGNORED_DIR_WORDS) + ")) > 0"
_CODE = f"{_EXT} in ({', '.join(repr(e) for e in CODE_EXTENSIONS)}) and size <= 10485760"
_LINES = """(length(text) - length(replace(text, chr(10), '')) + case when text = '' or text like '%' || chr(10) then 0 else 1 end)"""


@query("filter_corpus_files", duck("files", f"select path from files where {_CODE} and not ({_IGNORED})"))
def filter_corpus_files(spark, sf):
    return corpus.filter_corpus_files(frame(spark, sf, "files")).select("path")


@query("filter_excluded_dirs_exact", duck("files", f"select path from files where not list_has_any({_DIRS}, [{', '.join(repr(e) for e in TREE_EXCLUDED)}])"))
def filter_excluded_dirs_exact(spark, sf):
    return corpus.filter_excluded_dirs_exact(frame(spark, sf, "files")).select("path")


_BY_EXT = f"""select {_EXT} as extension, count(*) as files, cast(sum({_LINES}) as bigint) as lines from files
where {_CODE} and not ({_IGNORED}) group by 1"""


@query("lines_by_extension", duck("files", _BY_EXT))
def lines_by_extension(spark, sf):
    return corpus.lines_by_extension(frame(spark, sf, "files"))


@query("sort_lines_desc", duck("files", _BY_EXT + " order by lines desc, extension"))
def sort_lines_desc(spark, sf):
    return corpus.sort_lines_desc(corpus.lines_by_extension(frame(spark, sf, "files")))


@query(
    "corpus_totals",
    duck("files", f"""select count(*) as all_files, count(*) filter (where {_CODE}) as code_files,
 cast(coalesce(sum({_LINES}) filter (where {_CODE}), 0) as bigint) as lines, 0::bigint as skipped_files from files where not ({_IGNORED})"""),
)
def corpus_totals(spark, sf):
    return corpus.corpus_totals(frame(spark, sf, "files"))


# A small limit, so that the fixture has files on both sides of it.
@query("skipped_files", duck("files", f"select path, cast(size as bigint) as size from files where {_EXT} in ({', '.join(repr(e) for e in CODE_EXTENSIONS)}) and size > 2000 and not ({_IGNORED})"))
def skipped_files(spark, sf):
    return corpus.skipped_files(frame(spark, sf, "files"), max_bytes=2000).select("path", F.col("size").cast("long").alias("size"))


_TOP = """top as (select string_split(path, '/')[2] as name, bool_or(len(string_split(path, '/')) > 2) as is_dir,
 cast(sum(size) as bigint) as size from files group by 1)"""


@query(
    "size_by_top_entry",
    duck("files", "select name, is_dir, size, cast(cast(round_even(cast(size as decimal(18,0)) * cast('0.00000095367431640625' as decimal(20,20)), 2) as decimal(20,2)) as varchar) as size_mb from top", _TOP),
)
def size_by_top_entry(spark, sf):
    return corpus.size_by_top_entry(frame(spark, sf, "files"))


@query("sort_dirs_then_size", duck("files", "select name, is_dir, size from top order by is_dir desc, size desc, name", _TOP))
def sort_dirs_then_size(spark, sf):
    return corpus.sort_dirs_then_size(corpus.size_by_top_entry(frame(spark, sf, "files"))).select("name", "is_dir", "size")


@query("size_totals", duck("files", "select count(*) filter (where not is_dir) as files, count(*) filter (where is_dir) as dirs, cast(sum(size) as bigint) as size from top", _TOP))
def size_totals(spark, sf):
    return corpus.size_totals(corpus.size_by_top_entry(frame(spark, sf, "files")))


_TOKENS = """tok as (select path, cast(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) as bigint) as tokens from files
 where regexp_extract(path, '([^./]*)$', 1) in ('ts', 'tsx', 'js', 'jsx', 'py', 'html', 'css', 'txt', 'dart'))"""


@query("tokens_by_file", duck("files", "select path, tokens from tok", _TOKENS))
def tokens_by_file(spark, sf):
    return corpus.tokens_by_file(frame(spark, sf, "files"))


@query("token_totals", duck("files", "select count(*) as files, cast(coalesce(sum(tokens), 0) as bigint) as tokens from tok", _TOKENS))
def token_totals(spark, sf):
    return corpus.token_totals(corpus.tokens_by_file(frame(spark, sf, "files")))


@query(
    "path_tree",
    duck("files", """select array_to_string(key, '/') as sort_key, depth, concat(repeat('  ', depth), '+--', substr(key[-1], 2)) as line
 from keyed union all select '', 0, '+--root'""",
         f"""p as (select list_filter(string_split(path, '/'), lambda x: x <> '') as parts from files
 where not list_has_any({_DIRS}, [{', '.join(repr(e) for e in TREE_EXCLUDED)}])),
 d as (select parts, cast(unnest(range(1, len(parts) + 1)) as int) as depth from p),
 keyed as (select distinct list_append(list_transform(parts[1:depth - 1], lambda x: '0' || x), case when depth < len(parts) then '0' else '1' end || parts[depth]) as key, depth from d)"""),
)
def path_tree(spark, sf):
    tree = corpus.path_tree(frame(spark, sf, "files"), "root")
    return tree.orderBy("sort_key").select(F.array_join("sort_key", "/").alias("sort_key"), "depth", "line")


@query(
    "bundle_lines",
    duck("files", """select path, cast(i - 1 as int) as ord, lines[i] as line from (select path, lines, unnest(range(1, len(lines) + 1)) as i from
 (select path, list_append(list_prepend('// ' || path, string_split(regexp_replace(text, '\\n$', ''), chr(10))), '') as lines from files))"""),
)
def bundle_lines(spark, sf):
    return corpus.bundle_lines(frame(spark, sf, "files").select("path", "text"))


# Files already at the target: labelled documents, under their own name or with a number.
_CATEGORY = f"case {_EXT} " + " ".join(f"when '{e}' then '{c}'" for e, c in FILE_CATEGORIES) + f" else '{OTHER_CATEGORY}' end"
_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_STEM = r"case when regexp_matches(name, '^.*[^.].*[.][^.]*$') then regexp_extract(name, '^(.*)[.][^.]*$', 1) else name end"
_SUFFIX = r"case when regexp_matches(name, '^.*[^.].*[.][^.]*$') then regexp_extract(name, '([.][^.]*)$', 1) else '' end"


def _target_files(spark, sf):
    files = naming.file_category(frame(spark, sf, "files")).withColumn("name", naming.base_name(F.col("path")))
    incoming = files.select("doc_id", "category", "name")
    numbered = F.regexp_replace("name", r"^(f[0-9]+)", "$1 (1)")
    labels = table(spark, sf, "labels").join(incoming, "doc_id")
    names = F.array(F.when(F.col("quality") == 1, F.col("name")), F.when(F.col("toxic") == 1, F.col("name")),
                    F.when((F.col("quality") == 1) & (F.col("doc_id") % 2 == 0), numbered),
                    F.when(F.col("toxic") == 1, F.regexp_replace("name", r"^(f[0-9]+)", "$1 (2)")))
    present = labels.select("category", F.explode(F.filter(names, lambda n: n.isNotNull())).alias("name"))
    return incoming, present


@query(
    "collision_suffix",
    duck("files", f"""select doc_id, category, name, case when not taken then name else concat(stem, ' (', cast((select min(n) from range(1, 50) t(n)
  where not exists (select 1 from present p where p.category = i.category and p.name = concat(i.stem, ' (', cast(n as varchar), ')', i.ext))) as varchar), ')', ext) end as target_name
 from (select n.*, exists (select 1 from present p where p.category = n.category and p.name = n.name) as taken, {_STEM} as stem, {_SUFFIX} as ext from named n) i""",
         f"""named as (select doc_id, {_CATEGORY} as category, {_BASE} as name from files),
 lab as (select n.*, quality, toxic from named n join labels l on n.doc_id = l.doc_id),
 present as (select category, name from lab where quality = 1 or toxic = 1
  union all select category, regexp_replace(name, '^(f[0-9]+)', '\\1 (1)') from lab where quality = 1 and doc_id % 2 = 0
  union all select category, regexp_replace(name, '^(f[0-9]+)', '\\1 (2)') from lab where toxic = 1)"""),
)
def collision_suffix(spark, sf):
    return corpus.collision_suffix(*_target_files(spark, sf))


_NUMBERED = r"""named as (select doc_id, @cat as category, regexp_replace(@base, '^f[0-9]+', concat('f', cast(doc_id % 40 as varchar))) as name from files),
 lab as (select n.*, quality, toxic from named n join labels l on n.doc_id = l.doc_id),
 present as (select category, name from lab where quality = 1 and doc_id % 7 = 0
  union select category, regexp_replace(name, '^(f[0-9]+)', '\1 (1)') from lab where quality = 1 and doc_id % 2 = 0
  union select category, regexp_replace(name, '^(f[0-9]+)', '\1 (3)') from lab where toxic = 1),
 ranked as (select n.*, row_number() over (partition by category, name order by doc_id) as nth, exists (select 1 from present p where p.category = n.category and p.name = n.name) as taken,
  @stem as stem, @suffix as ext from named n),
 used as (select category, name from present union select category, name from ranked where nth = 1 and not taken),
 families as (select distinct category, stem, ext from ranked),
 free as (select f.*, n, row_number() over (partition by f.category, stem, ext order by n) as k from families f, range(1, 3000) t(n)
  where not exists (select 1 from used u where u.category = f.category and u.name = concat(f.stem, ' (', cast(n as varchar), ')', f.ext)))"""


@query(
    "collision_suffix_repeats",
    duck("files", """select r.doc_id, r.category, r.name, case when r.nth = 1 and not r.taken then r.name else concat(r.stem, ' (', cast(f.n as varchar), ')', r.ext) end as target_name
 from ranked r left join free f on f.category = r.category and f.stem = r.stem and f.ext = r.ext and f.k = r.nth - case when r.taken then 0 else 1 end""",
         _NUMBERED.replace("@cat", _CATEGORY).replace("@base", _BASE).replace("@stem", _STEM).replace("@suffix", _SUFFIX)),
)
def collision_suffix_repeats(spark, sf):
    """Many incoming files of one name: each gets a number of its own, around those that are used."""
    files = naming.file_category(frame(spark, sf, "files")).withColumn("name", naming.base_name(F.col("path")))
    short = F.expr("regexp_replace(name, '^f[0-9]+', concat('f', cast(doc_id % 40 as string)))")
    incoming = files.select("doc_id", "category", short.alias("name"))
    labels = table(spark, sf, "labels").join(incoming, "doc_id")
    names = F.array(F.when((F.col("quality") == 1) & (F.col("doc_id") % 7 == 0), F.col("name")),
                    F.when((F.col("quality") == 1) & (F.col("doc_id") % 2 == 0), F.regexp_replace("name", r"^(f[0-9]+)", "$1 (1)")),
                    F.when(F.col("toxic") == 1, F.regexp_replace("name", r"^(f[0-9]+)", "$1 (3)")))
    present = labels.select("category", F.explode(F.filter(names, lambda n: n.isNotNull())).alias("name"))
    return corpus.collision_suffix(incoming, present, order=["doc_id"])
