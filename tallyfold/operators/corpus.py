"""File and text corpora: counts by extension, sizes, tokens, strings, tree listing."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.fixed_values import (
    CODE_EXTENSIONS, IGNORED_DIR_WORDS, MAX_COUNTED_BYTES, STRING_EXTENSIONS, TOKEN_EXTENSIONS, TREE_EXCLUDED,
)
from tallyfold.functions.naming import file_extension, mb_text, path_parts, raw_extension, slug_key
from tallyfold.functions.texts import line_count, quoted_strings, token_count, unify_newlines
from tallyfold.operators import numbering
from tallyfold.operators.intervals import points_in_ranges
from tallyfold.operators.joins import lookup_join
from tallyfold.session import cut_lineage


def _any_of(words) -> str:
    return "(" + "|".join(rf"\Q{w}\E" for w in words) + ")"


def outside_ignored_dirs(path: Column, words=IGNORED_DIR_WORDS) -> Column:
    """No directory name contains one of the words: no word is followed by a slash further on."""
    return ~path.rlike(rf"{_any_of(words)}[^/]*/")


def outside_excluded_dirs(path: Column, names=TREE_EXCLUDED) -> Column:
    """No directory below the root has exactly one of the names."""
    return ~path.rlike(rf"(^|/){_any_of(names)}/")


def has_extension(path: Column, extensions, ignore_case: bool = True) -> Column:
    name = F.lower(path) if ignore_case else path
    return name.rlike(rf"[.]{_any_of(e.lstrip('.') for e in extensions)}\z")


def filter_corpus_files(files: DataFrame, extensions=CODE_EXTENSIONS, words=IGNORED_DIR_WORDS,
                        max_bytes: int = MAX_COUNTED_BYTES) -> DataFrame:
    """Code files of bounded size outside ignored directories (path, size, …)."""
    path = F.col("path")
    return files.where(has_extension(path, extensions) & (F.col("size") <= max_bytes) & outside_ignored_dirs(path, words))


def skipped_files(files: DataFrame, extensions=CODE_EXTENSIONS, words=IGNORED_DIR_WORDS, max_bytes: int = MAX_COUNTED_BYTES) -> DataFrame:
    """Code files that are left out of the counts for their size: path, size."""
    path = F.col("path")
    large = has_extension(path, extensions) & (F.col("size") > max_bytes) & outside_ignored_dirs(path, words)
    return files.where(large).select("path", "size")


def filter_excluded_dirs_exact(files: DataFrame, names=TREE_EXCLUDED) -> DataFrame:
    return files.where(outside_excluded_dirs(F.col("path"), names))


def lines_by_extension(files: DataFrame, **filters) -> DataFrame:
    """Files and lines per extension of the counted files."""
    counted = filter_corpus_files(files, **filters).select(
        file_extension(F.col("path")).alias("extension"), line_count(F.col("text")).alias("lines")
    )
    return counted.groupBy("extension").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))


def corpus_totals(files: DataFrame, extensions=CODE_EXTENSIONS, words=IGNORED_DIR_WORDS,
                  max_bytes: int = MAX_COUNTED_BYTES) -> DataFrame:
    """All files seen, counted files and their lines, and code files skipped for their size, in one pass."""
    path = F.col("path")
    code = has_extension(path, extensions)
    counted = code & (F.col("size") <= max_bytes)
    lines = F.when(counted, line_count(F.col("text")))
    return files.where(outside_ignored_dirs(path, words)).agg(
        F.count("*").alias("all_files"), F.count_if(counted).alias("code_files"),
        F.coalesce(F.sum(lines), F.lit(0)).alias("lines"), F.count_if(code & ~counted).alias("skipped_files"),
    )


def sort_lines_desc(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("lines"), "extension")


def size_by_top_entry(files: DataFrame) -> DataFrame:
    """Each entry directly below the root with its whole size: name, is_dir, size, size_mb; `modified` (latest) where files have it."""
    parts = path_parts(F.col("path"))
    dated = [c for c in ("modified",) if c in files.columns]
    entries = files.select(parts[0].alias("name"), (F.size(parts) > 1).alias("is_dir"), "size", *dated)
    return entries.groupBy("name").agg(
        F.bool_or("is_dir").alias("is_dir"), F.sum("size").alias("size"), *[F.max(c).alias(c) for c in dated]
    ).withColumn("size_mb", mb_text(F.col("size")))


def sort_dirs_then_size(entries: DataFrame) -> DataFrame:
    return entries.orderBy(F.desc("is_dir"), F.desc("size"), "name")


def size_totals(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("dirs"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("size"),
    )


def tokens_by_file(files: DataFrame, extensions=TOKEN_EXTENSIONS, tokens=token_count) -> DataFrame:
    """Tokens per file of the listed extensions; `tokens` is any text -> count expression."""
    chosen = files.where(raw_extension(F.col("path")).isin(list(extensions)))
    return chosen.select("path", tokens(F.col("text")).alias("tokens"))


def token_totals(per_file: DataFrame) -> DataFrame:
    return per_file.agg(F.count("*").alias("files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def extract_quoted_strings(files: DataFrame, extensions=STRING_EXTENSIONS) -> DataFrame:
    """Quoted strings of the listed files (all files when `extensions` is None), with repeats."""
    chosen = files if extensions is None else files.where(has_extension(F.col("path"), extensions, ignore_case=False))
    return chosen.select("path", F.explode(quoted_strings(F.col("text"))).alias("string"))


def union_distinct(strings: DataFrame, *more: DataFrame) -> DataFrame:
    """Set union of the strings of all inputs."""
    out = strings.select("string")
    for other in more:
        out = out.union(other.select("string"))
    return out.distinct()


def sort_code_point(strings: DataFrame, column: str = "string") -> DataFrame:
    """Distinct strings in code-point order, which is Spark's byte order of UTF-8."""
    return strings.select(column).distinct().orderBy(column)


def last_wins_dictionary(strings: DataFrame) -> DataFrame:
    """`(key, text)`: of the strings that share a key, the last one in code-point order."""
    return strings.select(slug_key(F.col("string")).alias("key"), F.col("string")).groupBy("key").agg(
        F.max("string").alias("text")
    )


def translation_entries(dictionary: DataFrame, source_lang: str = "fr", target_langs=("en",)) -> DataFrame:
    """Long form `(lang, key, text)`: source texts, and empty texts to be filled per target language."""
    langs = F.array(
        F.struct(F.lit(source_lang).alias("lang"), F.col("text").alias("text")),
        *[F.struct(F.lit(t).alias("lang"), F.lit("").alias("text")) for t in target_langs],
    )
    return dictionary.select("key", F.explode(langs).alias("e")).select("e.lang", "key", "e.text")


def translation_map(entries: DataFrame, shards: int = 1) -> DataFrame:
    """Nested form `{lang: {key: text}}`: shard, doc. One document, or as many as the caller names, by key hash.

    A dictionary that does not fit a row is written as ordered lines (`sinks.json_document_lines`) instead.
    """
    share = F.pmod(F.xxhash64("key"), F.lit(shards).cast("long")).alias("shard")
    per_lang = entries.select(share, "lang", "key", "text").groupBy("shard", "lang").agg(
        F.array_sort(F.collect_list(F.struct("key", "text"))).alias("texts")
    )
    nested = F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "texts"))))
    return per_lang.groupBy("shard").agg(nested.alias("m")).select(
        "shard", F.transform_values("m", lambda _, texts: F.map_from_entries(texts)).alias("doc")
    )


def path_tree(files: DataFrame, root: str, excluded=TREE_EXCLUDED) -> DataFrame:
    """Indented listing `(sort_key, depth, line)`: per directory, subdirectories first, then files, by name.

    Written with `sink_lines(order=['sort_key'])`, a range-partitioned sort.
    """
    parts = path_parts(F.col("path"))
    nodes = filter_excluded_dirs_exact(files, excluded).select(parts.alias("parts")).select(
        "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth")
    )
    is_dir = F.col("depth") < F.size("parts")
    # Every ancestor is a directory (0); the node itself is one (0) or a file (1).
    ancestors = F.transform(F.slice("parts", F.lit(1), F.col("depth") - 1), lambda p: F.concat(F.lit("0"), p))
    own = F.concat(F.when(is_dir, "0").otherwise("1"), F.element_at("parts", F.col("depth")))
    keyed = nodes.select(F.concat(ancestors, F.array(own)).alias("sort_key"), "depth").distinct()
    name = F.substr(F.element_at("sort_key", F.lit(-1)), F.lit(2))
    listed = keyed.select(
        "sort_key", "depth", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("+--"), name).alias("line")
    )
    top = files.sparkSession.range(0, 1, 1, 1).select(
        F.array().cast("array<string>").alias("sort_key"), F.lit(0).alias("depth"), F.lit(f"+--{root}").alias("line")
    )
    return listed.unionByName(top)


def bundle_lines(files: DataFrame, with_content: bool = True, marker: str = "// ") -> DataFrame:
    """`(path, ord, line)`: a marker line with the path, then the content and a blank line if wanted."""
    head = F.concat(F.lit(marker), F.col("path"))
    if not with_content:
        return files.select("path", F.lit(0).alias("ord"), head.alias("line"))
    content = F.split(F.regexp_replace(unify_newlines(F.col("text")), r"\n\z", ""), "\n")
    lines = F.concat(F.array(head), content, F.array(F.lit("")))
    return files.select("path", F.posexplode(lines).alias("ord", "line"))


def _ranked(rows: DataFrame, keys, order) -> DataFrame:
    """Add `_k`, the place of a row among those of its keys, from 1, without bringing a key's rows to one task.

    Rows are range-sorted by keys and order and numbered through; a key's numbers begin at its smallest.
    """
    place = [*keys, *order]
    rows = cut_lineage(rows.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = rows.join(sizes, "_part").withColumn("_at", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_id", "_before")
    firsts = numbered.groupBy(*keys).agg(F.min("_at").alias("_first"))
    return lookup_join(numbered, firsts, keys).withColumn("_k", F.col("_at") - F.col("_first") + 1).drop("_at", "_first")


def _free_ranges(used: DataFrame, wanted: DataFrame, keys) -> DataFrame:
    """(keys, _low, _high, _skip): the k-th unused number, counted from 1, is k + _skip for k in _low .. _high.

    `used` are the distinct used numbers `i`, `wanted` how many are `needed` per key. Behind the j-th used number, i, the
    unused ones have the ranks from i - j + 1 on, and j of the numbers before them are used; of several with one rank the last counts.
    """
    keys = list(keys)
    ranks = numbering.row_number_by_position(lookup_join(used, wanted, keys, "left_semi"), keys, "i", "_skip")
    starts = ranks.groupBy(*keys, (F.col("i") - F.col("_skip") + 1).alias("_low")).agg(F.max("_skip").alias("_skip"))
    starts = starts.unionByName(wanted.select(*keys, F.lit(1).cast("long").alias("_low"), F.lit(0).cast("long").alias("_skip")))
    starts = starts.groupBy(*keys, "_low").agg(F.max("_skip").cast("long").alias("_skip"))
    gaps = cut_lineage(numbering.row_number_by_position(starts, keys, "_low", "_g"))
    ends = gaps.select(*keys, (F.col("_g") - 1).alias("_g"), (F.col("_low") - 1).alias("_end"))
    return lookup_join(gaps.join(ends, [*keys, "_g"], "left"), wanted, keys).select(
        *keys, "_low", F.least(F.coalesce("_end", "needed"), "needed").alias("_high"), "_skip").where("_low <= _high")


def collision_suffix(incoming: DataFrame, present: DataFrame, whole_names: bool = False, order=None) -> DataFrame:
    """Free target name of every incoming `(category, name)`; no two get the same.

    A name that is free at the target is kept by the first incoming file that has it (by `order`, by default the other columns
    of `incoming`, else the name). Every further file, and all files of a name that is taken, become `stem (i).ext` in
    the same order, each with the smallest i >= 1 that is used neither at the target, nor by a name that is kept, nor by a file
    before it; with `whole_names` (directories) it becomes `name (i)`. Rows without category or name stay as they are. Files that move one after the other get the same
    names, if those that keep theirs go first. One name may be that of most files: they are ranked by a range sort, and the
    k-th free number comes from ranges of unused numbers.
    """
    keys, stems = ["category", "name"], ["category", "stem", "ext"]
    columns = incoming.columns
    order = list(order or [c for c in columns if c not in keys])
    nameless = incoming.where("category is null or name is null")
    incoming = incoming.dropna(subset=keys)
    there = present.select(*keys).distinct()
    ranked = _ranked(incoming, keys, order).withColumnRenamed("_k", "_nth")
    marked = cut_lineage(lookup_join(ranked, there.withColumn("_taken", F.lit(True)), keys, "left"))
    stays = F.col("_taken").isNull() & (F.col("_nth") == 1)
    kept, moving = marked.where(stays).select(*columns), marked.where(~stays).select(*columns, "_nth")

    name = F.col("name")
    numbered = r"(?s)^(.*) [(]([1-9][0-9]{0,8})[)]" + ("()" if whole_names else r"([.][^.]*)?") + r"\z"
    used = there.union(kept.select(*keys)).where(name.rlike(numbered)).select(
        "category", F.regexp_extract(name, numbered, 1).alias("stem"), F.regexp_extract(name, numbered, 3).alias("ext"),
        F.regexp_extract(name, numbered, 2).cast("long").alias("i"),
    ).distinct()
    parts = r"(?s)^(.*[^.].*?)([.][^.]*)\z"
    has_ext = F.lit(False) if whole_names else name.rlike(parts)
    # Of a kept name the first file stays, so that the second is the first that moves.
    moves = lookup_join(moving, kept.select(*keys).withColumn("_keeps", F.lit(1)), keys, "left").select(
        *columns, (F.col("_nth") - F.coalesce("_keeps", F.lit(0))).alias("_k"),
        F.when(has_ext, F.regexp_extract(name, parts, 1)).otherwise(name).alias("stem"), F.when(has_ext, F.regexp_extract(name, parts, 2)).otherwise("").alias("ext"))
    moves = cut_lineage(moves)
    wanted = moves.groupBy(*stems).agg(F.max("_k").alias("needed"))
    free = cut_lineage(_free_ranges(used, wanted, stems))
    renamed = points_in_ranges(moves, free, stems, "_k", "_low", "_high").withColumn(
        "target_name", F.concat("stem", F.lit(" ("), (F.col("_k") + F.col("_skip")).cast("string"), F.lit(")"), "ext"))
    stay = kept.unionByName(nameless).select(*columns, F.col("name").alias("target_name"))
    return renamed.select(*columns, "target_name").unionByName(stay)
