"""Expressions over whole texts: lines, tokens, quoted strings, stored pages."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.fixed_values import NON_TEXT_PREFIXES
from tallyfold.functions.parsing import strip

# Single, double and back quotes; the text between two quotes of one kind is the string.
_QUOTED = (r"'([^']*)'", r'"([^"]*)"', r"`([^`]*)`")


def unify_newlines(text: Column) -> Column:
    """Every line end as one newline character."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def line_count(text: Column) -> Column:
    """Newlines, plus one when the text ends in an unfinished line; 0 for an empty text."""
    body = unify_newlines(text)
    newlines = F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit("")))
    unfinished = F.when((body == "") | F.endswith(body, F.lit("\n")), 0).otherwise(1)
    return (newlines + unfinished).cast("long")


def token_count(text: Column) -> Column:
    """Runs of non-blank characters."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")).cast("long")


def quoted_strings(text: Column, skip_prefixes=NON_TEXT_PREFIXES) -> Column:
    """Trimmed quoted strings longer than one character that do not look like a path or address."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in _QUOTED])

    def wanted(s):
        keep = F.length(s) > 1
        for prefix in skip_prefixes:
            keep = keep & ~F.startswith(s, F.lit(prefix))
        return keep

    return F.filter(F.transform(found, strip), wanted)


def plain_text(markup: Column) -> Column:
    """Markup without tags, entities resolved, blanks folded, trimmed."""
    text = F.regexp_replace(markup, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def element_body(markup: Column, tag: str) -> Column:
    """What stands inside the first element of that name, up to the closing tag that matches it; empty without one.

    The text is cut in front of every opening and closing tag of the name, and a running depth over the pieces (+1, -1) tells which
    of them lie inside. An element that is never closed goes on to the end. Letter case does not matter.
    """
    opens, closes = rf"(?i)^<{tag}(?=[\s>/])", rf"(?i)^</{tag}\s*>"
    pieces = F.split(markup, rf"(?i)(?=<{tag}[\s>/])|(?=</{tag}\s*>)")

    def walk(acc, piece):
        step = F.when(piece.rlike(opens), 1).when(piece.rlike(closes), -1).otherwise(0)
        depth = F.when(acc["over"], 0).otherwise(F.greatest(acc["depth"] + step, F.lit(0)))
        over = acc["over"] | ((acc["depth"] > 0) & (depth == 0))
        return F.struct(depth.alias("depth"), over.alias("over"), F.concat(acc["inside"], F.array(depth > 0)).alias("inside"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("over"), F.array().cast("array<boolean>").alias("inside"))
    inside = F.aggregate(pieces, start, walk, lambda acc: acc["inside"])
    held = F.filter(F.zip_with(pieces, inside, lambda p, i: F.when(i, p)), lambda p: p.isNotNull())
    return F.coalesce(F.regexp_replace(F.array_join(held, ""), rf"(?is)^<{tag}[^>]*>", ""), F.lit(""))


def page_title(html: Column, tag: str = "h1") -> Column:
    return plain_text(element_body(html, tag))


def page_body(html: Column, tag: str = "article") -> Column:
    return plain_text(element_body(html, tag))


def page_links(html: Column, tag: str = "nav") -> Column:
    """Links of the menu block, in order, as an array of (title, href)."""
    menu = element_body(html, tag)
    anchor = r'(?s)<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    hrefs = F.regexp_extract_all(menu, F.lit(anchor), F.lit(1))
    titles = F.regexp_extract_all(menu, F.lit(anchor), F.lit(2))
    return F.transform(
        F.arrays_zip(titles.alias("title"), hrefs.alias("href")),
        lambda a: F.struct(plain_text(a["title"]).alias("title"), a["href"].alias("href")),
    )
