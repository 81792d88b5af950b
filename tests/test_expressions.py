"""Trap tables for the column expressions."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from tallyfold.fixed_values import TARGET_LAYOUT
from tallyfold.functions import literals, naming, parsing, phones, texts


def values(spark, inputs, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


NUMBERS = ["1,5", "1.5", " 2 ", "1e3", "nan", "inf", "1_000", "1.5d", "1,234.5", "1.234,5", "abc", "", None, "-3,25", "+4", "\t7\n"]


def test_locale_number(spark):
    got = [None if v is None else float(v) for v in values(spark, NUMBERS, parsing.locale_number)]
    assert got == [1.5, 1.5, 2.0, 1000.0, None, None, None, None, None, None, None, None, None, -3.25, 4.0, 7.0]


def test_plain_number_rejects_the_comma(spark):
    got = [None if v is None else float(v) for v in values(spark, NUMBERS, parsing.plain_number)]
    assert got == [None, 1.5, 2.0, 1000.0, None, None, None, None, None, None, None, None, None, None, 4.0, 7.0]


DATES = [
    ("01-02-2025 03:04:05", dt.datetime(2025, 2, 1, 3, 4, 5)),
    ("1-2-2025 3:4:5", dt.datetime(2025, 2, 1, 3, 4, 5)),
    ("2025-2-1 3:4:5", dt.datetime(2025, 2, 1, 3, 4, 5)),
    ("01/02/2025 03:04", dt.datetime(2025, 2, 1, 3, 4)),
    ("29-02-2024 00:00:00", dt.datetime(2024, 2, 29)),
    ("31-02-2025 00:00:00", None), ("01-02-25 03:04:05", None), (" 01-02-2025 03:04:05", None),
    ("01-02-2025", None), ("01/02/2025 03:04:05", None), ("2025-02-01 25:00:00", None),
    ("2025-02-01 03:04:05\n", None), ("2025-02-01T03:04:05", None), ("", None), (None, None),
]


def test_timestamps(spark):
    assert values(spark, [d for d, _ in DATES], parsing.multi_format_timestamp) == [x for _, x in DATES]


def test_timestamps_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 does not exist in that zone on this day.
        assert values(spark, ["10-03-2024 02:30:00"], parsing.multi_format_timestamp) == [dt.datetime(2024, 3, 10, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_codes(spark):
    assert values(spark, ["CREATED", "odd", None, ""], parsing.map_code) == ["CREATED", "odd", None, ""]


def normalised(p):
    """The rule, stated once more in plain Python."""
    if p is None:
        return None
    p = p.strip()
    digit = lambda i: p[i:i + 1] in tuple("123456789")
    if len(p) == 10 and p[0] == "0" and digit(1):
        return "33" + p[1:]
    if len(p) == 9 and digit(0):
        return "33" + p
    if len(p) == 13 and p[:4] == "0033":
        return "33" + p[4:]
    if len(p) == 14 and p[:5] == "00330" and digit(5):
        return "33" + p[5:]
    if len(p) == 12 and p[:3] == "+33":
        return "33" + p[3:]
    return p


def phone_table():
    heads = ["", "0", "00", "01", "1", "9", "0033", "00330", "003301", "+33", "33", "331", "a", " 0"]
    fills = ["1", "0", "9", "x", "3"]
    return [h + f * n for h, f, n in itertools.product(heads, fills, range(0, 12))] + [None]


def test_phones_against_the_rule(spark):
    table = phone_table()
    assert values(spark, table, phones.normalise_phone) == [normalised(p) for p in table]
    valid = [p is not None and len(p) == 11 and p[:2] == "33" and p[2] in "123456789" for p in table]
    assert values(spark, table, phones.phone_is_valid) == valid


def test_normalised_valid_numbers_are_valid(spark):
    table = ["0612345678", "612345678", "0033612345678", "00330612345678", "+33612345678"]
    assert values(spark, table, lambda c: phones.phone_is_valid(phones.normalise_phone(c))) == [True] * 5


def test_identifiers(spark):
    ids = ["12", "1a", "", "12\n", "\u0663", None, "007"]
    assert values(spark, ids, parsing.is_numeric_id) == [True, False, False, False, False, False, True]
    accounts = ["0", "000", "100", "701200", "10a", "", None, "1\n"]
    assert values(spark, accounts, parsing.is_numeric_account) == [False, False, True, True, False, False, False, False]


def test_names(spark):
    assert values(spark, [' a<b>:"/\\|?*c '], naming.safe_filename) == ["a_b________c"]
    assert values(spark, [" Zoé-O'Neil_3! "], naming.safe_name) == ["Zoé-ONeil_3"]
    assert values(spark, ["-Hello, World/It's \"x\"_"], naming.slug_key) == ["hello,_world_its_x"]


def test_extensions(spark):
    paths = ["/a/b.PY", "/a.b/c", "/a/.profile", "x.tar.gz", "a.", "..a", "/d/..b.c"]
    import os.path

    assert values(spark, paths, naming.file_extension) == [os.path.splitext(p)[1].lower() for p in paths]
    assert values(spark, paths, naming.raw_extension) == [p.split("/")[-1].split(".")[-1] for p in paths]


def test_mebibytes_round_like_format(spark):
    sizes = [0, 1, 131072, 393216, 655360, 1048576, 5242880 + 131072, 10**15 + 7]
    got = values(spark, [str(s) for s in sizes], lambda c: naming.mb_text(c.cast("long")))
    assert got == [f"{s / 1048576:.2f}" for s in sizes]


TEXTS = ["", "a", "a\n", "a\nb", "a\n\nb\n", "\n", "a\r\nb\rc", "a\r\n", " x  y\tz\n"]


def test_line_and_token_counts(spark, tmp_path):
    import io

    lines = [len(io.StringIO(t, newline=None).readlines()) for t in TEXTS]
    assert values(spark, TEXTS, texts.line_count) == lines
    assert values(spark, TEXTS, texts.token_count) == [len(t.split()) for t in TEXTS]


def test_quoted_strings(spark):
    import re

    text = "x = 'ab' + \"c d \" + `e\nf` + 'h' + 'http://x' + '@k' + './p' + '' + ' www ' + 'it\"s'"
    raw = re.findall(r"'([^']*)'", text) + re.findall(r'"([^"]*)"', text) + re.findall(r"`([^`]*)`", text)
    expected = [s.strip() for s in raw if len(s.strip()) > 1 and not s.strip().startswith(("http", "www", "/", ".", "@"))]
    assert values(spark, [text], texts.quoted_strings) == [expected]


def test_page_fields(spark):
    html = '<h1 class="t"> A &amp; <b>B</b> </h1><nav><ul><li><a class="m" href="/x">X &lt;1&gt;</a></li><li><a href="/y">Y</a></li></ul></nav><article>t <!-- no --> u</article><a href="/z">Z</a>'
    assert values(spark, [html], texts.page_title) == ["A & B"]
    assert values(spark, [html], texts.page_body) == ["t u"]
    assert [tuple(x) for x in values(spark, [html], texts.page_links)[0]] == [("X <1>", "/x"), ("Y", "/y")]


def test_literals(spark):
    df = spark.sql("select 'it''s' as a, timestamp '2025-01-02 03:04:05' as b, date '2025-01-02' as c, true as d, x'00ff' as e, 1.50 as f, cast(null as string) as g")
    assert df.select(literals.row_literal(df)).first()[0] == "('it''s', '2025-01-02 03:04:05', '2025-01-02', TRUE, '\\x00ff', 1.50, NULL)"


def test_layout_has_unique_names():
    assert len(TARGET_LAYOUT) == 57
    assert len({t for _, t, _ in TARGET_LAYOUT}) == len({s for s, _, _ in TARGET_LAYOUT}) == 57


@pytest.mark.parametrize("name,expected", [("a.pdf", "Documents/PDF"), ("a.PY", "Code/Python"), ("a", "Autres"), ("a.xyz", "Autres")])
def test_category(spark, name, expected):
    df = spark.createDataFrame([(name,)], "path string")
    assert naming.file_category(df).first()["category"] == expected


def test_element_body_matches_its_closing_tag(spark):
    pages = ["<nav>a<nav>b</nav>c</nav>d", "x<NAV class='q'>a</Nav >b<nav>c</nav>", "<navy>n</navy><nav>a</nav>", "</nav><nav>a</nav>", "<nav>open", "<nav><nav>a</nav>", "none", "", None, "<nav/>x</nav>"]
    assert values(spark, pages, lambda c: texts.element_body(c, "nav")) == ["a<nav>b</nav>c", "a", "a", "a", "open", "<nav>a</nav>", "", "", "", "x"]
