"""Small tables with what may go wrong: nulls, empty and long texts, repeated rows, clashing names."""

from pyspark.sql import functions as F

CLASHING = ("score", "n", "label", "node", "comp", "mark", "pos", "line", "word", "words", "key", "at", "h1", "place", "ids", "raw", "held_out", "lang_pred",
            "n_langs", "n_lines", "n_dropped", "rep", "sig", "set", "token", "digest", "body", "keeper", "kind", "chunk", "_first", "_words")

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
SHORT = [
    (1, "The cat sat on the mat and looked at the old grey dog.\nA second line that is long enough.", "en"),
    (1, "The cat sat on the mat and looked at the old grey dog.\nA second line that is long enough.", "en"),
    (2, None, "en"), (3, "", None), (4, "   \n\t ", "de"), (None, "A row without an id, and a token=abcdef123456 inside.", "en"), (None, None, None),
    (5, "12345 67890 !!! ###", "fr"), (6, LONG, "en"), (7, "x", None), (8, "é", "fr"), (9, "日本語のテキスト", "ja"),
    (10, "The cat sat on the mat and looked at the old grey dog.\nA second line that is long enough!", "en"),
]


def documents(spark, rows=SHORT, clash=True):
    df = spark.createDataFrame([(i, t, x, None, None) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING if clash else ():
        df = df.withColumn(c, F.lit("own"))
    return df


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("own")).withColumn("label", F.lit("own"))
