"""Small awkward tables that every operator has to take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, Doc_Id string"

ODD = [
    (1, "The cat sat on the mat, and then it ran away.", "en", "a", 10, "x", "y"),
    (1, "The cat sat on the mat, and then it ran away.", "en", "a", 10, "x", "y"),
    (2, None, None, None, None, None, None),
    (3, "", "en", None, 0, None, None),
    (4, " \t\n ", None, "a", 4, None, None),
    (None, "no id stands beside this text at all today", "en", "a", None, None, None),
    (None, "no id stands beside this text at all today", "en", "b", None, None, None),
    (5, "word " * 40_000, "en", "a", 200_000, None, None),
    (6, "x" * 50_000, None, None, None, None, None),
    (7, "Größe İSTANBUL ΣΑΣ 日本語 🙂 <|endoftext|> don't it's 12345", "de", "c", None, "q", None),
    (2**62, "the cat  sat on the mat, and then\tit ran away.", "en", "a", 11, "x", "y"),
    (8, "one two three", "en", "a", 13, None, None),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df):
    return [r.asDict(recursive=True) for r in df.collect()]
