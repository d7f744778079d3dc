"""Small documents that hold every odd case, and rows as plain tuples."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, id string, kept int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", "a", None, "x", "y", None) for i, t in rows], DOCS)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((x is not None, x) for x in r))
