"""Small tables with the columns of documents and names that clash with those inside the operators."""

#: Names that the operators use inside, as extra columns of the input.
CLASH = ("id", "n", "row", "rows", "key", "size", "grp", "h", "uid", "words", "part", "chunk", "bits", "cell", "class", "at", "_text", "_tries", "norm", "digest")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def table_of(spark, rows):
    """rows (doc_id, text, lang, source) with extra columns."""
    return spark.createDataFrame([(*r, None, *CLASH) for r in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
