import pytest

#: Null and empty texts, white space, ties, repeated rows and ids, null ids.
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "one two three four five"), (7, "one two three four five"), (7, "one two three four five"), (8, "x" * 3000 + " " + "word " * 3000), (None, "one two three four five"), (9, "é ß Ünï code\u0085line \x1c sep"), (10, "a\nb\nc\nd\na\nb\nc\nd")]
#: Names that the operators use inside.
EXTRA = ("row", "fp", "key", "hash", "size", "data", "times", "own", "at", "t", "h1", "gone", "path", "host", "digest", "h", "__row", "__rank", "__r", "__root", "__of", "__id", "whole", "rows", "bad_id")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every odd case, and columns whose names clash with inner ones."""
    rows = [(i, t, "en", "b" if k % 3 else None, len(t or ""), *[k] * len(EXTRA)) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def real_docs(spark):
    """The generated documents of the smallest size."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
