import pytest

#: Names that the operators use inside; documents may bring columns called so.
CLASHES = "seq digest kept label node size key lost order start goal number taken position bands found shard hash words twins base more votes mean inverse usable text_a _id _sha".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and clashing columns."""
    long = "word after word " * 20_000
    rows = [
        (1, "The same text of ten words is here for all to see", "en", "a"), (1, "The same text of ten words is here for all to see", "en", "a"),
        (2, "The same text of ten words is here for all to see", "fr", None), (3, None, "en", "b"), (4, "", None, "b"), (5, " \n\t ", "en", "b"),
        (6, long, "en", "c"), (7, "12345 !!!", "de", "c"), (None, "a text without an id, of some ten words or so, you see", "en", "c"), (8, "é ü 漢字 ΣΑΣ <|endoftext|>\x00", "de", "a"),
        (9, "one\none\nshared line of some length\n\nend", "en", "a"), (10, "Shared Line Of Some Length  \nother", "en", "a"), (None, None, None, None),
    ]
    base = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return with_clashes(base)


def with_clashes(frame):
    from pyspark.sql import functions as F

    return frame.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return docs.orderBy("doc_id").collect()
