import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"

#: Rows with nulls everywhere, empty and blank texts, repeats, a long text.
ODD = [
    (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "s", 4), (4, "one two", "en", "s", 7), (4, "one two", "en", "s", 7),
    (None, "one two", "en", "s", 7), (5, "Ünïcode wörds ﬁ ǅ 漢字 ́ 😀", "de", "s", 9), (6, "word " * 60000, "en", "t", 300000), (7, "x" * 200000, "en", "t", 200000),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOC)


def with_clashes(df):
    """Extra columns named as operators might name their own."""
    from pyspark.sql import functions as F

    names = ["key", "node", "row", "slot", "shard", "_row", "_salt", "piece", "length", "spans", "kept", "hit_flags", "_posterior", "_logit", "block", "score", "base", "C0"]
    return df.withColumns({n: F.lit(n) for n in names})
