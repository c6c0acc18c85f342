import pytest

#: Nulls in every column, empty and long texts, copies, repeated rows, other alphabets.
EDGES = [
    (1, "Plain words in a line of some length.\nAnother line that is long enough.", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", "en", None, 4),
    (5, "Plain words in a line of some length.\nAnother line that is long enough.", "en", "b", 10),
    (6, "word " * 6000, "en", "b", 30000),
    (7, "Æsir über naïve 日本語 テキスト <|endoftext|> it's 42!\n\n  two  spaces ", "xx", "c", 60),
    (7, "Æsir über naïve 日本語 テキスト <|endoftext|> it's 42!\n\n  two  spaces ", "xx", "c", 60),
    (8, "Plain words in a line of some lengths.\nSomething else entirely stands here.", "en", "c", 10),
    (9, "one", "de", "a", 3),
    (10, "one two", "de", "a", 7),
    (11, "x" * 450, "de", "a", 450),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(spark, edges):
    """The same with columns called as the operators call theirs."""
    from pyspark.sql import functions as F

    names = ["id", "size", "h", "g", "x", "d", "i", "n", "row", "label", "near", "gone", "taken", "target", "_id", "_h", "fp", "words", "slot"]
    return edges.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
