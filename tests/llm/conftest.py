import pytest

pytest.importorskip("quillmesh.llm")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names clash with results."""
    rows = [
        (1, "The cat sat on the mat, and the dog sat on the log.", "en", "a", 1),
        (1, "The cat sat on the mat, and the dog sat on the log.", "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (None, "Null id row", "en", "b", 11),
        (4, "!!! 123 ***", None, "b", 11),
        (5, "word " * 40_000, "fr", "a", 200_000),
        (6, "x" * 30_000, "fr", "a", 30_000),
        (7, "  \n\t ​　 mixed  spaces <|endoftext|> \x1c end  ", "en", "c", 5),
        (8, "naïve 字 😀 été", "fr", "c", 5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS score", "'x' AS held_out", "2 AS n_tokens", "3 AS component_id", "4 AS fp", "5 AS row")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
