import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def bpe_json():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="session")
def bpe_ranks():
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


#: Nulls in any column, empty and long texts, ties, repeated rows, extra columns with names that operators use.
EDGE_DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h bigint, part int"


@pytest.fixture
def edge_docs(spark):
    rows = [
        (1, "one two three four five six", "en", "s", 27, 1, 1),
        (2, "one two three four five six", None, None, None, None, None),
        (2, "one two three four five six", None, None, None, None, None),
        (3, None, "en", "s", None, 1, 1),
        (4, "", "en", "s", 0, 1, 1),
        (5, " \n\t ", "en", "s", 4, 1, 1),
        (None, "no id here at all", "en", "s", 17, 1, 1),
        (6, "word " * 30_000, "en", "s", 150_000, 1, 1),
        (7, "a" * 70_000 + " e\u0301 😀", "en", "s", 70_004, 1, 1),
        (8, "few", "en", "s", 3, 1, 1),
    ]
    return spark.createDataFrame(rows, EDGE_DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], EDGE_DOCS)
