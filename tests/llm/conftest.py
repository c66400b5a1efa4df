import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

#: Nulls, empty texts, white space, ties, repeated rows, a null id, other scripts, a long text.
ODD_ROWS = [
    (1, None, "en", "s1", "x"), (2, "", None, None, "x"), (3, "   \n\t ", "en", "s1", None), (4, "one", "en", "s2", "x"), (5, "same text of a few words here", "en", "s2", "x"),
    (5, "same text of a few words here", "en", "s2", "x"), (6, "same text of a few words here", "de", None, "x"), (None, "no id at all", "fr", "s1", "x"),
    (8, "日本語 텍스트 ελληνικά 😀   ▁ <s> <|endoftext|> \x00", "en", "s3", "x"), (9, "word " * 30_000, "en", "s1", "x"), (10, "x" * 5000, "en", "s1", "x"),
]
#: Columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, score string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
