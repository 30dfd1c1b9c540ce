import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from llm_fixtures import prose  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, long and repeated texts, and columns whose names operators use themselves."""
    long_text = prose(1, 30_000)
    rows = [
        (1, prose(2, 120), "a", 0.5, 7, "k1"), (2, None, None, None, None, None), (3, "", "b", 0.1, 1, "k2"),
        (4, prose(2, 120), "a", 0.5, 7, "k1"), (4, prose(2, 120), "a", 0.5, 7, "k1"), (None, prose(3, 90), "c", 0.2, 2, None),
        (None, prose(3, 90), "c", 0.2, 2, None), (6, long_text, "d", 0.3, 3, "k3"), (7, " \n\t ", "d", 0.3, 3, "k3"),
        (8, "x", "e", 0.9, 4, "k4"), (9, "same " * 500, "e", 0.9, 4, "k4"), (10, "naïve \U0001f600 ünïcode " * 40, None, 1.0, 5, ""),
    ]
    kind = "doc_id long, text string, lang string, score double, n_words int, k string"
    wide = spark.createDataFrame(rows, kind)
    for name in ("t", "h", "s", "class_id", "key_of_text", "w_", "items", "found_secrets", "predicted", "own", "words_", "u_", "f_", "own_sha256_", "text_before_"):
        wide = wide.selectExpr("*", f"'{name}' AS `{name}`")
    return wide.repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
