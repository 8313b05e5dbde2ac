import pytest

LONG = "word soup stays whole. " * 6000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [
        (0, "The cat sat on the mat. It was 7 pm.\nAll rights reserved 2024", "en"), (1, None, "en"), (2, "", None), (3, " \t\n ", "fr"), (4, LONG, "en"), (5, "été à la plage, où il fait beau", "fr"),
        (6, "The cat sat on the mat. It was 7 pm.\nAll rights reserved 2024", "en"), (6, "The cat sat on the mat. It was 7 pm.\nAll rights reserved 2024", "en"), (7, "😀 漢字 <|endoftext|> it's", None), (8, "x", "en"),
    ]
    df = spark.createDataFrame([(*r, "s", 1, i, "c", 2.0) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, component int, ids string, score double")
    return df


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
