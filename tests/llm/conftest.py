from __future__ import annotations

import pytest

ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, a string, key string, _spans string, _gone string, prob string, `Bucket` string, kept_id string, _d string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def odd_rows() -> list[tuple]:
    more = ("a", "k", "s", "g", "p", "b", "i", "d")
    base = [
        (1, "the house of the people was on the hill and it was old", "en", "s1"), (1, "the house of the people was on the hill and it was old", "en", "s1"),
        (None, "no key here but some text", "en", "s1"), (2, None, "en", "s1"), (3, "", None, None), (4, " \n\t ", "de", "s2"), (5, "12345 67 !!", "fr", None),
        (6, LONG, "en", "s2"), (7, LONG, "en", "s2"), (8, "the house of the people was on the hill and it was old", None, "s3"), (None, None, None, None),
        (9, "über straße ▁ \U0001f600 日本語", "de", "s3"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), *more) for r in base]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeats and further columns with names that the operators use too."""
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)
