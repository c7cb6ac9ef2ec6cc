"""Awkward tables that every operator gets: nulls, empty and very long texts, repeats, clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def rows(*texts) -> list[tuple]:
    return [(i, t, "en", "web", None if t is None else len(t)) for i, t in enumerate(texts)]


def awkward(spark):
    """Nulls in every column, an empty text, only white space, one very long text, repeated rows and repeated ids."""
    a, long = prose(1, 80), prose(2, 30_000)
    data = [
        (1, a, "en", "web", len(a)), (1, a, "en", "web", len(a)), (2, None, None, None, None), (3, "", "en", "web", 0), (4, " \n\t ", "en", None, 4),
        (None, a, "en", "web", len(a)), (5, long, "en", "books", len(long)), (6, a, None, "books", len(a)), (7, "word", "en", "web", 4), (7, prose(3, 60), "en", "web", 1),
    ]
    return spark.createDataFrame(data, DOCS)


def clashing(df, *names):
    """Extra columns whose names an operator uses itself."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("x") for n in names})


def empty(spark):
    return spark.createDataFrame([], DOCS)
