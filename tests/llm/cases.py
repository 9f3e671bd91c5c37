"""Rows every operator must take: nulls, empty and very long texts, ties, repeats, clashing columns."""

from pyspark.sql import functions as F

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = " ".join(f"wörd{i % 977} the{i % 13}" for i in range(12_000))


def awkward(spark, more=()):
    """Documents with odd rows, and columns whose names operators may want for themselves."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
        (2, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
        (2, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, "   \n\t ", "de", "b", 6),
        (6, LONG, "en", "b", len(LONG)),
        (7, "😀 naïve 中文字   x", "zh", "c", 10),
        (None, "alpha", "en", "a", 5),
        (8, "one", None, "a", 3),
        *more,
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    return df.withColumns(
        {c: F.lit(7) for c in ("row", "keep_id", "kept", "hash", "blob", "found", "n", "score", "words", "part")}
    )


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
