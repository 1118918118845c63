"""Frames with the awkward cases that every operator must take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that bear the names of helper columns.
CLASHES = ("digest", "file", "row", "__file", "__row", "__id", "__text", "n", "key", "fp", "slot", "bucket", "chunk", "__c0", "kept", "id", "origin", "spans")


def docs(spark, rows, clashes: bool = False):
    df = spark.createDataFrame(rows, DOCS)
    if clashes:
        from pyspark.sql import functions as F

        for c in CLASHES:
            df = df.withColumn(c, F.lit("x"))
    return df


def awkward() -> list[tuple]:
    long = " ".join(f"word{i % 977} tail{i % 13}" for i in range(20_000))
    return [
        (1, "Alpha beta GAMMA delta epsilon", "en", "a", 30),
        (2, "alpha BETA gamma delta epsilon", "en", "a", 30),
        (3, None, None, None, None),
        (4, "", "fr", "b", 0),
        (5, "", "fr", None, 0),
        (None, "no id here at all", "en", "a", 17),
        (None, "no id here at all", "en", "a", 17),
        (7, "twice the same row", "de", "b", 18),
        (7, "twice the same row", "de", "b", 18),
        (8, long, "en", "c", len(long)),
        (9, long, "en", "c", len(long)),
        (10, " \t\n ", "en", "c", 4),
        (11, "ÀÉ à é ÀÉ", "fr", "b", 9),
        (12, "àé à é àé", "fr", "b", 9),
        (-5, "Negative id and 😀 astral", "en", "a", 24),
    ]
