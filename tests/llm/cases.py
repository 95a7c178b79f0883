"""Awkward rows that every operator must take: nulls, empties, long texts, ties, repeats."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("kept", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, LONG, "en", "a", len(LONG)),
    (5, "same text here", "en", "a", 14),
    (5, "same text here", "en", "a", 14),
    (6, "same text here", None, "b", 14),
    (None, "no id at all, ünïcode 漢字 \x85 x", "xx", None, 30),
    (None, "no id at all, ünïcode 漢字 \x85 x", "xx", None, 30),
    (7, "double  spaces\n\n and <|endoftext|> tail ", "en", "c", 40),
    (8, " exotic spaces\x1cand\x0bcontrols\x00", "en", "c", 20),
    (8, "another text of id 8", "en", "c", 20),
]


def docs(spark, rows=ROWS, partitions=3):
    """Documents with extra columns that have the names of result columns."""
    full = [(*r, "mine", "mine", "mine", "mine") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
