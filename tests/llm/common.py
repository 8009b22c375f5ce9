"""Small tables with the cases that every operator must stand: nulls, empty and long texts, ties, repeats, odd columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
#: Columns with the names that operators use inside.
CLASHING = ("id", "data", "h", "fp", "key", "row", "spans", "removed", "found", "text_", "row_key")
LONG = ("lorem ipsum dolor sit amet consectetur " * 3000).strip()
ODD = [
    (1, "The quick brown fox jumps over the lazy dog. It then goes home to sleep for the night."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, "The quick brown fox jumps over the lazy dog. It then goes home to sleep for the night."),
    (6, "The quick brown fox jumps over the lazy dog. It then goes home to sleep for the night."),
    (None, "No id here but several words of text, enough to count. The quick brown fox jumps over the lazy dog."),
    (None, None),
    (7, "é漢😀 \x00 ÀÉ naïve\x7f"),
    (8, "x" * 5000),
]


def odd(spark: SparkSession) -> DataFrame:
    """The odd rows, with clashing columns of nulls beside them."""
    rows = [(d, t, *[None] * len(CLASHING)) for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in CLASHING))


def empty(spark: SparkSession) -> DataFrame:
    return odd(spark).limit(0)


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def texts(spark: SparkSession, sf: str = SF) -> list[tuple[int, bytes]]:
    return [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=str)
