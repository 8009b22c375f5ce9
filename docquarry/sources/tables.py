"""Collections: a key and a document on each row, the document typed or VARIANT."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.values import TypedValue, Value, VariantValue


@dataclass
class Documents:
    """``df`` has ``key`` and ``doc``; other columns (version, times) may follow.

    ``order``: top-level members whose order, one after another, is that of the keys, so that sorting needs no key text.
    """

    df: DataFrame
    exact: bool = True
    order: tuple[str, ...] = ()

    def key_order(self) -> list[Column]:
        return [F.col("doc")[name] for name in self.order] or [F.col("key")]

    @cached_property
    def root(self) -> Value:
        dtype = self.df.schema["doc"].dataType
        if dtype.typeName() == "variant":
            return VariantValue(F.col("doc"), (), self.exact)
        return TypedValue(F.col("doc"), dtype, self.exact)


def typed(df: DataFrame, key: Column, exact: bool = True, order: tuple[str, ...] = ()) -> Documents:
    """A table as a collection: its columns are the members, SQL NULL is a missing member.

    The struct is only named here; Spark reads the members that a query touches.
    """
    return Documents(df.select(key.alias("key"), F.struct(*df.columns).alias("doc")), exact, order)


def variant(df: DataFrame, key: Column, text: Column, exact: bool = True) -> Documents:
    """JSON text as a collection. Of a member that occurs twice the last counts, which needs
    ``spark.sql.variant.allowDuplicateKeys``; see ``prepare``."""
    return Documents(df.select(key.alias("key"), F.parse_json(text).alias("doc")), exact)


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def padded(*columns: str, width: int = 20) -> Column:
    """Numbers as key text in whose byte order they stay in order."""
    return F.concat_ws("-", *(F.lpad(F.col(c).cast("string"), width, "0") for c in columns))
