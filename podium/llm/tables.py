"""Small helpers on tables of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.plans import pin

#: what identifies a row of documents: its id (null counts as the least) and a hash of its text
ROW, SUM = "__row", "__sum"


def texts(documents: DataFrame) -> DataFrame:
    """doc_id and text only, of fixed types."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63)))


def text_sum(column: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def identified(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return documents.withColumn(ROW, row_id(doc_id)).withColumn(SUM, text_sum(text))


def positional(documents: DataFrame) -> tuple[DataFrame, str, str]:
    """The same rows under names that clash with nothing (c0, c1, ...), and the names of doc_id and text there."""
    names = documents.columns
    return documents.toDF(*[f"c{i}" for i in range(len(names))]), f"c{names.index('doc_id')}", f"c{names.index('text')}"


def bytes_of(documents: DataFrame) -> int:
    """Bytes of all texts, for sizing partitions only."""
    return documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def thinned(df: DataFrame, key: Column, n: int, rows: int) -> DataFrame:
    """Of about ``rows`` rows those of the smallest hashes, four times n or so, so that taking the n least
    sends little to the driver from any number of tasks."""
    if rows <= 4 * n:
        return df
    return df.where(key < -(1 << 63) + int(4 * n / rows * (1 << 64)))


__all__ = ["ROW", "SUM", "bytes_of", "identified", "pin", "positional", "row_id", "text_sum", "texts", "thinned"]
