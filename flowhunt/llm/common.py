"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Rows per Arrow batch: a batch of whole documents stays at a few MB.
BATCH_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the documents that a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def whole(text: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def fold(key: str, of: int) -> Column:
    """The contract's fold of a row: crc32 of its id written as text, modulo ``of``."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % of
