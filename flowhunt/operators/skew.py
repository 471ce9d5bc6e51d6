"""Attaching per-key values to rows when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOT_ROWS = 1_000_000
HOT_KEYS = 100_000
_SPREAD = 1024


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows: at most rows / hot_rows of them."""
    return df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot_rows).select(*keys)


def attach_by_key(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    hot_rows: int = HOT_ROWS,
    row_count: str | None = None,
) -> DataFrame:
    """Left join to a table with one row per key, safe under hot keys.

    Keys with more than ``hot_rows`` rows on the left go to every task. They are counted first: with
    more than ``HOT_KEYS`` of them no key can hold much of the table, and one shuffle join, whose
    skewed partitions are split at run time, does for all keys. The rows of hot keys are spread
    evenly through the shuffle for the remaining keys, where they match nothing.
    ``row_count`` names a column of ``right`` that already counts the left rows of the key;
    without it the hot keys are counted from ``left``.
    """
    values = [c for c in right.columns if c not in keys]
    if row_count:
        few = right.filter(F.col(row_count) > hot_rows).limit(HOT_KEYS + 1).count() <= HOT_KEYS
    else:
        few = hot_keys(left, keys, hot_rows).limit(HOT_KEYS + 1).count() <= HOT_KEYS
    if not few:
        return left.join(right, keys, "left").select(*left.columns, *values)
    if row_count:
        hot = right.filter(F.col(row_count) > hot_rows)
        cold = right.filter(F.col(row_count) <= hot_rows)
    else:
        frequent = F.broadcast(hot_keys(left, keys, hot_rows))
        hot = right.join(frequent, keys, "left_semi")
        cold = right.join(frequent, keys, "left_anti")
    hot_side = hot.select(*keys, F.struct(*values).alias("_hot"))
    cold_side = cold.select(*keys, F.lit(0).alias("_spread"), F.struct(*values).alias("_cold"))

    spread = F.when(
        F.col("_hot").isNotNull(), 1 + F.pmod(F.hash(*left.columns), F.lit(_SPREAD))
    ).otherwise(0)
    joined = (
        left.join(F.broadcast(hot_side), keys, "left")
        .withColumn("_spread", spread)
        .join(cold_side, [*keys, "_spread"], "left")
    )

    def value(name: str) -> Column:
        return F.coalesce(F.col("_hot")[name], F.col("_cold")[name]).alias(name)

    return joined.select(*left.columns, *[value(v) for v in values])
