"""Baselines kept up period by period from mergeable quantile sketches.

A period's flows are read once, into one sketch per column. Thresholds of any span of periods come from merging
their sketches: a few thousand numbers a period, whatever its traffic. Where thresholds must be exact, use
``operators.profile.baseline_thresholds``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowhunt.operators.profile import THRESHOLD_QUANTILES
from flowhunt.sources.store import KeptTable

SKETCH = 4096  # items a level of a sketch holds at most
RANK_ERROR = 0.002  # of a threshold among the flows it was taken from, at that size


def _schema(columns: list[str]) -> str:
    return "period STRING, flows BIGINT, " + ", ".join(f"{c} BINARY" for c in columns)


def period_sketches(flows: DataFrame, period: Column, columns: list[str] | None = None, size: int = SKETCH) -> DataFrame:
    """One row per period: its name, the number of flows, and a sketch per column."""
    columns = columns or list(THRESHOLD_QUANTILES)
    sketches = [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(size)).alias(c) for c in columns]
    return flows.groupBy(period.cast("string").alias("period")).agg(F.count("*").alias("flows"), *sketches)


def fold_sketches(columns: list[str], size: int = SKETCH) -> Callable[[DataFrame], DataFrame]:
    """Sketches of several batches as one row per period."""

    def fold(rows: DataFrame) -> DataFrame:
        merged = [F.kll_merge_agg_double(c, F.lit(size)).alias(c) for c in columns]
        return rows.groupBy("period").agg(F.sum("flows").alias("flows"), *merged)

    return fold


def baseline_table(
    spark: SparkSession, path: str, columns: list[str] | None = None, size: int = SKETCH, every: int = 16
) -> KeptTable:
    """The sketches of all periods, kept below ``path``."""
    columns = columns or list(THRESHOLD_QUANTILES)
    return KeptTable(spark, path, fold_sketches(columns, size), _schema(columns), every)


def sketched_thresholds(
    kept: DataFrame, quantiles: dict[str, float] = THRESHOLD_QUANTILES, first: str | None = None, last: str | None = None,
    size: int = SKETCH,
) -> DataFrame:
    """One row with a threshold per column over the periods ``first`` to ``last``, for ``profile.baseline_flags``."""
    if first is not None:
        kept = kept.filter(F.col("period") >= first)
    if last is not None:
        kept = kept.filter(F.col("period") <= last)
    merged = kept.agg(*[F.kll_merge_agg_double(c, F.lit(size)).alias(c) for c in quantiles])
    return merged.select(*[F.kll_sketch_get_quantile_double(F.col(c), F.lit(float(q))).alias(c) for c, q in quantiles.items()])


def threshold_ranks(flows: DataFrame, thresholds: DataFrame, quantiles: dict[str, float] = THRESHOLD_QUANTILES) -> DataFrame:
    """Rows (column, q, value, low, high): the shares of ``flows`` below and up to each threshold."""
    value = thresholds.first().asDict()
    each = [
        F.struct(
            F.lit(c).alias("column"), F.lit(float(q)).alias("q"), F.lit(value[c]).cast("double").alias("value"),
            (F.count_if(F.col(c) < value[c]) / F.count(c)).alias("low"), (F.count_if(F.col(c) <= value[c]) / F.count(c)).alias("high"),
        )
        for c, q in quantiles.items()
    ]
    return flows.agg(F.array(*each).alias("e")).select(F.explode("e").alias("e")).select("e.*")
