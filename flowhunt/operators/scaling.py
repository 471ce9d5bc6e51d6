"""Min-max and standard scaling: fit dataset-wide constants, then apply them as literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowhunt.functions.columns import one_row, round_half_up
from flowhunt.schemas import FEATURES


def minmax_ranges(df: DataFrame, columns: list[str]) -> dict:
    """``<column>_low`` and ``<column>_high`` of each column, in one pass."""
    ends = {}
    for c in columns:
        ends[f"{c}_low"], ends[f"{c}_high"] = F.min(c).cast("double"), F.max(c).cast("double")
    return one_row(df, **ends)


def minmax_scale(
    df: DataFrame, columns: dict[str, str], digits: int | None = 6, ranges: dict | None = None
) -> DataFrame:
    """(x - min) / (max - min) for each {column: new name}; a constant column becomes 0.

    ``ranges`` holds stored ends; without it they are taken from ``df``.
    """
    ends = ranges or minmax_ranges(df, list(columns))
    scaled = {}
    for c, name in columns.items():
        low, high = ends[f"{c}_low"], ends[f"{c}_high"]
        if low is None or low == high:
            value = F.when(F.col(c).isNotNull(), 0.0)
        else:
            value = (F.col(c) - low) / (high - low)
        scaled[name] = round_half_up(value, digits) if digits is not None else value
    return df.withColumns(scaled)


def scaler(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Rows (feature, mean, std) with the population deviation."""
    stats = [
        F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))
        for c in columns
    ]
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def z_stats(df: DataFrame, columns: list[str] = FEATURES, **more: Column) -> dict:
    """``<column>_mean`` and ``<column>_std`` of each column, and ``more`` aggregates, in one pass."""
    values = dict(more)
    for c in columns:
        values[f"{c}_mean"] = F.avg(c)
        values[f"{c}_std"] = F.stddev_pop(c)
    return one_row(df, **values)


def z_scores(
    df: DataFrame, columns: list[str] = FEATURES, stats: dict | None = None
) -> dict[str, Column]:
    """Standardised columns; a constant column becomes 0."""
    stats = stats or z_stats(df, columns)
    return {c: standardised(c, stats[f"{c}_mean"], stats[f"{c}_std"]) for c in columns}


def standardised(column: str, mean: float, std: float) -> Column:
    if not std:
        return F.when(F.col(column).isNotNull(), 0.0)
    return (F.col(column) - mean) / std


def standard_scale(df: DataFrame, columns: list[str] = FEATURES, digits: int | None = None) -> DataFrame:
    scaled = z_scores(df, columns)
    if digits is not None:
        scaled = {c: round_half_up(v, digits) for c, v in scaled.items()}
    return df.withColumns(scaled)


def zscore_anomaly(
    df: DataFrame, columns: list[str] = FEATURES, stats: dict | None = None
) -> DataFrame:
    """``ml_anomaly_score`` as the mean absolute z-score: a closed-form stand-in for a model.

    Higher is more anomalous.
    """
    parts = z_scores(df, columns, stats)
    total = F.lit(0.0)
    for c in columns:
        total = total + F.abs(parts[c])
    return df.withColumn("ml_anomaly_score", round_half_up(total / len(columns), 6))
