"""Dataset profiles, baseline thresholds and the flags drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowhunt.functions.columns import round_half_up
from flowhunt.operators.quantiles import approx_quantiles, exact_quantiles

# Described columns, percentiles, threshold quantiles and the depth limit.
DESCRIBED = [
    "packet_count", "duration", "total_bytes", "bytes_per_second",
    "packets_per_second", "dns_query_length", "dns_subdomain_depth", "dns_entropy",
]
PERCENTILES = [0.50, 0.90, 0.95, 0.99]
QUARTILES = [0.25, 0.50, 0.75]
THRESHOLD_QUANTILES = {"packet_count": 0.99, "duration": 0.99, "dns_entropy": 0.95}
DEEP_DNS = 4


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, row count and NULL count, in one aggregate pass."""
    nulls = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.count("*").alias("rows"),
            F.count_if(F.col(f.name).isNull()).alias("nulls"),
        )
        for f in df.schema.fields
    ]
    return df.agg(F.array(*nulls).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def describe(
    df: DataFrame,
    columns: list[str] = DESCRIBED,
    percentiles: list[float] = PERCENTILES,
    exact: bool = True,
) -> DataFrame:
    """One row per column: count, mean, sample deviation, min, percentiles, max."""
    moments = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        )
        for c in columns
    ]
    base = df.agg(F.array(*moments).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    quantiles = exact_quantiles if exact else approx_quantiles
    wanted = quantiles(df, {c: percentiles for c in columns})
    names = {q: f"p{round(q * 100):02d}" for q in percentiles}
    wide = wanted.groupBy("column").agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in names.items()]
    )
    numbers = ["mean", "std", "min", *names.values(), "max"]
    return base.join(wide, "column", "left").select(
        "column", "count", *[round_half_up(F.col(c), 6).alias(c) for c in numbers]
    )


def baseline_thresholds(
    flows: DataFrame, quantiles: dict[str, float] = THRESHOLD_QUANTILES, exact: bool = True
) -> DataFrame:
    """One row with a threshold per column."""
    compute = exact_quantiles if exact else approx_quantiles
    values = compute(flows, {c: [q] for c, q in quantiles.items()})
    return values.agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in quantiles]
    )


def baseline_flags(flows: DataFrame, thresholds: DataFrame, deep_dns: int = DEEP_DNS) -> DataFrame:
    """Four flags and their sum, the suspicion score.

    ``thresholds`` is the one-row table above, or a stored one.
    """
    limit = thresholds.first()
    flags = {
        "flag_high_packet": F.col("packet_count") > limit["packet_count"],
        "flag_long_duration": F.col("duration") > limit["duration"],
        "flag_high_dns_entropy": F.col("dns_entropy") > limit["dns_entropy"],
        "flag_deep_dns": F.col("dns_subdomain_depth") >= deep_dns,
    }
    flagged = flows.withColumns(flags)
    score = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return flagged.withColumn("suspicion_score", score)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in a stated order (a peek at a table)."""
    return df.orderBy(*order).limit(n)
