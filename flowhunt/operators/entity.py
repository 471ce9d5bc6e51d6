"""Per-source behaviour columns that the labels and rules read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowhunt.functions.columns import MICROS, micros_to_seconds
from flowhunt.operators.skew import HOT_ROWS, attach_by_key

ENTITY_COLUMNS = [
    "dst_port_count", "connection_count", "avg_duration", "bytes_sent", "periodicity_score",
]
MIN_PERIODIC_PACKETS = 5


def regularity(min_packets: int = MIN_PERIODIC_PACKETS) -> Column:
    """1 - std/mean of a flow's gaps, floored at 0; null with too few packets."""
    variation = F.least(F.lit(1.0), F.col("std_iat") / F.col("mean_iat"))
    return F.when((F.col("packet_count") >= min_packets) & (F.col("mean_iat") > 0), 1 - variation)


def duration_micros() -> Column:
    return F.floor(F.col("duration") * MICROS + 0.5)


def entity_features(
    flows: DataFrame, min_packets: int = MIN_PERIODIC_PACKETS, approx_distinct: bool = False
) -> DataFrame:
    """One row per source: ports reached, flows, mean duration, bytes, best periodicity.

    Periodicity is 1 - std/mean of the gaps of a flow, floored at 0, over flows with enough
    packets. Durations are summed as whole microseconds so that the order of addition cannot
    matter. The distinct count shuffles (source, port) pairs, not flows.
    """
    distinct = F.approx_count_distinct if approx_distinct else F.count_distinct
    return flows.groupBy("src_ip").agg(
        distinct("dst_port").alias("dst_port_count"),
        F.count("*").alias("connection_count"),
        micros_to_seconds(F.sum(duration_micros()) / F.count("*")).alias("avg_duration"),
        F.sum("total_bytes").alias("bytes_sent"),
        F.coalesce(F.max(regularity(min_packets)), F.lit(0.0)).alias("periodicity_score"),
    )


def attach_entities(flows: DataFrame, entities: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Flows with their source's entity columns."""
    return attach_by_key(flows, entities, ["src_ip"], hot_rows, row_count="connection_count")
