"""Report queries over alerts and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowhunt.functions.columns import iso_utc, parse_time


def severity_distribution(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count("*").alias("alerts"))


def top_sources(alerts: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` sources with the most alerts; the address breaks ties."""
    counts = alerts.groupBy("src_ip").agg(
        F.count("*").alias("alerts"), F.max("final_threat_score").alias("max_score")
    )
    return counts.orderBy(F.desc("alerts"), "src_ip").limit(k)


def alerts_over_time(alerts: DataFrame, bucket: str = "1 second") -> DataFrame:
    """Alerts per tumbling time bucket and severity."""
    start = F.window(parse_time(F.col("timestamp")), bucket)["start"]
    return alerts.groupBy(iso_utc(start).alias("bucket"), "severity").agg(
        F.count("*").alias("alerts")
    )


def system_stats(flows: DataFrame, alerts: DataFrame, campaigns: DataFrame) -> DataFrame:
    """One row of totals for a status page."""
    raised = alerts.agg(
        F.struct(
            F.count("*").alias("total"), F.count_if(F.col("severity") == "CRITICAL").alias("critical")
        ).alias("s")
    ).scalar()
    active = campaigns.agg(
        F.count_if(F.col("campaign_type") == "active_campaign").alias("n")
    ).scalar()
    totals = flows.agg(
        F.count("*").alias("total_flows"),
        F.sum("packet_count").alias("total_packets"),
        F.sum("total_bytes").alias("total_bytes"),
    )
    return totals.select(
        "*",
        raised["total"].alias("total_alerts"),
        raised["critical"].alias("critical_alerts"),
        active.alias("active_campaigns"),
    )


def topology_edges(flows: DataFrame) -> DataFrame:
    """Edge list of the address graph."""
    return flows.groupBy("src_ip", "dst_ip").agg(
        F.count("*").alias("flows"),
        F.sum("packet_count").alias("packets"),
        F.sum("total_bytes").alias("bytes"),
    )


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Alert counts by label and severity with subtotals (NULL = all)."""
    return alerts.rollup("threat_label", "severity").agg(F.count("*").alias("alerts"))
