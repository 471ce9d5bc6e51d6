"""Labelled flows to numbered alerts, and alert listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowhunt.functions.bands import alert_severity, threat_type
from flowhunt.functions.columns import col_or_default, iso_utc, round_half_up
from flowhunt.operators.ordering import number_rows
from flowhunt.operators.rules import STANDARD_RULES, Rule, apply_rules
from flowhunt.operators.scoring import non_benign
from flowhunt.schemas import ALERT, FLOW_KEY

# Alerts are numbered by time; the flow key breaks ties.
ALERT_ORDER = ["last_seen", "first_seen", *FLOW_KEY]

# Indicator texts.
HIGH_PACKETS = "high packet count"
SHORT_FLOW = "short-lived high-volume flow"
LOW_VARIANCE = "low inter-arrival variance"
STATISTICAL = "statistical anomaly in flow behavior"


def feature_indicators(df: DataFrame, mode: str = "features") -> Column:
    """Texts for packet count, duration and mean gap; one general text if none applies.

    ``mode="as_coded"`` reads the column names ``flow_duration`` and ``avg_inter_arrival_time``,
    which flows do not have, and so takes their defaults 0 and 1.
    """
    names = ("flow_duration", "avg_inter_arrival_time") if mode == "as_coded" else ("duration", "mean_iat")
    checks = [
        (col_or_default(df, "packet_count", 0) > 1000, HIGH_PACKETS),
        (col_or_default(df, names[0], 0.0) < 1, SHORT_FLOW),
        (col_or_default(df, names[1], 1.0) < 0.01, LOW_VARIANCE),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(STATISTICAL)))


def merge_indicators(features: Column, rules: Column) -> Column:
    """Set union in first-seen order."""
    return F.array_distinct(F.concat(features, rules))


def build_reason(label: Column, indicators: Column) -> Column:
    return F.concat(label, F.lit(" detected due to: "), F.array_join(indicators, ", "))


def confidence(score: Column, rules: Column) -> Column:
    """Capped score plus a tenth per triggered rule, capped at 1."""
    lifted = F.least(score, F.lit(1.0)) + F.lit(0.1) * F.size(rules)
    return round_half_up(F.least(lifted, F.lit(1.0)), 2)


def boost_score(score: Column, boost: Column) -> Column:
    return F.least(score + boost, F.lit(1.0))


def summary(severity: Column) -> Column:
    return F.format_string(
        "%s alert: %s from %s:%d → %s:%d over %s",
        severity,
        *[F.col(c) for c in ("threat_label", "src_ip", "src_port", "dst_ip", "dst_port", "protocol")],
    )


def alert_id(number: Column) -> Column:
    """Four digits at least, more when needed."""
    return F.format_string("ALERT-%04d", number)


def alert_rows(
    labelled: DataFrame,
    rules: tuple[Rule, ...] = STANDARD_RULES,
    indicator_mode: str = "features",
) -> DataFrame:
    """Alert columns for every non-benign flow, not yet numbered (a pure projection)."""
    ruled = apply_rules(non_benign(labelled), rules)
    base = col_or_default(ruled, "final_threat_score", 0.0)
    boosted = ruled.withColumn("_score", boost_score(base, F.col("rule_boost"))).withColumn(
        "_severity", alert_severity(F.col("_score"))
    )
    indicators = merge_indicators(feature_indicators(ruled, indicator_mode), F.col("rule_indicators"))
    return boosted.select(
        *ALERT_ORDER,
        iso_utc(F.col("last_seen")).alias("timestamp"),
        "threat_label",
        threat_type(F.col("threat_label")).alias("threat_type"),
        F.col("_severity").alias("severity"),
        round_half_up(F.col("_score"), 3).alias("final_threat_score"),
        confidence(F.col("_score"), F.col("triggered_rules")).alias("confidence"),
        "triggered_rules",
        build_reason(F.col("threat_label"), indicators).alias("reason"),
        summary(F.col("_severity")).alias("summary"),
    )


def number_alerts(rows: DataFrame) -> DataFrame:
    """Dense alert numbers in time order; the result is a written table."""
    numbered = number_rows(rows, ALERT_ORDER, "alert_no", label="alerts")
    return numbered.withColumn("alert_id", alert_id(F.col("alert_no")))


def generate_alerts(
    labelled: DataFrame,
    rules: tuple[Rule, ...] = STANDARD_RULES,
    indicator_mode: str = "features",
) -> DataFrame:
    """Numbered alerts: ALERT columns plus ``alert_no``, ``first_seen`` and ``last_seen``."""
    return number_alerts(alert_rows(labelled, rules, indicator_mode))


def published(alerts: DataFrame) -> DataFrame:
    """Exactly the ALERT columns, for a sink."""
    return alerts.select(*ALERT.names)


def critical_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("severity") == "CRITICAL")


def top_critical(alerts: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` critical alerts by number."""
    return critical_alerts(alerts).orderBy("alert_no").limit(n)


def query_alerts(
    alerts: DataFrame,
    severity: str | None = None,
    src_ip: str | None = None,
    alert: str | None = None,
    page: int | None = None,
    page_size: int = 50,
    after: int | None = None,
) -> DataFrame:
    """Filtered listing. Without a filter a page is a range of the alert number. With one, ``after`` (the
    last number of the page before) reaches the next page at the same cost however deep it lies; a page
    number sorts the matching rows up to that page."""
    kept = alerts
    if alert is not None:
        kept = kept.filter(F.col("alert_id") == alert)
    if severity is not None:
        kept = kept.filter(F.col("severity") == severity)
    if src_ip is not None:
        kept = kept.filter(F.col("src_ip") == src_ip)
    if after is not None:
        return kept.filter(F.col("alert_no") > after).orderBy("alert_no").limit(page_size)
    if page is None:
        return kept
    first = (page - 1) * page_size
    if severity is None and src_ip is None and alert is None:
        return kept.filter(F.col("alert_no").between(first + 1, first + page_size))
    return kept.orderBy("alert_no").offset(first).limit(page_size)
