"""Score bands, threat labels and verdicts as CASE expressions built from tables of limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowhunt.functions.columns import col_or_default

# Lower limit of each band, highest first.
SCORE_BANDS = [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM")]
SEVERITY3_BANDS = [(0.6, "HIGH"), (0.3, "MEDIUM")]
# Alert bands as [low, high).
ALERT_BANDS = [(0.0, 0.3, "LOW"), (0.3, 0.6, "MEDIUM"), (0.6, 0.8, "HIGH"), (0.8, 1.01, "CRITICAL")]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
# Incident counts of the campaign classes.
CAMPAIGN_CLASSES = [(5, "active_campaign"), (2, "repeated_activity")]
# Substring of the label -> threat type.
THREAT_TYPES = [
    ("scan", "port_scan"),
    ("beacon", "beaconing"),
    ("dos", "denial_of_service"),
    ("ddos", "denial_of_service"),
    ("malware", "malware_activity"),
]
# Metric limits of the evaluation verdicts.
RECALL_VERDICTS = [(0.85, "EXCELLENT"), (0.70, "GOOD")]
FPR_VERDICTS = [(0.05, "EXCELLENT"), (0.10, "GOOD")]


def _at_least(value: Column, limits: list[tuple], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for limit, name in reversed(limits):
        out = F.when(value >= limit, F.lit(name)).otherwise(out)
    return out


def score_band(score: Column) -> Column:
    return _at_least(score, SCORE_BANDS, "LOW")


def severity3(score: Column) -> Column:
    return _at_least(score, SEVERITY3_BANDS, "LOW")


def alert_severity(score: Column) -> Column:
    """Four bands; outside them, NULL and NaN included, the severity is UNKNOWN."""
    out = F.lit("UNKNOWN")
    for low, high, name in ALERT_BANDS:
        out = F.when((score >= low) & (score < high), F.lit(name)).otherwise(out)
    return out


def severity_ordinal(severity: Column) -> Column:
    """LOW 0 .. CRITICAL 3, anything else -1."""
    return (F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1).cast("int")


def severity_name(ordinal: Column) -> Column:
    names = F.array(*[F.lit(s) for s in ["UNKNOWN", *SEVERITIES]])
    return F.element_at(names, ordinal + 2)


def campaign_type(alert_count: Column, classes: list[tuple] = CAMPAIGN_CLASSES) -> Column:
    return _at_least(alert_count, classes, "single_event")


def threat_label(df: DataFrame) -> Column:
    """First matching threat in order of precedence; absent columns take their default."""
    read = lambda name, default: col_or_default(df, name, default)
    # Limits of the label rules, in order of precedence.
    threats = [
        ("PORT_SCAN", read("dst_port_count", 0) >= 20),
        ("BRUTE_FORCE", (read("connection_count", 0) >= 30) & (read("avg_duration", 10.0) < 1)),
        ("DATA_EXFIL", read("bytes_sent", 0) >= 5_000_000),
        ("C2_BEACON", read("periodicity_score", 0.0) >= 0.8),
        ("DNS_TUNNEL", read("dns_query_length", 0) >= 50),
        ("SUSPICIOUS_TRAFFIC", read("final_threat_score", 0.0) >= 0.6),
    ]
    out = F.lit("BENIGN")
    for name, condition in reversed(threats):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def threat_type(label: Column) -> Column:
    out = F.lit("anomalous_flow")
    for part, name in reversed(THREAT_TYPES):
        out = F.when(F.lower(label).contains(part), F.lit(name)).otherwise(out)
    return out


def recall_verdict(recall: Column) -> Column:
    out = F.lit("NEEDS_IMPROVEMENT")
    for limit, name in reversed(RECALL_VERDICTS):
        out = F.when(recall > limit, F.lit(name)).otherwise(out)
    return out


def fpr_verdict(fpr: Column) -> Column:
    out = F.lit("HIGH_FALSE_POSITIVES")
    for limit, name in reversed(FPR_VERDICTS):
        out = F.when(fpr < limit, F.lit(name)).otherwise(out)
    return out
