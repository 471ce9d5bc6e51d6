"""Texts of explanations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowhunt.functions.columns import round_half_up

# Feature descriptions.
FEATURE_DESCRIPTIONS = {
    "packet_count": "number of packets in the flow",
    "duration": "flow duration in seconds",
    "total_bytes": "total bytes transferred",
    "avg_packet_size": "average packet size",
    "min_iat": "minimum inter-arrival time",
    "max_iat": "maximum inter-arrival time",
    "mean_iat": "average inter-arrival time",
    "std_iat": "inter-arrival time variability",
    "bytes_per_second": "data transfer rate",
    "packets_per_second": "packet transmission rate",
    "avg_bytes_per_packet": "average bytes per packet",
    "dns_query_length": "DNS query string length",
    "dns_subdomain_depth": "DNS subdomain nesting level",
    "dns_entropy": "DNS query randomness (entropy)",
}

# Feature, comparison, limit and pattern text, in order of precedence.
PATTERNS = [
    ("dns_entropy", ">", 3.5,
     "High DNS entropy indicates possible DNS tunneling or DGA (Domain Generation Algorithm) malware"),
    ("dns_subdomain_depth", ">=", 4.0,
     "Deep subdomain structure is characteristic of DNS tunneling attacks"),
    ("packet_count", ">", 100.0,
     "Unusually high packet count suggests potential scanning or flooding activity"),
    ("duration", ">", 60.0,
     "Long-lived connection may indicate persistent backdoor or data exfiltration"),
    ("bytes_per_second", ">", 10000.0,
     "High data transfer rate could indicate bulk data exfiltration"),
    ("std_iat", "<", 0.01,
     "Regular timing patterns (low IAT variability) suggest beaconing malware"),
    ("std_iat", ">", 1.0,
     "Bursty traffic pattern (high IAT variability) may indicate automated scanning"),
]

# Layout of a narrative.
HEADER = "🚨 Alert: %s (%s)\n   Threat: %s\n   Source: %s → %s\n   ML Threat Score: %.3f\n"
SECTION = "📊 Why This Flow Was Flagged (Top Contributing Factors):\n"
RAISED = "   %d. HIGH %s: %.2f\n      → This feature INCREASED the anomaly score by %.4f"
LOWERED = "   %d. LOW %s: %.2f\n      → This feature decreased the anomaly score by %.4f"
CONTEXT = "\n      💡 %s"
MISSING = "No explanation found for %s"


def feature_text(feature: Column) -> Column:
    """Description of a feature, or its name if it has none."""
    texts = F.create_map(*[F.lit(x) for pair in FEATURE_DESCRIPTIONS.items() for x in pair])
    return F.coalesce(texts[feature], feature)


def feature_context(feature: Column, value: Column) -> Column:
    """Pattern text for a feature value; empty if none applies."""
    tests = {">": value.__gt__, ">=": value.__ge__, "<": value.__lt__}
    out = F.lit("")
    for name, sign, limit, text in reversed(PATTERNS):
        out = F.when((feature == name) & tests[sign](limit), F.lit(text)).otherwise(out)
    return out


def impact(shap: Column) -> Column:
    return F.when(shap > 0, "increased").otherwise("decreased")


def narrative(top_features: Column) -> Column:
    """Narrative of an EXPLANATION row."""

    def factor(f: Column, position: Column) -> Column:
        number = (position + 1).cast("int")
        name = F.upper(feature_text(f["feature"]))
        value = round_half_up(f["actual_value"], 2)  # rounded as everywhere, then printed
        size = round_half_up(F.abs(f["shap_contribution"]), 4)
        line = F.when(
            f["impact"] == "increased", F.format_string(RAISED, number, name, value, size)
        ).otherwise(F.format_string(LOWERED, number, name, value, size))
        context = feature_context(f["feature"], f["actual_value"])
        return F.concat(line, F.when(context != "", F.format_string(CONTEXT, context)).otherwise(""))

    header = F.format_string(
        HEADER, *[F.col(c) for c in ("alert_id", "severity", "threat_label", "src_ip", "dst_ip", "ml_score")]
    )
    lines = F.concat(F.array(header, F.lit(SECTION)), F.transform(top_features, factor))
    return F.array_join(lines, "\n")
