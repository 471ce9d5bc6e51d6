"""Alerts to incidents, campaigns and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowhunt.functions.bands import CAMPAIGN_CLASSES, campaign_type, severity_name, severity_ordinal
from flowhunt.functions.columns import parse_time
from flowhunt.operators.ordering import sequence_within

INCIDENT_KEY = ["entity", "rule"]
SLICE_ALERTS = 1_000_000
PAGE_SIZE = 1_000


def explode_rules(alerts: DataFrame) -> DataFrame:
    """One row per triggered rule; ``NO_RULE`` if none, ``unknown`` if the source is missing."""
    rules = F.when(F.size("triggered_rules") > 0, F.col("triggered_rules")).otherwise(
        F.array(F.lit("NO_RULE"))
    )
    return alerts.select(
        "*", F.coalesce("src_ip", F.lit("unknown")).alias("entity"), F.explode(rules).alias("rule")
    )


def first_and_last() -> list[Column]:
    """The earliest and latest ``timestamp`` text of a group, compared as times: the fraction is optional."""
    time = parse_time(F.col("timestamp"))
    return [
        F.min(F.struct(time.alias("time"), "timestamp"))["timestamp"].alias("first_seen"),
        F.max(F.struct(time.alias("time"), "timestamp"))["timestamp"].alias("last_seen"),
    ]


def incidents(alerts: DataFrame) -> DataFrame:
    """Per (source, rule): count, highest severity, mean score, first and last time.

    Scores have three decimals, so they are summed as whole thousandths: the mean is the same
    whatever the order of addition. All aggregates combine on the map side.
    """
    exploded = explode_rules(alerts)
    thousandths = F.floor(F.col("final_threat_score") * 1000 + 0.5)
    ordinal = F.coalesce(severity_ordinal(F.col("severity")), F.lit(-1))
    rolled = exploded.groupBy(*INCIDENT_KEY).agg(
        F.count("*").alias("alert_count"),
        F.max(ordinal).alias("ordinal"),
        F.avg(thousandths).alias("thousandths"),
        *first_and_last(),
    )
    return rolled.select(
        *INCIDENT_KEY,
        "alert_count",
        severity_name(F.col("ordinal")).alias("max_severity"),
        (F.floor(F.col("thousandths") + 0.5) / 1000.0).alias("avg_score"),
        "first_seen",
        "last_seen",
    )


def campaigns(incident_rows: DataFrame, classes: list[tuple] = CAMPAIGN_CLASSES) -> DataFrame:
    return incident_rows.withColumn("campaign_type", campaign_type(F.col("alert_count"), classes))


def severity_transitions(alerts: DataFrame, numbered: bool = True) -> DataFrame:
    """Every (source, rule, alert) with its position, the previous severity and the direction.

    Events are ordered by time, then number. Generated alerts are numbered in that order, so the
    number also slices the work: no window sees more than ``SLICE_ALERTS`` rows. Alerts read from
    files may be numbered otherwise; ``numbered=False`` slices them by the hour.
    """
    exploded = explode_rules(alerts).select(
        *INCIDENT_KEY, "alert_no", "alert_id", "timestamp", "severity", "final_threat_score",
        F.unix_micros(parse_time(F.col("timestamp"))).alias("time_us"),
    )
    by_number, by_hour = F.floor(F.col("alert_no") / SLICE_ALERTS), F.floor(F.col("time_us") / 3_600_000_000)
    ordered = sequence_within(
        exploded, INCIDENT_KEY, ["time_us", "alert_no"], by_number if numbered else by_hour,
        previous={"severity": "previous_severity"},
    )
    now = F.coalesce(severity_ordinal(F.col("severity")), F.lit(-1))
    before = severity_ordinal(F.col("previous_severity"))
    direction = F.when(now > before, "up").when(now < before, "down").when(now == before, "same")
    return ordered.withColumn("direction", F.coalesce(direction, F.lit("first")))


def timeline_event(moves: DataFrame) -> Column:
    """Event text (fixed wording); any change of severity reads "escalated", as in the published wording."""
    clock = F.date_format(parse_time(F.col("timestamp")), "HH:mm:ss")
    changed = F.col("previous_severity").isNotNull() & (
        F.col("previous_severity") != F.col("severity")
    )
    detected = F.concat(
        F.col("rule"), F.lit(" detected (score: "), F.col("final_threat_score").cast("string"), F.lit(")")
    )
    text = F.when(changed, F.concat(F.lit("Severity escalated to "), F.col("severity")))
    return F.concat(clock, F.lit(" — "), text.otherwise(detected))


def timeline_events(alerts: DataFrame, numbered: bool = True) -> DataFrame:
    """Long form: one row per (source, rule, seq) with the event text and direction."""
    moves = severity_transitions(alerts, numbered)
    return moves.select(
        *INCIDENT_KEY, "seq", "alert_id", "direction", timeline_event(moves).alias("event")
    )


def timelines(
    campaign_rows: DataFrame, alerts: DataFrame, page_size: int = PAGE_SIZE, numbered: bool = True
) -> DataFrame:
    """Per campaign and page, the ordered event texts; a campaign without alerts has an empty page.

    Arrays hold at most ``page_size`` events however long the campaign is, and pages together hold
    all of them. The campaign's type is joined to pages, not to alerts.
    """
    page = F.floor((F.col("seq") - 1) / page_size) + 1
    pages = (
        timeline_events(alerts, numbered)
        .groupBy(*INCIDENT_KEY, page.alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("rows"))
    )
    joined = campaign_rows.select(*INCIDENT_KEY, "campaign_type").join(pages, INCIDENT_KEY, "left")
    events = F.transform("rows", lambda r: r["event"])
    return joined.select(
        *INCIDENT_KEY,
        "campaign_type",
        F.coalesce("page", F.lit(1)).alias("page"),
        F.coalesce(events, F.array().cast("array<string>")).alias("timeline"),
    )


def noise_reduction(alerts: DataFrame, incident_rows: DataFrame) -> DataFrame:
    """1 - incidents / alerts."""
    n = incident_rows.agg(F.count("*").alias("n")).scalar()
    counted = alerts.agg(F.count("*").alias("alerts")).withColumn("incidents", n)
    share = F.floor((1 - F.col("incidents") / F.col("alerts")) * 1e6 + 0.5) / 1e6
    return counted.withColumn("noise_reduction", share)
