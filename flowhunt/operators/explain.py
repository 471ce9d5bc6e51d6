"""Explaining alerts by the Shapley values of their flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowhunt.functions.wording import MISSING, impact, narrative
from flowhunt.operators.alerts import critical_alerts, top_critical
from flowhunt.operators.forest import Forest
from flowhunt.operators.ordering import first_match
from flowhunt.operators.shapley import shapley_arrays
from flowhunt.operators.skew import attach_by_key
from flowhunt.schemas import FEATURES, FLOW_KEY

ALERT_COLUMNS = ["alert_id", "severity", "threat_label", "final_threat_score"]


def alert_flow_match(alerts: DataFrame, flows: DataFrame, mode: str = "key") -> DataFrame:
    """Alerts with the features of their flow; an alert without one is dropped.

    ``mode="key"`` matches the full flow key and its first packet: a key may have several sessions. ``mode="first_pair"`` takes the first flow between
    the two addresses, reduced to one row per pair before the join.
    """
    wanted = alerts.select(*ALERT_COLUMNS, *FLOW_KEY, "first_seen", "alert_no")
    if mode == "key":
        key = [*FLOW_KEY, "first_seen"]
        return wanted.join(flows.select(*key, *FEATURES), key)
    pair = ["src_ip", "dst_ip"]
    order = ["first_seen", "src_port", "dst_port", "protocol"]
    first = first_match(flows.select(*pair, *order, *FEATURES), pair, order)
    matched = attach_by_key(wanted, first.select(*pair, *FEATURES), pair)
    return matched.filter(F.col("packet_count").isNotNull())


def top_features(shap: Column, k: int = 5) -> Column:
    """The ``k`` largest contributions by magnitude, signed, as an array of structs.

    The 14 values of an alert sit in one row, so ranking is an array sort: no shuffle.
    """
    ranked = F.array_sort(
        F.array(*[
            F.struct(
                (-F.abs(shap[i])).alias("rank"),
                F.lit(f).alias("feature"),
                shap[i].alias("shap_contribution"),
                F.col(f).cast("double").alias("actual_value"),
            )
            for i, f in enumerate(FEATURES)
        ])
    )
    return F.transform(
        F.slice(ranked, 1, k),
        lambda r: F.struct(
            r["feature"].alias("feature"),
            r["shap_contribution"].alias("shap_contribution"),
            r["actual_value"].alias("actual_value"),
            impact(r["shap_contribution"]).alias("impact"),
        ),
    )


def explain_alerts(
    alerts: DataFrame,
    flows: DataFrame,
    forest: Forest,
    k: int = 5,
    limit: int | None = None,
    mode: str = "key",
) -> DataFrame:
    """EXPLANATION rows for all critical alerts, or the first ``limit`` by number."""
    chosen = critical_alerts(alerts) if limit is None else top_critical(alerts, limit)
    explained = shapley_arrays(alert_flow_match(chosen, flows, mode), forest)
    return explained.select(
        "alert_id", "severity", "threat_label", "src_ip", "dst_ip",
        F.col("final_threat_score").alias("ml_score"),
        top_features(F.col("shap"), k).alias("top_features"),
    )


def narratives(explanations: DataFrame) -> DataFrame:
    return explanations.select("alert_id", narrative(F.col("top_features")).alias("narrative"))


def explanation_by_alert(wanted: DataFrame, explanations: DataFrame) -> DataFrame:
    """Narrative for each ``alert_id`` asked for, or a message if it has none."""
    told = narratives(explanations)
    missing = F.format_string(MISSING, F.col("alert_id"))
    return wanted.select("alert_id").join(told, "alert_id", "left").select(
        "alert_id", F.coalesce("narrative", missing).alias("narrative")
    )
