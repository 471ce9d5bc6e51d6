"""Fusing rule and model scores, banding and labelling flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowhunt.functions.bands import score_band, severity3, threat_label
from flowhunt.functions.columns import round_half_up
from flowhunt.operators.scaling import minmax_scale
from flowhunt.schemas import FEATURES, FLOW_KEY

# Fusion weights.
RULE_WEIGHT = 0.6
ML_WEIGHT = 0.4

SCORE_COLUMNS = {
    "ml_anomaly_score": "ml_score_normalized",
    "suspicion_score": "rule_score_normalized",
}


def feature_vector(flows: DataFrame) -> DataFrame:
    """The 14 features in model order."""
    return flows.select(*FEATURES)


def attach_ml_score(flows: DataFrame, scores: DataFrame, column: str = "iforest_score") -> DataFrame:
    """Add a model score by flow key; both tables must cover the same flows.

    The key is unique on both sides, so the join cannot skew. A flow without a score, or a score
    without a flow, raises when the row is computed.
    """
    left = flows.withColumn("_flow", F.lit(True))
    right = scores.select(*FLOW_KEY, "first_seen", F.col(column).alias("ml_anomaly_score")).withColumn(
        "_score", F.lit(True)
    )
    joined = left.join(right, [*FLOW_KEY, "first_seen"], "full")
    mismatch = F.raise_error(F.lit("flow records and model records do not match"))
    whole = F.col("_flow").isNotNull() & F.col("_score").isNotNull()
    # A filter, not a column: it is checked whichever columns the caller goes on to read.
    checked = joined.filter(F.when(whole, True).otherwise(mismatch.cast("boolean")))
    return checked.select(*flows.columns, "ml_anomaly_score")


def fuse_scores(
    flows: DataFrame,
    orientation: str = "anomaly",
    rule_weight: float = RULE_WEIGHT,
    ml_weight: float = ML_WEIGHT,
    higher_is: str = "normal",
    ranges: dict | None = None,
) -> DataFrame:
    """Min-max scale ``ml_anomaly_score`` and ``suspicion_score``, blend and band them.

    A forest's decision value is higher for normal flows; ``orientation="anomaly"`` turns it
    around before blending and ``"as_coded"`` adds it unchanged. ``higher_is="anomalous"`` marks a
    score that already points the right way.
    """
    scaled = minmax_scale(flows, SCORE_COLUMNS, ranges=ranges)
    if orientation == "anomaly" and higher_is == "normal":
        scaled = scaled.withColumn(
            "ml_score_normalized", round_half_up(1 - F.col("ml_score_normalized"), 6)
        )
    blend = rule_weight * F.col("rule_score_normalized") + ml_weight * F.col("ml_score_normalized")
    return scaled.withColumn("final_threat_score", round_half_up(blend, 6)).withColumn(
        "threat_score_band", score_band(F.col("final_threat_score"))
    )


def add_severity(scored: DataFrame) -> DataFrame:
    return scored.withColumn("severity", severity3(F.col("final_threat_score")))


def label_threats(scored: DataFrame) -> DataFrame:
    return scored.withColumn("threat_label", threat_label(scored))


def non_benign(labelled: DataFrame) -> DataFrame:
    return labelled.filter(F.col("threat_label") != "BENIGN")


def ml_anomalies(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("iforest_label") == -1)


def rule_only_hits(scored: DataFrame, least: int = 3) -> DataFrame:
    """High suspicion, yet normal for the model."""
    return scored.filter((F.col("suspicion_score") >= least) & (F.col("iforest_label") == 1))


def ml_only_hits(scored: DataFrame, limit: int | None = 5) -> DataFrame:
    """Anomalous for the model, low suspicion: six columns, first rows by score."""
    hits = scored.filter((F.col("suspicion_score") <= 1) & (F.col("iforest_label") == -1))
    if limit is not None:
        hits = hits.orderBy("iforest_score", *FLOW_KEY).limit(limit)
    return hits.select(
        "packet_count", "duration", "total_bytes", "dns_entropy", "suspicion_score", "iforest_score"
    )


def training_flows(flows: DataFrame, alerts: DataFrame) -> DataFrame:
    """Flows without an alert, for training on benign traffic; sessions of one key count apart."""
    key = [*FLOW_KEY, "first_seen"]
    return flows.join(alerts.select(*key).distinct(), key, "left_anti")
