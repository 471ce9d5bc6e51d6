"""The detection pipeline: packets to flows, scores, labels and alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from flowhunt.operators.alerts import generate_alerts
from flowhunt.operators.entity import attach_entities, entity_features
from flowhunt.operators.evaluation import critical_sources, mark_by_entity
from flowhunt.operators.flows import SLICE_SECONDS, flow_features
from flowhunt.operators.forest import Forest, decide, fit_and_score, path_scores
from flowhunt.operators.intelligence import campaigns, incidents, timelines
from flowhunt.operators.profile import baseline_flags, baseline_thresholds
from flowhunt.operators.rules import STANDARD_RULES, Rule
from flowhunt.operators.scaling import zscore_anomaly
from flowhunt.operators.scoring import fuse_scores, label_threats
from flowhunt.session import materialize


def stored_flows(packets: DataFrame, slice_seconds: float = SLICE_SECONDS) -> DataFrame:
    """The flow table, written once: thresholds, scalers, entities and scores all read it."""
    return materialize(flow_features(packets, slice_seconds), "flows")


def enriched_flows(flows: DataFrame, exact: bool = True) -> DataFrame:
    """Flows with baseline flags and suspicion score from their own quantiles."""
    return baseline_flags(flows, baseline_thresholds(flows, exact=exact))


def scored_flows(
    flows: DataFrame, model: str | Forest = "zscore", orientation: str = "anomaly", exact: bool = True
) -> DataFrame:
    """Enriched flows with model score, fused score and band.

    ``model`` is ``"zscore"`` (the closed-form stand-in), ``"forest"`` (fit on these flows) or a
    fitted forest.
    """
    if model == "zscore":
        return fuse_scores(zscore_anomaly(enriched_flows(flows, exact)), higher_is="anomalous")
    # The score passes through Python, so it is stored before its range is taken.
    if model == "forest":
        forest, raw = fit_and_score(flows)
    else:
        forest, raw = model, materialize(path_scores(flows, model), "scored")
    scored = decide(raw, forest).withColumn("ml_anomaly_score", F.col("iforest_score"))
    thresholds = baseline_thresholds(flows, exact=exact)
    return fuse_scores(baseline_flags(scored, thresholds), orientation)


def labelled_flows(flows: DataFrame, **scoring) -> DataFrame:
    """Scored flows with entity columns and a threat label."""
    scored = scored_flows(flows, **scoring)
    return label_threats(attach_entities(scored, entity_features(flows)))


def detect(
    packets: DataFrame,
    slice_seconds: float = SLICE_SECONDS,
    rules: tuple[Rule, ...] = STANDARD_RULES,
    **scoring,
) -> DataFrame:
    """Packets to numbered alerts."""
    flows = stored_flows(packets, slice_seconds)
    return generate_alerts(labelled_flows(flows, **scoring), rules)


@dataclass(frozen=True)
class Intelligence:
    incidents: DataFrame
    campaigns: DataFrame
    timelines: DataFrame


def intelligence(alerts: DataFrame) -> Intelligence:
    """Alerts to incidents, campaigns and timelines."""
    rolled = incidents(alerts)
    classed = campaigns(rolled)
    return Intelligence(rolled, classed, timelines(classed, alerts))


def evaluated_against_alerts(labelled: DataFrame, alerts: DataFrame) -> DataFrame:
    """Flows marked malicious when their source raised a critical alert."""
    return mark_by_entity(labelled, critical_sources(alerts))
