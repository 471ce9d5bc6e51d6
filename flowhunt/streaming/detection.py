"""Scoring new flows against a stored fit, and keeping incidents up to date."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowhunt.functions.bands import severity_name, severity_ordinal
from flowhunt.functions.columns import flow_key_string, iso_utc, micros_to_seconds, parse_time
from flowhunt.operators.alerts import alert_rows
from flowhunt.operators.entity import MIN_PERIODIC_PACKETS, duration_micros, regularity
from flowhunt.operators.forest import Forest, score_isolation_forest
from flowhunt.operators.intelligence import INCIDENT_KEY, explode_rules, first_and_last
from flowhunt.operators.profile import baseline_flags
from flowhunt.operators.rules import STANDARD_RULES, Rule
from flowhunt.operators.scaling import minmax_ranges, z_stats, zscore_anomaly
from flowhunt.operators.scoring import SCORE_COLUMNS, fuse_scores, label_threats
from flowhunt.sources.store import HIDDEN, KeptTable, exists, names, publish

PORT_SKETCH = 12  # bits of the sketch: 4096 registers at most a source
PORT_ERROR = 3 * 1.04 / 2 ** (PORT_SKETCH / 2)


@dataclass(frozen=True)
class Detector:
    """Everything fitted on past flows that scoring a new flow needs."""

    thresholds: DataFrame
    ranges: dict
    z: dict | None = None
    forest: Forest | None = None

    def score(self, flows: DataFrame) -> DataFrame:
        enriched = baseline_flags(flows, self.thresholds)
        if self.forest is None:
            return zscore_anomaly(enriched, stats=self.z)
        scored = score_isolation_forest(enriched, self.forest)
        return scored.withColumn("ml_anomaly_score", F.col("iforest_score"))

    def label(self, flows: DataFrame) -> DataFrame:
        higher_is = "anomalous" if self.forest is None else "normal"
        return label_threats(fuse_scores(self.score(flows), higher_is=higher_is, ranges=self.ranges))


def fit_detector(flows: DataFrame, thresholds: DataFrame, forest: Forest | None = None) -> Detector:
    """Fit score ranges (and z-score moments) on a stored flow table."""
    draft = Detector(thresholds, {}, None if forest else z_stats(flows), forest)
    return Detector(thresholds, minmax_ranges(draft.score(flows), list(SCORE_COLUMNS)), draft.z, forest)


def stream_alerts(
    flows: DataFrame, detector: Detector, rules: tuple[Rule, ...] = STANDARD_RULES,
    entities: DataFrame | None = None,
) -> DataFrame:
    """Alerts for new flows: one projection per flow, no state.

    ``entities`` is a stored table of source columns (``operators.entity.entity_features``), read anew
    for every batch; a source it does not hold, like every source without it, takes the defaults.
    Dense numbers need a finite table, so a streamed alert is named by its flow and time.
    """
    if entities is not None:
        flows = flows.join(entities, "src_ip", "left")
    rows = alert_rows(detector.label(flows), rules)
    name = F.concat_ws("@", flow_key_string(), iso_utc(F.col("first_seen")))
    return rows.withColumn("alert_id", name)


def incident_deltas(alerts: DataFrame) -> DataFrame:
    """Mergeable incident parts of a batch of alerts."""
    thousandths = F.floor(F.col("final_threat_score") * 1000 + 0.5)
    ordinal = F.coalesce(severity_ordinal(F.col("severity")), F.lit(-1))
    return explode_rules(alerts).groupBy(*INCIDENT_KEY).agg(
        F.count("*").alias("alert_count"),
        F.max(ordinal).alias("ordinal"),
        F.sum(thousandths).alias("thousandths"),
        *first_and_last(),
    )


INCIDENT_DELTA = "entity STRING, rule STRING, alert_count BIGINT, ordinal INT, thousandths BIGINT, first_seen STRING, last_seen STRING"


def fold_incidents(deltas: DataFrame) -> DataFrame:
    """Incident parts of several batches as one per incident."""
    return deltas.groupBy(*INCIDENT_KEY).agg(
        F.sum("alert_count").alias("alert_count"),
        F.max("ordinal").alias("ordinal"),
        F.sum("thousandths").alias("thousandths"),
        F.min_by("first_seen", parse_time(F.col("first_seen"))).alias("first_seen"),
        F.max_by("last_seen", parse_time(F.col("last_seen"))).alias("last_seen"),
    )


def incident_table(spark: SparkSession, path: str, every: int = 16) -> KeptTable:
    """The incidents of a stream of alerts, kept below ``path``."""
    return KeptTable(spark, path, fold_incidents, INCIDENT_DELTA, every)


def append_incidents(path: str, every: int = 16) -> Callable[[DataFrame, int], None]:
    """Batch handler: the batch's incident parts go to the kept table."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        incident_table(batch.sparkSession, path, every).append(incident_deltas(batch), batch_id)

    return handle


def merge_incidents(deltas: DataFrame) -> DataFrame:
    """Current incidents from all parts."""
    merged = fold_incidents(deltas)
    mean = F.floor(F.col("thousandths") / F.col("alert_count") + 0.5) / 1000.0
    return merged.select(
        *INCIDENT_KEY, "alert_count", severity_name(F.col("ordinal")).alias("max_severity"),
        mean.alias("avg_score"), "first_seen", "last_seen",
    )


SOURCE_DELTA = "src_ip STRING, ports BINARY, connection_count BIGINT, duration_us BIGINT, bytes_sent BIGINT, periodicity_score DOUBLE"


def source_deltas(flows: DataFrame) -> DataFrame:
    """Mergeable source columns of a batch of flows; ports are a sketch."""
    return flows.groupBy("src_ip").agg(
        F.hll_sketch_agg("dst_port", F.lit(PORT_SKETCH)).alias("ports"), F.count("*").alias("connection_count"),
        F.sum(duration_micros()).alias("duration_us"), F.sum("total_bytes").alias("bytes_sent"),
        F.max(regularity(MIN_PERIODIC_PACKETS)).alias("periodicity_score"),
    )


def fold_sources(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("src_ip").agg(
        F.hll_union_agg("ports").alias("ports"), *[F.sum(c).alias(c) for c in ("connection_count", "duration_us", "bytes_sent")],
        F.max("periodicity_score").alias("periodicity_score"),
    )


def source_table(spark: SparkSession, path: str, every: int = 16) -> KeptTable:
    """The source columns of a stream of flows, kept below ``path``."""
    return KeptTable(spark, path, fold_sources, SOURCE_DELTA, every)


def source_features(kept: DataFrame) -> DataFrame:
    """The columns of ``operators.entity.entity_features`` from kept parts.

    The port count comes from a sketch: exact while a source has reached few hundred ports, within
    ``PORT_ERROR`` beyond (three standard errors).
    """
    return kept.select(
        "src_ip", F.hll_sketch_estimate("ports").alias("dst_port_count"), "connection_count",
        micros_to_seconds(F.col("duration_us") / F.col("connection_count")).alias("avg_duration"), "bytes_sent",
        F.coalesce("periodicity_score", F.lit(0.0)).alias("periodicity_score"),
    )


def alert_batches(
    path: str, detector: Detector, rules: tuple[Rule, ...] = STANDARD_RULES, every: int = 16
) -> Callable[[DataFrame, int], None]:
    """Batch handler: alerts of each batch of flows, judged with the source columns of all flows so far.

    The batch first enters the kept source columns, then its flows are judged with them; both are published
    under the batch's number, so a batch that is given again changes nothing. Alerts lie below ``path``/alerts.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        final, hidden = f"{path}/alerts/{batch_id:012d}", f"{path}/{HIDDEN}/alerts-{batch_id:012d}"
        if exists(spark, final):
            return
        sources = source_table(spark, f"{path}/sources", every)
        sources.append(source_deltas(batch), batch_id)
        # Only the sources of the batch are looked up.
        own = source_features(sources.read().join(batch.select("src_ip").distinct(), "src_ip", "left_semi"))
        stream_alerts(batch, detector, rules, own).write.mode("overwrite").parquet(hidden)
        publish(spark, hidden, final)

    return handle


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """All alerts that :func:`alert_batches` has published."""
    return spark.read.parquet(*[f"{path}/alerts/{n}" for n in names(spark, f"{path}/alerts")])
