"""Measuring detections against labels.

Published scores have six decimals between 0 and 1, so the distinct scores of any number of flows
are at most 1,000,001. Curves and areas work on counts per score, which map tasks pre-combine; the
one window over all scores never sees more rows than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowhunt.functions.bands import fpr_verdict, recall_verdict
from flowhunt.functions.columns import round_half_up
from flowhunt.operators.skew import HOT_ROWS, attach_by_key
from flowhunt.schemas import FLOW_KEY

# Decision threshold and the sweep around it.
THRESHOLD = 0.6
SWEEP = [0.4, 0.5, 0.6, 0.7, 0.8]
BINS = 50


def predict_at(flows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    predicted = (F.col("final_threat_score") > threshold).cast("int")
    return flows.withColumn("predicted_malicious", predicted)


def critical_sources(alerts: DataFrame) -> DataFrame:
    """Distinct source addresses of critical alerts."""
    return alerts.filter(F.col("severity") == "CRITICAL").select("src_ip").distinct()


def mark_by_entity(flows: DataFrame, sources: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``actual_malicious`` = 1 where the source is in ``sources`` (a distinct set)."""
    marked = attach_by_key(flows, sources.withColumn("_listed", F.lit(1)), ["src_ip"], hot_rows)
    actual = F.coalesce("_listed", F.lit(0))
    return marked.select(*flows.columns, actual.alias("actual_malicious"))


def flows_of_sources(flows: DataFrame, sources: DataFrame) -> DataFrame:
    """Semi-join: only the flows whose source is listed."""
    return mark_by_entity(flows, sources).filter(F.col("actual_malicious") == 1).drop("actual_malicious")


def _cells(weight: Column | None = None) -> list[Column]:
    actual = F.col("actual_malicious") == 1
    predicted = F.col("predicted_malicious") == 1
    cells = {
        "true_negatives": ~actual & ~predicted,
        "false_positives": ~actual & predicted,
        "false_negatives": actual & ~predicted,
        "true_positives": actual & predicted,
    }
    one = F.lit(1).cast("bigint") if weight is None else weight
    return [F.sum(F.when(c, one).otherwise(0)).cast("bigint").alias(n) for n, c in cells.items()]


def confusion_matrix(
    flows: DataFrame, by: list[str] | None = None, weight: Column | None = None
) -> DataFrame:
    """TN, FP, FN, TP from ``actual_malicious`` and ``predicted_malicious``."""
    cells = _cells(weight)
    grouped = flows.groupBy(*by).agg(*cells) if by else flows.agg(*cells)
    if by:
        return grouped
    counts = ["true_negatives", "false_positives", "false_negatives", "true_positives"]
    return grouped.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def rates(matrix: DataFrame, digits: int = 6) -> DataFrame:
    """Metrics from confusion counts; an undefined ratio is 0."""
    tn, fp, fn, tp = (
        F.col(c) for c in ("true_negatives", "false_positives", "false_negatives", "true_positives")
    )

    def share(part: Column, whole: Column) -> Column:
        return round_half_up(F.coalesce(part / F.when(whole > 0, whole), F.lit(0.0)), digits)

    return matrix.select(
        "*",
        share(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        share(fp, fp + tn).alias("fpr"),
        share(fn, fn + tp).alias("fnr"),
        share(tn, tn + fp).alias("specificity"),
    )


def detection_metrics(flows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One flat row: counts, rates, AUC, totals."""
    metrics = rates(confusion_matrix(predict_at(flows, threshold)))
    tn, fp, fn, tp = (
        F.col(c) for c in ("true_negatives", "false_positives", "false_negatives", "true_positives")
    )
    auc = auc_roc(flows).select("auc_roc").scalar()
    return metrics.select(
        "*",
        auc.alias("auc_roc"),
        F.lit(threshold).alias("threshold"),
        (tn + fp + fn + tp).alias("total_flows"),
        (tp + fn).alias("actual_malicious"),
        (tp + fp).alias("predicted_malicious"),
        recall_verdict(F.col("recall")).alias("recall_verdict"),
        fpr_verdict(F.col("fpr")).alias("fpr_verdict"),
    )


def evaluation_report(flows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same as nested report structs."""
    counts = ["true_negatives", "false_positives", "false_negatives", "true_positives"]
    scores = ["accuracy", "precision", "recall", "f1_score", "fpr", "fnr", "specificity", "auc_roc"]
    return detection_metrics(flows, threshold).select(
        F.struct(*counts).alias("confusion_matrix"),
        F.struct(*scores).alias("performance_metrics"),
        "threshold", "total_flows", "actual_malicious", "predicted_malicious",
    )


def metrics_by_attack_type(flows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each attack type against all benign flows.

    Counts per (type, prediction) come first; the benign counts then enter every type as a scalar.
    """
    predicted = predict_at(flows, threshold)
    counts = predicted.groupBy("truth_label").agg(
        F.sum("predicted_malicious").alias("hit"), F.count("*").alias("n")
    )
    benign = predicted.filter(F.col("truth_label") == "BENIGN").agg(
        F.struct(
            F.coalesce(F.sum("predicted_malicious"), F.lit(0)).alias("hit"), F.count("*").alias("n")
        ).alias("benign")
    ).scalar()
    attacks = counts.filter(F.col("truth_label") != "BENIGN")
    matrix = attacks.select(
        "truth_label",
        (benign["n"] - benign["hit"]).alias("true_negatives"),
        benign["hit"].alias("false_positives"),
        (F.col("n") - F.col("hit")).alias("false_negatives"),
        F.col("hit").alias("true_positives"),
    )
    return rates(matrix)


def score_counts(flows: DataFrame) -> DataFrame:
    """Positives and negatives per published score."""
    return flows.groupBy(round_half_up(F.col("final_threat_score"), 6).alias("score")).agg(
        F.sum("actual_malicious").cast("bigint").alias("positives"),
        F.sum(1 - F.col("actual_malicious")).cast("bigint").alias("negatives"),
    )


def auc_roc(flows: DataFrame) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counted half; NULL with one class."""
    counts = score_counts(flows).withColumn(
        "below",
        F.coalesce(
            F.sum("negatives").over(
                Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    )
    wins = F.sum(F.col("positives") * (F.col("below") + F.col("negatives") / 2.0))
    pairs = F.sum("positives").cast("double") * F.sum("negatives")
    return counts.agg(round_half_up(wins / F.when(pairs > 0, pairs), 6).alias("auc_roc"))


def _running(flows: DataFrame) -> DataFrame:
    counts = score_counts(flows)
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(
        F.col("score").alias("threshold"),
        F.sum("positives").over(down).alias("true_positives"),
        F.sum("negatives").over(down).alias("false_positives"),
        F.sum("positives").over(Window.partitionBy()).alias("p"),
        F.sum("negatives").over(Window.partitionBy()).alias("n"),
    )


def roc_curve(flows: DataFrame) -> DataFrame:
    """One point per score, predicting everything at or above it."""
    tp, fp = F.col("true_positives"), F.col("false_positives")
    return _running(flows).select(
        "threshold", "true_positives", "false_positives",
        round_half_up(tp / F.when(F.col("p") > 0, F.col("p")), 6).alias("tpr"),
        round_half_up(fp / F.when(F.col("n") > 0, F.col("n")), 6).alias("fpr"),
    )


def pr_curve(flows: DataFrame) -> DataFrame:
    tp, fp = F.col("true_positives"), F.col("false_positives")
    return _running(flows).select(
        "threshold",
        round_half_up(tp / (tp + fp), 6).alias("precision"),
        round_half_up(tp / F.when(F.col("p") > 0, F.col("p")), 6).alias("recall"),
    )


def threshold_sweep(flows: DataFrame, thresholds: list[float] = SWEEP) -> DataFrame:
    """Metrics at several thresholds, from the counts per score."""
    each = score_counts(flows).withColumn(
        "threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))
    )
    above = F.col("score") > F.col("threshold")

    def total(column: str, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    matrix = each.groupBy("threshold").agg(
        total("negatives", ~above).alias("true_negatives"),
        total("negatives", above).alias("false_positives"),
        total("positives", ~above).alias("false_negatives"),
        total("positives", above).alias("true_positives"),
    )
    return rates(matrix)


def score_histogram(flows: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal-width bins per class over that class's own range; the last bin is closed.

    A class with a single value uses a range of one around it, so its rows fall in the middle bin.
    """
    counts = score_counts(flows)
    sides = counts.select(
        "score", F.explode(F.array(
            F.struct(F.lit(0).alias("actual_malicious"), F.col("negatives").alias("rows")),
            F.struct(F.lit(1).alias("actual_malicious"), F.col("positives").alias("rows")),
        )).alias("side")
    ).select("score", "side.*").filter(F.col("rows") > 0)
    whole = Window.partitionBy("actual_malicious")  # distinct scores of one class
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    same = F.col("low") == F.col("high")
    start = F.when(same, F.col("low") - 0.5).otherwise(F.col("low"))
    width = F.when(same, F.lit(1.0)).otherwise(F.col("high") - F.col("low"))
    spot = F.floor((F.col("score") - F.col("start")) * bins / F.col("width"))
    ranged = (
        sides.withColumn("low", low).withColumn("high", high)
        .withColumn("start", start).withColumn("width", width)
    )
    return ranged.groupBy("actual_malicious", F.least(spot, F.lit(bins - 1)).alias("bin")).agg(
        F.sum("rows").alias("flows")
    )


def detection_latency(flows: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per attacking source: seconds from its first malicious flow to its first alert.

    ``flows`` carries ``actual_malicious``. Both sides are reduced to one row per source first.
    """
    started = flows.filter(F.col("actual_malicious") == 1).groupBy("src_ip").agg(
        F.min(F.unix_micros("first_seen")).alias("start_us")
    )
    raised = alerts.groupBy("src_ip").agg(F.min(F.unix_micros("last_seen")).alias("alert_us"))
    delay = (F.col("alert_us") - F.col("start_us")) / 1_000_000.0
    return started.join(raised, "src_ip", "left").select(
        "src_ip", "start_us", "alert_us", delay.alias("latency_seconds")
    )


def hash_fold(folds: int) -> Column:
    """Fold of a flow from a digest of its key: stable whatever the partitioning."""
    text = F.concat_ws("|", *FLOW_KEY)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % folds


def cross_validate(flows: DataFrame, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """Metrics per hash fold."""
    split = predict_at(flows, threshold).withColumn("fold", hash_fold(folds))
    return rates(confusion_matrix(split, by=["fold"]))


def bootstrap_ci(
    flows: DataFrame, replicates: int = 200, threshold: float = THRESHOLD, level: float = 0.95, seed: int = 42,
    buckets: int = 4096,
) -> DataFrame:
    """Percentile intervals of the metrics by Poisson bootstrap over hash buckets of flows.

    Flows are first reduced to counts per (bucket, actual, predicted), at most 4 x ``buckets`` rows at
    any size; each bucket then weighs Poisson(1) in each replicate, drawn from a digest.
    """
    cells = (
        predict_at(flows, threshold)
        .groupBy(hash_fold(buckets).alias("bucket"), "actual_malicious", "predicted_malicious")
        .agg(F.count("*").alias("n"))
    )
    draws = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    text = F.concat_ws("|", "bucket", "replicate", F.lit(str(seed)))
    uniform = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    weight = F.lit(0)
    cumulative, term = 0.0, 0.36787944117144233  # exp(-1)
    for k in range(1, 13):
        cumulative += term
        term /= k
        weight = weight + (F.col("u") >= cumulative).cast("int")
    matrix = confusion_matrix(
        draws.withColumn("u", uniform), by=["replicate"], weight=(weight * F.col("n")).cast("bigint")
    )
    names = ["accuracy", "precision", "recall", "f1_score", "fpr"]
    long = rates(matrix).select(
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names
        ])).alias("m")
    ).select("m.*")
    tail = (1 - level) / 2
    return long.groupBy("metric").agg(
        round_half_up(F.avg("value"), 6).alias("mean"),
        round_half_up(F.percentile("value", F.lit(tail)), 6).alias("low"),
        round_half_up(F.percentile("value", F.lit(1 - tail)), 6).alias("high"),
        F.count("*").alias("replicates"),
    )
