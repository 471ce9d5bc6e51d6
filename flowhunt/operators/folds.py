"""Cross-validation of the closed-form detector, all folds in the same passes.

Fold k is judged by a detector fitted on the other folds. Whatever the number of folds, the flows are read once
for the moments (per fold, merged for "all others"), once a bracket for the quantiles, once for the score ranges and
once to judge. Constants enter as one array per number, indexed by fold.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, functions as F

from flowhunt.functions.columns import round_half_up
from flowhunt.operators.evaluation import THRESHOLD, confusion_matrix, hash_fold, rates
from flowhunt.operators.profile import DEEP_DNS, THRESHOLD_QUANTILES
from flowhunt.operators.quantiles import exact_quantiles
from flowhunt.operators.scoring import ML_WEIGHT, RULE_WEIGHT
from flowhunt.schemas import FEATURES


def other_moments(flows: DataFrame, folds: int, columns: list[str] = FEATURES) -> dict[str, list[tuple[float, float]]]:
    """Mean and deviation of each column over all folds but k, merged from the moments of each fold."""
    parts = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))]
    found = {r["fold"]: r for r in flows.groupBy("fold").agg(*parts).collect()}
    out: dict[str, list[tuple[float, float]]] = {c: [] for c in columns}
    for c in columns:
        for k in range(folds):
            n, mean, m2 = 0, 0.0, 0.0
            for fold in sorted(found):
                r = found[fold]
                if fold == k or not r[f"{c}_n"]:
                    continue
                more, delta = r[f"{c}_n"], r[f"{c}_mean"] - mean
                m2 += r[f"{c}_var"] * more + delta * delta * n * more / (n + more)
                mean += delta * more / (n + more)
                n += more
            out[c].append((mean, sqrt(m2 / n) if n else 0.0))
    return out


def other_quantiles(flows: DataFrame, folds: int, wanted: dict[str, float] = THRESHOLD_QUANTILES) -> dict[str, list]:
    """A quantile of each column over all folds but k; all of them share their passes."""
    others = {f"{c}_{k}": F.when(F.col("fold") != k, F.col(c)) for c in wanted for k in range(folds)}
    values = exact_quantiles(flows.select(*[v.alias(n) for n, v in others.items()]), {n: [wanted[n.rsplit("_", 1)[0]]] for n in others})
    found = {r["column"]: r["value"] for r in values.collect()}
    return {c: [found.get(f"{c}_{k}") for k in range(folds)] for c in wanted}


def _at(values: list, k: Column) -> Column:
    return F.array(*[F.lit(v).cast("double") for v in values])[k]


def cross_validate_fitted(flows: DataFrame, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """Metrics per fold, each judged by a detector fitted on the other folds.

    ``flows`` is a stored table with ``actual_malicious``.
    """
    flows = flows.withColumn("fold", hash_fold(folds))
    moments, limits = other_moments(flows, folds), other_quantiles(flows, folds)
    k = F.col("k")
    total = F.lit(0.0)
    for c in FEATURES:
        mean, std = (_at([m[i] for m in moments[c]], k) for i in (0, 1))
        total = total + F.when(std == 0, F.lit(0.0)).otherwise(F.abs((F.col(c) - mean) / std))
    flags = [F.col(c) > _at(limits[c], k) for c in THRESHOLD_QUANTILES] + [F.col("dns_subdomain_depth") >= DEEP_DNS]
    scores = {
        "ml": round_half_up(total / len(FEATURES), 6),
        "rule": sum((F.coalesce(f, F.lit(False)).cast("double") for f in flags), F.lit(0.0)),
    }
    every = flows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter("k <> fold")
    ends = every.withColumns(scores).groupBy("k").agg(*[
        f(c).alias(f"{c}_{n}") for c in scores for n, f in (("low", F.min), ("high", F.max))
    ])
    found = {r["k"]: r for r in ends.collect()}

    def scaled(c: str) -> Column:
        low, high = (_at([found[i][f"{c}_{n}"] if i in found else None for i in range(folds)], k) for n in ("low", "high"))
        return F.when(low == high, F.lit(0.0)).otherwise(round_half_up((F.col(c) - low) / (high - low), 6))

    held = flows.withColumn("k", F.col("fold")).withColumns(scores)
    final = round_half_up(RULE_WEIGHT * scaled("rule") + ML_WEIGHT * scaled("ml"), 6)
    judged = held.withColumn("predicted_malicious", F.coalesce(final > threshold, F.lit(False)).cast("int"))
    return rates(confusion_matrix(judged, by=["fold"]))
