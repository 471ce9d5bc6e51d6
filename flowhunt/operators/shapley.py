"""Tree Shapley values of a forest (path-dependent form of Lundberg and Lee, 2018).

A leaf is a box: for each feature on its path an interval, and the share of samples that follow
the path when that feature is unknown. Whether a row lies inside each interval is a bit pattern of
at most eight bits, so the contributions of every leaf are tabulated once per pattern and a row
only looks them up. The explained output is minus the mean path length: positive values push
towards anomalous.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import ceil, factorial

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from flowhunt.operators.forest import FULL, Forest, _scaled, feature_matrix, tree_arrays
from flowhunt.schemas import FEATURES, FLOW_KEY

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROWS, _LEAVES = 256, 64  # rows and leaves handled at once
TASK_ROWS = 20_000


def leaf_boxes(arrays: dict[str, np.ndarray]) -> list[tuple[float, float, dict]]:
    """(value, reach, {feature: (low, high, share)}) per leaf, value already divided by the trees."""
    boxes = []
    trees = arrays["feature"].shape[0]
    for t in range(trees):
        pending = [(0, {})]
        while pending:
            node, path = pending.pop()
            feature = arrays["feature"][t, node]
            if feature < 0:
                reach = arrays["cover"][t, node] / arrays["cover"][t, 0]
                boxes.append((-arrays["path_length"][t, node] / trees, reach, path))
                continue
            cut = arrays["threshold"][t, node]
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            for side, bounds in (("left_node", (low, min(high, cut))), ("right_node", (max(low, cut), high))):
                child = arrays[side][t, node]
                part = share * arrays["cover"][t, child] / arrays["cover"][t, node]
                pending.append((child, {**path, feature: (*bounds, part)}))
    return boxes


def contribution_table(value: np.ndarray, share: np.ndarray) -> np.ndarray:
    """(leaf, pattern, feature) contributions for leaves with the same number of features.

    For feature j the coalitions of the others are summed by size: they are the coefficients of
    the polynomial with one factor (share + inside * t) per other feature.
    """
    d = share.shape[1]
    inside = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype("float64")
    weights = np.array([factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)])
    out = np.empty((len(value), 1 << d, d))
    for j in range(d):
        poly = np.zeros((len(value), 1 << d, d))
        poly[:, :, 0] = 1.0
        for k in range(d):
            if k == j:
                continue
            grown = poly * share[:, None, k, None]
            grown[:, :, 1:] += poly[:, :, :-1] * inside[None, :, k, None]
            poly = grown
        out[:, :, j] = (poly @ weights) * (inside[None, :, j] - share[:, None, j]) * value[:, None]
    return out


def explainer(forest: Forest, variant: str = FULL) -> tuple[float, list[tuple]]:
    """Base value and, per number of path features, (features, low, high, table, selector)."""
    nodes = forest.nodes.filter(F.col("variant") == variant).toPandas()
    boxes = leaf_boxes(tree_arrays(nodes))
    base = float(sum(value * reach for value, reach, _ in boxes))
    groups = []
    for d in sorted({len(path) for _, _, path in boxes} - {0}):
        members = [(value, path) for value, _, path in boxes if len(path) == d]
        value = np.array([v for v, _ in members])
        features = np.array([list(path) for _, path in members], "int64")
        bounds = np.array([list(path.values()) for _, path in members])
        selector = np.zeros((features.size, len(FEATURES)))
        selector[np.arange(features.size), features.ravel()] = 1.0
        table = contribution_table(value, bounds[:, :, 2])
        groups.append((features, bounds[:, :, 0], bounds[:, :, 1], table, selector))
    return base, groups


def contributions(x: np.ndarray, groups: list[tuple]) -> np.ndarray:
    """(row, feature) Shapley values of standardised rows.

    Values and interval ends become ranks among all ends of their feature, so whether a value lies inside is one
    comparison of whole numbers. Rows and leaves are taken in blocks that stay in the processor's cache.
    """
    every = range(len(FEATURES))
    ends = [np.unique(np.concatenate([e[g[0] == i] for g in groups for e in g[1:3]] or [np.empty(0)])) for i in every]
    ranks = np.stack([np.searchsorted(ends[i], x[:, i], side="right") - 1 for i in every]).astype("int32")
    out = np.zeros((len(x), len(FEATURES)))
    for features, low, high, table, selector in groups:
        leaves, d = features.shape
        lowest, width = np.zeros((leaves, d, 1), "int32"), np.zeros((leaves, d, 1), "uint32")
        for i in every:
            at = features == i
            begin, end = (np.searchsorted(ends[i], e[at]) for e in (low, high))
            lowest[at, 0], width[at, 0] = begin, np.maximum(end - begin, 0)
        flat, kind = table.reshape(leaves << d, d), np.dtype("uint8" if d <= 8 else "int64")
        for start in range(0, len(x), _ROWS):
            own = ranks[:, start : start + _ROWS]
            for a in range(0, leaves, _LEAVES):
                b = min(leaves, a + _LEAVES)
                pattern = np.zeros((b - a, own.shape[1]), kind)
                for j in range(d):
                    # Below the interval the difference is negative, as an unsigned number too large.
                    above = own.take(features[a:b, j], axis=0) - lowest[a:b, j]
                    pattern |= (above.view("uint32") < width[a:b, j]).astype(kind) << kind.type(j)
                found = flat.take((np.arange(a, b) << d) + pattern.T, axis=0)
                out[start : start + _ROWS] += found.reshape(own.shape[1], -1) @ selector[a * d : b * d]
    return out


def shapley_arrays(flows: DataFrame, forest: Forest, variant: str = FULL) -> DataFrame:
    """Add ``shap``: 14 contributions in model order, and ``shap_base``."""
    base, groups = explainer(forest, variant)
    shared = flows.sparkSession.sparkContext.broadcast(groups)

    @F.pandas_udf("array<double>")
    def explain(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(list(contributions(feature_matrix(columns), shared.value)))

    scaled = _scaled(flows, forest.scaling)
    return flows.withColumn("shap", explain(*[scaled[c] for c in FEATURES])).withColumn(
        "shap_base", F.lit(base)
    )


def shapley_values(flows: DataFrame, forest: Forest, variant: str = FULL) -> DataFrame:
    """Long rows (flow key, first_seen, feature, shap, actual_value) for every flow given.

    A row costs about a millisecond, so a file-sized partition would be a very long task: the
    columns needed are first dealt to tasks of about ``TASK_ROWS`` rows, and to every core.
    """
    key = [*FLOW_KEY, "first_seen"]
    tasks = max(ceil(flows.count() / TASK_ROWS), flows.sparkSession.sparkContext.defaultParallelism)
    spread = flows.select(*key, *FEATURES).repartition(tasks, *key)
    explained = shapley_arrays(spread, forest, variant)
    each = F.arrays_zip(
        F.array(*[F.lit(f) for f in FEATURES]).alias("feature"),
        F.col("shap"),
        F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("actual_value"),
    )
    return explained.select(*key, F.explode(each).alias("e")).select(
        *key, "e.feature", "e.shap", "e.actual_value"
    )


def sample_flows(flows: DataFrame, n: int = 500, seed: int = 42) -> DataFrame:
    """Uniform sample without replacement: the ``n`` smallest digests of the flow key and first time."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *FLOW_KEY, F.unix_micros("first_seen").cast("string")))
    return flows.orderBy(digest, *FLOW_KEY, "first_seen").limit(n)


def global_importance(
    flows: DataFrame, forest: Forest, sample: int | None = None, seed: int = 42
) -> DataFrame:
    """Mean absolute contribution per feature over all flows, or over a sample of them."""
    rows = flows if sample is None else sample_flows(flows, sample, seed)
    return shapley_values(rows, forest).groupBy("feature").agg(
        F.avg(F.abs("shap")).alias("importance")
    )


def rank_importance(importance: DataFrame, top: int | None = None) -> DataFrame:
    ranked = importance.orderBy(F.desc("importance"), "feature")
    return ranked if top is None else ranked.limit(top)
