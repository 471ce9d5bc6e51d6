"""A small forest given as text, so that another engine can repeat its scores and explanations.

It cuts raw feature values (its scaler changes nothing). Thresholds lie between possible values.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from flowhunt.operators.forest import FULL, Forest, average_path
from flowhunt.schemas import FEATURES, FOREST_NODE

# A tree is the number of samples in a leaf, or (feature, threshold, below, from there on).
FIXED_TREES = (
    ("packet_count", 20.5, ("avg_packet_size", 150000.005, 41, 5), ("duration", 2.5000005, 11, 7)),
    ("dns_entropy", 3.2505, ("total_bytes", 900000.5, 37, ("std_iat", 0.1000005, 6, 3)), 18),
    ("bytes_per_second", 400000.005, ("mean_iat", 0.2500005, 44, 9), ("packet_count", 33.5, 4, 7)),
)
SAMPLES = 64
OFFSET = -0.59


def cover(tree) -> int:
    return tree if isinstance(tree, int) else cover(tree[2]) + cover(tree[3])


def fixed_forest(spark: SparkSession) -> Forest:
    rows = []
    for number, tree in enumerate(FIXED_TREES):
        pending, size = [(tree, 0, 0)], 1
        while pending:
            node, at, depth = pending.pop()
            if isinstance(node, int):
                rows.append((FULL, number, at, -1, None, -1, -1, node, depth + float(average_path(node))))
                continue
            feature, cut, below, above = node
            rows.append((FULL, number, at, FEATURES.index(feature), cut, size, size + 1, cover(node), None))
            pending += [(below, size, depth + 1), (above, size + 1, depth + 1)]
            size += 2
    scaling = spark.createDataFrame([(f, 0.0, 1.0) for f in FEATURES], "feature STRING, mean DOUBLE, std DOUBLE")
    meta = spark.range(1).select(
        F.lit(len(FIXED_TREES)).alias("trees"), F.lit(SAMPLES).alias("sample_size"),
        F.create_map(F.lit(FULL), F.lit(OFFSET)).alias("offsets"),
    )
    return Forest(spark.createDataFrame(rows, FOREST_NODE), scaling, meta)
