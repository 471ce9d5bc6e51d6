"""Isolation forest as Spark jobs (Liu, Ting and Zhou, 2008).

Fitting is column expressions only. Rows draw their trees by arithmetic on a digest of the flow key. All trees
grow level by level at once: windows over (tree, node) give the range of every feature, and a digest of
(seed, tree, node) picks feature and cut, so any engine with MD5 grows the same forest. Growing shuffles the
samples once (trees x ``sample_size`` rows, whatever the data). Scoring passes Arrow batches of feature
columns to Python. A fitted forest has at most trees x (2 x sample_size - 1) nodes, whatever the data, so it
may pass through the driver and be broadcast.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowhunt.functions.columns import round_half_up
from flowhunt.operators.quantiles import exact_quantiles
from flowhunt.operators.scaling import standardised, z_stats
from flowhunt.schemas import FEATURES, FLOW_KEY, FOREST_NODE
from flowhunt.session import materialize

# Ship the task functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Model parameters.
TREES = 200
CONTAMINATION = 0.05
SEED = 42
SAMPLE_SIZE = 256
ROLLED = 0.25  # share of the trees that a new generation replaces

FULL = "all"
RAW_DIGITS = 9  # path scores are kept to so many digits, so that equal mean paths are equal scores

_WALKED = 512  # rows that walk the trees at once
_DRAWS = (1 << 31) - 1  # draws are remainders of this prime


@dataclass(frozen=True)
class Forest:
    """``nodes``: FOREST_NODE rows; ``scaling``: feature, mean, std; ``meta``: one row."""

    nodes: DataFrame
    scaling: DataFrame
    meta: DataFrame


def average_path(n):
    """Mean depth of an unsuccessful search in a binary tree of ``n`` points."""
    n = np.maximum(np.asarray(n, dtype="float64"), 1.0)
    long = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _scaled(flows: DataFrame, scaling: DataFrame) -> dict[str, Column]:
    """Features standardised by a stored scaler (one row per feature)."""
    stats = {r["feature"]: r for r in scaling.collect()}
    return {c: standardised(c, stats[c]["mean"], stats[c]["std"]) for c in FEATURES}


def draw_factors(tree: int, seed: int = SEED) -> tuple[int, int, int]:
    """What a tree multiplies and adds to the two halves of a row's digest."""
    digest = hashlib.md5(f"{seed}:{tree}".encode()).hexdigest()
    return int(digest[:7], 16) + 1, int(digest[7:14], 16) + 1, int(digest[14:21], 16)


def _digits(digest: Column, start: int, count: int) -> Column:
    """Hex digits of a digest as a whole number."""
    return F.conv(F.substring(digest, start, count), 16, 10).cast("bigint")


def tree_samples(
    flows: DataFrame, rows: int, trees: int | list[int] = TREES, sample_size: int = SAMPLE_SIZE, seed: int = SEED
) -> DataFrame:
    """Up to ``sample_size`` rows per tree, drawn without replacement by a digest of the flow key.

    Needs one pass and no sort of the data: each row decides which trees it might serve, about
    1.5 x ``sample_size`` candidates per tree survive, and only those are shuffled and cut.
    """
    numbers = list(range(trees)) if isinstance(trees, int) else trees
    wanted = 1.5 * sample_size + 32
    key = F.md5(F.concat_ws("|", *FLOW_KEY, F.unix_micros("first_seen").cast("string")))
    halves = flows.withColumns({"_a": _digits(key, 1, 7), "_b": _digits(key, 8, 7)})

    def draw(factors: Column) -> Column:
        return (F.col("_a") * factors["m"] + F.col("_b") * factors["n"] + factors["c"]) % F.lit(_DRAWS)

    limit = int(_DRAWS * min(1.0, wanted / max(rows, 1)))
    every = F.array(*[
        F.struct(F.lit(t).alias("tree"), *[F.lit(v).cast("bigint").alias(k) for k, v in zip("mnc", draw_factors(t, seed))])
        for t in numbers
    ])
    offered = halves.withColumn("_t", F.explode(F.filter(every, lambda t: draw(t) < limit)))
    drawn = offered.withColumns({"tree": F.col("_t.tree"), "draw": draw(F.col("_t"))}).drop("_t")
    # One small shuffle with a fixed layout; growing the trees keeps it.
    tasks = min(len(numbers), 2 * flows.sparkSession.sparkContext.defaultParallelism)
    drawn = drawn.repartition(tasks, "tree")
    nth = F.row_number().over(Window.partitionBy("tree").orderBy("draw", "_a", "_b", *FLOW_KEY, "first_seen"))
    return drawn.withColumn("nth", nth).filter(F.col("nth") <= sample_size).drop("_a", "_b", "draw")


def _average_path(n: Column) -> Column:
    """:func:`average_path` of a column."""
    long = 2.0 * (F.log(n - 1.0) + float(np.euler_gamma)) - 2.0 * (n - 1.0) / n
    return F.when(n > 2, long).when(n == 2, 1.0).otherwise(0.0)


def grow_trees(sample: DataFrame, variants: dict[str, list[str]], sample_size: int, seed: int = SEED) -> DataFrame:
    """FOREST_NODE rows of all trees of all variants; ``sample`` holds ``tree`` and the features.

    A node with rows that differ is cut at low + u * (high - low) of one varying feature until the tree is
    ceil(log2(rows)) deep. Children of node k are 2k + 1 and 2k + 2. Each row carries the nodes on its path,
    so the whole forest is one job; windows by (variant, tree, node) keep the layout by tree.
    """
    allowed = F.create_map(*[
        x for v, names in variants.items() for x in (F.lit(v), F.array(*[F.lit(FEATURES.index(f)) for f in names]))
    ])
    number = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(FEATURES)]
    rows = sample.select("tree", F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"), *number)
    tree = Window.partitionBy("variant", "tree")
    node_type = "array<struct<node:int,feature:int,threshold:double,cover:int,path_length:double>>"
    # ceil(log2(n)) is the number of binary digits of n - 1.
    depth_limit = F.when(F.col("rows") > 1, F.length(F.bin(F.col("rows") - 1))).otherwise(0)
    rows = (
        rows.withColumn("rows", F.count("*").over(tree)).withColumn("limit", depth_limit)
        .withColumns({"node": F.lit(0), "open": F.lit(True), "path": F.array().cast(node_type)})
    )
    values = F.array(*[F.col(f"x{i}") for i in range(len(FEATURES))])
    for depth in range(max(sample_size - 1, 0).bit_length() + 1):
        here = Window.partitionBy("variant", "tree", "node")
        ends = {k: F.array(*[f(f"x{i}").over(here) for i in range(len(FEATURES))]) for k, f in (("low", F.min), ("high", F.max))}
        seen = rows.select("*", F.count("*").over(here).cast("int").alias("n"), *[v.alias(k) for k, v in ends.items()])
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("tree").cast("string"), F.col("node").cast("string")))
        varying = F.filter(allowed[F.col("variant")], lambda i: F.col("high")[i] > F.col("low")[i])
        seen = seen.withColumns({"digest": digest, "varying": varying})
        splits = F.col("open") & (F.lit(depth) < F.col("limit")) & (F.size("varying") > 0)
        picked = F.element_at("varying", (_digits(F.col("digest"), 1, 8) % F.size("varying") + 1).cast("int"))
        seen = seen.withColumn("pick", F.when(splits, picked))
        u = (_digits(F.col("digest"), 9, 13) + 0.5) / float(1 << 52)
        low, high = F.col("low")[F.col("pick")], F.col("high")[F.col("pick")]
        seen = seen.withColumn("cut", low + u * (high - low))
        seen = seen.withColumn("cut", F.when(F.col("cut") <= low, high).otherwise(F.col("cut")))
        leaf = F.when(F.col("pick").isNull(), F.lit(float(depth)) + _average_path(F.col("n")))
        entry = F.struct(
            "node", F.coalesce("pick", F.lit(-1)).alias("feature"), F.col("cut").alias("threshold"),
            F.col("n").alias("cover"), leaf.alias("path_length"),
        )
        child = 2 * F.col("node") + 1 + (values[F.col("pick")] >= F.col("cut")).cast("int")
        rows = seen.select(
            "variant", "tree", "limit", *[f"x{i}" for i in range(len(FEATURES))],
            F.when(F.col("open"), F.concat("path", F.array(entry).cast(node_type))).otherwise(F.col("path")).alias("path"),
            F.when(F.col("pick").isNotNull(), child).otherwise(F.col("node")).alias("node"), F.col("pick").isNotNull().alias("open"),
        )
    each = rows.select("variant", "tree", F.explode("path").alias("e")).select("variant", "tree", "e.*")
    nodes = each.groupBy("variant", "tree", "node").agg(*[F.first(c).alias(c) for c in ("feature", "threshold", "cover", "path_length")])
    inner = F.col("feature") >= 0
    return nodes.select(
        "variant", "tree", "node", "feature", "threshold", F.when(inner, 2 * F.col("node") + 1).otherwise(-1).alias("left_node"),
        F.when(inner, 2 * F.col("node") + 2).otherwise(-1).alias("right_node"), "cover", "path_length",
    )


def fit_forest(flows: DataFrame, **options) -> Forest:
    """Fit one forest, or one per variant: :func:`fit_and_score` without the scores."""
    return fit_and_score(flows, **options)[0]


def fit_and_score(
    flows: DataFrame,
    trees: int = TREES,
    sample_size: int = SAMPLE_SIZE,
    seed: int = SEED,
    contamination: float = CONTAMINATION,
    variants: dict[str, list[str]] | None = None,
) -> tuple[Forest, DataFrame]:
    """Fit one forest, or one per variant (a named subset of the features) from the same samples.

    ``flows`` is read three times (scaler, sample, offset): pass a stored table. The offset needs the
    scores of all flows, so they are stored with the flows' columns (``raw_<variant>``) and given back:
    whoever scores the flows that were fitted need not pass them through the trees again.
    """
    spark = flows.sparkSession
    variants = variants or {FULL: FEATURES}
    # One aggregate gives the scaler and the number of rows.
    stats = z_stats(flows, FEATURES, _rows=F.count(F.lit(1)))
    rows = stats["_rows"]
    scaling = spark.createDataFrame(
        [(f, stats[f"{f}_mean"], stats[f"{f}_std"]) for f in FEATURES], "feature STRING, mean DOUBLE, std DOUBLE"
    )
    nodes = materialize(_grown(flows, rows, scaling, trees, sample_size, seed, variants), "forest")
    facts = {"trees": trees, "sample_size": sample_size, "seed": seed, "contamination": contamination, "rows": rows, "born": [0] * trees}
    return _with_offsets(nodes, scaling, facts, list(variants), flows)


def _grown(flows: DataFrame, rows: int, scaling: DataFrame, trees: int | list[int], sample_size: int, seed: int, variants: dict) -> DataFrame:
    picked = tree_samples(flows.select(*FLOW_KEY, "first_seen", *FEATURES), rows, trees, sample_size, seed)
    scaled = picked.select("tree", *[c.alias(f) for f, c in _scaled(picked, scaling).items()])
    return grow_trees(scaled, variants, sample_size, seed)


def _with_offsets(nodes: DataFrame, scaling: DataFrame, facts: dict, variants: list[str], flows: DataFrame) -> tuple[Forest, DataFrame]:
    """The forest with the offsets that mark the stated share of ``flows``, and the scored flows."""
    spark = flows.sparkSession
    partial = Forest(nodes, scaling, spark.createDataFrame([(facts["trees"], facts["sample_size"])], "trees INT, sample_size INT"))
    names = [f"raw_{v}" for v in variants]
    scored = materialize(path_scores(flows, partial, variants), "forest-scores")
    cuts = exact_quantiles(scored, {n: [facts["contamination"]] for n in names})
    offsets = cuts.agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.substring("column", 5, 1000).alias("variant"), "value"))
        ).alias("offsets")
    )
    born = F.array(*[F.lit(g) for g in facts["born"]]).alias("born")
    meta = offsets.select(*[F.lit(v).alias(k) for k, v in facts.items() if k != "born"], born, "offsets")
    return Forest(nodes, scaling, materialize(meta, "forest-meta")), scored


def roll_forest(forest: Forest, flows: DataFrame, share: float = ROLLED) -> tuple[Forest, DataFrame]:
    """The next generation: the oldest ``share`` of the trees is replaced by trees grown on ``flows``.

    New trees have a seed of their own generation and keep the scaler, which isolation trees do not depend on;
    the offset follows the scores of ``flows``. Trees that stay are not touched. A forest of one variant.
    """
    meta = forest.meta.first().asDict()
    born = list(meta.get("born") or [0] * meta["trees"])
    generation = max(born) + 1
    oldest = sorted(range(meta["trees"]), key=lambda t: (born[t], t))[: max(1, round(share * meta["trees"]))]
    seed = meta["seed"] + generation
    grown = _grown(flows, flows.count(), forest.scaling, oldest, meta["sample_size"], seed, {FULL: FEATURES})
    kept = forest.nodes.filter((F.col("variant") == FULL) & ~F.col("tree").isin(oldest))
    nodes = materialize(kept.unionByName(grown), "forest")
    facts = {c: meta[c] for c in ("trees", "sample_size", "seed", "contamination", "rows")}
    facts["born"] = [generation if t in set(oldest) else g for t, g in enumerate(born)]
    return _with_offsets(nodes, forest.scaling, facts, [FULL], flows)


def tree_arrays(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    """Node table of one variant as padded (tree, node) arrays."""
    trees, width = int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1
    out = {
        "feature": np.full((trees, width), -1, "int32"),
        "threshold": np.zeros((trees, width)),
        "left_node": np.zeros((trees, width), "int32"),
        "right_node": np.zeros((trees, width), "int32"),
        "cover": np.zeros((trees, width)),
        "path_length": np.zeros((trees, width)),
    }
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    for name, array in out.items():
        array[at] = nodes[name].fillna(0).to_numpy()
    return out


def _numbered_through(arrays: dict[str, np.ndarray]) -> tuple[list[np.ndarray], int]:
    """(feature, cut, right child, path length) of the nodes of all trees in one numbering, and its levels.

    Level by level, siblings next to each other, the roots first. No value lies below the cut of a leaf, whose
    right child is itself.
    """
    trees, width = arrays["feature"].shape
    feature, cut, left, right, length = (
        arrays[c].ravel() for c in ("feature", "threshold", "left_node", "right_node", "path_length")
    )
    first, level, count, parts = np.arange(trees) * width, np.arange(trees) * width, trees, []
    while len(level):
        inner = feature[level] >= 0
        to = np.where(inner, count + 2 * np.cumsum(inner) - 1, np.arange(count - len(level), count))
        parts.append((np.where(inner, feature[level], 0), np.where(inner, cut[level], -np.inf), to, length[level]))
        first, parents = first[inner], level[inner]
        level = np.stack([first + left[parents], first + right[parents]], axis=1).ravel()
        first, count = np.repeat(first, 2), count + len(level)
    joined = [np.concatenate(column) for column in zip(*parts, strict=True)]
    return [joined[0].astype("int32"), joined[1], joined[2].astype("int32"), joined[3]], len(parts)


def mean_path(x: np.ndarray, arrays: dict[str, np.ndarray]) -> np.ndarray:
    """Mean path length of each row over all trees, all trees walked at once.

    A step is a few gathers without masks, on as many rows as stay in the processor's cache.
    """
    (feature, cut, right, length), levels = _numbered_through(arrays)
    roots = np.arange(arrays["feature"].shape[0], dtype="int32")
    out = np.empty(len(x))
    for start in range(0, len(x), _WALKED):
        chunk = x[start : start + _WALKED]
        values, rows = np.ascontiguousarray(chunk).ravel(), (np.arange(len(chunk), dtype="int32") * x.shape[1])[:, None]
        node = np.broadcast_to(roots, (len(chunk), len(roots)))
        for _ in range(levels - 1):
            # All places exist; this mode only skips a check.
            below = values.take(rows + feature.take(node, mode="clip"), mode="clip") < cut.take(node, mode="clip")
            node = right.take(node, mode="clip") - below
        out[start : start + len(chunk)] = length.take(node).mean(axis=1)
    return out


def feature_matrix(columns: tuple[pd.Series, ...]) -> np.ndarray:
    return np.nan_to_num(np.column_stack([c.to_numpy("float64") for c in columns]))


def broadcast_variants(forest: Forest, variants: list[str]):
    """Node arrays per variant, shipped once per executor."""
    frame = forest.nodes.filter(F.col("variant").isin(*variants)).toPandas()
    arrays = {v: tree_arrays(frame[frame["variant"] == v]) for v in variants}
    return forest.nodes.sparkSession.sparkContext.broadcast(arrays)


def path_scores(flows: DataFrame, forest: Forest, variants: list[str] | None = None) -> DataFrame:
    """Add ``raw_<variant>``: -2^(-mean path / average path), closer to 0 is more normal.

    Only the feature columns travel to Python; the other columns stay in the JVM.
    """
    variants = variants or [FULL]
    shared = broadcast_variants(forest, variants)
    sample = forest.meta.select("sample_size").first()["sample_size"]
    rows_seen = min(sample, int(max(a["cover"][:, 0].max() for a in shared.value.values())))
    norm = float(average_path(rows_seen)) or 1.0

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        models = shared.value
        for columns in batches:
            x = feature_matrix(columns)
            yield pd.Series(list(np.column_stack([-(2.0 ** (-mean_path(x, models[v]) / norm)) for v in variants])), dtype=object)

    # Else a filter on the score is pushed below it and the trees are walked twice, by two Python processes a task.
    once = score.asNondeterministic()
    scaled = _scaled(flows, forest.scaling)
    added = flows.withColumn("_raw", once(*[scaled[c] for c in FEATURES]))
    return added.select(
        *flows.columns, *[round_half_up(F.col("_raw")[i], RAW_DIGITS).alias(f"raw_{v}") for i, v in enumerate(variants)]
    )


def score_isolation_forest(flows: DataFrame, forest: Forest, variant: str = FULL) -> DataFrame:
    """Add ``iforest_score`` (higher is more normal, negative is anomalous) and ``iforest_label``."""
    return decide(path_scores(flows, forest, [variant]), forest, variant)


def decide(raw: DataFrame, forest: Forest, variant: str = FULL) -> DataFrame:
    """Score and label from a stored ``raw_<variant>``."""
    offset = forest.meta.first()["offsets"][variant]
    scored = raw.withColumn("iforest_score", F.col(f"raw_{variant}") - offset)
    return scored.withColumn("iforest_label", predict(F.col("iforest_score"))).drop(f"raw_{variant}")


def predict(decision: Column) -> Column:
    return F.when(decision < 0, -1).otherwise(1)
