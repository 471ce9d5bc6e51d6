"""Forest and Shapley values: invariants and brute force."""

import hashlib
import tracemalloc
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowhunt.operators import baselines as bl, explain, forest as fo, shapley as sh
from flowhunt.functions.wording import feature_context, feature_text
from flowhunt.operators.ablation import feature_ablation
from flowhunt.operators.scoring import training_flows
from flowhunt.schemas import FEATURES, FLOW_KEY
from flowhunt.sources import models

OUTLIERS = 5


@pytest.fixture(scope="module")
def flows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (400, len(FEATURES)))
    x[:OUTLIERS] += 12
    x[:, 3] = 1.0  # a constant feature
    rows = [(f"s{i}", "d", i, 80, "TCP", *map(float, r), int(i < OUTLIERS)) for i, r in enumerate(x)]
    ddl = "src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING, " + ", ".join(f"{f} DOUBLE" for f in FEATURES) + ", actual_malicious INT"
    df = spark.createDataFrame(rows, ddl).withColumn("first_seen", F.timestamp_micros(F.col("src_port")))
    return df.repartition(4).cache()


@pytest.fixture(scope="module")
def model(flows):
    return fo.fit_forest(flows, trees=40, sample_size=128)


def test_forest_ranks_outliers_first(flows, model):
    got = fo.score_isolation_forest(flows, model).orderBy("iforest_score").select("src_port", "iforest_label", "iforest_score").collect()
    assert {r.src_port for r in got[:OUTLIERS]} == set(range(OUTLIERS))
    assert sum(r.iforest_label == -1 for r in got) == 20  # five percent
    used = {r.feature for r in model.nodes.select("feature").distinct().collect()}
    assert 3 not in used and model.nodes.groupBy("tree").count().count() == 40


def test_a_filter_on_the_label_scores_once(flows, model):
    """Filtering a score and returning it must not walk the trees twice, in two Python processes a task."""
    hits = fo.score_isolation_forest(flows, model).filter("iforest_label = -1 AND src_port >= 0").select("src_port", "iforest_score")
    assert hits._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert hits.count() == 20


def test_forest_does_not_depend_on_partitioning(flows, model):
    again = fo.fit_forest(flows.repartition(9, "dst_port", "src_port"), trees=40, sample_size=128)
    assert again.meta.first().offsets == pytest.approx(model.meta.first().offsets)


def test_samples_are_full_and_distinct_at_every_size(spark, flows):
    picked = fo.tree_samples(flows, 400, trees=40, sample_size=50)
    sizes = [r["count"] for r in picked.groupBy("tree").count().collect()]
    assert len(sizes) == 40 and set(sizes) == {50}
    # One scheme: with many rows for few trees a row may still serve several of them.
    many = spark.range(40_000).select(
        *[F.lit("x").alias(c) for c in ("src_ip", "dst_ip", "protocol")], F.col("id").cast("int").alias("src_port"),
        F.lit(1).alias("dst_port"), F.lit(0).cast("timestamp").alias("first_seen"),
    )
    drawn = fo.tree_samples(many, 40_000, trees=60, sample_size=100)
    assert {r["count"] for r in drawn.groupBy("tree").count().collect()} == {100}
    assert drawn.select("tree", "src_port").distinct().count() == 6000 > drawn.select("src_port").distinct().count()


def plain_tree(x, allowed, tree, seed, rows):
    """The nodes of one tree, grown one after the other."""
    limit, nodes = (rows - 1).bit_length(), {}
    pending = [(np.arange(len(x)), 0, 0)]
    while pending:
        members, node, depth = pending.pop()
        low, high = x[members].min(axis=0), x[members].max(axis=0)
        varying = [i for i in allowed if high[i] > low[i]]
        if depth >= limit or not varying:
            nodes[node] = (-1, None, -1, -1, len(members), depth + float(fo.average_path(len(members))))
            continue
        digest = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
        pick = varying[int(digest[:8], 16) % len(varying)]
        cut = low[pick] + (int(digest[8:21], 16) + 0.5) / 2.0**52 * (high[pick] - low[pick])
        cut = high[pick] if cut <= low[pick] else cut
        nodes[node] = (pick, cut, 2 * node + 1, 2 * node + 2, len(members), None)
        right = x[members, pick] >= cut
        assert 0 < right.sum() < len(members)
        pending += [(members[~right], 2 * node + 1, depth + 1), (members[right], 2 * node + 2, depth + 1)]
    return nodes


def test_trees_grown_at_once_equal_trees_grown_alone(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 5, (150, 14)).astype(float)
    x[:, 2], x[:40] = 7.0, x[0]  # a constant feature, and rows that cannot be told apart
    tree = np.repeat([0, 1, 2, 3], [100, 40, 9, 1])
    sample = spark.createDataFrame([(int(t), *map(float, r)) for t, r in zip(tree, x)], "tree INT, " + ", ".join(f"{f} DOUBLE" for f in FEATURES))
    variants = {"all": FEATURES, "less": FEATURES[5:]}
    got = fo.grow_trees(sample, variants, 128, seed=3).collect()
    found = {(r.variant, r.tree, r.node): (r.feature, r.threshold, r.left_node, r.right_node, r.cover) for r in got}
    paths = {(r.variant, r.tree, r.node): r.path_length for r in got}
    want = {
        (v, t, node): row for v, names in variants.items() for t in range(4)
        for node, row in plain_tree(x[tree == t], [FEATURES.index(f) for f in names], t, 3, int((tree == t).sum())).items()
    }
    assert found == {k: row[:5] for k, row in want.items()}
    assert all(paths[k] == pytest.approx(row[5]) if row[5] is not None else paths[k] is None for k, row in want.items())


def test_model_store(spark, flows, model, tmp_path):
    models.save_model(model, str(tmp_path / "m"))
    loaded = models.load_model(spark, str(tmp_path / "m"))
    a = fo.score_isolation_forest(flows, model).agg(F.sum("iforest_score")).first()[0]
    b = fo.score_isolation_forest(flows, loaded).agg(F.sum("iforest_score")).first()[0]
    assert a == pytest.approx(b)
    with pytest.raises(Exception):
        models.save_model(model, str(tmp_path / "m"))


def test_shapley_adds_up_to_the_model_output(flows, model):
    arrays = fo.tree_arrays(model.nodes.toPandas())
    scaled = flows.select("src_port", *[c.alias(f) for f, c in fo._scaled(flows, model.scaling).items()]).toPandas().set_index("src_port")
    path = dict(zip(scaled.index, fo.mean_path(scaled[FEATURES].to_numpy(), arrays)))
    for r in sh.shapley_arrays(flows, model).select("src_port", "shap", "shap_base").collect():
        assert sum(r.shap) + r.shap_base == pytest.approx(-path[r.src_port])
        assert r.shap[3] == 0.0
        if r.src_port < OUTLIERS:
            assert sum(r.shap) > 0


def test_work_arrays_stay_small(flows, model):
    """However many rows a batch has: blocks of rows and leaves, and the same paths as one row at a time."""
    arrays, (base, groups) = fo.tree_arrays(model.nodes.toPandas()), sh.explainer(model)
    x = np.random.default_rng(2).normal(0, 2, (5000, len(FEATURES)))
    tracemalloc.start()
    path, paths_peak = fo.mean_path(x, arrays), tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    values, peak = sh.contributions(x, groups), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert paths_peak < 8 << 20 and peak < 8 << 20
    assert np.allclose(base + values.sum(axis=1), -path)
    for i in range(0, 5000, 250):
        walked = []
        for t in range(len(arrays["feature"])):
            node = 0
            while arrays["feature"][t, node] >= 0:
                side = "left_node" if x[i, arrays["feature"][t, node]] < arrays["threshold"][t, node] else "right_node"
                node = arrays[side][t, node]
            walked.append(arrays["path_length"][t, node])
        assert path[i] == np.mean(walked)


def test_shapley_matches_enumeration(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (64, 14))
    sample = spark.createDataFrame([(0, *map(float, r)) for r in x], "tree INT, " + ", ".join(f"{f} DOUBLE" for f in FEATURES))
    arrays = fo.tree_arrays(fo.grow_trees(sample, {"few": FEATURES[:4]}, 64).toPandas())
    boxes = sh.leaf_boxes(arrays)
    groups = []
    for d in sorted({len(p) for _, _, p in boxes}):
        members = [(v, p) for v, _, p in boxes if len(p) == d]
        features = np.array([list(p) for _, p in members])
        bounds = np.array([list(p.values()) for _, p in members])
        selector = np.zeros((features.size, 14))
        selector[np.arange(features.size), features.ravel()] = 1
        groups.append((features, bounds[:, :, 0], bounds[:, :, 1], sh.contribution_table(np.array([v for v, _ in members]), bounds[:, :, 2]), selector))

    def expected(row, known, node=0):
        f = arrays["feature"][0, node]
        if f < 0:
            return -arrays["path_length"][0, node]
        sides = arrays["left_node"][0, node], arrays["right_node"][0, node]
        if f in known:
            return expected(row, known, sides[0] if row[f] < arrays["threshold"][0, node] else sides[1])
        return sum(arrays["cover"][0, s] / arrays["cover"][0, node] * expected(row, known, s) for s in sides)

    found = sh.contributions(x[:6], groups)
    for row, values in zip(x[:6], found):
        for j in range(4):
            others = [k for k in range(4) if k != j]
            phi = sum(
                factorial(len(s)) * factorial(3 - len(s)) / factorial(4) * (expected(row, {*s, j}) - expected(row, set(s)))
                for size in range(4) for s in combinations(others, size)
            )
            assert values[j] == pytest.approx(phi)


def test_explanations_and_narratives(spark, flows, model):
    alerts = flows.filter("actual_malicious = 1").select(
        *FLOW_KEY, "first_seen", (F.col("src_port") + 1).alias("alert_no"), F.format_string("ALERT-%04d", F.col("src_port") + 1).alias("alert_id"),
        F.lit("CRITICAL").alias("severity"), F.lit("DNS_TUNNEL").alias("threat_label"), F.lit(0.9).alias("final_threat_score"),
    )
    told = explain.explain_alerts(alerts, flows, model, limit=3)
    rows = told.orderBy("alert_id").collect()
    assert [r.alert_id for r in rows] == ["ALERT-0001", "ALERT-0002", "ALERT-0003"]
    for r in rows:
        sizes = [abs(f.shap_contribution) for f in r.top_features]
        assert len(sizes) == 5 and sizes == sorted(sizes, reverse=True)
        assert all((f.impact == "increased") == (f.shap_contribution > 0) for f in r.top_features)
    assert explain.explain_alerts(alerts, flows, model).count() == OUTLIERS
    # A second session of a key neither doubles an explanation nor leaves the training flows.
    later = flows.withColumn("first_seen", F.expr("first_seen + INTERVAL 1 HOUR"))
    assert explain.explain_alerts(alerts, flows.unionByName(later), model).count() == OUTLIERS
    assert training_flows(flows.unionByName(later), alerts).count() == 2 * flows.count() - OUTLIERS
    assert explain.explain_alerts(alerts, flows, model, mode="first_pair").count() == OUTLIERS
    text = {r.alert_id: r.narrative for r in explain.explanation_by_alert(alerts, told).collect()}
    assert text["ALERT-0005"] == "No explanation found for ALERT-0005"
    first = text["ALERT-0001"].split("\n")
    assert first[0] == "🚨 Alert: ALERT-0001 (CRITICAL)" and first[3] == "   ML Threat Score: 0.900"
    assert first[7].startswith("   1. ")
    importance = sh.rank_importance(sh.global_importance(flows, model, sample=50)).collect()
    assert len(importance) == 14 and importance[-1].feature == "avg_packet_size"


def test_feature_wording(spark):
    cases = [("dns_entropy", 3.6, "High DNS entropy"), ("dns_entropy", 3.5, ""), ("dns_subdomain_depth", 4.0, "Deep subdomain"),
             ("std_iat", 0.005, "Regular timing"), ("std_iat", 1.5, "Bursty"), ("std_iat", 0.5, ""), ("duration", 61.0, "Long-lived")]
    df = spark.createDataFrame(cases, "f STRING, v DOUBLE, start STRING").coalesce(1)
    for r in df.select("start", feature_context(F.col("f"), F.col("v")).alias("t")).collect():
        assert r.t.startswith(r.start) and bool(r.t) == bool(r.start)
    names = spark.createDataFrame([("duration",), ("other",)], "f STRING").coalesce(1)
    assert [r[0] for r in names.select(feature_text(F.col("f"))).collect()] == ["flow duration in seconds", "other"]


def test_ablation_has_a_row_per_feature(flows):
    got = feature_ablation(flows, trees=10).collect()
    assert {r.left_out for r in got} == {"all", *FEATURES}
    assert all(r.true_positives + r.false_negatives == OUTLIERS for r in got)


def test_rolled_trees_equal_trees_fitted_apart(spark, flows, model, tmp_path):
    store = models.ModelStore(spark, str(tmp_path / "models"))
    with pytest.raises(FileNotFoundError):
        store.load()
    first = store.publish(model)
    newer = flows.filter("src_port >= 100")
    rolled = store.roll(newer)
    assert (first, store.current(), store.versions()) == (1, 2, [1, 2])

    def trees(nodes, wanted):
        return sorted(map(tuple, nodes.filter(F.col("tree").isin(wanted)).select("tree", "node", "feature", "threshold", "cover").collect()))

    kept, replaced = list(range(10, 40)), list(range(10))
    assert trees(rolled.nodes, kept) == trees(model.nodes, kept)
    apart = fo._grown(newer, newer.count(), model.scaling, replaced, 128, fo.SEED + 1, {fo.FULL: FEATURES})
    assert trees(rolled.nodes, replaced) == trees(apart, replaced) and trees(rolled.nodes, replaced) != trees(model.nodes, replaced)
    again = store.roll(flows).meta.first()
    assert again.born == [1] * 10 + [2] * 10 + [0] * 20 and again.trees == 40
    marked = fo.score_isolation_forest(newer, store.load(2)).filter("iforest_label = -1").count()
    assert 10 <= marked <= 16  # five percent of 300
    # A version that is being written is not seen, a failed one does not stand in the way, and an old one may be used again.
    models.save_model(model, str(tmp_path / "models" / "_unfinished" / "000004"))
    assert store.versions() == [1, 2, 3] and store.current() == 3
    store.use(1)
    assert store.current() == 1 and trees(store.load().nodes, replaced) == trees(model.nodes, replaced)
    assert store.publish(model) == 4 == store.current()
    with pytest.raises(ValueError, match="no version"):
        store.use(9)


def test_sketched_baselines_stay_within_their_error(spark, tmp_path):
    flows = spark.range(200_000).select(
        (F.col("id") % 7).alias("day"), (F.rand(1) * 1e6).alias("packet_count"), (F.randn(2) * F.col("id")).alias("duration"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.round(F.rand(3) * 5, 1)).alias("dns_entropy"),
    ).cache()
    table = bl.baseline_table(spark, str(tmp_path / "kept"), every=4)
    for b in range(6):
        table.append(bl.period_sketches(flows.filter(F.floor(F.col("packet_count")) % 6 == b), F.col("day")), b)
    assert table.read().agg(F.sum("flows"), F.count("*")).first()[:] == (200_000, 7)
    for first, last, part in ((None, None, flows), ("2", "4", flows.filter("day BETWEEN 2 AND 4"))):
        limits = bl.sketched_thresholds(table.read(), first=first, last=last)
        for r in bl.threshold_ranks(part, limits).collect():
            assert r.low <= r.q + bl.RANK_ERROR and r.high >= r.q - bl.RANK_ERROR
