"""Rules, alerts, incidents, timelines, evaluation, labels and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowhunt.functions.columns import nan_to_null
from flowhunt.operators import alerts as al, evaluation as ev, intelligence as intel, rules as ru, scoring
from flowhunt.sources import files, ground_truth
from flowhunt.streaming import detection as sd

FLOW_DDL = (
    "src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING, packet_count BIGINT, duration DOUBLE, "
    "mean_iat DOUBLE, packets_per_second DOUBLE, dns_entropy DOUBLE, dns_subdomain_depth INT, dst_port_count BIGINT, "
    "final_threat_score DOUBLE, threat_label STRING, second INT"
)


def labelled(spark, rows):
    df = spark.createDataFrame(rows, FLOW_DDL)
    at = F.timestamp_micros(F.col("second") * 1_000_000)
    return df.withColumn("first_seen", at).withColumn("last_seen", at).drop("second")


def flow(src="10.0.0.1", dport=53, proto="UDP", packets=10, duration=2.0, iat=0.5, pps=6.0, entropy=3.6, depth=3, ports=1, score=0.5, label="DNS_TUNNEL", second=0, sport=1):
    return (src, "r", sport, dport, proto, packets, duration, iat, pps, entropy, depth, ports, score, label, second)


def test_alert_fields(spark):
    rows = [
        flow(second=1),
        flow(src="10.0.0.2", proto="TCP", dport=22, ports=20, score=0.9, packets=2000, duration=0.5, iat=0.001, label="PORT_SCAN", second=2),
        flow(src="10.0.0.3", ports=30, score=0.3, second=3, proto="udp"),
        flow(src="10.0.0.4", label="BENIGN", second=4),
        flow(src="10.0.0.5", proto="TCP", score=0.7, label="SUSPICIOUS_TRAFFIC", second=5),
    ]
    got = al.generate_alerts(labelled(spark, rows)).orderBy("alert_no").collect()
    assert [a.alert_id for a in got] == ["ALERT-0001", "ALERT-0002", "ALERT-0003", "ALERT-0004"]
    assert [a.triggered_rules for a in got] == [["DNS_BEACONING"], ["PORT_SCAN"], ["PORT_SCAN", "DNS_BEACONING"], []]
    assert [a.final_threat_score for a in got] == [0.7, 1.0, 0.75, 0.7]
    assert [a.severity for a in got] == ["HIGH", "CRITICAL", "HIGH", "HIGH"]
    assert [a.confidence for a in got] == [0.8, 1.0, 0.95, 0.7]
    assert got[0].reason == "DNS_TUNNEL detected due to: statistical anomaly in flow behavior, suspicious high-entropy, repetitive DNS queries"
    assert got[1].reason == ("PORT_SCAN detected due to: high packet count, short-lived high-volume flow, "
                             "low inter-arrival variance, high destination port diversity")
    assert got[0].summary == "HIGH alert: DNS_TUNNEL from 10.0.0.1:1 → r:53 over UDP"
    assert got[0].timestamp == "1970-01-01T00:00:01.000000Z"
    as_coded = al.alert_rows(labelled(spark, rows[4:]), indicator_mode="as_coded").first()
    assert as_coded.reason.endswith("short-lived high-volume flow")


def test_alert_numbers_grow_past_four_digits(spark):
    rows = spark.createDataFrame([(9999,), (10000,)], "n INT").coalesce(1)
    assert [r[0] for r in rows.select(al.alert_id(F.col("n"))).collect()] == ["ALERT-9999", "ALERT-10000"]


def test_query_alerts_pages_hold_everything_once(spark):
    alerts = spark.range(1, 26).select(F.col("id").alias("alert_no"), F.lit("HIGH").alias("severity"), al.alert_id(F.col("id")).alias("alert_id"))
    pages = [[r.alert_no for r in al.query_alerts(alerts, page=p, page_size=10).collect()] for p in (1, 2, 3)]
    assert sorted(sum(pages, [])) == list(range(1, 26))
    filtered = [r.alert_no for r in al.query_alerts(alerts, severity="HIGH", page=3, page_size=10).collect()]
    assert filtered == [21, 22, 23, 24, 25]


def test_rules_with_missing_columns_and_registration(spark):
    bare = spark.createDataFrame([("UDP", 53)], "protocol STRING, dst_port INT")
    assert ru.apply_rules(bare).first().triggered_rules == []
    mine = ru.register_rule(ru.Rule("DNS", "dst_port = 53", 0.5, "dns"))
    row = ru.apply_rules(bare, mine).first()
    assert (row.triggered_rules, row.rule_boost, row.rule_indicators) == (["DNS"], 0.5, ["dns"])
    assert [r.name for r in ru.register_rule(ru.Rule("DNS", "true", 1.0, "x"), mine)] == ["PORT_SCAN", "DNS_BEACONING", "DNS"]


def test_fusion_orientation(spark):
    df = spark.createDataFrame([(-0.2, 2), (0.1, 0)], "ml_anomaly_score DOUBLE, suspicion_score INT").coalesce(1)
    assert [r.final_threat_score for r in scoring.fuse_scores(df).collect()] == [1.0, 0.0]
    assert [r.final_threat_score for r in scoring.fuse_scores(df, "as_coded").collect()] == [0.6, 0.4]


def test_attach_ml_score_needs_the_same_flows(spark):
    ddl = "src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING, first_seen TIMESTAMP"
    flows = spark.createDataFrame([("a", "b", 1, 2, "TCP", None)], ddl).withColumn("first_seen", F.timestamp_micros(F.lit(0)))
    scores = flows.withColumn("iforest_score", F.lit(0.1))
    assert scoring.attach_ml_score(flows, scores).first().ml_anomaly_score == 0.1
    other = scores.withColumn("src_ip", F.lit("z"))
    with pytest.raises(Exception, match="do not match"):
        scoring.attach_ml_score(flows, other).collect()


# Golden pairs of incidents and campaigns.
GOLDEN = [
    ("192.168.118.134", "DNS_BEACONING", 11, "CRITICAL", 0.896, "active_campaign"),
    ("192.168.118.2", "NO_RULE", 27, "CRITICAL", 0.687, "active_campaign"),
    ("192.168.118.134", "NO_RULE", 30, "CRITICAL", 0.669, "active_campaign"),
    ("103.102.166.224", "NO_RULE", 1, "HIGH", 0.637, "single_event"),
]


def test_golden_campaigns(spark):
    rows = spark.createDataFrame([g[:5] for g in GOLDEN], "entity STRING, rule STRING, alert_count BIGINT, max_severity STRING, avg_score DOUBLE")
    got = {(r.entity, r.rule): r.campaign_type for r in intel.campaigns(rows).collect()}
    assert got == {g[:2]: g[5] for g in GOLDEN}
    pair = spark.createDataFrame([(2,), (4,)], "alert_count BIGINT")
    assert {r.campaign_type for r in intel.campaigns(pair).collect()} == {"repeated_activity"}


def stream_of(spark, scores, rule_lists=None, src="192.168.118.2"):
    severities = ["CRITICAL" if s >= 0.8 else "HIGH" for s in scores]
    rows = [(i + 1, f"ALERT-{i + 1:04d}", src, "2026-01-25T13:41:34.313693Z", sev, s, (rule_lists or [[]] * len(scores))[i])
            for i, (s, sev) in enumerate(zip(scores, severities))]
    return spark.createDataFrame(rows, "alert_no BIGINT, alert_id STRING, src_ip STRING, timestamp STRING, severity STRING, final_threat_score DOUBLE, triggered_rules ARRAY<STRING>")


def test_golden_timeline_wording(spark):
    alerts = stream_of(spark, [0.858, 0.831, 0.639, 0.611, 0.9])
    incidents = intel.incidents(alerts)
    row = incidents.first()
    assert (row.entity, row.rule, row.alert_count, row.max_severity, row.avg_score) == ("192.168.118.2", "NO_RULE", 5, "CRITICAL", 0.768)
    got = intel.timelines(intel.campaigns(incidents), alerts).first()
    assert got.timeline == [
        "13:41:34 — NO_RULE detected (score: 0.858)",
        "13:41:34 — NO_RULE detected (score: 0.831)",
        "13:41:34 — Severity escalated to HIGH",
        "13:41:34 — NO_RULE detected (score: 0.611)",
        "13:41:34 — Severity escalated to CRITICAL",
    ]
    directions = [r.direction for r in intel.timeline_events(alerts).orderBy("seq").collect()]
    assert directions == ["first", "same", "down", "same", "up"]


def test_timeline_pages_and_slices(spark, monkeypatch):
    monkeypatch.setattr(intel, "SLICE_ALERTS", 7)
    alerts = stream_of(spark, [0.9 if i % 5 else 0.7 for i in range(60)], [["A", "B"] if i % 2 else ["A"] for i in range(60)])
    pages = intel.timelines(intel.campaigns(intel.incidents(alerts)), alerts, page_size=8).orderBy("rule", "page").collect()
    whole = intel.timelines(intel.campaigns(intel.incidents(alerts)), alerts).orderBy("rule").collect()
    for one in whole:
        parts = [p.timeline for p in pages if p.rule == one.rule]
        assert max(map(len, parts)) <= 8 and sum(parts, []) == one.timeline
    empty = intel.campaigns(intel.incidents(alerts)).withColumn("entity", F.lit("nobody"))
    assert all(r.timeline == [] for r in intel.timelines(empty, alerts).collect())


def test_unknown_severity_does_not_break_the_rollup(spark):
    alerts = stream_of(spark, [0.7]).withColumn("severity", F.lit("UNKNOWN")).withColumn("src_ip", F.lit(None).cast("string"))
    row = intel.incidents(alerts).first()
    assert (row.entity, row.max_severity) == ("unknown", "UNKNOWN")


def scored(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    actual = rng.integers(0, 2, n)
    score = np.round(np.clip(0.35 * actual + rng.random(n) * 0.6, 0, 1), 2)
    rows = [(f"s{i % 9}", "d", i, 80, "TCP", float(s), int(a)) for i, (s, a) in enumerate(zip(score, actual))]
    return spark.createDataFrame(rows, "src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING, final_threat_score DOUBLE, actual_malicious INT"), score, actual


def test_metrics_against_brute_force(spark):
    df, score, actual = scored(spark)
    row = ev.detection_metrics(df).first()
    hit = score > 0.6
    tp, fp, fn, tn = (hit & (actual == 1)).sum(), (hit & (actual == 0)).sum(), (~hit & (actual == 1)).sum(), (~hit & (actual == 0)).sum()
    assert (row.true_positives, row.false_positives, row.false_negatives, row.true_negatives) == (tp, fp, fn, tn)
    assert row.precision == pytest.approx(tp / (tp + fp), abs=1e-6) and row.recall == pytest.approx(tp / (tp + fn), abs=1e-6)
    pos, neg = score[actual == 1], score[actual == 0]
    auc = ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()
    assert row.auc_roc == pytest.approx(auc, abs=1e-6)
    squared = df.withColumn("final_threat_score", F.col("final_threat_score") ** 2)
    assert ev.auc_roc(squared).first().auc_roc == row.auc_roc
    roc = ev.roc_curve(df).orderBy(F.desc("threshold")).collect()
    assert roc[-1].tpr == 1.0 and roc[-1].fpr == 1.0 and [r.tpr for r in roc] == sorted(r.tpr for r in roc)
    sweep = {r.threshold: r.true_positives for r in ev.threshold_sweep(df).collect()}
    assert sweep[0.6] == tp and len(sweep) == 5
    hist = ev.score_histogram(df).collect()
    for side in (0, 1):
        counts = np.zeros(50, int)
        for r in hist:
            if r.actual_malicious == side:
                counts[r.bin] += r.flows
        assert (counts == np.histogram(score[actual == side], 50)[0]).sum() >= 46 and counts.sum() == (actual == side).sum()
    ci = {r.metric: r for r in ev.bootstrap_ci(df, replicates=60).collect()}
    assert ci["recall"].low < row.recall < ci["recall"].high and ci["recall"].replicates == 60
    folds = ev.cross_validate(df, 4).collect()
    assert len(folds) == 4 and sum(r.true_positives for r in folds) == tp


def test_one_class_has_no_auc(spark):
    df, _, _ = scored(spark, 20)
    assert ev.auc_roc(df.withColumn("actual_malicious", F.lit(0))).first().auc_roc is None
    row = ev.detection_metrics(df.filter("false")).first()
    assert (row.total_flows, row.precision) == (0, 0.0)


def test_mark_by_entity(spark):
    df, _, _ = scored(spark, 50)
    marked = ev.mark_by_entity(df.drop("actual_malicious"), spark.createDataFrame([("s1",)], "src_ip STRING"), hot_rows=2)
    assert {r.src_ip for r in marked.filter("actual_malicious = 1").collect()} == {"s1"} and marked.count() == 50


def test_labels_prefer_the_most_specific_key(spark):
    keys = [("10.0.0.5:1_b:2_TCP", "EXACT"), ("10.0.0.5_*_TCP", "WILD"), ("172.16.0.10:443_malicious-c2.com:443_TCP", "C2")]
    labels = ground_truth.parse_label_keys(spark.createDataFrame(keys, "key STRING, label STRING"))
    rows = [("10.0.0.5", "b", 1, 2, "TCP"), ("10.0.0.5", "c", 9, 9, "TCP"), ("10.0.0.5", "c", 9, 9, "UDP"), ("172.16.0.10", "malicious-c2.com", 443, 443, "TCP")]
    flows = spark.createDataFrame(rows, "src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING")
    got = {tuple(r)[:5]: r.truth_label for r in ground_truth.label_flows(flows, labels).collect()}
    assert [got[r] for r in rows] == ["EXACT", "WILD", "BENIGN", "C2"]
    none = ground_truth.read_ground_truth(spark, None)
    assert ground_truth.label_rows(none).count() == 0


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"alert_id": "ALERT-0012", "triggered_rules": ["PORT_SCAN"], "severity": "HIGH"}]')
    alert = files.number_from_alert_id(files.read_alerts_json(spark, str(tmp_path / "a.json"), array_file=True)).first()
    assert (alert.alert_no, alert.triggered_rules, alert.src_ip) == (12, ["PORT_SCAN"], None)
    (tmp_path / "truth.json").write_text('{"sample_labels": {"k_x_TCP": "PORT_SCAN"}, "pcap_labels": {}}')
    truth = ground_truth.read_ground_truth(spark, str(tmp_path / "truth.json"))
    assert [tuple(r) for r in ground_truth.label_rows(truth).collect()] == [("k_x_TCP", "PORT_SCAN")]
    frame = spark.createDataFrame([(float("nan"), 1.0)], "a DOUBLE, b DOUBLE")
    assert tuple(nan_to_null(frame).first()) == (None, 1.0)


def test_label_keys_split_from_the_right_and_bad_ones_raise(spark):
    keys = [("host_one:1_b:2_TCP", "NAMED"), ("*_*_*", "REST")]
    labels = ground_truth.parse_label_keys(spark.createDataFrame(keys, "key STRING, label STRING"))
    rows = [("host_one", "b", 1, 2, "TCP"), ("x", "y", 1, 2, "UDP")]
    flows = spark.createDataFrame(rows, "src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING")
    got = {tuple(r)[:5]: r.truth_label for r in ground_truth.label_flows(flows, labels).collect()}
    assert [got[r] for r in rows] == ["NAMED", "REST"]
    for bad in ("nonsense", "a:b:c_d_TCP", None):
        with pytest.raises(Exception, match="not a label key"):
            ground_truth.parse_label_keys(spark.createDataFrame([(bad, "L")], "key STRING, label STRING")).collect()


def test_label_plan_grows_with_the_masks(spark):
    import itertools

    flows = spark.createDataFrame([("a", "b", 1, 2, "TCP")], "src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING")
    parts = [("a", "*"), ("b", "*"), ("1", "*"), ("2", "*"), ("TCP", "*")]
    keys = [(f"{s}:{sp}_{d}:{dp}_{p}", f"{s}{d}{sp}{dp}{p}") for s, d, sp, dp, p in itertools.product(*parts)]
    labelled = ground_truth.label_flows(flows, ground_truth.parse_label_keys(spark.createDataFrame(keys, "key STRING, label STRING")))
    assert labelled.first().truth_label == "ab12TCP"
    joins = labelled._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins <= 31


def test_times_are_compared_as_times(spark):
    rows = [(1, "2026-01-01T00:00:34Z", "LOW"), (2, "2026-01-01T00:00:34.500000Z", "HIGH"), (3, "2026-01-01T00:00:33.900000Z", "LOW")]
    alerts = spark.createDataFrame(rows, "alert_no BIGINT, timestamp STRING, severity STRING").select(
        "*", F.format_string("ALERT-%04d", "alert_no").alias("alert_id"), F.lit("a").alias("src_ip"), F.lit(0.5).alias("final_threat_score"),
        F.array(F.lit("R")).alias("triggered_rules"),
    )
    row = intel.incidents(alerts).first()
    assert (row.first_seen, row.last_seen) == ("2026-01-01T00:00:33.900000Z", "2026-01-01T00:00:34.500000Z")
    for numbered in (True, False):  # a file's alerts may be numbered in another order than their times
        moves = intel.severity_transitions(alerts, numbered=numbered).orderBy("seq").collect()
        assert [m.alert_id for m in moves] == ["ALERT-0003", "ALERT-0001", "ALERT-0002"]
    deltas = [sd.incident_deltas(alerts.filter(f"alert_no {c}")) for c in ("= 1", "> 1")]
    merged = sd.merge_incidents(deltas[0].unionByName(deltas[1])).first()
    assert (merged.alert_count, merged.first_seen, merged.last_seen) == (3, row.first_seen, row.last_seen)


def test_missing_score_raises_whatever_is_read(spark):
    flows = spark.createDataFrame([("a", "b", 1, 2, "TCP", 0), ("a", "c", 1, 2, "TCP", 0)], "src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING, t INT")
    flows = flows.withColumn("first_seen", F.timestamp_seconds("t")).drop("t")
    scores = flows.limit(1).withColumn("iforest_score", F.lit(0.1))
    with pytest.raises(Exception, match="do not match"):
        scoring.attach_ml_score(flows, scores).select("src_ip").collect()


def test_pages_after_a_number(spark):
    alerts = spark.range(1, 101).select(F.col("id").alias("alert_no"), F.when(F.col("id") % 2 == 0, "LOW").otherwise("HIGH").alias("severity"))
    first = [r.alert_no for r in al.query_alerts(alerts, severity="LOW", after=0, page_size=10).collect()]
    second = [r.alert_no for r in al.query_alerts(alerts, severity="LOW", after=first[-1], page_size=10).collect()]
    assert first + second == [r.alert_no for p in (1, 2) for r in al.query_alerts(alerts, severity="LOW", page=p, page_size=10).collect()]


def test_label_lines_hold_bounded_maps(spark, tmp_path):
    keys = [(f"10.0.{i // 250}.{i % 250}_*_TCP", "PORT_SCAN") for i in range(3000)]
    labels = spark.createDataFrame(keys + keys[:5] + [(keys[0][0], "A_SCAN")], "key STRING, label STRING")
    path = str(tmp_path / "labels")
    ground_truth.write_label_lines(labels, path, per_line=50)
    truth = ground_truth.read_ground_truth(spark, path, lines=True)
    sizes = [r[0] for r in truth.select(F.size("sample_labels")).collect()]
    assert len(sizes) > 40 and max(sizes) < 150
    got = sorted(tuple(r) for r in ground_truth.label_rows(truth).collect())
    assert got == sorted([(keys[0][0], "A_SCAN")] + keys[1:])
    ground_truth.write_label_lines(labels.limit(0), str(tmp_path / "none"))
    assert ground_truth.label_rows(ground_truth.read_ground_truth(spark, str(tmp_path / "none"), lines=True)).count() == 0


def test_label_file_query_equals_sql(spark, monkeypatch):
    import os

    from flowhunt.plans.catalog import QUERIES
    from flowhunt.plans.oracle import ORACLE

    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("driver tables not present")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    monkeypatch.setattr(ground_truth, "LINE_LABELS", 2)
    got, want = QUERIES["label_file"](spark, sf_dir).toPandas(), con.execute(ORACLE["label_file"]).df()
    rows = [sorted(map(str, f[sorted(f.columns)].astype(object).itertuples(index=False, name=None))) for f in (got, want)]
    assert rows[0] == rows[1]
