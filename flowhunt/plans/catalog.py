"""The query catalogue: every operator over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowhunt.functions.bands import alert_severity, score_band, severity3
from flowhunt.functions.columns import anonymize_ip, flow_key_string, iso_utc, one_row, round_half_up
from flowhunt.operators import (
    ablation, alerts as al, baselines as bl, dashboard, entity, evaluation as ev, explain, flows as fl, folds as fd, forest as fo,
    intelligence as intel, ordering, profile as pf, rules, scaling, scoring, shapley,
)
from flowhunt.plans import detect
from flowhunt.plans.fixed_model import fixed_forest
from flowhunt.schemas import FEATURES, FLOW_KEY
from flowhunt.session import materialize, prepare, scratch_path
from flowhunt.sources import capture, capture_ranges, files, ground_truth, models
from flowhunt.streaming import detection as sd, flows as sf, io as sio
from flowhunt.sources.tables import packets as table_packets, role_of_source, truth_label

# The fixture's capture lasts about three seconds: narrow slices make flows span several of them.
SLICE = 0.1
IDLE = 0.2
LATE = "200 milliseconds"
CAPTURE_RANGE = 400_000  # bytes; production ranges are larger than these captures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text and string arrays as comma lists, so any engine can compare them."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "timestamp":
            out.append(iso_utc(F.col(f.name)).alias(f.name))
        elif kind == "array<string>":
            out.append(F.array_join(f.name, ", " if "indicator" in f.name else ",").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_packets(prepare(spark), sf_dir)


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.stored_flows(_packets(spark, sf_dir), SLICE)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.labelled_flows(_flows(spark, sf_dir))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.generate_alerts(_labelled(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled flows with the truth of their source's role, stored for repeated passes."""
    truth = truth_label(F.col("src_ip"))
    labelled = _labelled(spark, sf_dir).withColumn("truth_label", truth)
    return materialize(
        labelled.withColumn("actual_malicious", (F.col("truth_label") != "BENIGN").cast("int")), "judged"
    )


def _judged_and_alerts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    judged = _judged(spark, sf_dir)
    return judged, al.generate_alerts(judged.drop("truth_label", "actual_malicious"))


# Packets and flows


@query
def packet_gate(spark, sf_dir):
    """Every 17th packet is given another protocol, which the gate drops."""
    other = F.when(F.col("packet_id") % 17 == 0, "ICMP").otherwise(F.col("protocol"))
    return plain(fl.packet_gate(_packets(spark, sf_dir).withColumn("protocol", other)))


@query
def packet_filter(spark, sf_dir):
    return plain(fl.packet_filter(_packets(spark, sf_dir), ["UDP"], [53], ["172.16.0.3"]))


@query
def packet_stats(spark, sf_dir):
    return fl.packet_stats(_packets(spark, sf_dir), True, IDLE)


@query
def packet_stats_json(spark, sf_dir):
    """Totals, flows exported by a stream and flows it still holds, written as JSON and read back."""
    out, checkpoint = _short_stream(spark, sf_dir)
    path = scratch_path(spark, "stats-json")
    held = sf.open_flows(spark, checkpoint, IDLE)
    totals = sf.running_stats(_packets(spark, sf_dir), spark.read.parquet(out), held)
    files.write_json(totals, path)
    return spark.read.schema(totals.schema).json(path)


@query
def capture_decode(spark, sf_dir):
    """Packets stored as frames, then decoded from their bytes."""
    frames = materialize(capture.encode_frames(_packets(spark, sf_dir)), "frames")
    return plain(capture.decode_frames(frames, length="wire"))


@query
def capture_files(spark, sf_dir):
    """Packets written as capture files and read back in small byte ranges."""
    path = scratch_path(prepare(spark), "captures")
    capture_ranges.write_capture(capture.encode_frames(_packets(spark, sf_dir)), path)
    return plain(capture.read_capture(spark, path, "wire", CAPTURE_RANGE).drop("packet_id"))


@query
def inter_arrival(spark, sf_dir):
    return fl.inter_arrival(_packets(spark, sf_dir), SLICE)


@query
def flow_features(spark, sf_dir):
    return plain(fl.flow_features(_packets(spark, sf_dir), SLICE))


@query
def flow_features_collector(spark, sf_dir):
    flows = fl.flow_features(_packets(spark, sf_dir), SLICE, entropy_digits=4, text_unit="bytes")
    return flows.select(*FLOW_KEY, "packet_count", "duration", "dns_entropy")


@query
def flows_csv(spark, sf_dir):
    """Flows written to CSV and read back with the fixed schema."""
    path = scratch_path(prepare(spark), "flows-csv")
    files.write_csv(fl.flow_features(_packets(spark, sf_dir), SLICE), path)
    return plain(files.read_flows_csv(spark, path))


@query
def session_flows(spark, sf_dir):
    return plain(fl.session_flows(_packets(spark, sf_dir), IDLE, SLICE))


@query
def first_dns_query(spark, sf_dir):
    return fl.first_dns_query(_packets(spark, sf_dir))


@query
def dns_entropy_depth(spark, sf_dir):
    return fl.dns_text_features(fl.first_dns_query(_packets(spark, sf_dir)))


@query
def beacon_intervals(spark, sf_dir):
    return fl.beacon_intervals(_packets(spark, sf_dir), SLICE)


@query
def flow_keys(spark, sf_dir):
    flows = fl.flow_features(_packets(spark, sf_dir), SLICE)
    return flows.select(
        flow_key_string().alias("flow_key"), anonymize_ip(F.col("src_ip")).alias("masked_src")
    )


@query
def sorted_flows(spark, sf_dir):
    flows = fl.flow_features(_packets(spark, sf_dir), SLICE).select(*FLOW_KEY, "first_seen")
    return plain(ordering.sort_flows(flows))


@query
def flow_head(spark, sf_dir):
    flows = fl.flow_features(_packets(spark, sf_dir), SLICE)
    return pf.head(flows, ["first_seen", *FLOW_KEY]).select(*FLOW_KEY, "packet_count")


@query
def first_flow_of_pair(spark, sf_dir):
    flows = fl.flow_features(_packets(spark, sf_dir), SLICE)
    order = ["first_seen", "src_port", "dst_port", "protocol"]
    first = ordering.first_match(flows.select("src_ip", "dst_ip", *order, "packet_count"), ["src_ip", "dst_ip"], order)
    return first.select(*FLOW_KEY, "packet_count")


# Profiles and baselines


@query
def describe_flows(spark, sf_dir):
    return pf.describe(_flows(spark, sf_dir))


@query
def describe_scores(spark, sf_dir):
    scored = materialize(
        detect.scored_flows(_flows(spark, sf_dir)).select(
            "ml_score_normalized", "rule_score_normalized", "final_threat_score"
        ),
        "scores",
    )
    return pf.describe(scored, scored.columns, pf.QUARTILES)


@query
def null_profile(spark, sf_dir):
    return pf.profile(fl.flow_features(_packets(spark, sf_dir), SLICE))


@query
def baseline_thresholds(spark, sf_dir):
    limits = pf.baseline_thresholds(_flows(spark, sf_dir))
    return limits.select(*[round_half_up(F.col(c), 6).alias(c) for c in limits.columns])


@query
def baseline_flags(spark, sf_dir):
    enriched = detect.enriched_flows(_flows(spark, sf_dir))
    return enriched.select(
        *FLOW_KEY, "flag_high_packet", "flag_long_duration", "flag_high_dns_entropy", "flag_deep_dns",
        "suspicion_score",
    )


@query
def suspicion_counts(spark, sf_dir):
    return pf.value_counts(detect.enriched_flows(_flows(spark, sf_dir)), "suspicion_score")


@query
def entity_features(spark, sf_dir):
    return entity.entity_features(fl.flow_features(_packets(spark, sf_dir), SLICE))


@query
def attach_entities(spark, sf_dir):
    flows = _flows(spark, sf_dir)
    with_entity = entity.attach_entities(flows, entity.entity_features(flows))
    return with_entity.select(*FLOW_KEY, *entity.ENTITY_COLUMNS)


# Scores, rules, labels


@query
def feature_vector(spark, sf_dir):
    return scoring.feature_vector(fl.flow_features(_packets(spark, sf_dir), SLICE))


@query
def minmax_scale(spark, sf_dir):
    scored = detect.scored_flows(_flows(spark, sf_dir))
    return scored.select(*FLOW_KEY, "ml_anomaly_score", "ml_score_normalized", "rule_score_normalized")


@query
def standard_scale(spark, sf_dir):
    return scaling.standard_scale(_flows(spark, sf_dir), digits=6).select(*FLOW_KEY, *FEATURES)


@query
def rule_score_fusion(spark, sf_dir):
    scored = detect.scored_flows(_flows(spark, sf_dir))
    return scored.select(*FLOW_KEY, "final_threat_score", "threat_score_band")


@query
def severity_schemes(spark, sf_dir):
    scored = scoring.add_severity(detect.scored_flows(_flows(spark, sf_dir)))
    score = F.col("final_threat_score")
    return scored.select(
        *FLOW_KEY, score, score_band(score).alias("threat_score_band"), severity3(score).alias("severity"),
        alert_severity(score).alias("alert_severity"),
    )


@query
def threat_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select(*FLOW_KEY, "final_threat_score", "threat_label")


@query
def label_counts(spark, sf_dir):
    return pf.value_counts(_labelled(spark, sf_dir), "threat_label")


@query
def rules_port_scan(spark, sf_dir):
    return rules.rule_hits(_labelled(spark, sf_dir), "PORT_SCAN").select(*FLOW_KEY, "dst_port_count")


@query
def rules_dns_beaconing(spark, sf_dir):
    hits = rules.rule_hits(_labelled(spark, sf_dir), "DNS_BEACONING")
    return hits.select(*FLOW_KEY, "packets_per_second", "dns_entropy", "dns_subdomain_depth")


@query
def apply_rules(spark, sf_dir):
    ruled = rules.apply_rules(_labelled(spark, sf_dir))
    return plain(ruled.select(*FLOW_KEY, "triggered_rules", "rule_boost", "rule_indicators"))


@query
def rules_documented(spark, sf_dir):
    ruled = rules.apply_rules(_labelled(spark, sf_dir), rules.DOCUMENTED_RULES)
    return plain(ruled.filter(F.size("triggered_rules") > 0).select(*FLOW_KEY, "triggered_rules"))


@query
def rules_custom(spark, sf_dir):
    own = rules.Rule("SSH_GUESSING", "connection_count >= 30 AND dst_port = 22", 0.1, "many short logins")
    ruled = rules.apply_rules(_labelled(spark, sf_dir), rules.register_rule(own))
    hits = ruled.filter(F.array_contains("triggered_rules", "SSH_GUESSING"))
    return plain(hits.select(*FLOW_KEY, "triggered_rules"))


# Alerts and intelligence


@query
def alerts(spark, sf_dir):
    return plain(al.published(_alerts(spark, sf_dir)))


@query
def alerts_json(spark, sf_dir):
    """Alerts written as JSON and read back with the fixed schema."""
    path = scratch_path(prepare(spark), "alerts-json")
    files.write_json(al.published(_alerts(spark, sf_dir)), path)
    return plain(files.read_alerts_json(spark, path))


@query
def alerts_by_id(spark, sf_dir):
    return plain(al.published(al.query_alerts(_alerts(spark, sf_dir), alert="ALERT-0007")))


@query
def alerts_page(spark, sf_dir):
    page = al.query_alerts(_alerts(spark, sf_dir), severity="MEDIUM", page=2, page_size=20)
    return plain(al.published(page))


@query
def critical_alerts(spark, sf_dir):
    return plain(al.published(al.critical_alerts(_alerts(spark, sf_dir))))


@query
def top_critical(spark, sf_dir):
    return plain(al.published(al.top_critical(_alerts(spark, sf_dir))))


@query
def incidents(spark, sf_dir):
    return intel.incidents(_alerts(spark, sf_dir))


@query
def campaigns(spark, sf_dir):
    return intel.campaigns(intel.incidents(_alerts(spark, sf_dir)))


@query
def severity_transitions(spark, sf_dir):
    moves = intel.severity_transitions(_alerts(spark, sf_dir))
    return moves.select("entity", "rule", "seq", "alert_id", "severity", "previous_severity", "direction")


@query
def timeline_events(spark, sf_dir):
    return intel.timeline_events(_alerts(spark, sf_dir))


@query
def timelines(spark, sf_dir):
    """Pages of 25 events, so that long campaigns have several."""
    raised = _alerts(spark, sf_dir)
    pages = intel.timelines(intel.campaigns(intel.incidents(raised)), raised, page_size=25)
    return pages.withColumn("timeline", F.array_join("timeline", "\n"))


@query
def severity_distribution(spark, sf_dir):
    return dashboard.severity_distribution(_alerts(spark, sf_dir))


@query
def top_sources(spark, sf_dir):
    return dashboard.top_sources(_alerts(spark, sf_dir))


@query
def alerts_over_time(spark, sf_dir):
    return dashboard.alerts_over_time(_alerts(spark, sf_dir), "100 milliseconds")


@query
def alert_summary(spark, sf_dir):
    return dashboard.alert_summary(_alerts(spark, sf_dir))


@query
def topology_edges(spark, sf_dir):
    return dashboard.topology_edges(fl.flow_features(_packets(spark, sf_dir), SLICE))


@query
def system_stats(spark, sf_dir):
    flows = _flows(spark, sf_dir)
    raised = al.generate_alerts(detect.labelled_flows(flows))
    return dashboard.system_stats(flows, raised, intel.campaigns(intel.incidents(raised)))


@query
def noise_reduction(spark, sf_dir):
    raised = _alerts(spark, sf_dir)
    return intel.noise_reduction(raised, intel.incidents(raised))


# Evaluation


@query
def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(ev.predict_at(_judged(spark, sf_dir)))


@query
def detection_metrics(spark, sf_dir):
    return ev.detection_metrics(_judged(spark, sf_dir))


@query
def metrics_by_type(spark, sf_dir):
    return ev.metrics_by_attack_type(_judged(spark, sf_dir))


@query
def auc_roc(spark, sf_dir):
    return ev.auc_roc(_judged(spark, sf_dir))


@query
def roc_curve(spark, sf_dir):
    return ev.roc_curve(_judged(spark, sf_dir))


@query
def pr_curve(spark, sf_dir):
    return ev.pr_curve(_judged(spark, sf_dir))


@query
def threshold_sweep(spark, sf_dir):
    return ev.threshold_sweep(_judged(spark, sf_dir))


@query
def score_histogram(spark, sf_dir):
    return ev.score_histogram(_judged(spark, sf_dir))


@query
def cross_validate(spark, sf_dir):
    return ev.cross_validate(_judged(spark, sf_dir))


@query
def cross_validate_fitted(spark, sf_dir):
    """Thresholds, ranges and moments of each fold come from the other folds."""
    return fd.cross_validate_fitted(_flows(spark, sf_dir).withColumn(
        "actual_malicious", (truth_label(F.col("src_ip")) != "BENIGN").cast("int")
    ))


@query
def evaluation_report(spark, sf_dir):
    """The report as one record, written as JSON and read back."""
    path = scratch_path(prepare(spark), "report")
    report = ev.evaluation_report(_judged(spark, sf_dir))
    files.write_json(report, path)
    back = spark.read.schema(report.schema).json(path)
    return back.select("confusion_matrix.*", "performance_metrics.*", "threshold", "total_flows", "actual_malicious", "predicted_malicious")


@query
def sample_flows(spark, sf_dir):
    """The 500 flows that a global explanation may be limited to."""
    return shapley.sample_flows(_flows(spark, sf_dir)).select(*FLOW_KEY, "packet_count")


@query
def bootstrap_ci(spark, sf_dir):
    return ev.bootstrap_ci(_judged(spark, sf_dir))


@query
def critical_sources(spark, sf_dir):
    return ev.critical_sources(_alerts(spark, sf_dir))


@query
def mark_by_entity(spark, sf_dir):
    judged, raised = _judged_and_alerts(spark, sf_dir)
    marked = ev.mark_by_entity(judged.drop("actual_malicious"), ev.critical_sources(raised))
    return marked.select(*FLOW_KEY, "actual_malicious")


@query
def entity_semi_join(spark, sf_dir):
    judged, raised = _judged_and_alerts(spark, sf_dir)
    kept = ev.flows_of_sources(judged.drop("actual_malicious"), ev.critical_sources(raised))
    return kept.select(*FLOW_KEY, "threat_label")


@query
def training_flows(spark, sf_dir):
    flows = _flows(spark, sf_dir)
    raised = al.generate_alerts(detect.labelled_flows(flows))
    return scoring.training_flows(flows, raised).select(*FLOW_KEY)


@query
def label_wildcard_join(spark, sf_dir):
    """Exact labels for tunnel flows, source wildcards for scanners, in label-file notation."""
    flows = _flows(spark, sf_dir)
    role = role_of_source(F.col("src_ip"))
    exact = flows.filter((role == 3) & (F.col("protocol") == "UDP")).select(
        flow_key_string().alias("key"), F.lit("DNS_TUNNELING").alias("label")
    )
    wild = flows.filter(role == 0).select(
        F.concat("src_ip", F.lit("_*_TCP")).alias("key"), F.lit("PORT_SCAN").alias("label")
    )
    labels = ground_truth.parse_label_keys(exact.unionByName(wild.distinct()))
    return ground_truth.label_flows(flows, labels).select(*FLOW_KEY, "truth_label")


@query
def label_masks(spark, sf_dir):
    """Seven combinations of stated parts, and the label for everything else."""
    stated = [
        ("10.0.0.3_*:53_UDP", "A"), ("*_172.16.0.1:53_UDP", "B"), ("*_*:22_TCP", "C"), ("10.0.0.1_*_TCP", "D"),
        ("*_172.16.0.2_TCP", "E"), ("10.0.0.4_*_*", "F"), ("*_*_UDP", "G"), ("*_*_*", "REST"),
    ]
    labels = ground_truth.parse_label_keys(spark.createDataFrame(stated, "key STRING, label STRING"))
    return ground_truth.label_flows(_flows(spark, sf_dir), labels).select(*FLOW_KEY, "truth_label")


@query
def label_file(spark, sf_dir):
    """Labels of scanning sources written as a label file, read back with its map columns."""
    flows = _flows(spark, sf_dir)
    path = scratch_path(spark, "label-file")
    keys = flows.filter(role_of_source(F.col("src_ip")) == 0).select(F.concat("src_ip", F.lit("_*_TCP")).alias("key")).distinct()
    ground_truth.write_label_lines(keys.withColumn("label", F.lit("PORT_SCAN")), path)
    truth = ground_truth.read_ground_truth(spark, path, lines=True)
    labels = ground_truth.parse_label_keys(ground_truth.label_rows(truth))
    return ground_truth.label_flows(flows, labels).select(*FLOW_KEY, "truth_label")


@query
def label_captures(spark, sf_dir):
    """Packets of three capture files, two of them labelled by name."""
    packets = _packets(spark, sf_dir)
    named = packets.withColumn("path", F.concat(F.lit("hdfs://captures/part-"), F.col("packet_id") % 3, F.lit(".pcap")))
    truth = spark.range(1).select(
        F.create_map(F.lit("part-0.pcap"), F.lit("SCAN"), F.lit("part-1.pcap"), F.lit("TUNNEL")).alias("pcap_labels")
    )
    return ground_truth.label_captures(named, truth).select("packet_id", "truth_label")


@query
def detection_latency(spark, sf_dir):
    return ev.detection_latency(*_judged_and_alerts(spark, sf_dir))


# Streams: a stored packet or flow table is read as a stream to its end


def _packet_stream(spark, sf_dir, job):
    """Run ``job`` over all packets and a clock packet that closes what is open at the end."""
    path, checkpoint = scratch_path(prepare(spark), "packets"), scratch_path(spark, "stream")
    out = scratch_path(spark, "stream-out")
    table_packets(spark, sf_dir).write.parquet(path)
    sio.clock_packet(spark, "2030-01-01 00:00:00").write.mode("append").parquet(path)
    stream = job(sio.read_packet_stream(spark, path))
    slots = spark.sparkContext.defaultParallelism
    sio.run_to_table(stream, out, checkpoint, state_partitions=slots).awaitTermination()
    return spark.read.parquet(out)


def _short_stream(spark, sf_dir):
    """Sessions of a stream that stops without a clock packet: (table of emitted flows, checkpoint)."""
    path, checkpoint = scratch_path(prepare(spark), "packets"), scratch_path(spark, "stream")
    out = scratch_path(spark, "stream-out")
    table_packets(spark, sf_dir).write.parquet(path)
    stream = sf.stream_flows(sio.read_packet_stream(spark, path), IDLE, LATE)
    sio.run_to_table(stream, out, checkpoint, state_partitions=spark.sparkContext.defaultParallelism).awaitTermination()
    return out, checkpoint


@query
def stream_flush(spark, sf_dir):
    """Emitted flows, and those drained from the state the stopped stream left."""
    out, checkpoint = _short_stream(spark, sf_dir)
    emitted = spark.read.parquet(out).withColumn("drained", F.lit(False))
    held = sf.open_flows(spark, checkpoint, IDLE).withColumn("drained", F.lit(True))
    return plain(emitted.unionByName(held))


@query
def live_flow_files(spark, sf_dir):
    """Flow files dropped by a stream that is stopped and restarted, read back as a stream and flagged."""
    packets = materialize(table_packets(prepare(spark), sf_dir), "packets")
    path, checkpoint, drops = (scratch_path(spark, n) for n in ("packets-in", "stream", "drops"))
    middle = packets.agg(F.timestamp_micros(F.floor((F.min(F.unix_micros("ts")) + F.max(F.unix_micros("ts"))) / 2))).scalar()
    for part in (F.col("ts") < middle, F.col("ts") >= middle):
        packets.filter(part).write.mode("append").parquet(path)
        stream = sf.stream_flows(sio.read_packet_stream(spark, path), IDLE, LATE)
        slots = spark.sparkContext.defaultParallelism
        sio.run_batches(stream, sio.drop_flow_files(drops), checkpoint, state_partitions=slots).awaitTermination()
    sio.drop_open_flows(sf.open_flows(spark, checkpoint, IDLE), drops)
    out = scratch_path(spark, "live")
    sio.run_to_table(sio.read_live_flows(spark, drops), out, scratch_path(spark, "stream")).awaitTermination()
    flagged = detect.enriched_flows(spark.read.parquet(out))
    return plain(flagged.select(*FLOW_KEY, "first_seen", "packet_count", "total_bytes", "std_iat", "dns_entropy", "suspicion_score"))


@query
def stream_flows(spark, sf_dir):
    return plain(_packet_stream(spark, sf_dir, sf.stream_flows))


@query
def stream_sessions(spark, sf_dir):
    """Flows that fall silent for ``IDLE`` seconds come out as several."""
    sessions = _packet_stream(spark, sf_dir, lambda p: sf.stream_flows(p, IDLE))
    return plain(sessions.select(*FLOW_KEY, "packet_count", "total_bytes", "first_seen", "last_seen", "duration"))


@query
def stream_counters(spark, sf_dir):
    return plain(_packet_stream(spark, sf_dir, lambda p: sf.stream_counters(p, "100 milliseconds")))


def _flow_stream(spark, sf_dir, with_sources=True):
    """Streamed alerts of a stored flow table, scored by a fit on that table, two files a batch."""
    path = scratch_path(prepare(spark), "flows")
    fl.flow_features(_packets(spark, sf_dir), SLICE).repartition(6).write.parquet(path)
    flows = spark.read.parquet(path)
    detector = sd.fit_detector(flows, materialize(pf.baseline_thresholds(flows), "thresholds"))
    sources = materialize(entity.entity_features(flows), "sources") if with_sources else None
    stream = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return sd.stream_alerts(stream, detector, entities=sources)


def _streamed_alerts(spark, sf_dir, with_sources):
    out = scratch_path(prepare(spark), "stream-alerts")
    sio.run_to_table(_flow_stream(spark, sf_dir, with_sources), out, scratch_path(spark, "stream")).awaitTermination()
    found = spark.read.parquet(out)
    return plain(found.select(*FLOW_KEY, "threat_label", "severity", "final_threat_score", "triggered_rules"))


@query
def stream_alerts(spark, sf_dir):
    return _streamed_alerts(spark, sf_dir, True)


@query
def stream_alerts_alone(spark, sf_dir):
    """Without stored source columns only names, scores and the DNS rule can speak."""
    return _streamed_alerts(spark, sf_dir, False)


@query
def stream_incidents(spark, sf_dir):
    """Incidents kept up over several batches, with a new snapshot every second one."""
    kept = scratch_path(prepare(spark), "incidents")
    job = sio.run_batches(_flow_stream(spark, sf_dir), sd.append_incidents(kept, every=2), scratch_path(spark, "stream"))
    job.awaitTermination()
    return sd.merge_incidents(sd.incident_table(spark, kept).read())


BATCHES = 4


def _flow_batches(spark, sf_dir):
    """(stored flow table, the same as a stream of ``BATCHES`` batches), dealt by a digest of the flow key."""
    path, flows = scratch_path(prepare(spark), "flow-batches"), _flows(spark, sf_dir)
    number = ev.hash_fold(BATCHES)
    for i in range(BATCHES):
        flows.filter(number == i).coalesce(1).write.mode("append").parquet(path)
    return flows, spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def stream_alerts_kept(spark, sf_dir):
    """Alerts of batches, each judged with the source columns kept from all batches so far."""
    flows, stream = _flow_batches(spark, sf_dir)
    detector = sd.fit_detector(flows, materialize(pf.baseline_thresholds(flows), "thresholds"))
    kept = scratch_path(spark, "kept-alerts")
    sio.run_batches(stream, sd.alert_batches(kept, detector, every=2), scratch_path(spark, "stream")).awaitTermination()
    found = sd.read_alerts(spark, kept)
    return plain(found.select(*FLOW_KEY, "threat_label", "severity", "final_threat_score", "triggered_rules"))


@query
def stream_sources(spark, sf_dir):
    """Source columns kept up over several batches."""
    _, stream = _flow_batches(spark, sf_dir)
    kept = scratch_path(spark, "kept-sources")

    def fold(batch, batch_id):
        sd.source_table(batch.sparkSession, kept, every=3).append(sd.source_deltas(batch), batch_id)

    sio.run_batches(stream, fold, scratch_path(spark, "stream")).awaitTermination()
    return sd.source_features(sd.source_table(spark, kept).read())


@query
def baseline_incremental(spark, sf_dir):
    """Thresholds from sketches that a stream kept per tenth of a second: whether their ranks are within the error."""
    flows, stream = _flow_batches(spark, sf_dir)
    kept = scratch_path(spark, "kept-baselines")
    tenth = F.floor(F.unix_micros("first_seen") / 100_000)

    def fold(batch, batch_id):
        bl.baseline_table(batch.sparkSession, kept, every=3).append(bl.period_sketches(batch, tenth), batch_id)

    sio.run_batches(stream, fold, scratch_path(spark, "stream")).awaitTermination()
    table = bl.baseline_table(spark, kept).read()
    ranks = bl.threshold_ranks(flows, bl.sketched_thresholds(table))
    within = (F.col("low") <= F.col("q") + bl.RANK_ERROR) & (F.col("high") >= F.col("q") - bl.RANK_ERROR)
    counted = table.agg(F.sum("flows").alias("flows"), F.count("*").alias("periods")).first()
    return ranks.select("column", "q", within.alias("within"), F.lit(counted["flows"]).alias("flows"), F.lit(counted["periods"]).alias("periods"))


# Forest and explanations: fitted forests, and one given as text where its explanations are compared


@query
def isolation_forest_scores(spark, sf_dir):
    forest, raw = fo.fit_and_score(_flows(spark, sf_dir))
    return _rounded(fo.decide(raw, forest)).select(*FLOW_KEY, "iforest_score")


@query
def isolation_forest_labels(spark, sf_dir):
    forest, raw = fo.fit_and_score(_flows(spark, sf_dir))
    return pf.value_counts(fo.decide(raw, forest), "iforest_label")


def _rounded(scored):
    return scored.withColumn("iforest_score", round_half_up(F.col("iforest_score"), 6))


def _fixed_scored(spark, sf_dir):
    """Enriched flows scored by the forest given as text, which SQL can repeat."""
    return fo.score_isolation_forest(detect.enriched_flows(_flows(spark, sf_dir)), fixed_forest(spark))


@query
def fixed_forest_scores(spark, sf_dir):
    return _rounded(_fixed_scored(spark, sf_dir)).select(*FLOW_KEY, "iforest_score", "iforest_label")


@query
def fixed_forest_labels(spark, sf_dir):
    return pf.value_counts(_fixed_scored(spark, sf_dir), "iforest_label")


@query
def ml_anomalies(spark, sf_dir):
    return _rounded(scoring.ml_anomalies(_fixed_scored(spark, sf_dir))).select(*FLOW_KEY, "iforest_score", "suspicion_score")


@query
def rule_only_hits(spark, sf_dir):
    """From three flags on. The tables have next to no such flow, so every third flow with a flag is given two more."""
    scored = _fixed_scored(spark, sf_dir)
    raised = scored.withColumn("suspicion_score", F.when(
        (F.col("src_port") % 3 == 0) & (F.col("suspicion_score") > 0), F.col("suspicion_score") + 2
    ).otherwise(F.col("suspicion_score")))
    hits = scoring.rule_only_hits(raised)
    return _rounded(hits).select(*FLOW_KEY, "iforest_score", "suspicion_score")


@query
def ml_only_hits(spark, sf_dir):
    return _rounded(scoring.ml_only_hits(_fixed_scored(spark, sf_dir)))


@query
def score_fusion(spark, sf_dir):
    """The fixed model's score joined by flow key, turned around, scaled and fused."""
    flows = _flows(spark, sf_dir)
    scores = materialize(
        fo.score_isolation_forest(flows, fixed_forest(spark)).select(*FLOW_KEY, "first_seen", "iforest_score"), "scores"
    )
    fused = scoring.fuse_scores(materialize(scoring.attach_ml_score(detect.enriched_flows(flows), scores), "joined"))
    return fused.select(*FLOW_KEY, "ml_score_normalized", "final_threat_score")


@query
def forest_invariants(spark, sf_dir):
    """What must hold of any fitted forest: trees, samples, share of anomalies, additive explanations."""
    model, raw = fo.fit_and_score(_flows(spark, sf_dir))
    base = shapley.explainer(model)[0]
    told = shapley.shapley_arrays(raw, model)
    norm = float(fo.average_path(256))
    path = -F.log2(-F.col(f"raw_{fo.FULL}")) * norm
    gap = F.abs(F.aggregate("shap", F.lit(base), lambda a, x: a + x) + path)
    offset = model.meta.first()["offsets"][fo.FULL]
    grown = one_row(model.nodes.filter("node = 0"), trees=F.count("*"), root_cover=F.sum("cover"))
    low = F.count_if(F.col(f"raw_{fo.FULL}") < offset)
    return told.agg(
        F.lit(grown["trees"]).cast("bigint").alias("trees"), F.lit(grown["root_cover"]).cast("bigint").alias("root_cover"),
        F.count("*").alias("flows"), (low <= F.ceil(F.count("*") * fo.CONTAMINATION)).alias("anomalies_fit"),
        (F.max(gap) < 1e-6).alias("additive"),
    )


@query
def forest_score_fusion(spark, sf_dir):
    """The model score joined by flow key, turned around, scaled and fused."""
    flows = _flows(spark, sf_dir)
    forest, raw = fo.fit_and_score(flows)
    scores = fo.decide(raw, forest).select(*FLOW_KEY, "first_seen", "iforest_score")
    joined = scoring.attach_ml_score(detect.enriched_flows(flows), scores)
    fused = scoring.fuse_scores(materialize(joined, "joined"))
    return fused.select(*FLOW_KEY, "ml_score_normalized", "final_threat_score", "threat_score_band")


@query
def forest_alerts(spark, sf_dir):
    labelled = detect.labelled_flows(_flows(spark, sf_dir), model="forest")
    return plain(al.published(al.generate_alerts(labelled)))


@query
def model_retrain(spark, sf_dir):
    """Fit, store, load, score with the loaded model."""
    flows = _flows(spark, sf_dir)
    model = models.retrain(flows, scratch_path(spark, "model"))
    return _rounded(fo.score_isolation_forest(flows, model)).select(*FLOW_KEY, "iforest_score", "iforest_label")


@query
def model_rolling(spark, sf_dir):
    """Three generations, each grown on another third of the flows; the last one scores all of them."""
    flows = materialize(_flows(spark, sf_dir).withColumn("part", ev.hash_fold(3)), "parted")
    parts = [flows.filter(F.col("part") == i).drop("part") for i in range(3)]
    store = models.ModelStore(spark, scratch_path(spark, "models"))
    store.fit(parts[0])
    for part in parts[1:]:
        store.roll(part)
    scored = fo.score_isolation_forest(flows, store.load())
    return _rounded(scored).select(*FLOW_KEY, "iforest_score", "iforest_label")


@query
def shapley_values(spark, sf_dir):
    values = shapley.shapley_values(_flows(spark, sf_dir), fixed_forest(spark))
    return plain(values.withColumn("shap", round_half_up(F.col("shap"), 6)))


@query
def forest_shapley_values(spark, sf_dir):
    flows = _flows(spark, sf_dir)
    values = shapley.shapley_values(flows, fo.fit_forest(flows))
    return plain(values.withColumn("shap", round_half_up(F.col("shap"), 6)))


@query
def global_importance(spark, sf_dir):
    ranked = shapley.rank_importance(shapley.global_importance(_flows(spark, sf_dir), fixed_forest(spark)))
    return ranked.withColumn("importance", round_half_up(F.col("importance"), 6))


def _explanations(spark, sf_dir, limit=None):
    flows = _flows(spark, sf_dir)
    raised = al.generate_alerts(detect.labelled_flows(flows))
    return raised, explain.explain_alerts(raised, flows, fixed_forest(spark), limit=limit)


def _factors(told):
    """One row per alert and factor."""
    each = told.select("*", F.posexplode("top_features").alias("place", "f"))
    return each.select(
        "alert_id", "severity", "threat_label", "src_ip", "dst_ip", "ml_score", (F.col("place") + 1).alias("place"),
        "f.feature", round_half_up(F.col("f.shap_contribution"), 6).alias("shap_contribution"), "f.actual_value", "f.impact",
    )


@query
def explain_alerts(spark, sf_dir):
    return _factors(_explanations(spark, sf_dir)[1])


@query
def explain_fitted(spark, sf_dir):
    """Critical alerts explained by a forest fitted on all flows."""
    flows = _flows(spark, sf_dir)
    raised = al.generate_alerts(detect.labelled_flows(flows))
    told = explain.explain_alerts(raised, flows, fo.fit_forest(flows))
    return _factors(told).select("alert_id", "place", "feature", "shap_contribution", "actual_value", "impact")


@query
def explain_top_critical(spark, sf_dir):
    return _factors(_explanations(spark, sf_dir, limit=10)[1]).select("alert_id", "place", "feature", "shap_contribution")


@query
def narratives(spark, sf_dir):
    return explain.narratives(_explanations(spark, sf_dir)[1])


@query
def explanation_by_alert(spark, sf_dir):
    raised, told = _explanations(spark, sf_dir)
    return explain.explanation_by_alert(raised, told)


@query
def feature_ablation(spark, sf_dir):
    judged = _judged(spark, sf_dir).select(*FLOW_KEY, "first_seen", *FEATURES, "actual_malicious")
    return ablation.feature_ablation(judged)
