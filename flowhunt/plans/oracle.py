"""Equivalent SQL for the query catalogue, run by another engine to check results.

Each stage of the pipeline is one named CTE; a query is a SELECT over the stages it needs.
"""

from __future__ import annotations

from flowhunt.operators.profile import DESCRIBED
from flowhunt.schemas import FEATURES, FLOW

KEY = "src_ip, dst_ip, src_port, dst_port, protocol"


def _round(value: str, digits: int) -> str:
    return f"(floor(CAST({value} AS DOUBLE) * 1e{digits} + CAST(0.5 AS DOUBLE)) / 1e{digits})"


def _iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%fZ')"


_PACKETS = """
SELECT e.event_id AS packet_id,
  epoch_us(TIMESTAMP '2024-01-01') + CASE WHEN role = 1 THEN rn * 50000
       ELSE (off_us + 500000) // 1000000 END AS us,
  concat('10.', CAST(user_id // 62500 % 250 AS VARCHAR), '.', CAST(user_id // 250 % 250 AS VARCHAR), '.', CAST(user_id % 250 AS VARCHAR)) AS src_ip,
  concat('172.16.0.', CAST(user_id % 7 AS VARCHAR)) AS dst_ip,
  CAST(CASE WHEN role = 2 THEN 40000 + event_id % 20000 ELSE 50000 + user_id % 1000 END AS INTEGER) AS src_port,
  CAST(CASE WHEN role = 0 THEN 1 + event_id % 1024 WHEN role = 1 THEN 443 WHEN role = 2 THEN 22
            WHEN event_type = 'view' THEN 53 WHEN event_type = 'error' THEN 80 ELSE 443 END AS INTEGER) AS dst_port,
  CASE WHEN dns THEN 'UDP' ELSE 'TCP' END AS protocol,
  CAST(floor(value * 1000) AS BIGINT) + 40 AS length,
  CASE WHEN dns THEN CASE WHEN role = 3
       THEN concat(substr(md5(CAST(event_id AS VARCHAR)), 1, 16), '.',
                   substr(md5(CAST(event_id AS VARCHAR)), 17, 16), '.', host)
       ELSE host END END AS dns_query
FROM (SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS off_us, user_id % 10 AS role,
        user_id % 10 NOT IN (0, 1, 2) AND event_type = 'view' AS dns,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) e
CROSS JOIN (SELECT count(*) AS n_pages, min(page_id) AS p0 FROM pages) n
JOIN (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages) h
  ON h.page_id = n.p0 + e.event_id % n.n_pages
"""

_GAPS = f"""
SELECT *, us - lag(us) OVER w AS gap_us, row_number() OVER w AS packet_no
FROM packets WHERE protocol IN ('TCP', 'UDP')
WINDOW w AS (PARTITION BY {KEY} ORDER BY us, packet_id)
"""

def _first_dns(key: str, packets: str) -> str:
    return f"""
SELECT {key}, dns_query FROM (
  SELECT {key}, rtrim(dns_query, '.') AS dns_query,
    row_number() OVER (PARTITION BY {key} ORDER BY us, packet_id) AS r
  FROM {packets} WHERE rtrim(dns_query, '.') <> '') WHERE r = 1
"""


_ENTROPY = """
SELECT dns_query, -sum(p * log2(p)) AS bits FROM (
  SELECT dns_query, count(*) / CAST(length(dns_query) AS DOUBLE) AS p FROM (
    SELECT dns_query, unnest(string_split(dns_query, '')) AS c
    FROM (SELECT DISTINCT dns_query FROM first_dns)) GROUP BY dns_query, c) GROUP BY dns_query
"""


def _flows(key: str, gaps: str) -> str:
    return f"""
SELECT g.*, make_timestamp(first_us) AS first_seen, make_timestamp(last_us) AS last_seen,
  (last_us - first_us) / 1e6 AS duration,
  {_round("total_bytes / packet_count", 2)} AS avg_packet_size,
  coalesce(min_us, 0) / 1e6 AS min_iat, coalesce(max_us, 0) / 1e6 AS max_iat,
  coalesce(floor(mean_us + CAST(0.5 AS DOUBLE)), 0) / 1e6 AS mean_iat,
  coalesce(floor(std_us + CAST(0.5 AS DOUBLE)), 0) / 1e6 AS std_iat,
  CASE WHEN last_us > first_us THEN {_round("total_bytes * 1e6 / (last_us - first_us)", 2)} ELSE 0.0::DOUBLE END AS bytes_per_second,
  CASE WHEN last_us > first_us THEN {_round("packet_count * 1e6 / (last_us - first_us)", 2)} ELSE 0.0::DOUBLE END AS packets_per_second,
  {_round("total_bytes / packet_count", 2)} AS avg_bytes_per_packet,
  CAST(coalesce(length(d.dns_query), 0) AS INTEGER) AS dns_query_length,
  CAST(coalesce(length(d.dns_query) - length(replace(d.dns_query, '.', '')), 0) AS INTEGER) AS dns_subdomain_depth,
  coalesce({_round("e.bits", 3)}, 0) AS dns_entropy
FROM (SELECT {key}, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS total_bytes,
        min(us) AS first_us, max(us) AS last_us, min(gap_us) AS min_us, max(gap_us) AS max_us,
        avg(gap_us) AS mean_us, stddev_pop(gap_us) AS std_us FROM {gaps} GROUP BY {key}) g
LEFT JOIN first_dns d USING ({key}) LEFT JOIN entropy e ON e.dns_query = d.dns_query
"""


_THRESHOLDS = """
SELECT quantile_cont(packet_count, 0.99) AS t_packets, quantile_cont(duration, 0.99) AS t_duration,
  quantile_cont(dns_entropy, 0.95) AS t_entropy FROM flows
"""

_ENRICHED = """
SELECT *, CAST(flag_high_packet AS INTEGER) + CAST(flag_long_duration AS INTEGER)
  + CAST(flag_high_dns_entropy AS INTEGER) + CAST(flag_deep_dns AS INTEGER) AS suspicion_score
FROM (SELECT flows.*, packet_count > t_packets AS flag_high_packet, duration > t_duration AS flag_long_duration,
        dns_entropy > t_entropy AS flag_high_dns_entropy, dns_subdomain_depth >= 4 AS flag_deep_dns
      FROM flows, thresholds)
"""

_ENTITIES = """
SELECT src_ip, count(DISTINCT dst_port) AS dst_port_count, count(*) AS connection_count,
  floor(sum(CAST(floor(duration * 1e6 + CAST(0.5 AS DOUBLE)) AS BIGINT)) / count(*) + CAST(0.5 AS DOUBLE)) / 1e6 AS avg_duration,
  CAST(sum(total_bytes) AS BIGINT) AS bytes_sent,
  coalesce(max(CASE WHEN packet_count >= 5 AND mean_iat > 0
                    THEN 1 - least(1.0::DOUBLE, std_iat / mean_iat) END), 0) AS periodicity_score
FROM flows GROUP BY src_ip
"""

_STATS = "SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in FEATURES) + " FROM flows"


def _z(c: str) -> str:
    return f"CASE WHEN {c}_s = 0 THEN 0.0::DOUBLE ELSE (x.{c} - {c}_m) / {c}_s END"


_SCORED = f"""
SELECT *, {_round("0.6::DOUBLE * rule_score_normalized + 0.4::DOUBLE * ml_score_normalized", 6)} AS final_threat_score
FROM (SELECT *,
    CASE WHEN ml_hi = ml_lo THEN 0.0::DOUBLE ELSE {_round("(ml_anomaly_score - ml_lo) / (ml_hi - ml_lo)", 6)} END AS ml_score_normalized,
    CASE WHEN ru_hi = ru_lo THEN 0.0::DOUBLE ELSE {_round("(suspicion_score - ru_lo) / CAST(ru_hi - ru_lo AS DOUBLE)", 6)} END AS rule_score_normalized
  FROM (SELECT *, min(ml_anomaly_score) OVER () AS ml_lo, max(ml_anomaly_score) OVER () AS ml_hi,
          min(suspicion_score) OVER () AS ru_lo, max(suspicion_score) OVER () AS ru_hi
        FROM (SELECT x.*, {_round("(" + " + ".join(f"abs({_z(c)})" for c in FEATURES) + f") / {len(FEATURES)}", 6)} AS ml_anomaly_score
              FROM enriched x, stats)))
"""

_LABELLED = """
SELECT scored.*, entities.* EXCLUDE (src_ip),
  CASE WHEN dst_port_count >= 20 THEN 'PORT_SCAN'
       WHEN connection_count >= 30 AND avg_duration < 1 THEN 'BRUTE_FORCE'
       WHEN bytes_sent >= 5000000 THEN 'DATA_EXFIL'
       WHEN periodicity_score >= 0.8 THEN 'C2_BEACON'
       WHEN dns_query_length >= 50 THEN 'DNS_TUNNEL'
       WHEN final_threat_score >= 0.6 THEN 'SUSPICIOUS_TRAFFIC' ELSE 'BENIGN' END AS threat_label,
  CASE user_role WHEN 0 THEN 'PORT_SCAN' WHEN 1 THEN 'C2_BEACONING' WHEN 2 THEN 'BRUTE_FORCE'
       WHEN 3 THEN 'DNS_TUNNELING' ELSE 'BENIGN' END AS truth_label,
  CAST(user_role IN (0, 1, 2, 3) AS INTEGER) AS actual_malicious
FROM (SELECT *, CAST(split_part(src_ip, '.', 4) AS BIGINT) % 10 AS user_role
      FROM scored) scored JOIN entities USING (src_ip)
"""

_RULED = """
SELECT *, concat_ws(',', CASE WHEN scans THEN 'PORT_SCAN' END, CASE WHEN beacons THEN 'DNS_BEACONING' END) AS triggered_rules,
  CAST(scans AS INTEGER) + CAST(beacons AS INTEGER) AS n_rules,
  CASE WHEN scans THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN beacons THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS rule_boost,
  concat_ws(', ', CASE WHEN scans THEN 'high destination port diversity' END,
            CASE WHEN beacons THEN 'suspicious high-entropy, repetitive DNS queries' END) AS rule_indicators
FROM (SELECT *, dst_port_count >= 20 AS scans,
        upper(protocol) = 'UDP' AND dst_port = 53 AND packets_per_second > 5
        AND (dns_entropy > 3.5 OR flag_high_dns_entropy) AND (dns_subdomain_depth >= 3 OR flag_deep_dns) AS beacons
      FROM labelled)
"""


def _alert_severity(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 0.0 AND {score} < 0.3 THEN 'LOW' WHEN {score} >= 0.3 AND {score} < 0.6 THEN 'MEDIUM' "
        f"WHEN {score} >= 0.6 AND {score} < 0.8 THEN 'HIGH' WHEN {score} >= 0.8 AND {score} < 1.01 THEN 'CRITICAL' ELSE 'UNKNOWN' END"
    )


_ALERTS = f"""
SELECT *, concat('ALERT-', CASE WHEN alert_no < 10000 THEN lpad(CAST(alert_no AS VARCHAR), 4, '0') ELSE CAST(alert_no AS VARCHAR) END) AS alert_id,
  concat(severity, ' alert: ', threat_label, ' from ', src_ip, ':', src_port, ' → ', dst_ip, ':', dst_port, ' over ', protocol) AS summary
FROM (SELECT *, {_alert_severity("boosted")} AS severity, {_round("boosted", 3)} AS alert_score,
    {_round("least(least(boosted, 1.0::DOUBLE) + 0.1::DOUBLE * n_rules, 1.0::DOUBLE)", 2)} AS confidence,
    concat(threat_label, ' detected due to: ', concat_ws(', ', indicators, nullif(rule_indicators, ''))) AS reason
  FROM (SELECT *, least(final_threat_score + rule_boost, 1.0::DOUBLE) AS boosted,
      {_iso("last_seen")} AS "timestamp",
      CASE WHEN lower(threat_label) LIKE '%scan%' THEN 'port_scan' WHEN lower(threat_label) LIKE '%beacon%' THEN 'beaconing'
           WHEN lower(threat_label) LIKE '%dos%' THEN 'denial_of_service' WHEN lower(threat_label) LIKE '%malware%' THEN 'malware_activity'
           ELSE 'anomalous_flow' END AS threat_type,
      coalesce(nullif(concat_ws(', ', CASE WHEN packet_count > 1000 THEN 'high packet count' END,
        CASE WHEN duration < 1 THEN 'short-lived high-volume flow' END,
        CASE WHEN mean_iat < 0.01 THEN 'low inter-arrival variance' END), ''), 'statistical anomaly in flow behavior') AS indicators,
      row_number() OVER (ORDER BY last_us, first_us, {KEY}) AS alert_no
    FROM ruled WHERE threat_label <> 'BENIGN'))
"""

_EXPLODED = """
SELECT coalesce(src_ip, 'unknown') AS entity, unnest(CASE WHEN n_rules = 0 THEN ['NO_RULE'] ELSE string_split(triggered_rules, ',') END) AS rule,
  alert_no, alert_id, "timestamp", last_seen, severity, alert_score,
  CASE severity WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'CRITICAL' THEN 3 ELSE -1 END AS ordinal
FROM alerts
"""

_INCIDENTS = """
SELECT entity, rule, count(*) AS alert_count,
  ['UNKNOWN', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(ordinal) + 2] AS max_severity,
  floor(sum(CAST(floor(alert_score * 1000 + CAST(0.5 AS DOUBLE)) AS BIGINT)) / count(*) + CAST(0.5 AS DOUBLE)) / 1000.0::DOUBLE AS avg_score,
  min("timestamp") AS first_seen, max("timestamp") AS last_seen
FROM exploded GROUP BY entity, rule
"""

_MOVES = """
SELECT *, row_number() OVER w AS seq, lag(severity) OVER w AS previous_severity, lag(ordinal) OVER w AS previous_ordinal
FROM exploded WINDOW w AS (PARTITION BY entity, rule ORDER BY alert_no)
"""

_EVENTS = """
SELECT *, CASE WHEN previous_ordinal IS NULL THEN 'first' WHEN ordinal > previous_ordinal THEN 'up'
               WHEN ordinal < previous_ordinal THEN 'down' ELSE 'same' END AS direction,
  concat(strftime(last_seen, '%H:%M:%S'), ' — ', CASE WHEN previous_severity <> severity THEN concat('Severity escalated to ', severity)
    ELSE concat(rule, ' detected (score: ', CAST(alert_score AS VARCHAR), ')') END) AS event
FROM moves
"""

_CAMPAIGNS = """
SELECT *, CASE WHEN alert_count >= 5 THEN 'active_campaign' WHEN alert_count >= 2 THEN 'repeated_activity' ELSE 'single_event' END AS campaign_type
FROM incidents
"""

_SCORE_COUNTS = """
SELECT final_threat_score AS score, CAST(sum(actual_malicious) AS BIGINT) AS positives, CAST(sum(1 - actual_malicious) AS BIGINT) AS negatives
FROM labelled GROUP BY final_threat_score
"""

_RUNNING = """
SELECT score AS threshold, CAST(sum(positives) OVER w AS BIGINT) AS tp, CAST(sum(negatives) OVER w AS BIGINT) AS fp,
  CAST(sum(positives) OVER () AS BIGINT) AS p, CAST(sum(negatives) OVER () AS BIGINT) AS n
FROM score_counts WINDOW w AS (ORDER BY score DESC)
"""

_AUC = f"""
SELECT {_round("sum(positives * (below + negatives / 2.0::DOUBLE)) / (sum(positives)::DOUBLE * sum(negatives)::DOUBLE)", 6)} AS auc_roc
FROM (SELECT *, coalesce(sum(negatives) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below FROM score_counts)
"""

_STAGES = {
    "packets": _PACKETS, "gaps": _GAPS, "first_dns": _first_dns(KEY, "packets"), "entropy": _ENTROPY, "flows": _flows(KEY, "gaps"),
    "thresholds": _THRESHOLDS, "enriched": _ENRICHED, "entities": _ENTITIES, "stats": _STATS, "scored": _SCORED,
    "labelled": _LABELLED, "ruled": _RULED, "alerts": _ALERTS, "exploded": _EXPLODED, "incidents": _INCIDENTS,
    "moves": _MOVES, "events_text": _EVENTS, "campaigns": _CAMPAIGNS, "score_counts": _SCORE_COUNTS,
    "running": _RUNNING, "auc": _AUC,
}


def _query(last: str, select: str, stages: dict[str, str] = _STAGES) -> str:
    """``select`` over all stages up to ``last``."""
    names = list(stages)[: list(stages).index(last) + 1]
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({stages[n].strip()})" for n in names)
    return f"WITH {ctes}\n{select}"


def _cells(predicted: str) -> str:
    def cell(actual: int, hit: bool, name: str) -> str:
        sign = predicted if hit else f"NOT ({predicted})"
        return f"CAST(coalesce(sum(CASE WHEN actual_malicious = {actual} AND {sign} THEN 1 ELSE 0 END), 0) AS BIGINT) AS {name}"

    return ", ".join([
        cell(0, False, "true_negatives"), cell(0, True, "false_positives"),
        cell(1, False, "false_negatives"), cell(1, True, "true_positives"),
    ])


def _rates() -> str:
    tn, fp, fn, tp = "true_negatives", "false_positives", "false_negatives", "true_positives"
    shares = {
        "accuracy": (f"{tp} + {tn}", f"{tp} + {tn} + {fp} + {fn}"),
        "precision": (tp, f"{tp} + {fp}"),
        "recall": (tp, f"{tp} + {fn}"),
        "f1_score": (f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"),
        "fpr": (fp, f"{fp} + {tn}"),
        "fnr": (fn, f"{fn} + {tp}"),
        "specificity": (tn, f"{tn} + {fp}"),
    }
    return ", ".join(
        f"CASE WHEN {w} > 0 THEN {_round(f'({p}) / ({w})', 6)} ELSE 0.0::DOUBLE END AS {n}"
        for n, (p, w) in shares.items()
    )


def _bootstrap(replicates: int = 200, buckets: int = 4096, seed: int = 42) -> str:
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(1, 13):
        total += term
        term /= k
        steps.append(f"CASE WHEN u >= CAST({total!r} AS DOUBLE) THEN 1 ELSE 0 END")
    metrics = ["accuracy", "precision", "recall", "f1_score", "fpr"]
    each = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value FROM rated" for m in metrics)
    return f"""
SELECT metric, {_round("avg(value)", 6)} AS mean, {_round("quantile_cont(value, 0.025)", 6)} AS low,
  {_round("quantile_cont(value, 0.975)", 6)} AS high, count(*) AS replicates FROM (
  WITH cells AS (SELECT CAST(('0x' || substr(md5(concat_ws('|', {KEY})), 1, 8))::BIGINT % {buckets} AS BIGINT) AS bucket,
      actual_malicious, CAST(final_threat_score > 0.6 AS INTEGER) AS hit, count(*) AS n FROM labelled GROUP BY 1, 2, 3),
  drawn AS (SELECT *, ('0x' || substr(md5(concat_ws('|', bucket, replicate, {seed})), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
    FROM cells, range({replicates}) r(replicate)),
  weighed AS (SELECT *, n * ({" + ".join(steps)}) AS w FROM drawn),
  summed AS (SELECT replicate,
      CAST(sum(CASE WHEN actual_malicious = 0 AND hit = 0 THEN w ELSE 0 END) AS BIGINT) AS true_negatives,
      CAST(sum(CASE WHEN actual_malicious = 0 AND hit = 1 THEN w ELSE 0 END) AS BIGINT) AS false_positives,
      CAST(sum(CASE WHEN actual_malicious = 1 AND hit = 0 THEN w ELSE 0 END) AS BIGINT) AS false_negatives,
      CAST(sum(CASE WHEN actual_malicious = 1 AND hit = 1 THEN w ELSE 0 END) AS BIGINT) AS true_positives
    FROM weighed GROUP BY replicate),
  rated AS (SELECT *, {_rates()} FROM summed)
  {each}) GROUP BY metric"""


_FLOW_TEXT = f"{KEY}, {_iso('first_seen')} AS first_seen, {_iso('last_seen')} AS last_seen, " + ", ".join(FEATURES)
_FLAGS = "flag_high_packet, flag_long_duration, flag_high_dns_entropy, flag_deep_dns, suspicion_score"
_ALERT_TEXT = (
    'alert_id, "timestamp", src_ip, dst_ip, src_port, dst_port, protocol, threat_label, threat_type, severity, '
    "alert_score AS final_threat_score, confidence, triggered_rules, reason, summary"
)
_PACKET_TEXT = f"packet_id, {_iso('make_timestamp(us)')} AS ts, {KEY}, length, dns_query"


def _describe(stage: str, columns: list[str], percentiles: dict[str, float]) -> str:
    parts = []
    for c in columns:
        quantiles = ", ".join(f"{_round(f'quantile_cont({c}, {q})', 6)} AS {n}" for n, q in percentiles.items())
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", {_round(f'avg({c})', 6)} AS mean, "
            f"{_round(f'stddev_samp({c})', 6)} AS std, {_round(f'min({c})', 6)} AS \"min\", {quantiles}, "
            f"{_round(f'max({c})', 6)} AS \"max\" FROM {stage}"
        )
    return " UNION ALL ".join(parts)


def _profile() -> str:
    return " UNION ALL ".join(
        f"SELECT '{f.name}' AS \"column\", '{f.dataType.simpleString()}' AS data_type, count(*) AS \"rows\", "
        f"count(*) - count({f.name}) AS nulls FROM flows" for f in FLOW.fields
    )


_PERCENTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}
_QUARTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75}
_DETECTION = f"""
SELECT m.*, auc.auc_roc, 0.6::DOUBLE AS threshold, true_negatives + false_positives + false_negatives + true_positives AS total_flows,
  true_positives + false_negatives AS actual_malicious, true_positives + false_positives AS predicted_malicious,
  CASE WHEN recall > 0.85 THEN 'EXCELLENT' WHEN recall > 0.70 THEN 'GOOD' ELSE 'NEEDS_IMPROVEMENT' END AS recall_verdict,
  CASE WHEN fpr < 0.05 THEN 'EXCELLENT' WHEN fpr < 0.10 THEN 'GOOD' ELSE 'HIGH_FALSE_POSITIVES' END AS fpr_verdict
FROM (SELECT *, {_rates()} FROM (SELECT {_cells("final_threat_score > 0.6")} FROM labelled)) m, auc
"""
_CRITICAL = "SELECT DISTINCT src_ip FROM alerts WHERE severity = 'CRITICAL'"

# Streamed flows have no source columns: only names, scores and the DNS rule can speak.
_STREAMED = f"""
SELECT *, {_alert_severity("boosted")} AS severity, {_round("boosted", 3)} AS alert_score FROM (
  SELECT *, least(final_threat_score + CASE WHEN beacons THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE) AS boosted,
    CASE WHEN beacons THEN 'DNS_BEACONING' ELSE '' END AS triggered_rules FROM (
    SELECT *, CASE WHEN dns_query_length >= 50 THEN 'DNS_TUNNEL' WHEN final_threat_score >= 0.6 THEN 'SUSPICIOUS_TRAFFIC' ELSE 'BENIGN' END AS threat_label,
      upper(protocol) = 'UDP' AND dst_port = 53 AND packets_per_second > 5
      AND (dns_entropy > 3.5 OR flag_high_dns_entropy) AND (dns_subdomain_depth >= 3 OR flag_deep_dns) AS beacons
    FROM scored) WHERE threat_label <> 'BENIGN')
"""

def _cross_validation(folds: int = 5) -> str:
    """Every fold k judged by what the flows of all other folds fit."""
    z = " + ".join(f"abs(CASE WHEN {c}_s = 0 THEN 0.0::DOUBLE ELSE (f.{c} - {c}_m) / {c}_s END)" for c in FEATURES)
    moments = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in FEATURES)
    return f"""
SELECT *, {_rates()} FROM (
  SELECT fold, {_cells("final > 0.6")} FROM (
    SELECT fold, actual_malicious, {_round("0.6::DOUBLE * rule_n + 0.4::DOUBLE * ml_n", 6)} AS final FROM (
      SELECT fold, actual_malicious,
        CASE WHEN ml_lo = ml_hi THEN 0.0::DOUBLE ELSE {_round("(ml - ml_lo) / (ml_hi - ml_lo)", 6)} END AS ml_n,
        CASE WHEN rule_lo = rule_hi THEN 0.0::DOUBLE ELSE {_round("(rule - rule_lo) / CAST(rule_hi - rule_lo AS DOUBLE)", 6)} END AS rule_n
      FROM (
        SELECT *, min(ml) FILTER (fold <> k) OVER (PARTITION BY k) AS ml_lo, max(ml) FILTER (fold <> k) OVER (PARTITION BY k) AS ml_hi,
          min(rule) FILTER (fold <> k) OVER (PARTITION BY k) AS rule_lo, max(rule) FILTER (fold <> k) OVER (PARTITION BY k) AS rule_hi
        FROM (
          SELECT fold, k, actual_malicious, {_round(f"({z}) / {len(FEATURES)}", 6)} AS ml,
            CAST(packet_count > t_packets AS INTEGER) + CAST(duration > t_duration AS INTEGER) + CAST(dns_entropy > t_entropy AS INTEGER)
              + CAST(dns_subdomain_depth >= 4 AS INTEGER) AS rule
          FROM (SELECT *, CAST(('0x' || substr(md5(concat_ws('|', {KEY})), 1, 8))::BIGINT % {folds} AS BIGINT) AS fold,
                  CAST(CAST(split_part(src_ip, '.', 4) AS BIGINT) % 10 IN (0, 1, 2, 3) AS INTEGER) AS actual_malicious FROM flows) f
          JOIN (SELECT k, {moments}, quantile_cont(packet_count, 0.99) AS t_packets, quantile_cont(duration, 0.99) AS t_duration,
                  quantile_cont(dns_entropy, 0.95) AS t_entropy
                FROM (SELECT *, CAST(('0x' || substr(md5(concat_ws('|', {KEY})), 1, 8))::BIGINT % {folds} AS BIGINT) AS fold FROM flows), range({folds}) u(k)
                WHERE fold <> k GROUP BY k) ON TRUE))
      WHERE fold = k)) GROUP BY fold)
"""


ORACLE: dict[str, str] = {
    "stream_flows": _query("flows", f"SELECT {_FLOW_TEXT} FROM flows"),
    "stream_alerts": _query(
        "alerts", f"SELECT {KEY}, threat_label, severity, alert_score AS final_threat_score, triggered_rules FROM alerts"
    ),
    "stream_alerts_alone": _query(
        "scored", f"SELECT {KEY}, threat_label, severity, alert_score AS final_threat_score, triggered_rules FROM ({_STREAMED})"
    ),
    "stream_sessions": _query(
        "gaps",
        f"SELECT {KEY}, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS total_bytes, "
        f"{_iso('make_timestamp(min(us))')} AS first_seen, {_iso('make_timestamp(max(us))')} AS last_seen, "
        f"(max(us) - min(us)) / 1e6 AS duration FROM (SELECT *, sum(CASE WHEN gap_us > 200000 THEN 1 ELSE 0 END) "
        f"OVER (PARTITION BY {KEY} ORDER BY us, packet_id) AS session_no FROM gaps) GROUP BY {KEY}, session_no",
    ),
    "stream_incidents": _query("incidents", "SELECT * FROM incidents"),
    "packet_gate": _query("packets", f"SELECT {_PACKET_TEXT} FROM packets WHERE protocol IN ('TCP', 'UDP') AND packet_id % 17 <> 0"),
    "packet_filter": _query(
        "packets",
        f"SELECT {_PACKET_TEXT} FROM packets WHERE protocol = 'UDP' AND (src_port = 53 OR dst_port = 53) "
        "AND (src_ip = '172.16.0.3' OR dst_ip = '172.16.0.3')",
    ),
    "packet_stats": _query(
        "flows",
        "SELECT count(*) AS total_packets, count(*) FILTER (protocol = 'TCP') AS tcp_packets, "
        "count(*) FILTER (protocol = 'UDP') AS udp_packets, "
        "count(*) FILTER (protocol = 'UDP' AND (src_port = 53 OR dst_port = 53)) AS dns_packets, "
        "(SELECT count(*) FROM flows) AS exported_flows, "
        "(SELECT count(*) FROM flows WHERE last_us >= (SELECT max(last_us) FROM flows) - 200000) AS active_flows FROM packets",
    ),
    "stream_counters": _query(
        "packets",
        f"SELECT {_iso('make_timestamp((us // 100000) * 100000)')} AS window_start, count(*) AS total_packets, "
        "count(*) FILTER (protocol = 'TCP') AS tcp_packets, count(*) FILTER (protocol = 'UDP') AS udp_packets, "
        "count(*) FILTER (protocol = 'UDP' AND (src_port = 53 OR dst_port = 53)) AS dns_packets "
        "FROM packets GROUP BY us // 100000",
    ),
    "capture_decode": _query("packets", f"SELECT {_PACKET_TEXT} FROM packets"),
    "capture_files": _query("packets", f"SELECT {_PACKET_TEXT.removeprefix('packet_id, ')} FROM packets"),
    "inter_arrival": _query("gaps", f"SELECT packet_id, {KEY}, packet_no, gap_us / 1e6 AS iat FROM gaps"),
    "flow_features": _query("flows", f"SELECT {_FLOW_TEXT} FROM flows"),
    "flow_features_collector": _query(
        "flows",
        f"SELECT {KEY}, packet_count, duration, coalesce({_round('e.bits', 4)}, 0) AS dns_entropy "
        f"FROM flows LEFT JOIN first_dns d USING ({KEY}) LEFT JOIN entropy e ON e.dns_query = d.dns_query",
    ),
    "flows_csv": _query("flows", f"SELECT {_FLOW_TEXT} FROM flows"),
    "session_flows": _query(
        "gaps",
        f"SELECT {KEY}, session_no, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS total_bytes, "
        f"{_iso('make_timestamp(min(us))')} AS first_seen, {_iso('make_timestamp(max(us))')} AS last_seen, "
        f"(max(us) - min(us)) / 1e6 AS duration FROM (SELECT *, CAST(1 + sum(CASE WHEN gap_us > 200000 THEN 1 ELSE 0 END) "
        f"OVER (PARTITION BY {KEY} ORDER BY us, packet_id) AS BIGINT) AS session_no FROM gaps) GROUP BY {KEY}, session_no",
    ),
    "first_dns_query": _query("first_dns", f"SELECT {KEY}, dns_query FROM first_dns"),
    "dns_entropy_depth": _query(
        "entropy",
        f"SELECT {KEY}, d.dns_query, CAST(length(d.dns_query) AS INTEGER) AS dns_query_length, "
        "CAST(length(d.dns_query) - length(replace(d.dns_query, '.', '')) AS INTEGER) AS dns_subdomain_depth, "
        f"{_round('e.bits', 3)} AS dns_entropy FROM first_dns d JOIN entropy e ON e.dns_query = d.dns_query",
    ),
    "describe_flows": _query("flows", _describe("flows", DESCRIBED, _PERCENTILES)),
    "describe_scores": _query(
        "scored", _describe("scored", ["ml_score_normalized", "rule_score_normalized", "final_threat_score"], _QUARTILES)
    ),
    "null_profile": _query("flows", _profile()),
    "baseline_thresholds": _query(
        "thresholds",
        f"SELECT {_round('t_packets', 6)} AS packet_count, {_round('t_duration', 6)} AS duration, "
        f"{_round('t_entropy', 6)} AS dns_entropy FROM thresholds",
    ),
    "baseline_flags": _query("enriched", f"SELECT {KEY}, {_FLAGS} FROM enriched"),
    "suspicion_counts": _query("enriched", 'SELECT suspicion_score, count(*) AS "count" FROM enriched GROUP BY suspicion_score'),
    "entity_features": _query("entities", "SELECT * FROM entities"),
    "attach_entities": _query(
        "entities",
        f"SELECT {KEY}, dst_port_count, connection_count, avg_duration, bytes_sent, periodicity_score FROM flows JOIN entities USING (src_ip)",
    ),
    "beacon_intervals": _query(
        "packets",
        "SELECT src_ip, dst_ip, count(gap) AS intervals, floor(avg(gap) + CAST(0.5 AS DOUBLE)) / 1e6 AS mean_interval, "
        "coalesce(floor(stddev_samp(gap) + CAST(0.5 AS DOUBLE)), 0) / 1e6 AS std_interval FROM "
        "(SELECT src_ip, dst_ip, us - lag(us) OVER (PARTITION BY src_ip, dst_ip ORDER BY us) AS gap FROM packets) "
        "GROUP BY src_ip, dst_ip HAVING count(gap) > 0",
    ),
    "feature_vector": _query("flows", f"SELECT {', '.join(FEATURES)} FROM flows"),
    "minmax_scale": _query("scored", f"SELECT {KEY}, ml_anomaly_score, ml_score_normalized, rule_score_normalized FROM scored"),
    "standard_scale": _query(
        "stats", f"SELECT {KEY}, " + ", ".join(f"{_round(_z(c), 6)} AS {c}" for c in FEATURES) + " FROM flows x, stats"
    ),
    "rule_score_fusion": _query(
        "scored",
        f"SELECT {KEY}, final_threat_score, CASE WHEN final_threat_score >= 0.8 THEN 'CRITICAL' WHEN final_threat_score >= 0.6 THEN 'HIGH' "
        "WHEN final_threat_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS threat_score_band FROM scored",
    ),
    "severity_schemes": _query(
        "scored",
        f"SELECT {KEY}, final_threat_score, CASE WHEN final_threat_score >= 0.8 THEN 'CRITICAL' WHEN final_threat_score >= 0.6 THEN 'HIGH' "
        "WHEN final_threat_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS threat_score_band, "
        "CASE WHEN final_threat_score >= 0.6 THEN 'HIGH' WHEN final_threat_score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS severity, "
        f"{_alert_severity('final_threat_score')} AS alert_severity FROM scored",
    ),
    "threat_labels": _query("labelled", f"SELECT {KEY}, final_threat_score, threat_label FROM labelled"),
    "label_counts": _query("labelled", 'SELECT threat_label, count(*) AS "count" FROM labelled GROUP BY threat_label'),
    "rules_port_scan": _query("ruled", f"SELECT {KEY}, dst_port_count FROM ruled WHERE scans"),
    "rules_dns_beaconing": _query(
        "ruled", f"SELECT {KEY}, packets_per_second, dns_entropy, dns_subdomain_depth FROM ruled WHERE beacons"
    ),
    "apply_rules": _query("ruled", f"SELECT {KEY}, triggered_rules, rule_boost, rule_indicators FROM ruled"),
    "rules_documented": _query(
        "labelled",
        f"SELECT * FROM (SELECT {KEY}, concat_ws(',', CASE WHEN dst_port_count > 20 AND packets_per_second > 50 THEN 'PORT_SCAN' END, "
        "CASE WHEN dns_entropy > 4.5 OR dns_subdomain_depth > 4 THEN 'DNS_ABUSE' END, "
        "CASE WHEN packet_count >= 5 AND std_iat < 0.01 THEN 'C2_BEACONING' END, "
        "CASE WHEN bytes_per_second > 10000 AND bytes_sent >= 5000000 THEN 'DATA_EXFILTRATION' END) AS triggered_rules "
        "FROM labelled) WHERE triggered_rules <> ''",
    ),
    "rules_custom": _query(
        "ruled",
        f"SELECT {KEY}, concat_ws(',', nullif(triggered_rules, ''), CASE WHEN connection_count >= 30 AND dst_port = 22 THEN 'SSH_GUESSING' END) AS triggered_rules "
        "FROM ruled WHERE connection_count >= 30 AND dst_port = 22",
    ),
    "alerts": _query("alerts", f"SELECT {_ALERT_TEXT} FROM alerts"),
    "alerts_json": _query("alerts", f"SELECT {_ALERT_TEXT} FROM alerts"),
    "alerts_by_id": _query("alerts", f"SELECT {_ALERT_TEXT} FROM alerts WHERE alert_id = 'ALERT-0007'"),
    "alerts_page": _query(
        "alerts", f"SELECT {_ALERT_TEXT} FROM alerts WHERE severity = 'MEDIUM' ORDER BY alert_no OFFSET 20 LIMIT 20"
    ),
    "critical_alerts": _query("alerts", f"SELECT {_ALERT_TEXT} FROM alerts WHERE severity = 'CRITICAL'"),
    "top_critical": _query(
        "alerts", f"SELECT {_ALERT_TEXT} FROM alerts WHERE severity = 'CRITICAL' ORDER BY alert_no LIMIT 10"
    ),
    "incidents": _query("incidents", "SELECT * FROM incidents"),
    "campaigns": _query("campaigns", "SELECT * FROM campaigns"),
    "severity_transitions": _query(
        "events_text", "SELECT entity, rule, seq, alert_id, severity, previous_severity, direction FROM events_text"
    ),
    "timeline_events": _query("events_text", "SELECT entity, rule, seq, alert_id, direction, event FROM events_text"),
    "timelines": _query(
        "campaigns",
        "SELECT entity, rule, campaign_type, CAST(page AS BIGINT) AS page, timeline FROM (SELECT entity, rule, (seq - 1) // 25 + 1 AS page, "
        "string_agg(event, chr(10) ORDER BY seq) AS timeline FROM events_text GROUP BY entity, rule, (seq - 1) // 25 + 1) "
        "JOIN campaigns USING (entity, rule)",
    ),
    "severity_distribution": _query("alerts", "SELECT severity, count(*) AS alerts FROM alerts GROUP BY severity"),
    "top_sources": _query(
        "alerts",
        "SELECT src_ip, count(*) AS alerts, max(alert_score) AS max_score FROM alerts GROUP BY src_ip ORDER BY count(*) DESC, src_ip LIMIT 10",
    ),
    "alerts_over_time": _query(
        "alerts",
        f"SELECT {_iso('make_timestamp((last_us // 100000) * 100000)')} AS bucket, severity, count(*) AS alerts FROM alerts GROUP BY last_us // 100000, severity",
    ),
    "alert_summary": _query(
        "alerts", "SELECT threat_label, severity, count(*) AS alerts FROM alerts GROUP BY ROLLUP (threat_label, severity)"
    ),
    "topology_edges": _query(
        "flows",
        "SELECT src_ip, dst_ip, count(*) AS flows, CAST(sum(packet_count) AS BIGINT) AS packets, CAST(sum(total_bytes) AS BIGINT) AS bytes FROM flows GROUP BY src_ip, dst_ip",
    ),
    "system_stats": _query(
        "campaigns",
        "SELECT count(*) AS total_flows, CAST(sum(packet_count) AS BIGINT) AS total_packets, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, "
        "(SELECT count(*) FROM alerts) AS total_alerts, (SELECT count(*) FROM alerts WHERE severity = 'CRITICAL') AS critical_alerts, "
        "(SELECT count(*) FROM campaigns WHERE campaign_type = 'active_campaign') AS active_campaigns FROM flows",
    ),
    "noise_reduction": _query(
        "incidents",
        f"SELECT alerts, incidents, {_round('1 - incidents / alerts', 6)} AS noise_reduction FROM "
        "(SELECT (SELECT count(*) FROM alerts) AS alerts, (SELECT count(*) FROM incidents) AS incidents)",
    ),
    "confusion_matrix": _query("labelled", f"SELECT {_cells('final_threat_score > 0.6')} FROM labelled"),
    "detection_metrics": _query("auc", _DETECTION),
    "evaluation_report": _query("auc", f"SELECT * EXCLUDE (recall_verdict, fpr_verdict) FROM ({_DETECTION})"),
    "metrics_by_type": _query(
        "labelled",
        f"SELECT *, {_rates()} FROM (SELECT t.truth_label, {_cells('final_threat_score > 0.6')} FROM labelled l "
        "JOIN (SELECT DISTINCT truth_label FROM labelled WHERE truth_label <> 'BENIGN') t "
        "ON l.truth_label = 'BENIGN' OR l.truth_label = t.truth_label GROUP BY t.truth_label)",
    ),
    "auc_roc": _query("auc", "SELECT auc_roc FROM auc"),
    "roc_curve": _query(
        "running",
        f"SELECT threshold, tp AS true_positives, fp AS false_positives, {_round('tp / p', 6)} AS tpr, {_round('fp / n', 6)} AS fpr FROM running",
    ),
    "pr_curve": _query(
        "running", f"SELECT threshold, {_round('tp / (tp + fp)', 6)} AS \"precision\", {_round('tp / p', 6)} AS recall FROM running"
    ),
    "threshold_sweep": _query(
        "labelled",
        f"SELECT *, {_rates()} FROM (SELECT threshold, {_cells('final_threat_score > threshold')} "
        "FROM labelled CROSS JOIN (SELECT unnest([0.4::DOUBLE, 0.5, 0.6, 0.7, 0.8]) AS threshold) GROUP BY threshold)",
    ),
    "score_histogram": _query(
        "labelled",
        "SELECT actual_malicious, CAST(least(floor((final_threat_score - lo) * 50 / (hi - lo)), 49) AS BIGINT) AS bin, count(*) AS flows "
        "FROM (SELECT *, min(final_threat_score) OVER (PARTITION BY actual_malicious) AS lo, "
        "max(final_threat_score) OVER (PARTITION BY actual_malicious) AS hi FROM labelled) GROUP BY 1, 2",
    ),
    "cross_validate": _query(
        "labelled",
        f"SELECT *, {_rates()} FROM (SELECT CAST(('0x' || substr(md5(concat_ws('|', {KEY})), 1, 8))::BIGINT % 5 AS BIGINT) AS fold, "
        f"{_cells('final_threat_score > 0.6')} FROM labelled GROUP BY 1)",
    ),
    "cross_validate_fitted": _query("flows", _cross_validation()),
    "sample_flows": _query(
        "flows", f"SELECT {KEY}, packet_count FROM flows ORDER BY md5(concat_ws('|', '42', {KEY}, first_us)), {KEY}, first_us LIMIT 500"
    ),
    "mark_by_entity": _query(
        "alerts", f"SELECT {KEY}, CAST(src_ip IN ({_CRITICAL}) AS INTEGER) AS actual_malicious FROM labelled"
    ),
    "entity_semi_join": _query("alerts", f"SELECT {KEY}, threat_label FROM labelled WHERE src_ip IN ({_CRITICAL})"),
    "critical_sources": _query("alerts", _CRITICAL),
    "training_flows": _query(
        "alerts", f"SELECT {KEY} FROM flows ANTI JOIN alerts USING ({KEY})"
    ),
    "label_wildcard_join": _query(
        "labelled",
        f"SELECT {KEY}, CASE WHEN user_role = 3 AND protocol = 'UDP' THEN 'DNS_TUNNELING' WHEN user_role = 3 AND protocol = 'TCP' THEN 'BENIGN' "
        "WHEN user_role = 0 AND protocol = 'TCP' THEN 'PORT_SCAN' ELSE 'BENIGN' END AS truth_label FROM labelled",
    ),
    "label_masks": _query(
        "flows",
        f"SELECT {KEY}, CASE WHEN src_ip = '10.0.0.3' AND dst_port = 53 AND protocol = 'UDP' THEN 'A' WHEN dst_ip = '172.16.0.1' AND dst_port = 53 AND protocol = 'UDP' THEN 'B' "
        "WHEN src_ip = '10.0.0.1' AND protocol = 'TCP' THEN 'D' WHEN dst_ip = '172.16.0.2' AND protocol = 'TCP' THEN 'E' WHEN dst_port = 22 AND protocol = 'TCP' THEN 'C' "
        "WHEN src_ip = '10.0.0.4' THEN 'F' WHEN protocol = 'UDP' THEN 'G' ELSE 'REST' END AS truth_label FROM flows",
    ),
    "label_file": _query(
        "labelled", f"SELECT {KEY}, CASE WHEN user_role = 0 AND protocol = 'TCP' THEN 'PORT_SCAN' ELSE 'BENIGN' END AS truth_label FROM labelled"
    ),
    "label_captures": _query(
        "packets", "SELECT packet_id, CASE packet_id % 3 WHEN 0 THEN 'SCAN' WHEN 1 THEN 'TUNNEL' ELSE 'BENIGN' END AS truth_label FROM packets"
    ),
    "bootstrap_ci": _query("labelled", _bootstrap()),
    "detection_latency": _query(
        "alerts",
        "SELECT src_ip, start_us, alert_us, (alert_us - start_us) / 1e6 AS latency_seconds FROM "
        "(SELECT src_ip, min(first_us) AS start_us FROM labelled WHERE actual_malicious = 1 GROUP BY src_ip) "
        "LEFT JOIN (SELECT src_ip, min(last_us) AS alert_us FROM alerts GROUP BY src_ip) USING (src_ip)",
    ),
    "flow_keys": _query(
        "flows",
        "SELECT concat(src_ip, ':', src_port, '_', dst_ip, ':', dst_port, '_', protocol) AS flow_key, "
        "concat(split_part(src_ip, '.', 1), '.', split_part(src_ip, '.', 2), '.xxx.xxx') AS masked_src FROM flows",
    ),
    "sorted_flows": _query("flows", f"SELECT {KEY}, {_iso('first_seen')} AS first_seen FROM flows ORDER BY flows.first_us, {KEY}"),
    "flow_head": _query("flows", f"SELECT {KEY}, packet_count FROM flows ORDER BY flows.first_us, {KEY} LIMIT 5"),
    "first_flow_of_pair": _query(
        "flows",
        "SELECT src_ip, dst_ip, src_port, dst_port, protocol, packet_count FROM (SELECT *, row_number() OVER "
        "(PARTITION BY src_ip, dst_ip ORDER BY first_us, src_port, dst_port, protocol) AS r FROM flows) WHERE r = 1",
    ),
}
