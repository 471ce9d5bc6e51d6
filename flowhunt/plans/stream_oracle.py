"""SQL of streams that stop before everything is closed: flows by session, and which of them were emitted."""

from __future__ import annotations

from flowhunt.plans.oracle import _FLOW_TEXT, _STAGES, KEY, _first_dns, _flows, _iso, _query

# The catalogue's idle time and watermark delay.
_IDLE_US, _DELAY_MS = 200_000, 200
_SESSION = f"{KEY}, session_no"

_SESSION_GAPS = f"""
SELECT * EXCLUDE (gap_us, opens), CASE WHEN opens = 1 THEN NULL ELSE gap_us END AS gap_us,
  sum(opens) OVER (PARTITION BY {KEY} ORDER BY us, packet_id) AS session_no
FROM (SELECT *, CASE WHEN gap_us > {_IDLE_US} THEN 1 ELSE 0 END AS opens FROM ({_STAGES["gaps"]}))
"""

# A session is emitted when its timer lies behind the watermark, or when the next one's first millisecond is closed.
_ENDED = f"""
SELECT *, (last_us + {_IDLE_US} + 1000) // 1000 + 1 > watermark
  AND coalesce(next_us // 1000 + 1 > watermark, TRUE) AS drained
FROM (SELECT *, lead(first_us) OVER (PARTITION BY {KEY} ORDER BY first_us) AS next_us FROM flows),
  (SELECT max(us) // 1000 - {_DELAY_MS} AS watermark FROM packets)
"""

_SESSIONS = {
    **_STAGES, "gaps": _SESSION_GAPS, "first_dns": _first_dns(_SESSION, "gaps"), "flows": _flows(_SESSION, "gaps"),
}
_DRAINED = {}
for _name, _sql in _SESSIONS.items():
    _DRAINED[_name] = _sql
    if _name == "flows":
        _DRAINED["ended"] = _ENDED

# Source columns of a batch's flows: those of all flows up to that batch.
_BATCH = f"CAST('0x' || substr(md5(concat_ws('|', {KEY})), 1, 8) AS BIGINT) % 4"
_KEPT = {}
for _name, _sql in _STAGES.items():
    if _name == "entities":
        _KEPT["batched"] = f"SELECT *, {_BATCH} AS batch FROM flows"
        body = _sql.replace("FROM flows GROUP BY src_ip", "FROM batched JOIN range(4) u(upto) ON batch <= upto GROUP BY src_ip, upto")
        _KEPT[_name] = body.replace("SELECT src_ip,", "SELECT src_ip, upto,", 1)
    elif _name == "labelled":
        _KEPT[_name] = _sql.replace("entities.* EXCLUDE (src_ip)", "entities.* EXCLUDE (src_ip, upto)").replace(
            "JOIN entities USING (src_ip)", f"JOIN entities ON entities.src_ip = scored.src_ip AND upto = {_BATCH.replace(KEY, ', '.join('scored.' + k for k in KEY.split(', ')))}"
        )
    else:
        _KEPT[_name] = _sql

STREAM_ORACLE = {
    "stream_alerts_kept": _query(
        "alerts", f"SELECT {KEY}, threat_label, severity, alert_score AS final_threat_score, triggered_rules FROM alerts", _KEPT
    ),
    "baseline_incremental": _query(
        "flows",
        'SELECT t."column", t.q, TRUE AS within, n.flows, n.periods FROM (VALUES (\'packet_count\', 0.99::DOUBLE), (\'duration\', 0.99::DOUBLE), '
        "('dns_entropy', 0.95::DOUBLE)) t(\"column\", q), (SELECT count(*) AS flows, count(DISTINCT first_us // 100000) AS periods FROM flows) n",
    ),
    "stream_sources": _query("entities", "SELECT * FROM entities"),
    "stream_flush": _query("ended", f"SELECT {_FLOW_TEXT}, drained FROM ended", _DRAINED),
    "live_flow_files": _query(
        "enriched",
        f"SELECT {KEY}, {_iso('first_seen')} AS first_seen, packet_count, total_bytes, std_iat, dns_entropy, suspicion_score FROM enriched",
        _SESSIONS,
    ),
    "packet_stats_json": _query(
        "ended",
        "SELECT count(*) AS total_packets, count(*) FILTER (protocol = 'TCP') AS tcp_packets, "
        "count(*) FILTER (protocol = 'UDP') AS udp_packets, "
        "count(*) FILTER (protocol = 'UDP' AND (src_port = 53 OR dst_port = 53)) AS dns_packets, "
        "(SELECT count(*) FROM ended WHERE drained) AS active_flows, (SELECT count(*) FROM ended WHERE NOT drained) AS exported_flows FROM packets",
        _DRAINED,
    ),
}
