"""Fixed schemas; no source infers its columns."""

from __future__ import annotations

from pyspark.sql import types as T

FLOW_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]

# The 14 behavioural features, in the order the models use.
FEATURES = [
    "packet_count", "duration", "total_bytes", "avg_packet_size",
    "min_iat", "max_iat", "mean_iat", "std_iat",
    "bytes_per_second", "packets_per_second", "avg_bytes_per_packet",
    "dns_query_length", "dns_subdomain_depth", "dns_entropy",
]

_LONG, _INT, _DOUBLE, _TEXT, _TIME = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampType(),
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_KEY_FIELDS = [
    ("src_ip", _TEXT), ("dst_ip", _TEXT), ("src_port", _INT), ("dst_port", _INT), ("protocol", _TEXT),
]

PACKET = _struct(
    ("packet_id", _LONG), ("ts", _TIME), *_KEY_FIELDS, ("length", _LONG), ("dns_query", _TEXT)
)

_WHOLE = {"packet_count": _LONG, "total_bytes": _LONG, "dns_query_length": _INT, "dns_subdomain_depth": _INT}

FLOW = _struct(
    *_KEY_FIELDS, ("first_seen", _TIME), ("last_seen", _TIME),
    *[(name, _WHOLE.get(name, _DOUBLE)) for name in FEATURES],
)

ALERT = _struct(
    ("alert_id", _TEXT), ("timestamp", _TEXT), *_KEY_FIELDS, ("threat_label", _TEXT),
    ("threat_type", _TEXT), ("severity", _TEXT), ("final_threat_score", _DOUBLE),
    ("confidence", _DOUBLE), ("triggered_rules", T.ArrayType(_TEXT)), ("reason", _TEXT),
    ("summary", _TEXT),
)

INCIDENT = _struct(
    ("entity", _TEXT), ("rule", _TEXT), ("alert_count", _LONG), ("max_severity", _TEXT),
    ("avg_score", _DOUBLE), ("first_seen", _TEXT), ("last_seen", _TEXT),
)

CAMPAIGN = T.StructType(INCIDENT.fields + [T.StructField("campaign_type", _TEXT)])

EXPLANATION = _struct(
    ("alert_id", _TEXT), ("severity", _TEXT), ("threat_label", _TEXT), ("src_ip", _TEXT),
    ("dst_ip", _TEXT), ("ml_score", _DOUBLE),
    ("top_features", T.ArrayType(_struct(
        ("feature", _TEXT), ("shap_contribution", _DOUBLE), ("actual_value", _DOUBLE), ("impact", _TEXT),
    ))),
)

_LABELS = T.MapType(_TEXT, _TEXT)
GROUND_TRUTH = _struct(("attack_types", _LABELS), ("sample_labels", _LABELS), ("pcap_labels", _LABELS))

# One row per forest node. ``path_length`` is set on leaves only.
FOREST_NODE = _struct(
    ("variant", _TEXT), ("tree", _INT), ("node", _INT), ("feature", _INT), ("threshold", _DOUBLE),
    ("left_node", _INT), ("right_node", _INT), ("cover", _INT), ("path_length", _DOUBLE),
)
