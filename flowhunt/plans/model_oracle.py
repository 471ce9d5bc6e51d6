"""SQL of the fixed forest: scores by CASE, Shapley values from the definition, narratives as text."""

from __future__ import annotations

import re
from itertools import combinations
from math import factorial, inf

from flowhunt.functions import wording
from flowhunt.operators.forest import average_path
from flowhunt.plans.fixed_model import FIXED_TREES, OFFSET, SAMPLES, cover
from flowhunt.plans.oracle import KEY, _iso, _query, _round
from flowhunt.schemas import FEATURES


def _number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _path(tree, depth: int = 0) -> str:
    if isinstance(tree, int):
        return _number(depth + float(average_path(tree)))
    feature, cut, below, above = tree
    return f"CASE WHEN {feature} < {_number(cut)} THEN {_path(below, depth + 1)} ELSE {_path(above, depth + 1)} END"


def _leaves(tree, path: dict, depth: int):
    """(value, {feature: (low, high, share)}) of each leaf."""
    if isinstance(tree, int):
        yield -(depth + float(average_path(tree))) / len(FIXED_TREES), path
        return
    feature, cut, below, above = tree
    low, high, share = path.get(feature, (-inf, inf, 1.0))
    for child, bounds in ((below, (low, min(high, cut))), (above, (max(low, cut), high))):
        yield from _leaves(child, {**path, feature: (*bounds, share * cover(child) / cover(tree))}, depth + 1)


def _shapley(shares: list[float], inside: list[int], j: int) -> float:
    """Feature ``j``'s share of a leaf of value one, summed over the coalitions of the others."""
    d, others = len(shares), [k for k in range(len(shares)) if k != j]
    total = 0.0
    for size in range(d):
        for known in combinations(others, size):
            weight = factorial(size) * factorial(d - size - 1) / factorial(d)
            for k in others:
                weight *= inside[k] if k in known else shares[k]
            total += weight * (inside[j] - shares[j])
    return total


def _contributions() -> dict[str, str]:
    terms: dict[str, list[str]] = {f: [] for f in FEATURES}
    for tree in FIXED_TREES:
        for value, path in _leaves(tree, {}, 0):
            names, shares = list(path), [s for _, _, s in path.values()]
            bits = " + ".join(
                f"CASE WHEN {'TRUE' if lo == -inf else f'{n} >= {_number(lo)}'} AND {'TRUE' if hi == inf else f'{n} < {_number(hi)}'} "
                f"THEN {1 << i} ELSE 0 END" for i, (n, (lo, hi, _)) in enumerate(path.items())
            )
            for j, name in enumerate(names):
                cases = " ".join(
                    f"WHEN {p} THEN {_number(value * _shapley(shares, [(p >> i) & 1 for i in range(len(names))], j))}"
                    for p in range(1 << len(names))
                )
                terms[name].append(f"CASE ({bits}) {cases} END")
    return {f: " + ".join(t) if t else "CAST(0 AS DOUBLE)" for f, t in terms.items()}


_NORM = float(average_path(SAMPLES))
_PATHS = " + ".join(_path(t) for t in FIXED_TREES)
_FOREST = f"""(SELECT *, CASE WHEN decision < 0 THEN -1 ELSE 1 END AS iforest_label, {_round("decision", 6)} AS iforest_score
FROM (SELECT *, -pow(2, -(({_PATHS}) / {len(FIXED_TREES)}) / {_number(_NORM)}) - {_number(OFFSET)} AS decision FROM enriched))"""
_LONG = "(" + " UNION ALL ".join(
    f"SELECT {KEY}, first_us, first_seen, '{f}' AS feature, {e} AS shap, CAST({f} AS DOUBLE) AS actual_value FROM flows"
    for f, e in _contributions().items()
) + ")"
_TOP = f"""(SELECT * FROM (SELECT a.alert_id, a.severity, a.threat_label, a.src_ip, a.dst_ip, a.alert_score AS ml_score,
  feature, shap, actual_value, row_number() OVER (PARTITION BY a.alert_id ORDER BY -abs(shap), feature) AS place
  FROM alerts a JOIN {_LONG} s USING ({KEY}, first_us) WHERE a.severity = 'CRITICAL') WHERE place <= 5)"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _fixed(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', {_round(value, digits)})"


def _narratives() -> str:
    names = " ".join(f"WHEN {_text(f)} THEN {_text(t.upper())}" for f, t in wording.FEATURE_DESCRIPTIONS.items())
    context = " ".join(
        f"WHEN feature = '{f}' AND actual_value {sign} {_number(limit)} THEN {_text(text)}" for f, sign, limit, text in wording.PATTERNS
    )

    def filled(pattern: str, *values: str) -> str:
        """The layout with its fields replaced, as one concat."""
        parts = re.split(r"%(?:s|d|\.\df)", pattern)
        out = [_text(parts[0])]
        for value, part in zip(values, parts[1:]):
            out += [value, _text(part)]
        return "concat(" + ", ".join(out) + ")"

    values = ("place", f"CASE feature {names} END", _fixed("actual_value", 2), _fixed("abs(shap)", 4))
    line = (
        f"concat(CASE WHEN shap > 0 THEN {filled(wording.RAISED, *values)} ELSE {filled(wording.LOWERED, *values)} END, "
        f"CASE WHEN context IS NULL THEN '' ELSE {filled(wording.CONTEXT, 'context')} END)"
    )
    header = filled(wording.HEADER, "alert_id", "severity", "threat_label", "src_ip", "dst_ip", _fixed("ml_score", 3))
    newline = _text("\n")
    return (
        f"SELECT alert_id, concat(min({header}), {newline}, {_text(wording.SECTION)}, {newline}, "
        f"string_agg({line}, {newline} ORDER BY place)) AS narrative FROM (SELECT *, CASE {context} END AS context FROM {_TOP}) GROUP BY alert_id"
    )


_FUSED = f"""(SELECT *, {_round("0.6::DOUBLE * rule_score_normalized + 0.4::DOUBLE * ml_score_normalized", 6)} AS final_threat_score FROM (
  SELECT *, {_round("1 - " + _round("(decision - lo) / (hi - lo)", 6), 6)} AS ml_score_normalized,
    CASE WHEN rhi = rlo THEN 0.0::DOUBLE ELSE {_round("(suspicion_score - rlo) / CAST(rhi - rlo AS DOUBLE)", 6)} END AS rule_score_normalized
  FROM (SELECT *, min(decision) OVER () AS lo, max(decision) OVER () AS hi, min(suspicion_score) OVER () AS rlo,
          max(suspicion_score) OVER () AS rhi FROM {_FOREST})))"""

MODEL_ORACLE = {
    "fixed_forest_scores": _query("enriched", f"SELECT {KEY}, iforest_score, iforest_label FROM {_FOREST}"),
    "fixed_forest_labels": _query("enriched", f'SELECT iforest_label, count(*) AS "count" FROM {_FOREST} GROUP BY iforest_label'),
    "ml_anomalies": _query("enriched", f"SELECT {KEY}, iforest_score, suspicion_score FROM {_FOREST} WHERE iforest_label = -1"),
    "rule_only_hits": _query(
        "enriched",
        f"SELECT {KEY}, iforest_score, raised AS suspicion_score FROM (SELECT *, suspicion_score + CASE WHEN src_port % 3 = 0 "
        f"AND suspicion_score > 0 THEN 2 ELSE 0 END AS raised FROM {_FOREST}) WHERE raised >= 3 AND iforest_label = 1",
    ),
    "ml_only_hits": _query(
        "enriched",
        f"SELECT packet_count, duration, total_bytes, dns_entropy, suspicion_score, iforest_score FROM {_FOREST} f "
        f"WHERE suspicion_score <= 1 AND iforest_label = -1 ORDER BY decision, {KEY} LIMIT 5",
    ),
    "score_fusion": _query("enriched", f"SELECT {KEY}, ml_score_normalized, final_threat_score FROM {_FUSED}"),
    "shapley_values": _query(
        "flows", f"SELECT {KEY}, {_iso('first_seen')} AS first_seen, feature, {_round('shap', 6)} AS shap, actual_value FROM {_LONG}"
    ),
    "global_importance": _query(
        "flows", f"SELECT feature, {_round('avg(abs(shap))', 6)} AS importance FROM {_LONG} GROUP BY feature"
    ),
    "explain_alerts": _query(
        "alerts",
        f"SELECT alert_id, severity, threat_label, src_ip, dst_ip, ml_score, CAST(place AS INTEGER) AS place, feature, {_round('shap', 6)} AS shap_contribution, "
        f"actual_value, CASE WHEN shap > 0 THEN 'increased' ELSE 'decreased' END AS impact FROM {_TOP}",
    ),
    "explain_top_critical": _query(
        "alerts",
        f"SELECT alert_id, CAST(place AS INTEGER) AS place, feature, {_round('shap', 6)} AS shap_contribution FROM {_TOP} WHERE alert_id IN "
        "(SELECT alert_id FROM alerts WHERE severity = 'CRITICAL' ORDER BY alert_no LIMIT 10)",
    ),
    "narratives": _query("alerts", _narratives()),
    "explanation_by_alert": _query(
        "alerts",
        "SELECT alert_id, coalesce(narrative, concat('No explanation found for ', alert_id)) AS narrative "
        f"FROM alerts LEFT JOIN ({_narratives()}) USING (alert_id)",
    ),
    "forest_invariants": _query(
        "flows",
        "SELECT CAST(200 AS BIGINT) AS trees, CAST(200 * least(256, count(*)) AS BIGINT) AS root_cover, count(*) AS flows, "
        "TRUE AS anomalies_fit, TRUE AS additive FROM flows",
    ),
}
