"""SQL of the fitted forest: samples, trees, scores and what follows from them, from the same definitions."""

from __future__ import annotations

from flowhunt.operators.forest import CONTAMINATION, FULL, RAW_DIGITS, SAMPLE_SIZE, SEED, TREES
from flowhunt.plans.oracle import KEY, _ALERT_TEXT, _cells, _iso, _query, _rates, _round, _STAGES
from flowhunt.schemas import FEATURES

_LEVELS = (SAMPLE_SIZE - 1).bit_length()
_GAMMA = 0.5772156649015329


def _hex(digest: str, start: int, count: int) -> str:
    return f"CAST('0x' || substr({digest}, {start}, {count}) AS BIGINT)"


def _average(n: str) -> str:
    return (
        f"CASE WHEN {n} > 2 THEN 2.0::DOUBLE * (ln({n} - 1.0::DOUBLE) + {_GAMMA}::DOUBLE) - 2.0::DOUBLE * ({n} - 1.0::DOUBLE) / {n} "
        f"WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    )


def _level(k: int) -> dict[str, str]:
    """Ranges and cuts of the nodes of one depth, and the rows of the next."""
    ends = {f: "[" + ", ".join(f"{f}(x[{i + 1}]) OVER w" for i in range(len(FEATURES))) + "]" for f in ("min", "max")}
    return {
        f"ranged{k}": f"""
SELECT *, list_filter(allowed, lambda i: high[i + 1] > low[i + 1]) AS varying, md5(concat_ws(':', seed, tree, node)) AS digest
FROM (SELECT *, count(*) OVER w AS n, {ends["min"]} AS low, {ends["max"]} AS high FROM grown{k} WINDOW w AS (PARTITION BY variant, tree, node))""",
        f"cut{k}": f"""
SELECT * EXCLUDE (trial), CASE WHEN trial <= low[pick + 1] THEN high[pick + 1] ELSE trial END AS cut
FROM (SELECT *, low[pick + 1] + ({_hex("digest", 9, 13)} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE * (high[pick + 1] - low[pick + 1]) AS trial
  FROM (SELECT *, CASE WHEN {k} < deepest AND len(varying) > 0 THEN varying[{_hex("digest", 1, 8)} % len(varying) + 1] END AS pick FROM ranged{k}))""",
        f"nodes{k}": f"""
SELECT variant, tree, node, any_value(pick) AS pick, any_value(cut) AS cut, any_value(n) AS cover,
  CASE WHEN any_value(pick) IS NULL THEN {k} + {_average("any_value(n)")} END AS path_length
FROM cut{k} GROUP BY variant, tree, node""",
        f"grown{k + 1}": f"""
SELECT variant, allowed, tree, seed, x, deepest, 2 * node + 1 + CAST(x[pick + 1] >= cut AS INTEGER) AS node FROM cut{k} WHERE pick IS NOT NULL""",
    }


def _forest(variants: dict[str, list[str]], generation: str = "0", last: str = "TRUE", part: str = "0") -> dict[str, str]:
    """Stages from the flows to ``forest``: one row per variant and flow with raw score, offset and decision.

    ``generation`` of a tree, also the ``part`` of the flows it is grown on; the offset is that of the ``last`` part.
    """
    scaled = ", ".join(f"CASE WHEN {c}_s = 0 THEN 0.0::DOUBLE ELSE (f.{c} - {c}_m) / {c}_s END" for c in FEATURES)
    digest = f"md5(concat_ws('|', {KEY}, first_us))"
    given = ", ".join(f"('{v}', {[FEATURES.index(f) for f in names]})" for v, names in variants.items())
    draw = "(a * m + b * n + c) % 2147483647"
    stages = {
        "moments": "SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in FEATURES) + f" FROM flows WHERE {part} = 0",
        "vectors": f"SELECT {KEY}, first_us, {_hex(digest, 1, 7)} AS a, {_hex(digest, 8, 7)} AS b, [{scaled}] AS x, {part} AS part, row_number() OVER () AS row FROM flows f, moments",
        "factors": f"""SELECT tree, generation, seed, {_hex("d", 1, 7)} + 1 AS m, {_hex("d", 8, 7)} + 1 AS n, {_hex("d", 15, 7)} AS c
FROM (SELECT *, md5(concat(seed, ':', tree)) AS d FROM (SELECT *, {SEED} + generation AS seed FROM (SELECT tree, {generation} AS generation FROM range({TREES}) u(tree))))""",
        "variants": f"SELECT * FROM (VALUES {given}) v(variant, allowed)",
        "grown0": f"""
SELECT variant, allowed, tree, seed, x, CASE WHEN size > 1 THEN length(bin(size - 1)) ELSE 0 END AS deepest, 0 AS node
FROM (SELECT tree, seed, x, count(*) OVER (PARTITION BY tree) AS size FROM (
  SELECT tree, seed, x, row_number() OVER (PARTITION BY tree ORDER BY {draw}, a, b, {KEY}, first_us) AS nth FROM vectors JOIN factors ON part = generation
) WHERE nth <= {SAMPLE_SIZE}), variants""",
    }
    for k in range(_LEVELS + 1):
        stages.update(_level(k))
    del stages[f"grown{_LEVELS + 1}"]
    stages["nodes"] = " UNION ALL ".join(f"SELECT * FROM nodes{k}" for k in range(_LEVELS + 1))
    walk = "SELECT variant, tree, row, x, 0 AS node FROM vectors, factors, variants"
    for _ in range(_LEVELS):
        walk = f"""SELECT w.variant, w.tree, row, x, CASE WHEN pick IS NULL THEN w.node ELSE 2 * w.node + 1 + CAST(x[pick + 1] >= cut AS INTEGER) END AS node
FROM ({walk}) w JOIN nodes n ON n.variant = w.variant AND n.tree = w.tree AND n.node = w.node"""
    stages["leaves"] = f"SELECT w.variant, row, avg(path_length) AS path FROM ({walk}) w JOIN nodes n USING (variant, tree, node) GROUP BY w.variant, row"
    norm = f"SELECT {_average('max(cover)')} FROM nodes WHERE node = 0"
    stages["raws"] = f"SELECT variant, row, {_round(f'-pow(2, -(path / ({norm})))', RAW_DIGITS)} AS raw FROM leaves"
    stages["forest"] = f"""
SELECT r.variant, v.* EXCLUDE (a, b, x, row, part), raw - cut_off AS decision, CASE WHEN raw - cut_off < 0 THEN -1 ELSE 1 END AS iforest_label,
  raw < cut_off AS found
FROM raws r JOIN vectors v USING (row) 
  JOIN (SELECT variant, quantile_cont(raw, {CONTAMINATION}) AS cut_off FROM raws JOIN vectors USING (row) WHERE {last} GROUP BY variant) USING (variant)"""
    return stages


def _explained() -> dict[str, str]:
    """Stages from the nodes to ``explained``: Shapley values from the definition, summed over the coalitions of each leaf.

    A leaf is worth its value times, per feature on its path, 1 or 0 where the feature is known and the share of samples
    that go its way where it is not. Flows are first sorted by which intervals of a leaf they lie in.
    """
    n = len(FEATURES)
    each, edge = range(n), "c.node = 2 * b.node + 1"
    stages = {"boxes0": f"SELECT tree, node, 0 AS used, {[-1e308] * n} AS lo, {[1e308] * n} AS hi, {[1.0] * n}::DOUBLE[] AS share FROM nodes WHERE node = 0"}
    at = "list_transform(range(1, {}), lambda i: CASE WHEN i = p.pick + 1 THEN {} ELSE {} END)"
    for k in range(_LEVELS):
        stages[f"boxes{k + 1}"] = f"""
SELECT b.tree, c.node, b.used | (1 << p.pick) AS used,
  CASE WHEN {edge} THEN b.lo ELSE {at.format(n + 1, "greatest(b.lo[i], p.cut)", "b.lo[i]")} END AS lo,
  CASE WHEN {edge} THEN {at.format(n + 1, "least(b.hi[i], p.cut)", "b.hi[i]")} ELSE b.hi END AS hi,
  {at.format(n + 1, "b.share[i] * c.cover / p.cover", "b.share[i]")} AS share
FROM boxes{k} b JOIN nodes p ON p.tree = b.tree AND p.node = b.node AND p.pick IS NOT NULL
JOIN nodes c ON c.tree = p.tree AND c.node - 2 * p.node IN (1, 2)"""
    boxes = " UNION ALL ".join(f"SELECT * FROM boxes{k}" for k in range(_LEVELS + 1))
    stages["leaf"] = f"""
SELECT row_number() OVER () AS leaf, -path_length / {TREES} AS worth, used, lo, hi, share, list_filter(range({n}), lambda i: (used >> i) & 1 = 1) AS own
FROM ({boxes}) JOIN nodes USING (tree, node) WHERE pick IS NULL AND used > 0"""
    inside = " + ".join(f"CASE WHEN x{i} >= lo{i} AND x{i} < hi{i} THEN {1 << i} ELSE 0 END" for i in each)
    bounds = ", ".join(f"lo[{i + 1}] AS lo{i}, hi[{i + 1}] AS hi{i}" for i in each)
    stages["met"] = f"""
SELECT row, leaf, used & ({inside}) AS inside FROM (SELECT row, {", ".join(f"x[{i + 1}] AS x{i}" for i in each)} FROM vectors),
  (SELECT leaf, used, {bounds} FROM leaf)"""
    without = ", ".join(f"sum(CASE WHEN (known >> {i}) & 1 = 0 THEN part ELSE 0 END) AS c{i}" for i in each)
    parts = ", ".join(
        f"CASE WHEN (used >> {i}) & 1 = 1 THEN worth * c{i} / share[{i + 1}] * (((inside >> {i}) & 1) - share[{i + 1}]) ELSE 0 END AS v{i}" for i in each
    )
    stages["pieces"] = f"""
SELECT leaf, inside, {parts} FROM leaf JOIN (
  SELECT leaf, inside, {without} FROM (
    SELECT leaf, inside, known, factorial(bit_count(known)::INTEGER)::DOUBLE * factorial((len(own) - bit_count(known) - 1)::INTEGER)::DOUBLE / factorial(len(own)::INTEGER)::DOUBLE
        * list_reduce(list_transform(list_filter(own, lambda i: (known >> i) & 1 = 0), lambda i: share[i + 1]), lambda a, b: a * b) AS part
    FROM (SELECT leaf, inside, own, share, coalesce(list_sum(list_transform(own, lambda f, i: CASE WHEN (s >> (i - 1)) & 1 = 1 THEN 1 << f ELSE 0 END)), 0)::BIGINT AS known
      FROM (SELECT DISTINCT leaf, inside FROM met) JOIN leaf USING (leaf), range({1 << _LEVELS}) u(s) WHERE s < (1 << len(own)) - 1)
    WHERE known & inside = known) GROUP BY leaf, inside) USING (leaf)"""
    sums = ", ".join(f"sum(v{i}) AS v{i}" for i in each)
    stages["explained"] = f"SELECT v.* EXCLUDE (a, b, x, part), {', '.join(f'v{i}' for i in each)} FROM vectors v JOIN (SELECT row, {sums} FROM met JOIN pieces USING (leaf, inside) GROUP BY row) USING (row)"
    return stages


def _before(stage: str, new: dict[str, str], **replaced: str) -> dict[str, str]:
    """All stages, with ``new`` ones ahead of ``stage``."""
    out: dict[str, str] = {}
    for name, sql in _STAGES.items():
        if name == stage:
            out.update(new)
        out[name] = replaced.get(name, sql)
    return out


_FULL = _forest({FULL: FEATURES})
_SCORED = f"""
SELECT *, {_round("0.6::DOUBLE * rule_score_normalized + 0.4::DOUBLE * ml_score_normalized", 6)} AS final_threat_score
FROM (SELECT *, {_round("1 - " + _round("(decision - lo) / (hi - lo)", 6), 6)} AS ml_score_normalized,
    CASE WHEN rhi = rlo THEN 0.0::DOUBLE ELSE {_round("(suspicion_score - rlo) / CAST(rhi - rlo AS DOUBLE)", 6)} END AS rule_score_normalized
  FROM (SELECT e.*, decision, min(decision) OVER () AS lo, max(decision) OVER () AS hi, min(suspicion_score) OVER () AS rlo,
          max(suspicion_score) OVER () AS rhi FROM enriched e JOIN forest USING ({KEY}, first_us)))
"""
_AFTER_FLOWS = _before("thresholds", _FULL)
_AFTER_ENRICHED = _before("scored", _FULL, scored=_SCORED)
_ABLATED = _before("scored", _forest({FULL: FEATURES} | {f: [g for g in FEATURES if g != f] for f in FEATURES}))
_FACTORS = " UNION ALL ".join(
    f"SELECT a.alert_id, '{f}' AS feature, v{i} AS shap, CAST(a.{f} AS DOUBLE) AS actual_value FROM alerts a JOIN explained USING ({KEY}, first_us) "
    "WHERE a.severity = 'CRITICAL'" for i, f in enumerate(FEATURES)
)
_TOP = (
    f"SELECT alert_id, CAST(place AS INTEGER) AS place, feature, {_round('shap', 6)} AS shap_contribution, actual_value, "
    "CASE WHEN shap > 0 THEN 'increased' ELSE 'decreased' END AS impact FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY alert_id ORDER BY -abs(shap), feature) AS place FROM ({_FACTORS})) WHERE place <= 5"
)
_TOLD = " UNION ALL ".join(
    f"SELECT {KEY}, {_iso('make_timestamp(first_us)')} AS first_seen, '{f}' AS feature, {_round(f'v{i}', 6)} AS shap, "
    f"CAST({f} AS DOUBLE) AS actual_value FROM explained JOIN flows USING ({KEY}, first_us)"
    for i, f in enumerate(FEATURES)
)
# Three generations of a quarter of the trees each, on thirds of the flows; the trees not replaced are the first one's.
_AGED = f"CASE WHEN tree < {TREES // 4} THEN 1 WHEN tree < {TREES // 2} THEN 2 ELSE 0 END"
_THIRD = f"CAST('0x' || substr(md5(concat_ws('|', {KEY})), 1, 8) AS BIGINT) % 3"
_ROLLED = _before("thresholds", _forest({FULL: FEATURES}, _AGED, "part = 2", _THIRD))
_MALICIOUS = "CAST(CAST(split_part(src_ip, '.', 4) AS BIGINT) % 10 IN (0, 1, 2, 3) AS INTEGER)"
_BANDS = (
    "CASE WHEN final_threat_score >= 0.8 THEN 'CRITICAL' WHEN final_threat_score >= 0.6 THEN 'HIGH' "
    "WHEN final_threat_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"
)

FOREST_ORACLE = {
    "isolation_forest_scores": _query("forest", f"SELECT {KEY}, {_round('decision', 6)} AS iforest_score FROM forest", _AFTER_FLOWS),
    "isolation_forest_labels": _query("forest", 'SELECT iforest_label, count(*) AS "count" FROM forest GROUP BY iforest_label', _AFTER_FLOWS),
    "model_retrain": _query("forest", f"SELECT {KEY}, {_round('decision', 6)} AS iforest_score, iforest_label FROM forest", _AFTER_FLOWS),
    "model_rolling": _query("forest", f"SELECT {KEY}, {_round('decision', 6)} AS iforest_score, iforest_label FROM forest", _ROLLED),
    "forest_score_fusion": _query(
        "scored", f"SELECT {KEY}, ml_score_normalized, final_threat_score, {_BANDS} AS threat_score_band FROM scored", _AFTER_ENRICHED
    ),
    "forest_alerts": _query("alerts", f"SELECT {_ALERT_TEXT} FROM alerts", _AFTER_ENRICHED),
    "explain_fitted": _query("alerts", _TOP, _before("thresholds", {**_FULL, **_explained()})),
    "forest_shapley_values": _query("explained", _TOLD, _before("thresholds", {**_FULL, **_explained()})),
    "feature_ablation": _query(
        "forest",
        f"SELECT *, {_rates()} FROM (SELECT left_out, {_cells('found')} FROM ("
        f"SELECT variant AS left_out, found, {_MALICIOUS} AS actual_malicious FROM forest) GROUP BY left_out)",
        _ABLATED,
    ),
}
