"""Numbering, skewed joins, quantiles, scaling, bands."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowhunt.functions import bands
from flowhunt.functions.columns import anonymize_ip, nan_to_null, parse_time, round_half_up
from flowhunt.operators.ordering import first_match, number_rows, sequence_within
from flowhunt.operators import skew
from flowhunt.operators.quantiles import approx_quantiles, exact_quantiles
from flowhunt.operators.profile import baseline_flags, describe, profile
from flowhunt.operators.scaling import minmax_scale, standard_scale
from flowhunt.operators.skew import attach_by_key
from flowhunt.session import materialize, shared_folder


def test_number_rows_is_dense_over_many_partitions(spark):
    values = np.random.default_rng(0).permutation(20_000)
    df = spark.createDataFrame([(int(v), int(v) // 10_000) for v in values], "v INT, half INT").repartition(13)
    got = number_rows(df, ["half", "v"], "no").select("v", "no").toPandas()
    assert (got["no"] == got["v"] + 1).all() and len(got) == 20_000


def test_sequence_within_matches_brute_force_with_null_keys(spark):
    rng = np.random.default_rng(3)
    rows = [(None if rng.random() < 0.4 else f"k{rng.integers(3)}", int(i), f"v{i}") for i in rng.permutation(500)]
    df = spark.createDataFrame(rows, "k STRING, pos INT, v STRING")
    got = sequence_within(df, ["k"], ["pos"], F.floor(F.col("pos") / 37), previous={"v": "before"}).collect()
    assert len(got) == 500
    for key in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == key)
        found = sorted((r.seq, r.pos, r.before) for r in got if r.k == key)
        assert [f[0] for f in found] == list(range(1, len(mine) + 1))
        assert [f[1] for f in found] == [p for p, _ in mine]
        assert [f[2] for f in found] == [None] + [v for _, v in mine[:-1]]


def test_first_match(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k STRING, o INT, v STRING")
    assert sorted(map(tuple, first_match(df, ["k"], ["o"]).collect())) == [("a", 1, "y"), ("b", 5, "z")]


@pytest.mark.parametrize("hot_rows", [0, 3, 1_000_000])
@pytest.mark.parametrize("counted", [True, False])
def test_attach_by_key_equals_a_left_join(spark, hot_rows, counted, monkeypatch):
    left = spark.createDataFrame([(f"k{i % 7 if i % 3 else 0}", i) for i in range(60)] + [(None, 99)], "k STRING, i INT")
    right = left.filter("k IS NOT NULL AND k <> 'k5'").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("m"))
    got = attach_by_key(left, right, ["k"], hot_rows, row_count="n" if counted else None)
    monkeypatch.setattr(skew, "HOT_KEYS", 0)  # too many hot keys to broadcast
    plain = attach_by_key(left, right, ["k"], hot_rows, row_count="n" if counted else None)
    assert sorted(map(str, plain.collect())) == sorted(map(str, got.collect()))
    expected = left.join(right, "k", "left")
    assert sorted(map(str, got.select("k", "i", "n", "m").collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("kind", ["uniform", "ties", "tail", "tiny", "one"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(5)
    data = {
        "uniform": rng.random(5000), "ties": rng.integers(0, 4, 5000).astype(float), "tail": rng.pareto(0.5, 5000),
        "tiny": np.array([3.0, 1.0, 2.0]), "one": np.array([7.0]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in data] + [(None,)], "v DOUBLE").repartition(4)
    qs = [0.0, 0.05, 0.5, 0.9, 0.99, 1.0]
    for most in (20_000, 300, 3):  # the last ones need several narrowing passes
        got = {r.q: r.value for r in exact_quantiles(df, {"v": qs}, accuracy=1000, most=most).collect()}
        for q in qs:
            assert got[q] == pytest.approx(np.quantile(data, q), rel=1e-12)
    rough = {r.q: r.value for r in approx_quantiles(df, {"v": [0.5]}).collect()}
    assert rough[0.5] == pytest.approx(np.quantile(data, 0.5, method="inverted_cdf"), abs=np.ptp(data) * 0.01 + 1e-9)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "v DOUBLE"), {"v": [0.5]}).count() == 0


def test_describe_and_profile(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None), (4.0, "b")], "v DOUBLE, s STRING")
    row = describe(df, ["v"], [0.5]).first()
    assert (row["count"], row["mean"], row["min"], row["p50"], row["max"]) == (3, 2.333333, 1.0, 2.0, 4.0)
    assert row["std"] == pytest.approx(np.std([1, 2, 4], ddof=1), abs=1e-6)
    assert {(r.column, r.nulls) for r in profile(df).collect()} == {("v", 0), ("s", 1)}


def test_flags_are_strict(spark):
    flows = spark.createDataFrame([(10, 1.0, 3.0, 4), (11, 1.1, 3.1, 3)], "packet_count INT, duration DOUBLE, dns_entropy DOUBLE, dns_subdomain_depth INT")
    limits = spark.createDataFrame([(10.0, 1.0, 3.0)], "packet_count DOUBLE, duration DOUBLE, dns_entropy DOUBLE")
    assert [r.suspicion_score for r in baseline_flags(flows, limits).orderBy("packet_count").collect()] == [1, 3]


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (2.0, None)], "a DOUBLE, b DOUBLE")
    got = minmax_scale(df, {"a": "x", "b": "y"}).select("x", "y").collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (1.0, 0.0), (0.5, None)]
    z = [r.a for r in standard_scale(df, ["a", "b"]).collect()]
    assert z == pytest.approx([-1.2247448714, 1.2247448714, 0.0])


def test_bands_at_their_limits(spark):
    scores = [0.0, 0.3, 0.4, 0.6, 0.8, 1.0, 1.01, -0.1, None, float("nan")]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i INT, s DOUBLE").orderBy("i")
    s = F.col("s")
    got = df.select(bands.alert_severity(s).alias("a"), bands.score_band(s).alias("b"), bands.severity3(s).alias("c")).collect()
    assert [r.a for r in got] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "CRITICAL", "CRITICAL", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert [r.b for r in got][:6] == ["LOW", "LOW", "MEDIUM", "HIGH", "CRITICAL", "CRITICAL"]
    assert [r.c for r in got][:6] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "HIGH"]


def test_labels_and_types(spark):
    rows = [(25, 40, 0.5, 0, 0.0, 0, 0.0), (1, 40, 0.5, 0, 0.9, 0, 0.0), (1, 40, 2.0, 6_000_000, 0.9, 60, 0.9),
            (1, 1, 2.0, 0, 0.9, 60, 0.9), (1, 1, 2.0, 0, 0.1, 60, 0.9), (1, 1, 2.0, 0, 0.1, 0, 0.6), (1, 1, 2.0, 0, 0.1, 0, 0.59)]
    df = spark.createDataFrame(rows, "dst_port_count INT, connection_count INT, avg_duration DOUBLE, bytes_sent INT, periodicity_score DOUBLE, dns_query_length INT, final_threat_score DOUBLE").coalesce(1)
    labels = [r[0] for r in df.select(bands.threat_label(df)).collect()]
    assert labels == ["PORT_SCAN", "BRUTE_FORCE", "DATA_EXFIL", "C2_BEACON", "DNS_TUNNEL", "SUSPICIOUS_TRAFFIC", "BENIGN"]
    bare = df.select("final_threat_score")
    assert [r[0] for r in bare.select(bands.threat_label(bare)).collect()][-2:] == ["SUSPICIOUS_TRAFFIC", "BENIGN"]
    names = spark.createDataFrame([("PORT_SCAN",), ("C2_BEACON",), ("DDoS",), ("Malware",), ("X",)], "l STRING").coalesce(1)
    types = [r[0] for r in names.select(bands.threat_type(F.col("l"))).collect()]
    assert types == ["port_scan", "beaconing", "denial_of_service", "malware_activity", "anomalous_flow"]


def test_small_columns(spark):
    df = spark.createDataFrame([("2026-01-25T13:41:34.313161Z", "192.168.1.100", 0.125, float("nan"))], "t STRING, ip STRING, x DOUBLE, n DOUBLE")
    row = nan_to_null(df).select(F.unix_micros(parse_time(F.col("t"))).alias("us"), anonymize_ip(F.col("ip")).alias("ip"), round_half_up(F.col("x"), 2).alias("x"), "n").first()
    assert (row.us % 1_000_000, row.ip, row.x, row.n) == (313161, "192.168.xxx.xxx", 0.13, None)


def test_materialize_uses_the_shared_folder(spark):
    table = materialize(spark.range(5), "t")
    assert shared_folder(spark).rstrip("/") in table.inputFiles()[0]
    assert table.count() == 5
