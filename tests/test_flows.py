"""Packets to flows: edge rows, brute force, invariance under slicing and partitioning."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from flowhunt.functions.text import clean_query, shannon_entropy, subdomain_depth
from flowhunt.operators import flows as fl
from flowhunt.schemas import FLOW_KEY

COLUMNS = "packet_id BIGINT, us BIGINT, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING, length BIGINT, dns_query STRING"


def make(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def packet(i, us, key=("a", "b", 1, 2, "TCP"), length=100, dns=None):
    return (i, us, *key, length, dns)


DNS_KEY = ("a", "r", 9, 53, "UDP")
EDGES = [
    packet(1, 5_000_000),
    packet(2, 1_000_000, ("b", "a", 2, 1, "TCP")),
    packet(3, 1_000_000, ("b", "a", 2, 1, "TCP")),
    packet(4, 3_000_000, ("c", "b", 1, 2, "TCP")),
    packet(5, 1_000_000, ("c", "b", 1, 2, "TCP")),
    packet(6, 1_250_000, ("c", "b", 1, 2, "TCP")),
    packet(7, 1_000_000, ("a", "b", 1, 2, "ICMP")),
    packet(8, 1_000_000, DNS_KEY, 60, ""),
    packet(9, 1_100_000, DNS_KEY, 60, None),
    packet(10, 1_300_000, DNS_KEY, 60, "later.example."),
    packet(11, 1_200_000, DNS_KEY, 60, "bücher.example.."),
]


def by_source(df):
    return {r["src_ip"] + r["dst_ip"]: r for r in df.collect()}


def test_edge_rows(spark):
    rows = by_source(fl.flow_features(make(spark, EDGES)))
    assert set(rows) == {"ab", "ba", "cb", "ar"}
    single = rows["ab"]
    assert (single.packet_count, single.duration, single.mean_iat, single.bytes_per_second) == (1, 0.0, 0.0, 0.0)
    same = rows["ba"]
    assert (same.packet_count, same.duration, same.max_iat, same.packets_per_second) == (2, 0.0, 0.0, 0.0)
    late = rows["cb"]
    assert (late.min_iat, late.max_iat, late.mean_iat, late.std_iat) == (0.25, 1.75, 1.0, 0.75)
    assert (late.duration, late.bytes_per_second, late.packets_per_second) == (2.0, 150.0, 1.5)
    dns = rows["ar"]
    assert (dns.dns_query_length, dns.dns_subdomain_depth) == (14, 1)
    assert dns.dns_entropy == round(entropy("bücher.example"), 3)


def entropy(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def test_collector_variant_counts_bytes(spark):
    row = by_source(fl.flow_features(make(spark, EDGES), entropy_digits=4, text_unit="bytes"))["ar"]
    text = "bücher.example"
    size = len(text.encode())
    bits = -sum(n / size * math.log2(n / size) for n in Counter(text).values())
    assert (row.dns_query_length, row.dns_entropy) == (size, round(bits, 4))


def test_text_functions(spark):
    names = ["", "aaaa", "a.b.c", "x1y2.example.com", "日本.jp"]
    df = spark.createDataFrame([(n,) for n in names], "q STRING")
    q = F.col("q")
    got = df.select("q", shannon_entropy(q).alias("e"), subdomain_depth(q).alias("d"), clean_query(q).alias("c")).collect()
    for r in got:
        assert r.e == pytest.approx(entropy(r.q) if r.q else 0.0)
        assert r.e <= math.log2(max(len(set(r.q)), 1)) + 1e-12
        assert r.d == r.q.count(".")
    assert got[0].c is None


def random_packets(n, seed, flows=7, span=20_000_000):
    rng = np.random.default_rng(seed)
    keys = [(f"s{k % 3}", f"d{k % 2}", 1000 + k, 80, "TCP") for k in range(flows)]
    # the first flow holds about half of all packets
    pick = np.where(rng.random(n) < 0.5, 0, rng.integers(0, flows, n))
    times = rng.integers(0, span, n)
    return [packet(i, int(times[i]), keys[pick[i]], int(rng.integers(40, 1500))) for i in range(n)]


def test_slices_do_not_change_results_and_match_brute_force(spark):
    rows = random_packets(600, 1)
    packets = make(spark, rows)
    reference = None
    for width in (0.05, 1.0, 3600.0):
        got = {tuple(r[k] for k in FLOW_KEY): r.asDict() for r in fl.flow_features(packets.repartition(5), width).collect()}
        assert reference is None or got == reference
        reference = got
    for key, r in reference.items():
        mine = sorted((p[1], p[7]) for p in rows if tuple(p[2:7]) == key)
        times = np.array([t for t, _ in mine])
        gaps = np.diff(times) / 1e6
        assert r["packet_count"] == len(mine)
        assert r["total_bytes"] == sum(size for _, size in mine)
        assert r["duration"] == pytest.approx((times[-1] - times[0]) / 1e6)
        for name, value in (("min_iat", gaps.min()), ("max_iat", gaps.max()), ("mean_iat", gaps.mean()), ("std_iat", gaps.std())):
            assert r[name] == pytest.approx(value, abs=1.1e-6)
        assert r["min_iat"] <= r["mean_iat"] <= r["max_iat"]


def test_inter_arrival_numbers_packets(spark):
    rows = random_packets(200, 2)
    got = fl.inter_arrival(make(spark, rows), 0.5).collect()
    assert len(got) == len(rows)
    for key in {tuple(r[2:7]) for r in rows}:
        mine = sorted((p[1], p[0]) for p in rows if tuple(p[2:7]) == key)
        found = sorted((r.packet_no, r.packet_id, r.iat) for r in got if tuple(r[k] for k in FLOW_KEY) == key)
        assert [f[1] for f in found] == [i for _, i in mine]
        assert found[0][2] is None
        expected = np.diff([t for t, _ in mine]) / 1e6
        assert [f[2] for f in found[1:]] == pytest.approx(list(expected))


def test_sessions_split_after_more_than_the_idle_time(spark):
    key2 = ("x", "y", 1, 2, "TCP")
    rows = [packet(1, 0), packet(2, 60_000_000), packet(3, 0, key2), packet(4, 60_000_001, key2)]
    got = fl.session_flows(make(spark, rows), 60.0, 7.0).groupBy("src_ip").count().collect()
    assert {r.src_ip: r["count"] for r in got} == {"a": 1, "x": 2}


def test_packet_filter_and_stats(spark):
    packets = make(spark, EDGES)
    assert fl.packet_filter(packets, ["UDP"], [53], ["r"]).count() == 4
    assert fl.packet_filter(packets, hosts=["c"]).count() == 3
    stats = fl.packet_stats(packets).first()
    assert tuple(stats) == (10, 6, 4, 4)


def test_beacon_intervals(spark):
    rows = [packet(i, t * 1_000_000) for i, t in enumerate([0, 10, 20, 32])] + [packet(9, 0, ("x", "y", 1, 2, "TCP")), packet(10, 5_000_000, ("x", "y", 1, 2, "TCP"))]
    got = {r.src_ip: r for r in fl.beacon_intervals(make(spark, rows), 15.0).collect()}
    assert got["a"].mean_interval == pytest.approx(np.mean([10, 10, 12]), abs=1e-6)
    assert got["a"].std_interval == pytest.approx(np.std([10, 10, 12], ddof=1), abs=1e-6)
    assert (got["x"].intervals, got["x"].std_interval) == (1, 0.0)


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000))
def test_flow_bytes_sum_to_packet_bytes(spark, seed):
    rows = random_packets(60, seed)
    flows = fl.flow_features(make(spark, rows), 0.7)
    total = flows.agg(F.sum("total_bytes").alias("b"), F.sum("packet_count").alias("n")).first()
    assert (total.b, total.n) == (sum(r[7] for r in rows), len(rows))
