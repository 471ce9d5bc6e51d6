"""Streams agree with the batch operators."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowhunt.operators import flows as fl
from flowhunt.operators.entity import entity_features
from flowhunt.schemas import FLOW_KEY, PACKET
from flowhunt.sources.store import KeptTable
from flowhunt.streaming import detection as sd, flows as sf, io as sio

KEY1, KEY2 = ("a", "b", 1, 2, "TCP"), ("x", "y", 1, 53, "UDP")


def packets(spark, rows):
    df = spark.createDataFrame(rows, "packet_id BIGINT, us BIGINT, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING, length BIGINT, dns_query STRING")
    return df.withColumn("ts", F.timestamp_micros("us")).select(*[F.col(f.name) for f in PACKET.fields])


def test_stream_flows_split_and_match_batch(spark, tmp_path):
    second = 1_000_000
    rows = [(1, 0, *KEY1, 10, None), (2, 60 * second, *KEY1, 20, None), (3, 0, *KEY2, 10, None), (4, 60 * second + 1, *KEY2, 20, "q.example.")]
    rows += [(10 + i, t, *KEY1, 5, None) for i, t in enumerate([61 * second, 61 * second + 500, 75 * second, 300 * second])]
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run():
        stream = sf.stream_flows(sio.read_packet_stream(spark, folder))
        sio.run_to_table(stream, out, checkpoint).awaitTermination()

    source = packets(spark, rows)
    source.filter("ts < timestamp_micros(61000000)").coalesce(1).write.mode("append").parquet(folder)
    run()
    source.filter("ts >= timestamp_micros(61000000)").coalesce(1).write.mode("append").parquet(folder)
    sio.clock_packet(spark, "1970-01-02 00:00:00").write.mode("append").parquet(folder)
    run()
    got = sorted((r.src_ip, r.packet_count, r.total_bytes, r.duration, r.max_iat, r.std_iat, r.dns_query_length) for r in spark.read.parquet(out).collect())
    assert [g[:4] for g in got] == [("a", 1, 5, 0.0), ("a", 5, 45, 75.0), ("x", 1, 10, 0.0), ("x", 1, 20, 0.0)]
    whole = fl.flow_features(source.filter("src_ip = 'a' AND ts < timestamp_micros(200000000)"), 5.0).first()
    assert got[1][4:6] == (whole.max_iat, whole.std_iat) and got[3][6] == 9
    sessions = fl.session_flows(source, 60.0).groupBy("src_ip").count().collect()
    assert {r.src_ip: r["count"] for r in sessions} == {"a": 2, "x": 2}


def test_live_flow_files(spark, tmp_path):
    row = {"src_ip": "a", "dst_ip": "b", "src_port": 1, "dst_port": 2, "protocol": "TCP", "packet_count": 3,
           "first_seen": "2026-01-25T13:41:34.313161789Z", "last_seen": "2026-01-25T13:41:35Z", "dns_entropy": 1.5}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "flows_live_20260125_134135.json").write_text(json.dumps([row, row]))
    (tmp_path / "in" / "other.json").write_text(json.dumps([row]))
    out = str(tmp_path / "out")
    sio.run_to_table(sio.read_live_flows(spark, str(tmp_path / "in")), out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(out).select(*FLOW_KEY, F.unix_micros("first_seen").alias("us"), "dns_entropy").collect()
    assert len(got) == 2 and got[0].us % 1_000_000 == 313161 and got[0].dns_entropy == 1.5


def test_runs_take_packets_in_any_order(spark, tmp_path):
    """Repeated microseconds, word limits: all gap moments equal those of the batch operator."""
    rng = random.Random(5)
    rows, n = [], 0
    for flow in range(12):
        base = rng.choice([0, 5_000_000, 1_700_000_000_000_000])
        times = [base + rng.choice([0, 63, 64, 999, 1000, 1001, rng.randrange(5000), rng.randrange(90_000)]) for _ in range(rng.choice([1, 2, 3, 40]))]
        for t in times:
            rows.append((n, t, f"s{flow}", "d", 1, 53, "UDP", n % 7, rng.choice([None, "", f"q{n}.example"])))
            n += 1
    rng.shuffle(rows)
    source = packets(spark, rows)
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    source.repartition(4).write.parquet(folder)
    stream = sf.stream_flows(sio.read_packet_stream(spark, folder), 60.0, "1 second")
    sio.run_to_table(stream, out, checkpoint).awaitTermination()
    got = spark.read.parquet(out).unionByName(sf.open_flows(spark, checkpoint))
    want = fl.flow_features(source, 5.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 12


def test_state_of_a_hot_flow_is_bounded(spark, tmp_path):
    """A million packets of one flow in one second: a thousand rows of fixed size, and a dozen numbers."""
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    us = 1_700_000_000_000_000 + F.col("id") % 1_000_000
    rows = spark.range(1_000_000).select(
        F.col("id").alias("packet_id"), F.timestamp_micros(us).alias("ts"), *[F.lit(v).alias(c) for c, v in zip(FLOW_KEY, KEY1)],
        F.lit(5).cast("long").alias("length"), F.lit(None).cast("string").alias("dns_query"),
    )
    rows.write.parquet(folder)
    sio.run_to_table(sf.stream_flows(sio.read_packet_stream(spark, folder), 60.0, "60 seconds"), out, checkpoint).awaitTermination()
    buffers = sf.state_of(spark, checkpoint, "stateStoreSave")
    sizes = buffers.select(F.length(F.to_json("value")).alias("n")).agg(F.count("*"), F.max("n")).first()
    assert sizes[0] == 1000 and sizes[1] < 800
    # Drained as it stands, the flow is whole: no packet's time was kept, none is lost.
    flow = sf.open_flows(spark, checkpoint).first()
    assert (flow.packet_count, flow.total_bytes, flow.max_iat, flow.std_iat, flow.duration) == (1_000_000, 5_000_000, 0.000001, 0.0, 0.999999)


def test_joined_runs_equal_packets():
    rng = random.Random(8)
    times = sorted(rng.randrange(2_000_000) for _ in range(300))
    runs = []
    for k in sorted({t // 1000 for t in times}):
        own = [t for t in times if t // 1000 == k]
        gaps = np.diff(own)
        mean = float(gaps.mean()) if len(gaps) else 0.0
        runs.append((len(own), 7 * len(own), own[0], own[-1], len(gaps), int(min(gaps, default=0)), int(max(gaps, default=0)),
                     mean, float(((gaps - mean) ** 2).sum()), f"n{k}" if k % 3 == 0 else None))
    frame = pd.DataFrame(runs, columns=[*sf._RUN, "dns_query"])
    for idle in (3_000, 20_000, 10**9):
        cuts = [0, *[i for i in range(1, 300) if times[i] - times[i - 1] > idle], 300]
        got = sf.join_runs(frame, idle)
        assert len(got) == len(cuts) - 1
        for s, lo, hi in zip(got, cuts, cuts[1:]):
            own, gaps = times[lo:hi], np.diff(times[lo:hi])
            assert s[:7] == (hi - lo, 7 * (hi - lo), own[0], own[-1], len(gaps), min(gaps, default=0), max(gaps, default=0))
            assert s[8] == pytest.approx(float(((gaps - gaps.mean()) ** 2).sum()) if len(gaps) else 0.0)
            assert s[9] == next((f"n{k}" for k in sorted({t // 1000 for t in own}) if k % 3 == 0), None)


def test_open_flows_share_a_few_state_rows(spark, tmp_path):
    """400 flows in 8 buckets, some without ports, some in several sessions: 8 values are held and no flow is lost or mixed up."""
    rng = random.Random(3)
    rows, n = [], 0
    for flow in range(400):
        key = (f's"{flow}', None if flow % 7 == 0 else "d", None if flow % 5 == 0 else flow % 11, 53, "UDP")
        at = rng.randrange(20_000_000)
        for _ in range(rng.randrange(1, 6)):
            rows.append((n, at, *key, n % 9, rng.choice([None, f"q{n}.example"])))
            at, n = at + rng.choice([0, 1, 700, 1_000_000, 1_000_001, 2_500_000]), n + 1
    source = packets(spark, rows)
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    held = []
    for part in ("ts < timestamp_micros(12000000)", "ts >= timestamp_micros(12000000)"):
        source.filter(part).repartition(3).write.mode("append").parquet(folder)
        stream = sf.stream_flows(sio.read_packet_stream(spark, folder), 1.0, "1 second", buckets=8)
        sio.run_to_table(stream, out, checkpoint, state_partitions=3).awaitTermination()
        state = sf.state_of(spark, checkpoint, "transformWithState", stateVarName="flows")
        held.append(state.agg(F.count("*"), F.sum(F.size("value.flow"))).first())
    assert max(rows_held for rows_held, _ in held) <= 8 and held[0][1] > 8
    emitted = spark.read.parquet(out)
    got = emitted.unionByName(sf.open_flows(spark, checkpoint, 1.0))
    shared = [*FLOW_KEY, "packet_count", "total_bytes", "first_seen", "last_seen", "duration"]
    got, want = got.select(*shared), fl.session_flows(source, 1.0).select(*shared)
    assert 300 < emitted.count() < want.count() == got.count()
    assert got.exceptAll(want).count() == 0


def test_flow_files_are_dropped_once(spark, tmp_path):
    flows = fl.flow_features(packets(spark, [(i, i * 1000, f"s{i}", "d", 1, 2, "TCP", 5, None) for i in range(25)]), 5.0)
    folder = str(tmp_path / "drops")
    drop = sio.drop_flow_files(folder, rows_per_file=4)
    drop(flows, 3)
    drop(flows.limit(2), 3)  # given again: already published
    drop(flows.limit(0), 4)  # nothing to publish
    unfinished = tmp_path / "drops" / "_unfinished" / "0000000005"
    unfinished.mkdir(parents=True)
    (unfinished / "part-0.txt").write_text("[{broken")
    sio.drop_open_flows(flows.limit(1), folder)
    names = sorted(p.name for p in (tmp_path / "drops").iterdir() if p.name.startswith("flows"))
    assert names == ["flows_live_0000000003.json", "flows_live_final.json"]
    arrays = [json.loads(p.read_text()) for p in (tmp_path / "drops" / names[0]).glob("part-*")]
    assert sum(map(len, arrays)) == 25 and max(map(len, arrays)) <= 4
    out = str(tmp_path / "out")
    sio.run_to_table(sio.read_live_flows(spark, folder), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 26
    assert spark.read.parquet(out).exceptAll(flows.unionByName(flows.limit(1))).count() == 0


def test_kept_table_reads_bounded_files(spark, tmp_path):
    """Fifty batches, some given twice or late in a failure: sums are those of all, reads stay small."""
    path = str(tmp_path / "kept")
    table = KeptTable(spark, path, lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")), "k STRING, n BIGINT", every=8)
    assert table.read().count() == 0 and table.folders() == []
    want = {}
    for b in range(50):
        rows = [(f"k{(b * 7 + i) % 11}", b + i) for i in range(b % 4)]
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        batch = spark.createDataFrame(rows, "k STRING, n BIGINT").coalesce(1)
        table.append(batch, b)
        if b % 5 == 0:
            table.append(batch, b)  # given again
        assert len(table.folders()) <= 8
    table.append(spark.createDataFrame([("k0", 1000)], "k STRING, n BIGINT"), 3)  # long folded in
    assert {r.k: r.n for r in table.read().collect()} == want
    kept = [p for kind in ("deltas", "snapshots") for p in (tmp_path / "kept" / kind).iterdir()]
    assert len(kept) <= 8 + 8 + 2
    # A writer that failed before publishing leaves nothing that a reader sees.
    (tmp_path / "kept" / "_unfinished" / "deltas-000000000050").mkdir(parents=True, exist_ok=True)
    assert {r.k: r.n for r in table.read().collect()} == want


def test_sketched_ports_stay_within_their_error(spark, tmp_path):
    flows = spark.range(60_000).select(
        F.concat(F.lit("s"), F.when(F.col("id") < 150, 0).when(F.col("id") < 5_150, 1).otherwise(2)).alias("src_ip"),
        (F.col("id") % 50_000).cast("int").alias("dst_port"), F.lit(1.5).alias("duration"), F.lit(9).cast("long").alias("total_bytes"),
        F.lit(7).cast("long").alias("packet_count"), F.lit(2.0).alias("mean_iat"), (F.col("id") % 3 / 2.0).alias("std_iat"),
    )
    table = sd.source_table(spark, str(tmp_path / "kept"), every=3)
    for b in range(5):
        table.append(sd.source_deltas(flows.filter(F.col("id") % 5 == b)), b)
    got = {r.src_ip: r for r in sd.source_features(table.read()).collect()}
    want = {r.src_ip: r for r in entity_features(flows).collect()}
    for s, exact in want.items():
        assert tuple(got[s])[2:] == tuple(exact)[2:]
        assert abs(got[s].dst_port_count - exact.dst_port_count) <= sd.PORT_ERROR * exact.dst_port_count
    assert got["s0"].dst_port_count == 150
