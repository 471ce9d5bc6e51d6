"""Capture files."""

import random
import struct
import tracemalloc

import pytest
from pyspark.sql import functions as F

from flowhunt.sources import capture, capture_ranges as ranges


def ipv4(proto, src, dst, payload):
    header = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(payload), 0, 0, 64, proto, 0, bytes(src), bytes(dst))
    return header + payload


def dns(name):
    labels = b"".join(bytes([len(p.encode())]) + p.encode() for p in name.split("."))
    return struct.pack(">HHHHHH", 1, 0x100, 1, 0, 0, 0) + labels + b"\x00" + struct.pack(">HH", 1, 1)


def udp(sport, dport, payload=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def tcp(sport, dport):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, 0x18, 0, 0, 0)


A, B = (10, 0, 0, 1), (192, 168, 200, 254)
ETHER = b"\x02" * 12
FRAMES = [
    (1_700_000_000_000_001, ETHER + b"\x08\x00" + ipv4(17, A, B, udp(5000, 53, dns("www.bücher.example")))),
    (1_700_000_000_250_000, ETHER + b"\x81\x00\x00\x05\x08\x00" + ipv4(6, B, A, tcp(443, 50000))),
    (1_700_000_000_300_000, ETHER + b"\x08\x06" + b"\x00" * 40),  # ARP
    (1_700_000_000_400_000, ETHER + b"\x08\x00" + ipv4(1, A, B, b"\x00" * 8)),  # ICMP
    (1_700_000_000_500_000, ETHER + b"\x08\x00" + ipv4(17, A, B, udp(70, 80))),
]


def pcap(frames, order="<", magic=0xA1B2C3D4, units=1_000_000):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for us, data in frames:
        seconds, part = divmod(us, 1_000_000)
        out += struct.pack(order + "IIII", seconds, part * units // 1_000_000, len(data), len(data) + 100) + data
    return out


def block(kind, body):
    body += b"\x00" * (-len(body) % 4)
    size = struct.pack("<I", 12 + len(body))
    return struct.pack("<I", kind) + size + body + size


def pcapng(frames):
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    for us, data in frames:
        ticks = us * 1000
        out += block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data)
    return out


def test_read_capture(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(FRAMES))
    (tmp_path / "b.pcap").write_bytes(pcap(FRAMES, ">", 0xA1B23C4D, 1_000_000_000))
    (tmp_path / "c.pcapng").write_bytes(pcapng(FRAMES))
    (tmp_path / "notes.txt").write_text("not a capture")
    got = capture.read_capture(spark, str(tmp_path)).orderBy("ts").collect()
    assert len(got) == 9 and len({r.packet_id for r in got}) == 9
    for r in got[:3]:
        assert (r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol) == ("10.0.0.1", "192.168.200.254", 5000, 53, "UDP")
        assert (r.dns_query, r.length, r.ts.microsecond) == ("www.bücher.example", len(FRAMES[0][1]), 1)
    assert {(r.src_port, r.protocol, r.dns_query) for r in got[3:6]} == {(443, "TCP", None)}
    wire = capture.read_capture(spark, str(tmp_path / "a.pcap"), length="wire").agg({"length": "max"}).first()[0]
    assert wire == len(FRAMES[0][1]) + 100


def test_damaged_captures_are_reported(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(FRAMES)[:-7])
    (tmp_path / "b.pcapng").write_bytes(pcapng(FRAMES)[:-7])
    with pytest.raises(Exception, match="damaged behind frame 4"):
        capture.read_frames(spark, str(tmp_path)).count()
    frames = capture.read_frames(spark, str(tmp_path), damaged="report")
    assert frames.count() == 2 * len(FRAMES)
    left = frames.filter(frames.link == capture.DAMAGED).collect()
    assert len(left) == 2 and all(r.wire_length > 0 and r.frame is None for r in left)
    numbered = frames.withColumnRenamed("frame_no", "packet_id")
    assert capture.decode_frames(numbered).count() == 4


def embedded(n, rng):
    """Frames with payloads that look like records: zeros, whole captures, single records, noise."""
    inner = pcap(FRAMES)
    kinds = [b"\x00" * 700, inner, inner[24:], inner[24 : 24 + 16 + len(FRAMES[0][1])], rng.randbytes(300), b""]
    return [(1_700_000_000_000_000 + i * 1000, ETHER + b"\x08\x00" + ipv4(17, A, B, udp(1000 + i, 80, rng.choice(kinds)))) for i in range(n)]


@pytest.mark.parametrize("kind", ["pcap", "pcapng"])
def test_first_record_is_found_from_every_offset(kind, monkeypatch):
    monkeypatch.setattr(ranges, "LONGEST", 2000)
    monkeypatch.setattr(ranges, "BLOCK", 2000)
    monkeypatch.setattr(ranges, "MARGIN", 500)
    frames = embedded(60, random.Random(3))
    data = pcap(frames) if kind == "pcap" else pcapng(frames)
    if kind == "pcap":
        data = data[:16] + struct.pack("<I", 2000) + data[20:]
    file, starts = ranges.file_head(data[:64]), []
    at = file.begin
    while at < len(data):
        starts.append(at)
        at += 16 + struct.unpack_from("<I", data, at + 8)[0] if kind == "pcap" else struct.unpack_from("<I", data, at + 4)[0]
    fallbacks = []
    slow = ranges._from_the_begin
    monkeypatch.setattr(ranges, "_from_the_begin", lambda *a: fallbacks.append(a[2]) or slow(*a))
    for begin in range(0, len(data) + 1):
        want = next((s for s in starts if s >= begin), len(data))
        assert ranges.first_record(file, lambda o, n: data[o : o + n], begin, len(data)) == (want, True), begin
    assert len(fallbacks) < len(data) / 2


@pytest.mark.parametrize("size", [100, 1000, 5000, 1 << 20])
def test_ranges_equal_the_sequential_reader(spark, tmp_path, size):
    frames = embedded(40, random.Random(5))
    section = pcapng(frames[20:])
    (tmp_path / "a.pcap").write_bytes(pcap(frames))
    (tmp_path / "b.pcap").write_bytes(pcap(frames, ">", 0xA1B23C4D, 1_000_000_000))
    # Two sections with different clocks; the second describes its interface anew.
    micros = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    for us, data in frames[:20]:
        micros += block(6, struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(data), len(data)) + data)
    (tmp_path / "c.pcapng").write_bytes(micros + section)
    (tmp_path / "notes.txt").write_text("not a capture")
    found = ranges.read_frame_ranges(spark, str(tmp_path), size)
    got = [(r.path.rsplit("/", 1)[1], r.ts_us, r.link, r.wire_length, bytes(r.frame)) for r in found.orderBy("path", "place").collect()]
    whole = capture.read_frames(spark, str(tmp_path)).orderBy("path", "frame_no").collect()
    want = [(r.path.rsplit("/", 1)[1], r.ts_us, r.link, r.wire_length, bytes(r.frame)) for r in whole]
    assert sorted(got) == sorted(want) and len(got) == 120
    assert [g for g in got if g[0] == "c.pcapng"] == [w for w in want if w[0] == "c.pcapng"]
    packets = capture.read_capture(spark, str(tmp_path), range_bytes=size)
    assert packets.count() == 120 and packets.select("packet_id").distinct().count() == 120


def test_damage_is_told_by_its_range(spark, tmp_path):
    frames = embedded(40, random.Random(7))
    (tmp_path / "a.pcap").write_bytes(pcap(frames)[:-7])
    (tmp_path / "b.pcapng").write_bytes(pcapng(frames)[:-7])
    with pytest.raises(Exception, match="damaged at byte"):
        ranges.read_frame_ranges(spark, str(tmp_path), 3000).count()
    told = ranges.read_frame_ranges(spark, str(tmp_path), 3000, damaged="report")
    left = told.filter(F.col("link") == capture.DAMAGED).collect()
    assert told.count() == 80 and len(left) == 2 and all(r.wire_length > 0 and r.frame is None for r in left)


def test_written_captures_are_read_back(spark, tmp_path):
    rows = [(i, 1_700_000_000_000_000 + i, 1, 60 + i, FRAMES[0][1]) for i in range(50)]
    frames = spark.createDataFrame(rows, "packet_id long, ts_us long, link int, wire_length long, frame binary").repartition(3)
    folder = str(tmp_path / "out")
    ranges.write_capture(frames, folder)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"part-0000{i}.pcap" for i in range(3)]
    back = ranges.read_frame_ranges(spark, folder, 500)
    assert sorted((r.ts_us, r.link, r.wire_length) for r in back.collect()) == [r[1:4] for r in rows]
    with pytest.raises(Exception):
        ranges.read_frame_ranges(spark, str(tmp_path / "nowhere")).count()


def test_names_are_walked_by_label(spark):
    """Cut, overlong and repeated names; a name takes as many steps as its bytes can hold labels, not 256."""
    names = [(b"\x03www\x01b\x00", "www.b"), (b"\x03ww", "ww"), (b"\x01a\x02", "a."), (b"\x01a\x40" + b"b" * 64, "a"), (b"\x00", None), (b"", None)]
    names.append((b"\x3f" + b"c" * 63, "c" * 63))
    names.append((b"\x01d" * 200, ".".join("d" * 128)))  # 256 bytes at most
    rows = [(i, bytearray(b"##" + raw)) for i, (raw, _) in enumerate(names)]
    told = spark.createDataFrame(rows, "i INT, frame BINARY").select("i", capture.dns_name(F.col("frame"), F.lit(2)).alias("name"))
    assert [r.name for r in told.orderBy("i").collect()] == [name for _, name in names]
    assert "sequence(0, 255" not in told._jdf.queryExecution().analyzed().toString()


def test_search_for_a_record_looks_at_few_offsets():
    rng, records = random.Random(1), []
    for i in range(9000):
        body = rng.randbytes(rng.randrange(40, 90))
        records.append(struct.pack("<IIII", 1_700_000_000 + i, i, len(body), len(body)) + body)
    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262_144, 1) + b"".join(records)
    file = ranges.file_head(data[:64])
    tracemalloc.start()
    found = ranges.first_record(file, lambda o, n: data[o : o + n], 500_000, len(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    at = 24
    while at < 500_000:
        at += 16 + struct.unpack_from("<I", data, at + 8)[0]
    assert found == (at, True) and peak < 8 << 20
