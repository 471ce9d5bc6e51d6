"""Capture files (pcap, pcapng) to packet rows.

Python only cuts files into frames; headers and DNS names are decoded by column expressions, so
that work spreads over whatever partitions follow. Files are cut in byte ranges (``capture_ranges``) or, here, one
task each. Packet tables in Parquet are the main source.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowhunt.schemas import PACKET

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FRAME = "path STRING, frame_no BIGINT, ts_us BIGINT, link INT, wire_length BIGINT, frame BINARY"
_FRAMES_PER_BATCH = 20_000
DAMAGED = -1  # link of the row that reports unread bytes

# File signatures with byte order and time units per second, and block types.
_PCAP_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
_SECTION, _INTERFACE, _SIMPLE, _ENHANCED = 0x0A0D0D0A, 1, 3, 6

# Bytes before the IP header per link type (null, Ethernet, raw IP, Linux cooked 1 and 2).
LINK_HEADER = {0: 4, 1: 14, 101: 0, 113: 16, 276: 20}
DNS_PORTS = (53, 5353)


class _Damaged(ValueError):
    """A record that does not fit the file; holds the number of bytes not read."""


def _pcap_records(data: bytes, order: str, units: int) -> Iterator[tuple]:
    link = struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF
    at = 24
    while at + 16 <= len(data):
        seconds, part, kept, wire = struct.unpack_from(order + "IIII", data, at)
        at += 16
        if at + kept > len(data):
            at -= 16
            break
        yield seconds * 1_000_000 + part * 1_000_000 // units, link, wire, data[at : at + kept]
        at += kept
    if at < len(data):
        raise _Damaged(len(data) - at)


def _pcapng_records(data: bytes) -> Iterator[tuple]:
    at, order, interfaces = 0, "<", []
    while at + 12 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind == _SECTION:
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            size = struct.unpack_from(order + "I", data, at + 4)[0]
            interfaces = []
        if size < 12 or at + size > len(data):
            break
        body = at + 8
        if kind == _INTERFACE:
            interfaces.append((struct.unpack_from(order + "H", data, body)[0], _clock(data, body + 8, at + size - 4, order)))
        elif kind == _ENHANCED:
            number, high, low, kept, wire = struct.unpack_from(order + "IIIII", data, body)
            link, units = interfaces[number]
            ticks = (high << 32) | low
            yield ticks * 1_000_000 // units, link, wire, data[body + 20 : body + 20 + kept]
        elif kind == _SIMPLE:
            wire = struct.unpack_from(order + "I", data, body)[0]
            yield 0, interfaces[0][0], wire, data[body + 4 : min(body + 4 + wire, at + size - 4)]
        at += size
    if at < len(data):
        raise _Damaged(len(data) - at)


def _clock(data: bytes, at: int, end: int, order: str) -> int:
    """Ticks per second of an interface (option 9); microseconds by default."""
    while at + 4 <= end:
        code, size = struct.unpack_from(order + "HH", data, at)
        if code == 0:
            break
        if code == 9:
            power = data[at + 4]
            return 1 << (power & 0x7F) if power & 0x80 else 10**power
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def cut_frames(files: Iterator[pd.DataFrame], damaged: str = "raise") -> Iterator[pd.DataFrame]:
    """Frames of whole files. A record that does not fit raises, or with ``damaged="report"`` ends its file
    with a row of link -1 and no frame whose ``wire_length`` is the number of bytes left."""
    names = ["path", "frame_no", "ts_us", "link", "wire_length", "frame"]
    for batch in files:
        for path, data in zip(batch["path"], batch["content"], strict=True):
            magic = bytes(data[:4])
            if magic in _PCAP_MAGIC:
                records = _pcap_records(data, *_PCAP_MAGIC[magic])
            elif magic == b"\x0a\x0d\x0d\x0a":
                records = _pcapng_records(data)
            else:
                raise ValueError(f"not a capture file: {path}")
            rows, number = [], 0
            try:
                for record in records:
                    rows.append((path, number, *record))
                    number += 1
                    if len(rows) == _FRAMES_PER_BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            except _Damaged as left:
                if damaged == "raise":
                    raise ValueError(f"{path}: damaged behind frame {number}, {left} bytes left") from None
                rows.append((path, number, 0, DAMAGED, left.args[0], None))
            if rows:
                yield pd.DataFrame(rows, columns=names)


def read_frames(spark: SparkSession, path: str, damaged: str = "raise") -> DataFrame:
    """Frames of every ``.pcap`` and ``.pcapng`` file below ``path``; for ``damaged`` see ``cut_frames``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap*").load(path)
    return files.select("path", "content").mapInPandas(lambda batches: cut_frames(batches, damaged), FRAME)


def _number(frame: Column, start: Column, size: int) -> Column:
    """Big-endian unsigned integer at a 0-based offset."""
    digits = F.hex(F.substring(frame, start + 1, F.lit(size)))
    return F.conv(F.when(digits != "", digits), 16, 10).cast("bigint")


def _dotted(frame: Column, start: Column) -> Column:
    return F.concat_ws(".", *[_number(frame, start + i, 1).cast("string") for i in range(4)])


def dns_name(frame: Column, start: Column) -> Column:
    """First question name: a walk over length-prefixed labels, at most 255 bytes by protocol.

    A step takes a label. The digits travel in the state, as an outer column would be computed anew in each step.
    """
    digits = F.hex(F.substring(frame, start + 1, F.lit(256)))
    state = F.struct(digits.alias("digits"), F.lit(1).alias("at"), F.lit("").alias("text"), F.lit(False).alias("done"))

    def step(seen: Column, _: Column) -> Column:
        digits, at = seen["digits"], seen["at"]
        size = F.conv(F.substring(digits, at, F.lit(2)), 16, 10).cast("int")
        ends = seen["done"] | (at > F.length(digits)) | (size == 0) | (size > 63)
        dot = F.when(seen["text"] != "", F.lit("2E")).otherwise("")
        return F.when(
            ends, F.struct(digits.alias("digits"), at.alias("at"), seen["text"].alias("text"), F.lit(True).alias("done"))
        ).otherwise(F.struct(
            digits.alias("digits"), (at + 2 + 2 * size).alias("at"),
            F.concat(seen["text"], dot, F.substring(digits, at + 2, 2 * size)).alias("text"), F.lit(False).alias("done"),
        ))

    # A label takes two bytes at least, that is four digits.
    labels = F.sequence(F.lit(0), F.floor(F.length(digits) / 4).cast("int"))
    return F.aggregate(labels, state, step, lambda seen: F.when(seen["text"] != "", F.decode(F.unhex(seen["text"]), "UTF-8")))


def decode_frames(frames: DataFrame, length: str = "captured") -> DataFrame:
    """PACKET rows from (packet_id, ts_us, link, wire_length, frame): IPv4 TCP and UDP only.

    ``length="wire"`` counts bytes on the wire instead of bytes kept.
    """
    frame = F.col("frame")
    links = F.create_map(*[F.lit(x) for pair in LINK_HEADER.items() for x in pair])
    tagged = (F.col("link") == 1) & (_number(frame, F.lit(12), 2) == 0x8100)
    ip = F.col("_ip")
    at_ip = frames.withColumn("_ip", links[F.col("link")] + F.when(tagged, 4).otherwise(0))
    first = _number(frame, ip, 1)
    number = F.col("_proto")
    is_v4 = (F.floor(first / 16) == 4) & ((F.col("link") != 1) | (_number(frame, ip - 2, 2) == 0x0800))
    parsed = at_ip.filter(is_v4).withColumns(
        {
            "_proto": _number(frame, ip + 9, 1),
            "_l4": ip + (first % 16) * 4,
            "_piece": _number(frame, ip + 6, 2) % 8192,
        }
    ).filter(number.isin(6, 17) & (F.col("_piece") == 0))
    l4 = F.col("_l4")
    ports = parsed.withColumns(
        {
            "src_port": _number(frame, l4, 2).cast("int"),
            "dst_port": _number(frame, l4 + 2, 2).cast("int"),
            "_dns": F.when(number == 17, l4 + 8).otherwise(
                l4 + F.floor(_number(frame, l4 + 12, 1) / 16) * 4 + 2
            ),
        }
    )
    dns = F.col("_dns")
    asks = (F.col("src_port").isin(*DNS_PORTS) | F.col("dst_port").isin(*DNS_PORTS)) & (
        _number(frame, dns + 4, 2) > 0
    )
    size = F.length("frame").cast("bigint") if length == "captured" else F.col("wire_length")
    return ports.select(
        "packet_id",
        F.timestamp_micros("ts_us").alias("ts"),
        _dotted(frame, ip + 12).alias("src_ip"),
        _dotted(frame, ip + 16).alias("dst_ip"),
        "src_port",
        "dst_port",
        F.when(number == 6, "TCP").otherwise("UDP").alias("protocol"),
        size.alias("length"),
        F.when(asks, dns_name(frame, dns + 12)).alias("dns_query"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in PACKET.fields])


def read_capture(
    spark: SparkSession, path: str, length: str = "captured", range_bytes: int | None = None, whole_files: bool = False
) -> DataFrame:
    """PACKET rows of all capture files below ``path``, read in byte ranges by many tasks.

    Ids hold 33 bits of a hash of the path and 30 bits for the record's place; within a file the ids
    follow its order. ``whole_files=True`` reads each file in one task through Spark's own reader, for
    stores that ``pyarrow.fs`` cannot open.
    """
    if whole_files:
        frames = read_frames(spark, path).withColumnRenamed("frame_no", "place")
    else:
        from flowhunt.sources.capture_ranges import RANGE_BYTES, read_frame_ranges

        frames = read_frame_ranges(spark, path, range_bytes or RANGE_BYTES)
    file_id = F.pmod(F.xxhash64("path"), F.lit(1 << 33))
    numbered = frames.withColumn("packet_id", F.shiftleft(file_id, 30) + F.col("place"))
    return decode_frames(numbered, length)


def encode_frames(packets: DataFrame) -> DataFrame:
    """Ethernet/IPv4 frames with the headers and first question of PACKET rows.

    The inverse of :func:`decode_frames`, for exchange and for testing it on whole tables: built
    by expressions, no payload besides the DNS question; ``wire_length`` carries the length.
    """

    def two(value: Column) -> Column:
        return F.lpad(F.hex(value.cast("bigint")), 4, "0")

    def address(ip: Column) -> Column:
        return F.concat(*[F.lpad(F.hex(F.split(ip, r"\.")[i].cast("bigint")), 2, "0") for i in range(4)])

    tcp = F.col("protocol") == "TCP"
    labels = F.transform(
        F.split("dns_query", r"\."),
        lambda p: F.concat(F.lpad(F.hex(F.octet_length(p).cast("bigint")), 2, "0"), F.hex(F.encode(p, "UTF-8"))),
    )
    question = F.concat(
        F.lit("00010100000100000000" + "0000"), F.array_join(labels, ""), F.lit("00" + "00010001")
    )
    segment = F.when(tcp, F.concat(F.lit("00000000" * 2 + "5018" + "2000" + "00000000"))).otherwise(
        F.concat(F.lit("00000000"), F.coalesce(F.when(F.col("dns_query").isNotNull(), question), F.lit("")))
    )
    body = F.concat(two(F.col("src_port")), two(F.col("dst_port")), segment)
    ip = F.concat(
        F.lit("4500"), two(F.length(body) / 2 + 20), F.lit("0000" + "4000" + "40"),
        F.when(tcp, "06").otherwise("11"), F.lit("0000"), address(F.col("src_ip")), address(F.col("dst_ip")),
    )
    frame = F.unhex(F.concat(F.lit("02" * 12 + "0800"), ip, body))
    return packets.select(
        "packet_id", F.unix_micros("ts").alias("ts_us"), F.lit(1).alias("link"),
        F.col("length").alias("wire_length"), frame.alias("frame"),
    )
