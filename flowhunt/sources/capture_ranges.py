"""Capture files read by many tasks: byte ranges that find their first record by proof.

A record chain has no marks, so a range that begins in the middle of a file must find a header. It looks at
the bytes before its begin, one longest record and a margin, and follows every offset there that could be a
header. The true chain passes through this window and never breaks, so if all chains that survive meet in
one offset, that offset lies on the true chain. If they do not, as with captured captures that run
in step, or zeros, the window grows, and at last the headers are followed from the begin of the file, as they
are where the file is damaged or breaks its own limit of frame length.

pcapng packets name an interface of their section, which may be described in another range. The descriptions
are read by a pass of their own and joined; they are a few rows a file.

Files are opened through ``pyarrow.fs`` on the executors, which all must reach them. The writer puts packets
into pcap files, one per task, published when all are written.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from flowhunt.sources.capture import _ENHANCED, _INTERFACE, _PCAP_MAGIC, _SECTION, _SIMPLE, DAMAGED, _clock

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 64 << 20
LONGEST = 262_144  # bytes of a frame where a file states less: the limit capture tools use
MARGIN = 65_536
BLOCK = 1 << 20  # bytes of a pcapng block that a search takes for possible
BATCH_ROWS = 20_000
PLACE_BITS = 30  # records start at least 16 bytes apart: files of up to 16 GB have a place below this

_NG_MAGIC = b"\x0a\x0d\x0d\x0a"
RECORD = "path STRING, place BIGINT, kind INT, ts_us BIGINT, ticks BIGINT, interface INT, link INT, wire_length BIGINT, frame BINARY"


@dataclass(frozen=True)
class _File:
    """What the first bytes of a file say."""

    ng: bool
    order: str
    units: int
    link: int
    longest: int
    begin: int  # of the first record


def file_head(head: bytes, path: str = "") -> _File:
    magic = head[:4]
    if magic in _PCAP_MAGIC:
        order, units = _PCAP_MAGIC[magic]
        kept, link = struct.unpack_from(order + "II", head, 16)
        return _File(False, order, units, link & 0xFFFF, max(kept, LONGEST) if kept < 1 << 24 else LONGEST, 24)
    if magic == _NG_MAGIC:
        return _File(True, "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">", 1, 0, BLOCK, 0)
    raise ValueError(f"not a capture file: {path}")


def _next_offsets(file: _File, data: bytes, first: int, stop: int, size: int) -> np.ndarray:
    """For each offset first.. of ``data`` below ``stop``: where the record after it would start, or -1."""
    n = max(0, min(stop - first, len(data) - 15))
    raw = np.frombuffer(data, np.uint8)
    kind = "<u4" if file.order == "<" else ">u4"

    def word(at: int) -> np.ndarray:
        part = np.lib.stride_tricks.sliding_window_view(raw[at : at + n + 3], 4)
        return np.ascontiguousarray(part[:n]).view(kind).ravel()

    if n == 0:
        return np.zeros(0, np.int64)
    if not file.ng:
        # Few offsets pass the first test, and only those are looked at further.
        kept = word(8)
        at = np.flatnonzero(kept <= file.longest)
        at = at[word(4)[at] < file.units]
        end = first + at + 16 + kept[at].astype(np.int64)
        out = np.full(n, -1, np.int64)
        out[at[end <= size]] = end[end <= size]
        return out
    offset = first + np.arange(n)
    length = word(4).astype(np.int64)
    end = offset + length
    fits = (offset % 4 == 0) & (length % 4 == 0) & (length >= 12) & (length <= file.longest) & (end <= size)
    tail = end - 4 - first  # the length is repeated at the block's end
    seen = fits & (tail + 4 <= len(data))
    at = np.where(seen, tail, 0)
    repeated = sum(raw[np.minimum(at + k, len(raw) - 1)].astype(np.int64) << (8 * (k if file.order == "<" else 3 - k)) for k in range(4))
    return np.where(fits & (~seen | (repeated == length)), end, -1)


def first_record(file: _File, read, begin: int, size: int) -> tuple[int, bool]:
    """(offset, whether the chain reaches it) of the first record at or behind ``begin``, or of the file's first.

    ``read(offset, length)`` gives bytes of the file.
    """
    if begin <= file.begin:
        return file.begin, True
    for wider in (1, 4, 16):
        first = begin - wider * (file.longest + 16 + MARGIN)
        if first <= file.begin:
            break
        # Blocks repeat their length at their end, so look as far as that may be.
        data = read(first, begin - first + (file.longest if file.ng else 16))
        to = _next_offsets(file, data, first, begin, size)
        to = np.concatenate([to, np.full(begin - first - len(to), -1, np.int64)])
        inside = np.flatnonzero((to >= 0) & (to < begin))
        while len(inside):  # follow all chains at once, each round twice as far
            to[inside] = to[to[inside] - first]
            inside = inside[(to[inside] >= 0) & (to[inside] < begin)]
        ends = to[: file.longest + 16]
        ends = np.unique(ends[ends >= 0])
        if len(ends) == 1:
            return int(ends[0]), True
    return _from_the_begin(file, read, begin, size)


def _from_the_begin(file: _File, read, begin: int, size: int) -> tuple[int, bool]:
    """The same from the file's first record on, header by header."""
    at, data, base, order = file.begin, b"", 0, file.order
    while at < begin:
        if at + 16 > base + len(data):
            base, data = at, read(at, 8 << 20)
        if len(data) - (at - base) < 12:
            return file.begin, False
        if not file.ng:
            if len(data) - (at - base) < 16:
                return file.begin, False
            end = at + 16 + struct.unpack_from(order + "I", data, at - base + 8)[0]
        else:
            kind = data[at - base : at - base + 4]
            if kind == _NG_MAGIC:
                order = "<" if data[at - base + 8 : at - base + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            length = struct.unpack_from(order + "I", data, at - base + 4)[0]
            end = at + length if length >= 12 else size + 1
        if end > size:
            return file.begin, False
        at = end
    return at, True


class Range(InputPartition):
    """Records of a file that start in begin..end."""

    def __init__(self, path: str, begin: int, end: int, size: int) -> None:
        self.path, self.begin, self.end, self.size = path, begin, end, size


def _open(path: str):
    store, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return store, inner


def _listed(path: str) -> list[tuple[str, int]]:
    store, inner = _open(path)
    info = store.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else "file://"
    names = [(f, f.path[len(inner) :].split("/")) for f in found if f.type == pafs.FileType.File]
    return sorted(
        (prefix + f.path, f.size) for f, parts in names
        if ".pcap" in f.base_name and not any(p.startswith(("_", ".")) for p in parts)
    )


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, interfaces: bool, damaged: str) -> None:
        self.path, self.range_bytes, self.interfaces, self.damaged = path, range_bytes, interfaces, damaged

    def partitions(self) -> list[Range]:
        out = []
        for path, size in _listed(self.path):
            if size >> (PLACE_BITS + 4):
                raise ValueError(f"{path}: captures of 16 GB or more have no room in packet ids")
            out += [Range(path, b, min(b + self.range_bytes, size), size) for b in range(0, size, self.range_bytes)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, inner = _open(part.path)
        with store.open_input_file(inner) as source:

            def read(offset: int, length: int) -> bytes:
                source.seek(offset)
                return source.read(length)

            file = file_head(read(0, 64), part.path)
            if self.interfaces and not file.ng:
                return
            yield from self._batches(part, range_records(file, read, part, self.damaged, self.interfaces))

    def _batches(self, part: Range, records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        names = ["path", "place", "kind", "ts_us", "ticks", "interface", "link", "wire_length", "frame"]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([part.path] * len(rows), pa.string())]
            columns += [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for record in records:
            rows.append(record)
            if len(rows) == BATCH_ROWS:
                yield batch()
                rows = []
        if rows:
            yield batch()


def range_records(file: _File, read, part: Range, damaged: str = "raise", interfaces: bool = False) -> Iterator[tuple]:
    """(place, kind, ts_us, ticks, interface, link, wire_length, frame) of the records that start in a range.

    A record that does not fit raises, or with ``damaged="report"`` ends the chain with a row of link -1 whose
    ``wire_length`` is the number of the file's bytes left; the range in which it starts tells it.
    """
    at, proven = first_record(file, read, part.begin, part.size)
    data, base = b"", at

    def need(length: int) -> bytes | None:
        """Bytes at ``at``, or None where the file ends before."""
        nonlocal data, base
        if at + length > part.size:
            return None
        if at < base or at + length > base + len(data):
            base, data = at, read(at, max(length, min(part.end - at, 8 << 20) + 4096))
        return data

    order = file.order
    while at < part.end and at < part.size:
        head = need(16 if not file.ng else 12)
        mine = at >= part.begin
        if head is not None and not file.ng:
            seconds, fraction, kept, wire = struct.unpack_from(order + "IIII", head, at - base)
            body = need(16 + kept)
            if body is not None:
                if mine:
                    start = at - base + 16
                    yield at, _ENHANCED, seconds * 1_000_000 + fraction * 1_000_000 // file.units, None, None, file.link, wire, body[start : start + kept]
                at += 16 + kept
                continue
        elif head is not None:
            kind, size = struct.unpack_from(order + "II", head, at - base)
            if kind == _SECTION:
                order = "<" if head[at - base + 8 : at - base + 12] == b"\x4d\x3c\x2b\x1a" else ">"
                size = struct.unpack_from(order + "I", head, at - base + 4)[0]
            block = need(size) if size >= 12 else None
            if block is not None:
                start = at - base + 8
                if mine and interfaces and kind == _SECTION:
                    yield at, kind, None, None, None, None, None, None
                elif mine and interfaces and kind == _INTERFACE:
                    link = struct.unpack_from(order + "H", block, start)[0]
                    yield at, kind, None, _clock(block, start + 8, at - base + size - 4, order), None, link, None, None
                elif mine and not interfaces and kind == _ENHANCED:
                    number, high, low, kept, wire = struct.unpack_from(order + "IIIII", block, start)
                    yield at, kind, None, (high << 32) | low, number, None, wire, block[start + 20 : start + 20 + kept]
                elif mine and not interfaces and kind == _SIMPLE:
                    wire = struct.unpack_from(order + "I", block, start)[0]
                    yield at, kind, None, 0, 0, None, wire, block[start + 4 : min(start + 4 + wire, at - base + size - 4)]
                at += size
                continue
        if not mine and not proven:
            return  # the damage lies in an earlier range, which tells it
        if damaged == "raise":
            raise ValueError(f"{part.path}: damaged at byte {at}, {part.size - at} bytes left")
        if not interfaces:
            yield at, DAMAGED, 0, None, None, DAMAGED, part.size - at, None
        return


class PcapWriter(DataSourceArrowWriter):
    """One pcap file per task from (ts_us, link, wire_length, frame), renamed when all tasks are done."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, inner = _open(self.path)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.pcap"
        hidden = f"{inner}/_unfinished/{context.taskAttemptId()}-{name}"
        store.create_dir(f"{inner}/_unfinished", recursive=True)
        with store.open_output_stream(hidden) as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, LONGEST, 1))
            for batch in iterator:
                columns = (batch.column(c).to_pylist() for c in ("ts_us", "link", "wire_length", "frame"))
                for us, link, wire, frame in zip(*columns, strict=True):
                    if link != 1:
                        raise ValueError("only Ethernet frames are written")
                    out.write(struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(frame), wire) + frame)
        message = WriterCommitMessage()
        message.names = (hidden, f"{inner}/{name}")
        return message

    def commit(self, messages: list) -> None:
        store, inner = _open(self.path)
        for message in messages:
            if message is not None:
                store.move(*message.names)
        store.delete_dir(f"{inner}/_unfinished")

    def abort(self, messages: list) -> None:
        store, inner = _open(self.path)
        if store.get_file_info(f"{inner}/_unfinished").type == pafs.FileType.Directory:
            store.delete_dir(f"{inner}/_unfinished")


class CaptureSource(DataSource):
    """``spark.read.format("capture")``: options path, rangeBytes, rows (frames or interfaces), damaged."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> CaptureReader:
        o = self.options
        return CaptureReader(o["path"], int(o.get("rangebytes", RANGE_BYTES)), o.get("rows") == "interfaces", o.get("damaged", "raise"))

    def writer(self, schema, overwrite: bool) -> PcapWriter:
        return PcapWriter(self.options["path"])


def read_frame_ranges(
    spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, damaged: str = "raise"
) -> DataFrame:
    """Frames of every capture below ``path``: path, place (ascending in a file), ts_us, link, wire_length, frame."""
    spark.dataSource.register(CaptureSource)
    reader = spark.read.format("capture").option("rangeBytes", range_bytes).option("damaged", damaged)
    records = reader.load(path)
    described = reader.option("rows", "interfaces").load(path)
    entry = F.struct("place", (F.col("kind") == _SECTION).alias("opens"), "link", F.col("ticks").alias("units"))
    tables = described.groupBy("path").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    joined = records.join(tables, "path", "left")
    opened = F.array_max(F.transform(
        F.filter("entries", lambda e: e["opens"] & (e["place"] < F.col("place"))), lambda e: e["place"]
    ))
    own = F.filter("entries", lambda e: ~e["opens"] & (e["place"] > F.col("opened")) & (e["place"] < F.col("place")))
    known = F.when(F.col("interface").isNotNull(), F.element_at(own, F.col("interface") + 1))
    units, ticks = F.col("of")["units"], F.col("ticks")
    # Whole seconds apart, so that no product leaves the range of a long.
    micros = F.expr("ticks div of.units") * 1_000_000 + F.floor((ticks % units) * F.lit(1_000_000) / units)
    return (
        joined.withColumn("opened", F.when(F.col("interface").isNotNull(), opened)).withColumn("of", known)
        .select(
            "path", F.shiftright("place", 4).alias("place"), F.coalesce("ts_us", micros).cast("bigint").alias("ts_us"),
            F.coalesce("link", F.col("of")["link"]).alias("link"), "wire_length", "frame",
        )
    )


def write_capture(frames: DataFrame, path: str) -> None:
    """Frames (``capture.encode_frames``) as pcap files, one per task, in a new folder."""
    frames.sparkSession.dataSource.register(CaptureSource)
    frames.select("ts_us", "link", "wire_length", "frame").write.format("capture").mode("append").save(path)
