"""Flows and counters from an endless packet stream.

Two stateful steps. The first is a built-in aggregate per (flow, millisecond): counts, ends and sixteen words
whose bits mark the microseconds at which packets came. Its buffer has a fixed size however many packets
a flow sends, takes them in any order, and combines before the shuffle. A closed millisecond becomes a run:
counts, ends and the moments of its gaps. The second step keeps a dozen numbers per flow and joins closed
runs, which reach it in time order, until the flow has been silent for longer than the idle time. It deals the
flows over a fixed number of buckets and joins all runs of a bucket at once.

What a stopped query still holds is read from its checkpoint by :func:`open_flows`.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowhunt.functions.columns import MICROS
from flowhunt.functions.text import clean_query
from flowhunt.operators.flows import finish_flows, merge_slices, packet_gate, packet_stats
from flowhunt.schemas import FLOW_KEY

cloudpickle.register_pickle_by_value(sys.modules[__name__])

IDLE_SECONDS = 60.0
WATERMARK = "60 seconds"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BUCKETS = 1024  # values of state that the open flows are dealt over

RUN_US = 1000  # microseconds of a run: the finest window Spark cuts
_WORD = 64
_WORDS = -(-RUN_US // _WORD)

_KEY_DDL = "src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING"
_RUN = ["n", "bytes", "first_us", "last_us", "gap_n", "gap_min", "gap_max", "gap_mean", "gap_m2"]
_HELD = ["flow", *_RUN, "dns_query"]  # what an open flow holds; its key travels as one JSON text
_STATE_DDL = ", ".join(
    f"{c} ARRAY<{'STRING' if c in ('flow', 'dns_query') else 'DOUBLE' if c in ('gap_mean', 'gap_m2') else 'BIGINT'}>" for c in _HELD
) + ", timer BIGINT"
_MERGED_DDL = (
    "flow STRING, packet_count BIGINT, total_bytes BIGINT, first_us BIGINT, last_us BIGINT, "
    "gap_min BIGINT, gap_max BIGINT, gap_mean DOUBLE, gap_m2 DOUBLE, dns_query STRING"
)
# The aggregate's buffer in a checkpoint, in the order in which ``_buffers`` lists its functions.
_BUFFER = "struct<n:bigint,bytes:bigint,first_us:bigint,last_us:bigint,dns:struct<us:bigint,packet_id:bigint,name:string>," + ",".join(
    f"w{i}:bigint" for i in range(_WORDS)
) + ">"


def _buffers() -> list[Column]:
    us = F.unix_micros("ts")
    place = F.pmod(us, F.lit(RUN_US)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place % _WORD)
    query = clean_query(F.col("dns_query"))
    named = F.when(query.isNotNull(), F.struct(us.alias("us"), F.col("packet_id"), query.alias("name")))
    return [
        F.count("*").alias("n"), F.sum("length").alias("bytes"), F.min(us).alias("first_us"), F.max(us).alias("last_us"),
        F.min(named).alias("dns"),
        *[F.bit_or(F.when(F.floor(place / _WORD) == i, bit)).alias(f"w{i}") for i in range(_WORDS)],
    ]


def _with_gaps(buffers: DataFrame) -> DataFrame:
    """Moments of the gaps of each run. Packets of one microsecond are gaps of 0; two packets need no bits."""
    n, span = F.col("n"), F.col("last_us") - F.col("first_us")
    words = F.filter(
        F.array(*[F.struct(F.lit(i * _WORD).alias("at"), F.col(f"w{i}").alias("bits")) for i in range(_WORDS)]),
        lambda w: w["bits"].isNotNull(),
    )
    places = F.flatten(F.transform(words, lambda w: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(_WORD - 1)), lambda b: F.getbit(w["bits"], b) == 1), lambda b: w["at"] + b
    )))
    pairs = F.zip_with(
        F.slice("places", 2, F.size("places")), F.slice("places", 1, F.size("places") - 1),
        lambda after, before: (after - before).cast("bigint"),
    )
    none, several = F.lit(0).cast("bigint"), F.col("gaps").isNotNull()
    repeats = n - 1 - F.size("gaps")
    mean = span / F.when(n > 1, n - 1)

    def square(x: Column) -> Column:
        return (x - F.col("gap_mean")) * (x - F.col("gap_mean"))

    spread = F.aggregate("gaps", F.lit(0.0), lambda total, g: total + square(g)) + repeats * square(F.lit(0.0))
    return (
        buffers.withColumn("places", F.when(n > 2, places))
        .withColumn("gaps", F.when(n > 2, pairs))
        .withColumn("gap_mean", F.coalesce(mean, F.lit(0.0)))
        .withColumn("gap_n", n - 1)
        .withColumn("gap_min", F.when(several, F.when(repeats > 0, none).otherwise(F.array_min("gaps"))).when(n > 1, span).otherwise(none))
        .withColumn("gap_max", F.when(several, F.coalesce(F.array_max("gaps"), none)).when(n > 1, span).otherwise(none))
        .withColumn("gap_m2", F.when(several, spread).otherwise(F.lit(0.0)))
        .withColumn("dns_query", F.col("dns")["name"])
    )


def run_stream(packets: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Closed runs: counts, ends, gap moments and first DNS name per (flow, millisecond)."""
    gated = packet_gate(packets.withWatermark("ts", watermark))
    runs = gated.groupBy(*FLOW_KEY, F.window("ts", f"{RUN_US // 1000} milliseconds").alias("run")).agg(*_buffers())
    return _with_gaps(runs.withColumn("run_end", F.window_time("run"))).select(*FLOW_KEY, "run_end", *_RUN, "dns_query")


class FlowSessions(StatefulProcessor):
    """Joins the runs of the flows of one bucket and emits each flow once it is idle.

    All open flows of a bucket are one value, its columns as arrays, so that a batch costs a few calls per bucket,
    not several per flow. One timer per bucket stands for the flow that ends first.
    """

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("flows", _STATE_DDL)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs = pd.concat(list(rows), ignore_index=True)[_HELD]
        state = self.open.get()
        if state:
            runs = pd.concat([self._held(state), runs], ignore_index=True)
        flow = pd.factorize(runs["flow"])[0]
        order = np.lexsort((runs["first_us"].to_numpy(), flow))
        runs, flow = runs.iloc[order], flow[order]
        sessions = pd.DataFrame(join_runs(runs, self.idle_us, flow), columns=[*_HELD[1:], "place"])
        at = sessions.pop("place").to_numpy()
        sessions.insert(0, "flow", runs["flow"].to_numpy(dtype=object)[at])
        last = np.append(flow[at][1:] != flow[at][:-1], True)  # the last session of each flow
        self._keep(sessions[last], state[-1] if state else None)
        if not last.all():
            yield self._rows(sessions[~last])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.open.get()
        if state:
            flows = self._held(state)
            ended = self._timers(flows) <= timerValues.getCurrentWatermarkInMs()
            self._keep(flows[~ended], state[-1])
            yield self._rows(flows[ended])

    def _timers(self, flows: pd.DataFrame) -> np.ndarray:
        """The millisecond behind which each flow is idle."""
        return (flows["last_us"].to_numpy("int64") + self.idle_us + RUN_US) // 1000 + 1

    def _keep(self, flows: pd.DataFrame, timer: int | None) -> None:
        """Hold these flows; ``timer`` is the one registered before."""
        first = int(self._timers(flows).min()) if len(flows) else None
        if timer is not None and timer != first:
            self.handle.deleteTimer(int(timer))
        if first is None:
            self.open.clear()
            return
        if timer != first:
            self.handle.registerTimer(first)
        self.open.update((*[flows[c].tolist() for c in _HELD], first))

    @staticmethod
    def _held(state: tuple) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(_HELD, state)))

    @staticmethod
    def _rows(flows: pd.DataFrame) -> pd.DataFrame:
        return flows.drop(columns="gap_n").rename(columns={"n": "packet_count", "bytes": "total_bytes"})

    def close(self) -> None:
        pass


def join_runs(runs: pd.DataFrame, idle_us: int, flow: np.ndarray | None = None) -> list[tuple]:
    """Runs in time order as sessions, one tuple each: the gaps between runs join the gaps inside them.

    ``flow`` numbers the flows of the runs, which then come in order of flow and time. The last value of a
    tuple is the place of the session's first run.
    """
    n, size, first, last, gap_n, low, high, mean, m2 = (runs[c].to_numpy() for c in _RUN)
    edge = first[1:] - last[:-1]
    opens = np.concatenate([[True], edge > idle_us])
    if flow is not None:
        opens[1:] |= flow[1:] != flow[:-1]
    starts = np.flatnonzero(opens)
    session = np.cumsum(opens) - 1
    ends = np.maximum.reduceat(last, starts)
    total = np.add.reduceat(n, starts)
    middle = (ends - first[starts]) / np.maximum(total - 1, 1)
    # Squared deviations around the final mean, of the gaps inside runs and of those between them.
    inside = m2 + gap_n * (mean - middle[session]) ** 2
    across = np.where(opens[1:], 0.0, (edge - middle[session[1:]]) ** 2)
    spread = np.add.reduceat(inside + np.concatenate([[0.0], across]), starts)
    none = np.iinfo(np.int64).max
    least = np.minimum.reduceat(np.minimum(np.where(gap_n > 0, low, none), np.concatenate([[none], np.where(opens[1:], none, edge)])), starts)
    most = np.maximum.reduceat(np.maximum(np.where(gap_n > 0, high, -1), np.concatenate([[-1], np.where(opens[1:], -1, edge)])), starts)
    names = runs["dns_query"].where(runs["dns_query"].notna(), None).to_numpy(dtype=object)
    named = np.flatnonzero([isinstance(x, str) for x in names])
    found = {int(session[i]): names[i] for i in named[::-1]}
    out = zip(total, np.add.reduceat(size, starts), first[starts], ends, total - 1, least, most, middle, spread, strict=True)
    sessions = []
    for k, (count, amount, begin, end, gaps, lowest, highest, average, around) in enumerate(out):
        ranges = (int(lowest), int(highest), float(average), float(around)) if count > 1 else (0, 0, 0.0, 0.0)
        sessions.append((int(count), int(amount), int(begin), int(end), int(gaps), *ranges, found.get(k), int(starts[k])))
    return sessions


def stream_flows(
    packets: DataFrame, idle_seconds: float = IDLE_SECONDS, watermark: str = WATERMARK, buckets: int = BUCKETS
) -> DataFrame:
    """FLOW rows, each appended once its 5-tuple has been idle for more than ``idle_seconds``.

    Needs the RocksDB state provider (``STATE_PROVIDER``). Rows older than the watermark are
    dropped. The idle time is at least a run, so that no run hides a split. A batch rewrites the open flows of
    the buckets it touches, so ``buckets`` should grow with the flows open at once; it is fixed by the first
    start of a checkpoint.
    """
    if idle_seconds * MICROS < RUN_US:
        raise ValueError("idle_seconds must not be shorter than a millisecond")
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    # Absent parts of a key are left out of its text, so keys with nulls stay apart.
    runs = run_stream(packets, watermark).select(
        F.pmod(F.xxhash64(*FLOW_KEY), F.lit(buckets)).cast("int").alias("bucket"),
        F.to_json(F.struct(*FLOW_KEY)).alias("flow"), "run_end", *_RUN, "dns_query",
    )
    merged = runs.groupBy("bucket").transformWithStateInPandas(
        FlowSessions(int(idle_seconds * MICROS)), _MERGED_DDL, "append", "eventTime",
    )
    return finish_flows(_with_key(merged))


def _with_key(flows: DataFrame) -> DataFrame:
    """The key columns in place of their text."""
    return flows.withColumn("flow", F.from_json("flow", _KEY_DDL)).select("flow.*", *[c for c in flows.columns if c != "flow"])


def state_of(spark: SparkSession, checkpoint: str, operator: str, **options: str) -> DataFrame:
    """Rows (key, value) that the first operator of that name keeps in a checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    steps = spark.read.format("state-metadata").load(checkpoint)
    step = steps.filter(F.col("operatorName").startswith(operator)).agg(F.min("operatorId")).first()[0]
    if step is None:
        raise ValueError(f"no {operator} in {checkpoint}")
    return spark.read.format("statestore").options(operatorId=step, **options).load(checkpoint)


def open_runs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stopped ``stream_flows`` holds: a run per open millisecond and one per open flow."""
    key = [F.col(f"key.{c}").alias(c) for c in FLOW_KEY]
    buffers = state_of(spark, checkpoint, "stateStoreSave").select(*key, F.col("value").cast(_BUFFER).alias("b"))
    fresh = _with_gaps(buffers.select(*FLOW_KEY, "b.*")).select(*FLOW_KEY, *_RUN, "dns_query")
    state = state_of(spark, checkpoint, "transformWithState", stateVarName="flows").select("value.*")
    held = _with_key(state.select(F.inline(F.arrays_zip(*_HELD))))
    return held.select(*fresh.columns).unionByName(fresh)


def open_flows(spark: SparkSession, checkpoint: str, idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """FLOW rows of the flows a stopped ``stream_flows`` has not emitted, ended as they stand.

    Windows see one flow's open milliseconds: as many as the watermark's delay holds at most, and one state.
    """
    ordered = Window.partitionBy(*FLOW_KEY).orderBy("first_us")
    edge = F.col("first_us") - F.lag("last_us").over(ordered)
    runs = open_runs(spark, checkpoint).withColumn("starts", (F.coalesce(edge, F.lit(0)) > int(idle_seconds * MICROS)).cast("int"))
    dns = F.when(F.col("dns_query").isNotNull(), F.struct(F.col("first_us"), F.col("dns_query").alias("name")))
    bounds = {c: F.when(F.col("gap_n") > 0, F.col(c)) for c in ("gap_min", "gap_max")}
    runs = runs.withColumns({"session_no": F.sum("starts").over(ordered), "slice": F.col("first_us"), "dns": dns, **bounds})
    return finish_flows(merge_slices(runs, [*FLOW_KEY, "session_no"]))


def stream_counters(packets: DataFrame, width: str = "10 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Packet, TCP, UDP and DNS totals per tumbling window."""
    udp = F.col("protocol") == "UDP"
    return (
        packet_gate(packets.withWatermark("ts", watermark))
        .groupBy(F.window("ts", width).alias("w"))
        .agg(
            F.count("*").alias("total_packets"),
            F.count_if(F.col("protocol") == "TCP").alias("tcp_packets"),
            F.count_if(udp).alias("udp_packets"),
            F.count_if(udp & ((F.col("src_port") == 53) | (F.col("dst_port") == 53))).alias("dns_packets"),
        )
        .select(F.col("w.start").alias("window_start"), "total_packets", "tcp_packets", "udp_packets", "dns_packets")
    )


def running_stats(packets: DataFrame, exported: DataFrame, held: DataFrame) -> DataFrame:
    """The collector's six counters: packets by kind, flows held and flows exported."""
    n = {name: df.agg(F.count("*").alias(name)) for name, df in (("active_flows", held), ("exported_flows", exported))}
    return packet_stats(packets).withColumns({name: F.lit(count.scalar()) for name, count in n.items()})
