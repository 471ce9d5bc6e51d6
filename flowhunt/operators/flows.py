"""Packets to directional 5-tuple flows with volume, timing, rate and DNS features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowhunt.functions.columns import MICROS, micros_to_seconds, round_half_up
from flowhunt.functions.text import clean_query, query_length, shannon_entropy, subdomain_depth
from flowhunt.operators.ordering import sequence_within
from flowhunt.schemas import FLOW, FLOW_KEY

SLICE_SECONDS = 10.0


def packet_gate(packets: DataFrame) -> DataFrame:
    """Keep TCP and UDP records."""
    return packets.filter(F.col("protocol").isin("TCP", "UDP"))


def packet_filter(
    packets: DataFrame,
    protocols: list[str] | None = None,
    ports: list[int] | None = None,
    hosts: list[str] | None = None,
) -> DataFrame:
    """Keep packets by protocol, and by port and host on either side."""
    kept = packets
    if protocols:
        kept = kept.filter(F.col("protocol").isin(*protocols))
    if ports:
        kept = kept.filter(F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports))
    if hosts:
        kept = kept.filter(F.col("src_ip").isin(*hosts) | F.col("dst_ip").isin(*hosts))
    return kept


def packet_stats(packets: DataFrame, flows: bool = False, idle_seconds: float = 60.0) -> DataFrame:
    """One row of totals; DNS means UDP with port 53 on either side.

    With ``flows``: also how many flows there are, and how many were still active at the end, that is
    not yet silent for ``idle_seconds``. One pass: kind and ports belong to the flow key, so the packets are
    first counted per flow.
    """
    udp = F.col("protocol") == "UDP"
    kinds = {
        "total_packets": F.lit(True), "tcp_packets": F.col("protocol") == "TCP", "udp_packets": udp,
        "dns_packets": udp & ((F.col("src_port") == 53) | (F.col("dst_port") == 53)),
    }
    gated = packet_gate(packets)
    if not flows:
        return gated.agg(*[F.count_if(k).alias(name) for name, k in kinds.items()])
    each = gated.groupBy(*FLOW_KEY).agg(F.count("*").alias("n"), F.max(F.unix_micros("ts")).alias("last_us"))
    end = each.agg(F.max("last_us")).scalar()  # the same shuffle is read again
    return each.agg(
        *[F.coalesce(F.sum(F.when(k, F.col("n"))), F.lit(0)).alias(name) for name, k in kinds.items()],
        F.count("*").alias("exported_flows"), F.count_if(F.col("last_us") >= end - int(idle_seconds * MICROS)).alias("active_flows"),
    )


def _slice_of(micros: Column, slice_seconds: float) -> Column:
    return F.floor(micros / int(slice_seconds * MICROS))


def inter_arrival(packets: DataFrame, slice_seconds: float = SLICE_SECONDS) -> DataFrame:
    """Each packet with the gap in seconds to the one before it in its flow (NULL on the first)."""
    timed = packet_gate(packets).select(
        "packet_id", *FLOW_KEY, F.unix_micros("ts").alias("us")
    )
    ordered = sequence_within(
        timed, FLOW_KEY, ["us", "packet_id"], _slice_of(F.col("us"), slice_seconds),
        name="packet_no", previous={"us": "prev_us"},
    )
    gap = (F.col("us") - F.col("prev_us")) / F.lit(float(MICROS))
    return ordered.select("packet_id", *FLOW_KEY, "packet_no", gap.alias("iat"))


def flow_slices(
    packets: DataFrame, slice_seconds: float = SLICE_SECONDS, keys: list[str] = FLOW_KEY
) -> DataFrame:
    """Per (flow, time slice): counts, bounds and the moments of the gaps inside the slice.

    Shuffling on (flow, slice) spreads one hot flow over as many tasks as it has slices. The first
    DNS name travels as the smallest (time, packet id, name).
    """
    us = F.unix_micros("ts")
    query = clean_query(F.col("dns_query"))
    timed = packet_gate(packets).select(
        *keys,
        us.alias("us"),
        _slice_of(us, slice_seconds).alias("slice"),
        "length",
        F.when(query.isNotNull(), F.struct(us.alias("us"), F.col("packet_id"), query.alias("name")))
        .alias("dns"),
    )
    in_slice = Window.partitionBy(*keys, "slice").orderBy("us")
    gaps = timed.withColumn("gap", F.col("us") - F.lag("us").over(in_slice))
    return gaps.groupBy(*keys, "slice").agg(
        F.count("*").alias("n"),
        F.sum("length").alias("bytes"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.min("gap").alias("gap_min"),
        F.max("gap").alias("gap_max"),
        F.count("gap").alias("gap_n"),
        F.avg("gap").alias("gap_mean"),
        (F.var_pop("gap") * F.count("gap")).alias("gap_m2"),
        F.min("dns").alias("dns"),
    )


def merge_slices(slices: DataFrame, keys: list[str] = FLOW_KEY) -> DataFrame:
    """Join the slices of a flow: add the gap across each slice boundary, combine the moments.

    The mean gap of a flow needs only its ends and its packet count, so squared deviations are
    summed around the final mean (no difference of large sums).
    """
    flow = Window.partitionBy(*keys)
    edge = F.col("first_us") - F.lag("last_us").over(flow.orderBy("slice"))
    packets_in_flow = F.sum("n").over(flow)
    mean = (F.max("last_us").over(flow) - F.min("first_us").over(flow)) / F.when(
        packets_in_flow > 1, packets_in_flow - 1
    )
    around = slices.withColumn("edge", edge).withColumn("mean", mean)

    def squared(c: str) -> Column:
        return (F.col(c) - F.col("mean")) * (F.col(c) - F.col("mean"))

    inside = F.coalesce(F.col("gap_m2") + F.col("gap_n") * squared("gap_mean"), F.lit(0.0))
    across = F.coalesce(squared("edge"), F.lit(0.0))
    return around.groupBy(*keys).agg(
        F.sum("n").alias("packet_count"),
        F.sum("bytes").alias("total_bytes"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.least(F.min("gap_min"), F.min("edge")).alias("gap_min"),
        F.greatest(F.max("gap_max"), F.max("edge")).alias("gap_max"),
        F.sum(inside + across).alias("gap_m2"),
        F.min("dns")["name"].alias("dns_query"),
    )


def flow_features(
    packets: DataFrame,
    slice_seconds: float = SLICE_SECONDS,
    entropy_digits: int = 3,
    text_unit: str = "chars",
) -> DataFrame:
    """FLOW rows. ``entropy_digits=4, text_unit="bytes"`` gives the collector's variant."""
    merged = merge_slices(flow_slices(packets, slice_seconds))
    return finish_flows(merged, entropy_digits, text_unit)


def finish_flows(merged: DataFrame, entropy_digits: int = 3, text_unit: str = "chars") -> DataFrame:
    """Flow totals (microseconds, moments, first name) to the published feature columns."""
    micros = F.col("last_us") - F.col("first_us")
    n, size, name = F.col("packet_count"), F.col("total_bytes"), F.col("dns_query")
    several = n > 1

    def per_second(amount: Column) -> Column:
        rate = amount * F.lit(float(MICROS)) / F.when(micros > 0, micros)
        return F.coalesce(round_half_up(rate, 2), F.lit(0.0))

    def gap(value: Column) -> Column:
        return F.when(several, micros_to_seconds(value)).otherwise(F.lit(0.0))

    per_packet = round_half_up(size / n, 2)
    columns = {
        "first_seen": F.timestamp_micros("first_us"),
        "last_seen": F.timestamp_micros("last_us"),
        "packet_count": n,
        "duration": micros_to_seconds(micros),
        "total_bytes": size,
        "avg_packet_size": per_packet,
        "min_iat": gap(F.col("gap_min")),
        "max_iat": gap(F.col("gap_max")),
        "mean_iat": gap(micros / F.when(several, n - 1)),
        "std_iat": gap(F.sqrt(F.col("gap_m2") / F.when(several, n - 1))),
        "bytes_per_second": per_second(size),
        "packets_per_second": per_second(n),
        "avg_bytes_per_packet": per_packet,
        "dns_query_length": query_length(name, text_unit),
        "dns_subdomain_depth": subdomain_depth(name),
        "dns_entropy": round_half_up(shannon_entropy(name, text_unit), entropy_digits),
    }
    types = {f.name: f.dataType for f in FLOW.fields}
    return merged.select(*FLOW_KEY, *[c.cast(types[k]).alias(k) for k, c in columns.items()])


def first_dns_query(packets: DataFrame) -> DataFrame:
    """First non-empty DNS name of each flow that has one."""
    query = clean_query(F.col("dns_query"))
    named = packet_gate(packets).withColumn("dns_query", query).filter(F.col("dns_query").isNotNull())
    first = F.min(F.struct(F.unix_micros("ts").alias("us"), "packet_id", "dns_query"))
    return named.groupBy(*FLOW_KEY).agg(first["dns_query"].alias("dns_query"))


def dns_text_features(queries: DataFrame) -> DataFrame:
    """Length, depth and entropy of a ``dns_query`` column."""
    name = F.col("dns_query")
    return queries.select(
        "*",
        query_length(name).alias("dns_query_length"),
        subdomain_depth(name).alias("dns_subdomain_depth"),
        round_half_up(shannon_entropy(name), 3).alias("dns_entropy"),
    )


def session_flows(
    packets: DataFrame, idle_seconds: float = 60.0, slice_seconds: float | None = None
) -> DataFrame:
    """Flows split where a 5-tuple stays silent for more than ``idle_seconds``.

    A slice no wider than the idle time cannot contain a split, so splits are found between slice
    summaries: a running count of long edges numbers the sessions of a flow.
    """
    slices = flow_slices(packets, min(slice_seconds or SLICE_SECONDS, idle_seconds))
    ordered = Window.partitionBy(*FLOW_KEY).orderBy("slice")
    edge = F.col("first_us") - F.lag("last_us").over(ordered)
    starts = F.when(edge > int(idle_seconds * MICROS), 1).otherwise(0)
    sessions = slices.withColumn("starts", starts).withColumn(
        "session_no", F.sum("starts").over(ordered) + 1
    )
    session = [*FLOW_KEY, "session_no"]
    return sessions.groupBy(*session).agg(
        F.sum("n").alias("packet_count"),
        F.sum("bytes").alias("total_bytes"),
        F.timestamp_micros(F.min("first_us")).alias("first_seen"),
        F.timestamp_micros(F.max("last_us")).alias("last_seen"),
        micros_to_seconds(F.max("last_us") - F.min("first_us")).alias("duration"),
    )


def beacon_intervals(packets: DataFrame, slice_seconds: float = SLICE_SECONDS) -> DataFrame:
    """Mean and sample deviation of the intervals between packets of a (source, target) pair."""
    pair = ["src_ip", "dst_ip"]
    merged = merge_slices(flow_slices(packets, slice_seconds, pair), pair)
    intervals = F.col("packet_count") - 1
    spread = F.sqrt(F.col("gap_m2") / F.when(intervals > 1, intervals - 1))
    return merged.filter(intervals > 0).select(
        *pair,
        intervals.alias("intervals"),
        micros_to_seconds((F.col("last_us") - F.col("first_us")) / intervals).alias("mean_interval"),
        F.coalesce(micros_to_seconds(spread), F.lit(0.0)).alias("std_interval"),
    )
