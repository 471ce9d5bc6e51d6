"""Packet records from the driver's ``events`` and ``pages`` tables.

``user_id % 10`` gives each user a role: 0 scanner, 1 beacon, 2 brute force, 3 DNS tunnel, others
ordinary. Time is compressed a million-fold so that default thresholds are crossed by some flows.
All times are whole microseconds from a fixed epoch, so no engine can round them differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowhunt.operators.ordering import sequence_within
from flowhunt.schemas import PACKET

EPOCH = "2024-01-01 00:00:00"
COMPRESSION = 1_000_000
BEACON_STEP_US = 50_000

ROLE_LABELS = {0: "PORT_SCAN", 1: "C2_BEACONING", 2: "BRUTE_FORCE", 3: "DNS_TUNNELING"}


SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
    "pages": "page_id BIGINT, url STRING",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _address(user: Column) -> Column:
    octets = [F.floor(user / 62_500) % 250, F.floor(user / 250) % 250, user % 250]
    return F.concat_ws(".", F.lit("10"), *[o.cast("string") for o in octets])


def role_of_source(src_ip: Column) -> Column:
    """The role number behind a source address made by :func:`packets`."""
    octets = F.split(src_ip, r"\.")
    return octets[3].cast("bigint") % 10  # users differ by multiples of 250 in the octets before


def truth_label(src_ip: Column) -> Column:
    """Attack name of the source's role, ``BENIGN`` for ordinary users."""
    role = role_of_source(src_ip)
    label = F.lit("BENIGN")
    for number, name in ROLE_LABELS.items():
        label = F.when(role == number, F.lit(name)).otherwise(label)
    return label


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PACKET rows, one per event.

    Three branches read ``events`` with their own filter, so that only name-carrying packets pay
    for the host join and only beacon packets pay for the per-user numbering; the bulk is a plain
    projection of the scan.
    """
    user, role = F.col("user_id"), F.col("user_id") % 10
    spare_us = F.timestamp_diff(
        "MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")
    )
    events = read_table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", spare_us.alias("off_us")
    ).filter("user_id IS NOT NULL AND event_type IS NOT NULL")  # an event without them is no packet
    epoch_us = F.unix_micros(F.lit(EPOCH).cast("timestamp"))
    compressed = F.floor((F.col("off_us") + COMPRESSION // 2) / COMPRESSION)
    is_dns = ~role.isin(0, 1, 2) & (F.col("event_type") == "view")

    def shape(rows: DataFrame, micros: Column, dns_query: Column, protocol: str) -> DataFrame:
        src_port = F.when(role == 2, 40000 + F.col("event_id") % 20000).otherwise(50000 + user % 1000)
        dst_port = (
            F.when(role == 0, 1 + F.col("event_id") % 1024)
            .when(role == 1, F.lit(443))
            .when(role == 2, F.lit(22))
            .when(F.col("event_type") == "view", F.lit(53))
            .when(F.col("event_type") == "error", F.lit(80))
            .otherwise(F.lit(443))
        )
        return rows.select(
            F.col("event_id").alias("packet_id"),
            F.timestamp_micros(epoch_us + micros.cast("bigint")).alias("ts"),
            _address(user).alias("src_ip"),
            F.concat(F.lit("172.16.0."), (user % 7).cast("string")).alias("dst_ip"),
            src_port.cast("int").alias("src_port"),
            dst_port.cast("int").alias("dst_port"),
            F.lit(protocol).alias("protocol"),
            (F.floor(F.col("value") * 1000).cast("bigint") + 40).alias("length"),
            dns_query.alias("dns_query"),
        )

    plain = shape(
        events.filter((role != 1) & ~is_dns), compressed, F.lit(None).cast("string"), "TCP"
    )

    # Events are numbered in time order, so event ids can slice the numbering: a slice holds at
    # most a million rows of any one user.
    numbered = sequence_within(
        events.filter(role == 1), ["user_id"], ["event_id"], F.floor(F.col("event_id") / 1_000_000)
    )
    beacons = shape(
        numbered, F.col("seq") * BEACON_STEP_US, F.lit(None).cast("string"), "TCP"
    )

    pages = read_table(spark, sf_dir, "pages")
    hosts = pages.select(
        F.col("page_id").alias("host_id"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
    )
    span = pages.agg(
        F.struct(F.min("page_id").alias("first"), F.count("*").alias("n")).alias("span")
    ).scalar()
    token = F.md5(F.col("event_id").cast("string"))
    tunnel_name = F.concat_ws(".", F.substring(token, 1, 16), F.substring(token, 17, 16), "host")
    named = events.filter(is_dns).withColumn("host_id", span["first"] + F.col("event_id") % span["n"])
    dns = shape(
        named.join(hosts, "host_id", "left"),  # a missing page loses the name, not the packet
        compressed,
        F.when(role == 3, tunnel_name).otherwise(F.col("host")),
        "UDP",
    )

    union = plain.unionByName(beacons).unionByName(dns)
    return union.select(*[F.col(f.name).cast(f.dataType) for f in PACKET.fields])
