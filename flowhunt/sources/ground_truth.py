"""Label files and label joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowhunt.schemas import FLOW_KEY, GROUND_TRUTH
from flowhunt.session import materialize

# Split from the right: the source's name may hold underscores.
_KEY_PATTERN = r"^([^:]+?)(?::(\d+|\*))?_([^_:]+)(?::(\d+|\*))?_([^_:]+)$"
BROADCAST_LABELS = 100_000
LINE_LABELS = 1000  # labels in a line's map, on average


def write_label_lines(labels: DataFrame, path: str, which: str = "sample_labels", per_line: int | None = None) -> None:
    """Write (key, label) rows as JSON Lines, a map for each hash bucket of keys; of a key's labels the first is kept."""
    labels = materialize(labels.groupBy("key").agg(F.min("label").alias("label")), "labels")
    buckets = labels.count() // (per_line or LINE_LABELS) + 1
    pairs = F.map_from_entries(F.collect_list(F.struct("key", "label")))
    lines = labels.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).agg(pairs.alias(which))
    lines.select(which).write.json(path)


def read_ground_truth(spark: SparkSession, path: str | None, lines: bool = False) -> DataFrame:
    """The label maps: one row a file, or a line with ``lines``; a row of empty maps if there is no file."""
    empty = spark.range(1).select(
        *[F.create_map().cast(f.dataType).alias(f.name) for f in GROUND_TRUTH.fields]
    )
    if path is None:
        return empty
    return spark.read.schema(GROUND_TRUTH).option("multiLine", not lines).json(path)


def label_rows(truth: DataFrame, which: str = "sample_labels") -> DataFrame:
    """(key, label) rows of one of the maps."""
    return truth.select(F.explode(which).alias("key", "label"))


def parse_label_keys(labels: DataFrame) -> DataFrame:
    """Split ``src:port_dst:port_proto`` keys; ``*`` or a missing part is a wildcard (NULL).

    A key of another form raises.
    """
    bad = F.raise_error(F.concat(F.lit("not a label key: "), F.coalesce("key", F.lit("NULL"))))
    labels = labels.filter(F.when(F.col("key").rlike(_KEY_PATTERN), True).otherwise(bad.cast("boolean")))

    def part(group: int) -> Column:
        text = F.regexp_extract("key", _KEY_PATTERN, group)
        return F.when(~text.isin("", "*"), text)

    return labels.select(
        part(1).alias("src_ip"),
        part(3).alias("dst_ip"),
        part(2).cast("int").alias("src_port"),
        part(4).cast("int").alias("dst_port"),
        part(5).alias("protocol"),
        "label",
    )


def label_flows(flows: DataFrame, labels: DataFrame) -> DataFrame:
    """Flows with ``truth_label`` from the most specific label that matches.

    Labels are grouped by which parts of the key they state (at most 32 groups). Each group is one
    equality join on those parts, so wildcards never compare every flow with every label and the plan
    grows with the number of groups only. Groups of at most ``BROADCAST_LABELS`` labels are broadcast;
    larger ones join by shuffle, where skewed keys are split at run time. Within a group, the
    alphabetically first label of a key wins; the label without any stated part replaces ``BENIGN``.
    """
    stated = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in FLOW_KEY])
    marked = labels.withColumn("_mask", stated)
    sizes = {r["_mask"]: r["n"] for r in marked.groupBy("_mask").agg(F.count("*").alias("n")).collect()}
    masks = sorted(sizes, key=lambda m: (m.count("1"), m), reverse=True)
    default = "BENIGN"
    out = flows
    names = []
    for i, mask in enumerate(masks):
        keys = [c for c, bit in zip(FLOW_KEY, mask, strict=True) if bit == "1"]
        if not keys:
            default = marked.filter(F.col("_mask") == mask).agg(F.min("label")).first()[0] or default
            continue
        names.append(f"_l{i}")
        group = marked.filter(F.col("_mask") == mask).groupBy(*keys).agg(F.min("label").alias(names[-1]))
        out = out.join(F.broadcast(group) if sizes[mask] <= BROADCAST_LABELS else group, keys, "left")
    found = F.coalesce(*[F.col(n) for n in names], F.lit(default))
    return out.select(*flows.columns, found.alias("truth_label"))


def label_captures(packets: DataFrame, truth: DataFrame) -> DataFrame:
    """Packets with ``truth_label`` by the capture file they came from (column ``path``), else ``BENIGN``."""
    by_file = label_rows(truth, "pcap_labels").groupBy(F.col("key").alias("_file")).agg(F.min("label").alias("truth_label"))
    if by_file.count() <= BROADCAST_LABELS:
        by_file = F.broadcast(by_file)
    named = packets.withColumn("_file", F.element_at(F.split("path", "/"), -1))
    return named.join(by_file, "_file", "left").drop("_file").fillna("BENIGN", ["truth_label"])
