"""Sorting, dense numbering and previous-row lookups that hold up under hot keys.

A window partitioned by a hot key runs in one task. Each operator here works on slices of a key
whose size the caller can bound, and carries only one summary row per slice across slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowhunt.session import materialize

_PARTITION_BITS = 33  # monotonically_increasing_id puts the partition number above these bits


def sort_flows(flows: DataFrame) -> DataFrame:
    """Flows by first_seen ascending (range-partitioned sort)."""
    return flows.orderBy("first_seen", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")


def number_rows(df: DataFrame, order: list[str], name: str, label: str = "numbered") -> DataFrame:
    """Dense 1-based numbers over the whole table in ``order``.

    Range partitioning splits the sort evenly whatever the data; inside a sorted partition the
    row position is free. The layout is written down before it is counted, so the positions and
    the per-partition counts come from the same rows even if tasks are rerun.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()), label)
    part = F.shiftright("_place", _PARTITION_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition of the sort: a few thousand rows at any data size.
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    position = F.col("_place").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + position + 1)
        .drop("_part", "_place", "_before")
    )


def sequence_within(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_id: Column,
    name: str = "seq",
    previous: dict[str, str] | None = None,
) -> DataFrame:
    """Number rows 1.. inside each key and optionally look up the previous row.

    ``slice_id`` must not decrease along ``order``. ``previous`` maps a column to the name under
    which its value in the preceding row of the key is returned. Windows see one (key, slice) at
    a time; the running totals see one row per slice.
    """
    previous = previous or {}
    # One struct per key: NULL fields compare equal, and window, aggregate and join all hash it the
    # same way, so the rows are shuffled once.
    sliced = df.withColumn("_key", F.struct(*keys)).withColumn("_slice", slice_id)
    within = Window.partitionBy("_key", "_slice").orderBy(*order)
    local = sliced.withColumn("_local", F.row_number().over(within))
    for source, target in previous.items():
        local = local.withColumn(target, F.lag(source).over(within))

    position = F.struct(*order)
    last_values = [F.max_by(c, position).alias(f"_last_{c}") for c in previous]
    edges = sliced.groupBy("_key", "_slice").agg(F.count("*").alias("_n"), *last_values)
    across = Window.partitionBy("_key").orderBy("_slice")
    running = F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select(
        "_key",
        "_slice",
        F.coalesce(running, F.lit(0)).alias("_before"),
        *[F.lag(f"_last_{c}").over(across).alias(f"_carry_{c}") for c in previous],
    )
    first_in_slice = F.col("_local") == 1
    columns = [F.col(c) for c in df.columns] + [(F.col("_before") + F.col("_local")).alias(name)]
    columns += [
        F.when(first_in_slice, F.col(f"_carry_{c}")).otherwise(F.col(target)).alias(target)
        for c, target in previous.items()
    ]
    return local.join(edges, ["_key", "_slice"]).select(*columns)


def first_match(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``.

    An aggregate instead of ``row_number() = 1``: each map task sends at most one row per key.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min_by(F.struct(*order, *rest), F.struct(*order))
    picked = df.groupBy(*keys).agg(best.alias("_best"))
    return picked.select(*keys, "_best.*").select(*df.columns)
