"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowhunt.session import materialize

ROUNDS = 60


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows (id, component) of all ids in edges (a, b); the component is its smallest id.

    Each round hooks the larger neighbours of every id onto its smallest one, first over all neighbours,
    then over the smaller ones only, until the edges form stars (a logarithmic number of rounds in
    practice). Neighbour lists are never gathered: each step is one aggregate for the minimum and one join,
    and the edges of a round are written to the shared folder. Null, repeated and self edges are dropped.
    """
    current = materialize(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    known = _digest(current)
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialize(large.filter("a <> b"), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        hooked = large.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = materialize(
            hooked.unionByName(least.select("a", F.col("low").alias("b"))).filter("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
            "small-star",
        )
        current, before, known = after, known, _digest(after)
        if known == before:
            break
    else:
        raise RuntimeError(f"no stars after {rounds} rounds")
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def _digest(edges: DataFrame):
    """Count and two order-free hash sums of an edge table."""
    parts = [F.sum(F.pmod(F.xxhash64(*pair), F.lit(1 << 40))) for pair in (("a", "b"), ("b", "a"))]
    return edges.agg(F.count("*"), *parts).first()
