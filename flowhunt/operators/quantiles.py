"""Exact interpolated quantiles without collecting a column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ACCURACY = 10_000
MOST = 20_000


def exact_quantiles(
    df: DataFrame, wanted: dict[str, list[float]], accuracy: int = ACCURACY, most: int = MOST
) -> DataFrame:
    """Rows (column, q, value), linear interpolation between closest ranks.

    A sketch, whose rank error is at most 1/accuracy, brackets every quantile. One-row aggregates then
    count what lies below and inside each bracket and sketch the inside again, until a bracket holds
    at most ``most`` rows or a single value; each pass leaves some 8/accuracy of the rows. Only the
    values inside are sent on and ranked, so no task sees more than a bounded bracket. A bracket that
    misses its rank raises instead of returning a neighbour.
    """
    number = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in wanted}
    margin = 4.0 / accuracy

    def sketch(inside: Column, at: float, n: float) -> Column:
        edge = max(margin, 2.0 / max(n, 1))
        return F.approx_percentile(inside, [max(0.0, at - edge), min(1.0, at + edge)], accuracy)

    # The first pass counts and brackets at once; small columns need no bracket.
    probes = [_Probe(c, float(q)) for c, qs in wanted.items() for q in qs]
    first = df.agg(
        *[F.count(number[c]).alias(f"n_{c}") for c in wanted],
        *[sketch(number[p.column], p.q, most).alias(f"e{i}") for i, p in enumerate(probes)],
    ).first()
    for i, p in enumerate(probes):
        p.start(first[f"n_{p.column}"], first[f"e{i}"])
    probes = [p for p in probes if p.n]
    if not probes:
        return df.sparkSession.createDataFrame([], "column STRING, q DOUBLE, value DOUBLE")
    open_probes = [p for p in probes if p.inside > most]
    while open_probes:
        before = [p.inside for p in open_probes]
        for p in open_probes:
            p.low, p.high = p.ends
        counted = df.agg(*[
            c for i, p in enumerate(open_probes) for c in (
                F.count_if(number[p.column] < p.low).alias(f"b{i}"), F.count_if(p.holds(number[p.column])).alias(f"n{i}")
            )
        ]).first()
        for i, p in enumerate(open_probes):
            p.below, p.inside = counted[f"b{i}"], counted[f"n{i}"]
        # A bracket that no longer shrinks holds few different values, each many times.
        open_probes = [p for p, was in zip(open_probes, before) if p.inside > most and p.low < p.high and p.inside < was]
        if open_probes:
            found = df.agg(*[
                sketch(
                    F.when(p.holds(number[p.column]), number[p.column]), (p.rank - p.below) / (p.inside - 1), p.inside
                ).alias(f"e{i}") for i, p in enumerate(open_probes)
            ]).first()
            for i, p in enumerate(open_probes):
                p.ends = found[f"e{i}"]

    rows = df.select(
        F.explode(F.array_compact(F.array(*[
            F.when(p.holds(number[p.column]), F.struct(F.lit(i).alias("i"), number[p.column].alias("value")))
            for i, p in enumerate(probes)
        ]))).alias("p")
    ).select("p.*")
    facts = {f: F.array(*[F.lit(getattr(p, f)) for p in probes]) for f in ("column", "q", "n", "below")}
    counts = rows.groupBy("i", "value").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("i").orderBy("value")) + facts["below"][F.col("i")]
    ranked = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("rows"))
    rank = (facts["n"][F.col("i")] - 1) * facts["q"][F.col("i")]

    def at_rank(position: Column) -> Column:
        hit = (F.col("before") <= position) & (position < F.col("upto"))
        return F.max(F.when(hit, F.col("value")))

    picked = ranked.groupBy("i").agg(
        at_rank(F.floor(rank)).alias("below"), at_rank(F.ceil(rank)).alias("above"), F.max(rank).alias("rank")
    )
    missed = F.raise_error(F.lit("quantile bracket missed its rank; raise accuracy"))
    value = F.col("below") + (F.col("above") - F.col("below")) * (F.col("rank") - F.floor("rank"))
    return picked.select(
        facts["column"][F.col("i")].alias("column"), facts["q"][F.col("i")].alias("q"),
        F.coalesce(value, missed.cast("double")).alias("value"),
    )


class _Probe:
    """One quantile of one column and the bracket that holds it."""

    def __init__(self, column: str, q: float) -> None:
        self.column, self.q = column, q
        self.low, self.high = float("-inf"), float("inf")

    def start(self, n: int, ends: list[float]) -> None:
        self.n, self.inside, self.below, self.ends = n, n, 0, ends
        self.rank = (n - 1) * self.q

    def holds(self, value: Column) -> Column:
        return value.between(self.low, self.high)


def approx_quantiles(
    df: DataFrame, wanted: dict[str, list[float]], accuracy: int = ACCURACY
) -> DataFrame:
    """Same shape, one pass, rank error up to 1/accuracy."""
    sketches = [
        F.struct(
            F.lit(c).alias("column"),
            F.array(*[F.lit(float(q)) for q in qs]).alias("qs"),
            F.approx_percentile(F.col(c).cast("double"), list(qs), accuracy).alias("values"),
        )
        for c, qs in wanted.items()
    ]
    columns = df.agg(F.array(*sketches).alias("sketches")).select(F.explode("sketches").alias("s"))
    pairs = F.explode(F.arrays_zip(F.col("s.qs"), F.col("s.values"))).alias("pair")
    return columns.select(F.col("s.column").alias("column"), pairs).select(
        "column", F.col("pair.qs").alias("q"), F.col("pair.values").alias("value")
    )
