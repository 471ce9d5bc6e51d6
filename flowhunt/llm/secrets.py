"""Secret scan with column expressions only.

Fixed patterns find labelled secrets. Everything else that could be one, a long run of key characters, is
scored by two first-order character Markov models, one of random strings and one of ordinary identifiers;
the sum of log-likelihood ratios over its transitions decides.

The models are trained from the table itself: strings that a fixed pattern found are the random ones, other
words of ``WORD_LENGTH`` characters or more the ordinary ones. Training counts the transitions of all rows,
however rare labelled secrets are; scanning covers every whole text.

Positions: the gaps that ``split`` leaves between the matches and the lengths of the matches add up to
code-point offsets, in one pass over the matches.

Defined cases: null text counts as empty and gives no span. Spans of the models never overlap a pattern's.
Rows are independent, so repeated rows and ids repeat their result. Without any labelled secret in the
table both models are uniform over what they saw and no span is added. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from flowhunt.llm.common import whole

# Kind, pattern, group whose length counts, least length. The keyword's letters match in
# either case. Runs of at least 16 hex digits and keys of at least 18 characters are written with their
# length, which finds the same matches; the assignment's length must be checked after matching, since a
# failing match still uses up its text.
KINDS = (
    ("assign", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    ("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
)
RUN = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

WORD_LENGTH = 8
SMOOTHING = 0.5
LEAST_RATIO = 10.0

_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def find_spans(body: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans (start, rank, end, kind) of the matches whose group is long enough, in code points."""
    matches = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(body, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(body, pattern, -1), F.lit(1), F.size(matches))
    steps = F.transform(
        F.arrays_zip(gaps.alias("gap"), matches.alias("found"), groups.alias("value")),
        lambda x: F.struct(
            F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("n"), (F.length(x["value"]) >= least).alias("ok")
        ),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + x["n"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(
            end.alias("pos"), F.when(x["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out")
        )

    none = F.array().cast(_SPANS)
    zero = F.struct(F.lit(0).alias("pos"), none.alias("out"))
    return F.when(body.rlike(pattern), F.aggregate(steps, zero, step, lambda acc: acc["out"])).otherwise(none)


def _pairs(token: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, F.lit(2)))


def fit_ratios(docs: DataFrame, text: str = "text") -> list[float]:
    """Log-likelihood ratio random / ordinary of every transition, row by row over ``ALPHABET``."""
    bodies = docs.select(whole(text).alias("body"))
    random = F.concat(*[
        F.filter(F.regexp_extract_all("body", F.lit(p), F.lit(g)), lambda v, n=n: F.length(v) >= n) for _, p, g, n in KINDS
    ])
    rest = F.col("body")
    for _, pattern, _, _ in KINDS:
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = F.regexp_extract_all(rest, F.lit(f"[A-Za-z][A-Za-z0-9_-]{{{WORD_LENGTH - 1},}}"), F.lit(0))
    tokens = bodies.select(
        F.explode(F.concat(
            F.transform(random, lambda v: F.struct(F.lit(1).alias("random"), v.alias("token"))),
            F.transform(ordinary, lambda v: F.struct(F.lit(0).alias("random"), v.alias("token"))),
        )).alias("t")
    )
    counts = (
        tokens.select("t.random", F.explode(_pairs(F.col("t.token"))).alias("pair"))
        .groupBy("random", "pair").count().collect()  # at most 2 x alphabet squared rows
    )
    seen = {(r["random"], r["pair"]): r["count"] for r in counts}
    sums: dict[tuple[int, str], int] = {}
    for (label, pair), n in seen.items():
        sums[label, pair[0]] = sums.get((label, pair[0]), 0) + n
    if not any(label for label, _ in seen):
        return [-1.0] * len(ALPHABET) ** 2

    def log_p(label: int, a: str, b: str) -> float:
        n = seen.get((label, a + b), 0) + SMOOTHING
        return math.log(n / (sums.get((label, a), 0) + SMOOTHING * len(ALPHABET)))

    return [log_p(1, a, b) - log_p(0, a, b) for a in ALPHABET for b in ALPHABET]


def ratio_of(token: Column, ratios: list[float]) -> Column:
    """Sum of the log-likelihood ratios over the transitions of ``token``."""
    table = F.split(F.lit(",".join(repr(r) for r in ratios)), ",").cast("array<double>")
    size = len(ALPHABET)

    def code(pair: Column, i: int) -> Column:
        return F.position(F.substring(pair, i, 1), F.lit(ALPHABET)) - 1

    return F.aggregate(
        _pairs(token), F.lit(0.0), lambda acc, p: acc + F.get(table, code(p, 1) * size + code(p, 2))
    )


def scan_secrets(
    docs: DataFrame, ratios: list[float], key: str = "doc_id", text: str = "text", least_ratio: float = LEAST_RATIO
) -> DataFrame:
    """One row per row of ``docs``: key, base (spans of the patterns), added (spans of the models)."""
    body = F.col("body")
    found = docs.select(F.col(key).alias("id"), whole(text).alias("body")).select(
        "id", "body",
        F.array_sort(F.concat(*[find_spans(body, k, i, p, g, n) for i, (k, p, g, n) in enumerate(KINDS)])).alias("base"),
        find_spans(body, "markov", len(KINDS), RUN, 0, 20).alias("runs"),
    )
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    scored = F.filter(
        free, lambda r: ratio_of(F.substring(body, r["start"] + 1, r["end"] - r["start"]), ratios) >= least_ratio
    )
    return found.select(F.col("id").alias(key), "base", F.when(F.size("runs") > 0, scored).otherwise(F.col("runs")).alias("added"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
