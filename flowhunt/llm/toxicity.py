"""Toxicity from a learned lexicon, misspellings included.

Lexicon: words whose labelled rows are mostly toxic, counted over different contexts (the word with its
two neighbours) so that copies of one text count once.

Matching: the terms form a trie. For all distinct words of a batch at once, a walk over the trie carries
each word's row of edit distances, which is the state of its Levenshtein automaton; words whose smallest
entry exceeds the allowed distance leave the walk. A word within ``distance`` edits of a term is a hit.

Scoring: each hit is looked at in its window. Inside a quotation, or near a word that marks reported
speech, it counts as quoted, else as abuse. A logistic model on the logarithms of the counts (exact abuse,
misspelled abuse, quoted) and of the length gives the score.

Learning reads at most about ``SAMPLE_ROWS`` labelled rows, chosen by hash; the rest of the table is only
scored. Held-out rows are never learned from.

Defined cases: null counts as empty and scores as a text without hits. Repeated rows repeat their score.
A row whose label is null is not learned from. Without toxic samples the lexicon is empty and every score
is the same. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowhunt.llm.common import fold, small_batches, whole

SAMPLE_ROWS = 20_000
LEXICON = 200
LEAST_CONTEXTS = 5
LEAST_PRECISION = 0.88  # of the Wilson bound: a word seen only in toxic rows needs 20 contexts
Z = 1.64
DISTANCE = 1
SHORTEST_FUZZY = 5  # terms shorter than this only match exactly
WINDOW = 60

_WORD = re.compile(r"[^\W\d_]+")
# Words that introduce reported speech.
REPORTING = frozenset("said says quote quoted called word term wrote reported".split())
_QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic",
                    text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most about ``rows`` rows (body, toxic) that may be learned from."""
    usable = labels.filter(F.col(label).isNotNull() & (fold(key, 5) != 0)).select(
        F.col(key).alias("id"), F.col(label).cast("int").alias("toxic")
    )
    step = max(1, math.ceil(usable.count() / rows))
    chosen = usable.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).groupBy("id").agg(F.max("toxic").alias("toxic"))
    return docs.select(F.col(key).alias("id"), whole(text).alias("body")).join(F.broadcast(chosen), "id").select("body", "toxic")


def learn_lexicon(sample: DataFrame, size: int = LEXICON, least: int = LEAST_CONTEXTS,
                  precision: float = LEAST_PRECISION) -> list[str]:
    """Words that mark toxic rows: lower bound of precision at least ``precision``."""
    words = sample.select("toxic", F.array_compact(F.split(F.lower("body"), r"[^\p{L}]+")).alias("w"))

    def context(x, i):
        return F.struct(x.alias("word"), F.xxhash64(F.get("w", i - 1), x, F.get("w", i + 1)).alias("context"))

    seen = (
        words.select("toxic", F.explode(F.transform("w", context)).alias("c"))
        .select("toxic", "c.word", "c.context")
        .filter(F.length("word") >= 3)
        .groupBy("word", "context").agg(F.max("toxic").alias("toxic"))
        .groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
        .filter(F.col("hits") >= least)
    )
    n, share = F.col("n"), F.col("hits") / F.col("n")
    spread = Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))
    lower = (share + Z * Z / (2 * n) - spread) / (1 + Z * Z / n)
    ranked = seen.withColumn("lower", lower).filter(F.col("lower") >= precision).orderBy(F.desc("hits"), "word").limit(size)
    return sorted(r["word"] for r in ranked.collect())


@dataclass
class Node:
    children: dict[str, Node]
    term: str | None = None


def build_trie(terms: list[str]) -> Node:
    root = Node({})
    for term in terms:
        node = root
        for letter in term:
            node = node.children.setdefault(letter, Node({}))
        node.term = term
    return root


def close_terms(words: list[str], root: Node, distance: int = DISTANCE) -> dict[str, tuple[str, int]]:
    """Word to its closest term and their distance, for words within ``distance``; ties by the term."""
    found: dict[str, tuple[str, int]] = {}
    if not words or not root.children:
        return found
    longest = max(map(len, words))
    codes = np.zeros((len(words), longest), np.uint32)
    lengths = np.array([len(w) for w in words])
    for i, w in enumerate(words):
        codes[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
    rows = np.tile(np.arange(longest + 1, dtype=np.int16), (len(words), 1))
    stack = [(root, np.arange(len(words)), rows)]
    while stack:
        node, who, above = stack.pop()
        for letter, child in sorted(node.children.items()):
            here = np.empty_like(above)
            here[:, 0] = above[:, 0] + 1
            differs = codes[who] != ord(letter)
            np.minimum(above[:, 1:] + 1, above[:, :-1] + differs, out=here[:, 1:])
            for j in range(1, longest + 1):
                np.minimum(here[:, j], here[:, j - 1] + 1, out=here[:, j])
            alive = here.min(axis=1) <= distance
            next_who, next_rows = who[alive], here[alive]
            if not next_who.size:
                continue
            if child.term is not None:
                final = next_rows[np.arange(len(next_who)), lengths[next_who]]
                limit = distance if len(child.term) >= SHORTEST_FUZZY else 0
                for i, d in zip(next_who[final <= limit], final[final <= limit]):
                    best = found.get(words[i])
                    if best is None or (int(d), child.term) < (best[1], best[0]):
                        found[words[i]] = (child.term, int(d))
            stack.append((child, next_who, next_rows))
    return found


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether the hit stands in quotation marks, or behind a reporting word, inside its window."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    if any(before.count(o) % 2 if o == c else before.rfind(o) > before.rfind(c) for o, c in _QUOTES.items() if c in after):
        return True
    return any(w in REPORTING for w in _WORD.findall(before)[-3:])


class Matcher:
    """Counts hits of whole texts; words already looked up are remembered up to a bound."""

    def __init__(self, terms: list[str], remembered: int = 400_000) -> None:
        self.root = build_trie(terms)
        self.shortest = min(map(len, terms), default=0) - DISTANCE
        self.longest = max(map(len, terms), default=-1) + DISTANCE
        self.known: set[str] = set()
        self.hits: dict[str, tuple[str, int]] = {}
        self.remembered = remembered

    def features(self, texts: list[str]) -> np.ndarray:
        """Rows of (abuse, misspelled abuse, quoted, words)."""
        lowered = [t.lower() for t in texts]
        words = [_WORD.findall(t) for t in lowered]
        sets = [set(w) for w in words]
        new = sorted(
            w for w in set().union(*sets) - self.known if self.shortest <= len(w) <= self.longest
        ) if sets else []
        self.hits.update(close_terms(new, self.root))
        self.known.update(new)
        out = np.zeros((len(texts), 4))
        for i, text in enumerate(lowered):
            out[i, 3] = len(words[i])
            if self.hits.keys().isdisjoint(sets[i]):
                continue
            for m in _WORD.finditer(text):
                hit = self.hits.get(m[0])
                if hit:
                    out[i, 2 if is_quoted(text, m.start(), m.end()) else int(hit[1] > 0)] += 1
        if len(self.known) > self.remembered:
            self.known, self.hits = set(), {}
        return out


def _design(counts: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(counts)), np.log1p(counts)])


def fit_weights(counts: np.ndarray, toxic: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps on the sample's few features."""
    x = _design(counts)
    weights = np.zeros(x.shape[1])
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (toxic - p) - ridge * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights))
        move = np.linalg.solve(curve, slope)
        weights += move
        if np.abs(move).max() < 1e-8:
            break
    return weights


def _count_batches(terms: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    matcher = Matcher(terms)
    for batch in batches:
        yield batch, matcher.features(batch.column(1).to_pylist())


def fit(sample: DataFrame, terms: list[str]) -> np.ndarray:
    """Weights from the bounded sample."""
    small_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, counts in _count_batches(terms, batches):
            columns = [pa.array(counts[:, i]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["toxic", "a", "m", "q", "w"])

    rows = sample.select("toxic", "body").mapInArrow(run, "toxic int, a double, m double, q double, w double").toPandas()
    rows = rows.sort_values(list(rows.columns))  # the sum's order, and so the weights, do not depend on tasks
    return fit_weights(rows[["a", "m", "q", "w"]].to_numpy(float), rows["toxic"].to_numpy(float))


def score(docs: DataFrame, terms: list[str], weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, score, predicted, n_abuse, n_misspelled, n_quoted."""
    small_batches(docs.sparkSession)
    weights = np.asarray(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, counts in _count_batches(terms, batches):
            p = np.round(1 / (1 + np.exp(-np.clip(_design(counts) @ weights, -30, 30))), 6)
            whole_counts = [pa.array(counts[:, i].astype(np.int64)) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), *whole_counts],
                names=["id", "score", "n_abuse", "n_misspelled", "n_quoted"],
            )

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("id"), whole(text).alias("body")).mapInArrow(
        run, f"id {kind}, score double, n_abuse long, n_misspelled long, n_quoted long"
    )
    return out.select(
        F.col("id").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_abuse", "n_misspelled", "n_quoted",
    )
