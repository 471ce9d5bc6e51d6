"""Hard negatives by threshold joins with norm bounds (in the manner of L2AP).

Vectors become whole numbers. Anchors meet all rows in blocks of bounded size; a block and its thresholds are
broadcast and the stored rows are read once a pass. In a task, batches of rows form small inverted indexes:

1. Dimensions are ordered by energy. A row's leading (weak) dimensions stay out of the index as long as the
   norms of both sides over them cannot reach the threshold; a row that never can is left out altogether.
2. Scores of the anchors are accumulated over the indexed dimensions, strongest first, and a pair is dropped
   as soon as its partial score and the norms of what remains miss the anchor's threshold.
3. Pairs that are left get the exact score of the dimensions outside the index.

A pass keeps the best rows of each window (an anchor's positives; the score band of one positive) and no more.
Thresholds start at the best score that a sample of rows reaches in the window and are lowered for windows that
did not fill, first to the score at which the sample alone fills them, then to the window's end. So every
window ends filled, or its band has been searched whole: results are exact, the sample only sets the order.

Defined cases: rows with a null key, label or vector, or a null or non-finite component take no part. Rows that
repeat key, label and vector count once; rows that share only the key are rows of their own, but never "other"
rows to each other. Ties go to the smaller key, then to a digest of label and vector. Shorter vectors
are continued with zeros; a zero vector scores 0. A positive with a negative score has an empty band. Scores are exact below
2^53. Extra columns of any name are not read. An empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowhunt.llm.common import small_batches
from flowhunt.session import materialize

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # the band in hundredths of the positive's score
SCALE = 256
BLOCK = 8192  # anchors that are broadcast at once
SAMPLE = 2048  # rows, on average, that set the first thresholds
SHARD = 2048  # rows of one inverted index
TILE = 512  # anchors that meet an index at once
STEP = 16  # dimensions between two prunings
SPARSE = 4  # below one live pair in so many, pairs are followed one by one
_SLACK = 1e-6  # covers the rounding of norms

_FOUND = "win long, score long, id {}, mark long"


def quantised(rows: DataFrame, key: str, label: Column, vector: str, scale: int = SCALE) -> DataFrame:
    """id, label, vec (whole numbers) and mark (digest of label and vec) of the rows that take part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(scale * x.cast("double")))
    return (
        rows.filter(F.col(key).isNotNull() & usable)
        .select(F.col(key).alias("id"), label.cast("long").alias("label"), whole.alias("vec"))
        .filter(F.col("label").isNotNull())
        .withColumn("mark", F.xxhash64("label", "vec"))
        .dropDuplicates(["id", "label", "vec"])
    )


def dimension_order(vectors: DataFrame) -> list[int]:
    """Dimensions by their sum of squares, weakest first (one row a dimension)."""
    each = vectors.select(F.posexplode("vec").alias("d", "x"))
    energy = each.groupBy("d").agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("e")).collect()
    return [r.d for r in sorted(energy, key=lambda r: (r.e, r.d))]


def _matrix(lists: pa.Array, order: np.ndarray) -> np.ndarray:
    """Lists as rows of a matrix with ordered dimensions; missing components are 0."""
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.list_value_length(lists).to_numpy())
    sizes = np.diff(ends, prepend=0)
    out = np.zeros((len(sizes), len(order)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(ends - sizes, sizes)] = values
    return out[:, order]


def _norms(x: np.ndarray) -> np.ndarray:
    """Norm of the first d dimensions of each row, for d = 0 .. all."""
    return np.sqrt(np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)], axis=1))


@dataclass
class _Windows:
    """The windows one pass looks for: per window its anchor, its band of scores and the rows wanted."""

    anchors: np.ndarray  # matrix
    ids: np.ndarray
    labels: np.ndarray
    owner: np.ndarray  # anchor of each window, ascending
    name: np.ndarray
    low: np.ndarray
    high: np.ndarray
    wanted: int
    alike: bool  # rows of the anchor's label, or of others

    def open(self, left: np.ndarray, low: np.ndarray) -> _Windows:
        """Only the windows ``left``, from ``low`` on, and only their anchors."""
        used, owner = np.unique(self.owner[left], return_inverse=True)
        return _Windows(
            self.anchors[used], self.ids[used], self.labels[used], owner, self.name[left], low, self.high[left], self.wanted, self.alike
        )

    def best(self, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["win", "score", "id", "mark"], ascending=[True, False, True, True])
        return table[table.groupby("win").cumcount() < self.wanted]


def live_pairs(x: np.ndarray, low: np.ndarray, y: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the allowed pairs that score at least the anchor's ``low``."""
    n_dims = y.shape[1]
    x_norm, y_norm = _norms(x), _norms(y)
    # The longest prefix of a row that reaches no anchor's threshold stays out of the index.
    need = np.where(x_norm > 0, (low - _SLACK)[:, None] / np.where(x_norm > 0, x_norm, 1), np.where(low > 0, np.inf, -np.inf)[:, None]).min(axis=0)
    outside = (y_norm < need).cumprod(axis=1).sum(axis=1) - 1
    met = np.flatnonzero(outside < n_dims)
    met = met[np.argsort(outside[met], kind="stable")]
    outside = np.maximum(outside[met], 0)
    indexed = np.where(np.arange(n_dims) >= outside[:, None], y[met], 0.0)
    alive, score = allowed[:, met], np.zeros((len(x), len(met)))
    a = b = None  # live pairs, once there are few
    for end in range(n_dims, 0, -STEP):
        start = max(0, end - STEP)
        some = slice(0, int(np.searchsorted(outside, end)))  # rows with postings in these dimensions
        rest = np.maximum(start, outside)  # dimensions not yet summed
        if a is None:
            score[:, some] += x[:, start:end] @ indexed[some, start:end].T
            alive = alive & (score + x_norm[:, rest] * y_norm[met, rest] + _SLACK * (1 + x_norm[:, rest]) >= low[:, None])
            if SPARSE * np.count_nonzero(alive) < alive.size:
                a, b = np.nonzero(alive)
                score = score[a, b]
        else:
            score += np.einsum("ij,ij->i", x[a, start:end], indexed[b, start:end])
            bound = x_norm[a, rest[b]] * y_norm[met[b], rest[b]] + _SLACK * (1 + x_norm[a, rest[b]])
            keep = score + bound >= low[a]
            a, b, score = a[keep], b[keep], score[keep]
    if a is None:
        a, b = np.nonzero(alive)
        score = score[a, b]
    for first in range(0, len(a), 1 << 16):  # the dimensions outside the index
        part = slice(first, first + (1 << 16))
        prefix = np.where(np.arange(n_dims) < outside[b[part]][:, None], y[met[b[part]]], 0.0)
        score[part] += np.einsum("ij,ij->i", x[a[part]], prefix)
    keep = score >= low[a]
    return a[keep], met[b[keep]], score[keep]


def _in_windows(w: _Windows, ids: np.ndarray, marks: np.ndarray, labels: np.ndarray, y: np.ndarray) -> Iterator[pd.DataFrame]:
    """Best rows of each window among one index's rows, a tile of anchors at a time."""
    n = np.bincount(w.owner, minlength=len(w.ids))
    first = np.cumsum(n) - n
    least = np.full(len(w.ids), np.inf)
    np.minimum.at(least, w.owner, w.low)
    # Anchors of similar demands share a tile, so that its bounds stay sharp.
    demand = np.argsort(least / np.maximum(_norms(w.anchors)[:, -1], 1), kind="stable")
    for start in range(0, len(demand), TILE):
        tile = demand[start : start + TILE]
        allowed = (w.labels[tile][:, None] == labels) == w.alike
        allowed &= w.ids[tile][:, None] != ids
        a, b, score = live_pairs(w.anchors[tile], least[tile], y, allowed)
        a = tile[a]
        for k in range(int(n[tile].max(initial=0))):
            has = n[a] > k
            win = first[a[has]] + k
            row, s = b[has], score[has]
            inside = (s >= w.low[win]) & (s <= w.high[win])
            if inside.any():
                win, row, s = win[inside], row[inside], s[inside]
                yield w.best(pd.DataFrame({"win": win, "score": s.astype(np.int64), "id": ids[row], "mark": marks[row]}))


def search(vectors: DataFrame, windows: _Windows, order: list[int]) -> DataFrame:
    """win, score, id, mark, rank of the best rows of each window; one pass over ``vectors``."""
    spark = vectors.sparkSession
    small_batches(spark, SHARD)
    shared, dims = spark.sparkContext.broadcast(vars(windows)), np.array(order, np.int64)  # arrays only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, kept, size = _Windows(**shared.value), [], 0
        for batch in batches:
            ids, marks, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "mark", "label"))
            for found in _in_windows(w, ids, marks, labels, _matrix(batch.column(batch.schema.get_field_index("vec")), dims)):
                kept.append(found)
                size += len(found)
                if size > 200_000 + 2 * w.wanted * len(w.name):
                    kept = [w.best(pd.concat(kept))]
                    size = len(kept[0])
        if kept:
            best = w.best(pd.concat(kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.name[best["win"].to_numpy()]), *(pa.array(best[c].to_numpy()) for c in ("score", "id", "mark"))],
                names=["win", "score", "id", "mark"],
            )

    kind = vectors.schema["id"].dataType.simpleString()
    found = vectors.select("id", "mark", "label", "vec").mapInArrow(run, _FOUND.format(kind))
    nth = F.row_number().over(Window.partitionBy("win").orderBy(F.desc("score"), "id", "mark"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= windows.wanted)


def fill(vectors: DataFrame, sample: DataFrame, windows: _Windows, order: list[int], label: str) -> DataFrame:
    """All windows filled as far as their bands go: win, score, id, rank (one table per lowered threshold)."""
    start = search(sample, windows, order).groupBy("win").agg(F.max("score").alias("best"), F.min("score").alias("last"), F.count("*").alias("n"))
    start = start.toPandas().set_index("win").reindex(windows.name)
    full = (start["n"] >= windows.wanted).to_numpy()
    thresholds = [start["best"].fillna(-np.inf).to_numpy(), np.where(full, start["last"].fillna(0), -np.inf), np.full(len(full), -np.inf)]
    left, tables = np.arange(len(windows.name)), []
    for threshold in thresholds:
        low = np.maximum(windows.low[left], threshold[left])
        found = materialize(search(vectors, windows.open(left, low), order), label)
        n = found.groupBy("win").count().toPandas().set_index("win")["count"].reindex(windows.name[left], fill_value=0).to_numpy()
        # Filled, or searched down to the end of its band.
        done = (n >= windows.wanted) | (low <= windows.low[left])
        final = vectors.sparkSession.createDataFrame(pd.DataFrame({"win": windows.name[left[done]]}, dtype="int64"), "win long")
        tables.append(found.join(F.broadcast(final), "win", "left_semi"))
        left = left[~done]
        if not len(left):
            break
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _block(vectors: DataFrame, order: list[int], wanted: int) -> _Windows | None:
    """The anchors of a block, each with one open window for its positives."""
    table = vectors.select("id", "label", "vec").toArrow()
    n = table.num_rows
    if not n:
        return None
    x = _matrix(table.column("vec").combine_chunks(), np.array(order, np.int64))
    ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
    name = np.arange(n, dtype=np.int64)
    return _Windows(x, ids, labels, np.arange(n), name, np.full(n, -np.inf), np.full(n, np.inf), wanted, True)


def hard_negatives(
    rows: DataFrame, anchor: Column, key: str = "vec_id", label: Column | str = "label", vector: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    block: int = BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says of ``rows`` which are anchors by their ``id``. For each of an anchor's best ``positives`` rows of its label,
    the best ``negatives`` rows of other labels that score ``low`` to ``high`` hundredths of the positive.
    """
    spark = rows.sparkSession
    vectors = materialize(quantised(rows, key, F.col(label) if isinstance(label, str) else label, vector, scale), "vectors")
    kind = vectors.schema["id"].dataType.simpleString()
    order = dimension_order(vectors)
    size, anchors = vectors.agg(F.count("*"), F.count(F.when(anchor, 1))).first()
    dealt = F.pmod(F.xxhash64("id", "mark", F.lit(1)), F.lit(max(1, size // sample)))
    few = materialize(vectors.filter(dealt == 0), "sample")
    blocks = -(-anchors // block)
    tables = []
    for b in range(blocks):
        here = vectors.filter(anchor & (F.pmod(F.xxhash64("id", "mark"), F.lit(blocks)) == b))
        first = _block(here, order, positives)
        if first is None:
            continue
        found = fill(vectors, few, first, order, "positives").select("win", "score", "id", "rank").toPandas()
        found = found.sort_values(["win", "rank"]).reset_index(drop=True)
        band = found["score"].to_numpy().astype(object)  # whole numbers of any size
        lows = np.array([-(-low * int(s) // 100) for s in band], np.float64)
        highs = np.array([high * int(s) // 100 for s in band], np.float64)
        name = np.arange(len(found), dtype=np.int64)
        second = _Windows(first.anchors, first.ids, first.labels, found["win"].to_numpy(), name, lows, highs, negatives, False)
        left = np.flatnonzero(lows <= highs)
        if not len(left):
            continue
        second = second.open(left, lows[left])
        named = pd.DataFrame({"win": name, "anchor_id": first.ids[found["win"]], "positive_id": found["id"], "positive_score": found["score"]})
        named = spark.createDataFrame(named, f"win long, anchor_id {kind}, positive_id {kind}, positive_score long")
        tables.append(fill(vectors, few, second, order, "negatives").join(F.broadcast(named), "win"))
    if not tables:
        return spark.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
