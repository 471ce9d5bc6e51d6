"""Best-fit packing of token sequences with a swap-based local search.

Documents become token ids closed by an end mark; only those longer than a sequence are cut, the first
piece taking the odd length. Full pieces are sequences of their own. All others are dealt over groups of
bounded size. A group is packed best fit, longest first, and then searched: the emptiest bin gives away
documents by moving one, by exchanging one for a shorter one, two for one, or one for two shorter ones. Every
step raises the sum of squared fills, so the search ends; it stops early at a lower bound for the number of
bins. Each group's emptiest bins, at most an eighth of its pieces, are then
pooled and dealt anew over fewer groups until one group is left, so no group's remainder stays underfull.

Only (key, length) rows are planned; token ids are stored once and meet their place in one join.

Ids are those of the ``tokenizers`` library. Where a rank file of the same vocabulary is given, texts
without a special string are encoded from it, several times faster and with the same ids (tests compare
every code point).

Defined cases: null counts as empty, whose only id is the end mark. Every row is a document, repeated and
null keys included; ties are broken by the stored order. Special strings inside texts are encoded as the
library does by default. Extra columns are not read by ``token_pieces`` and carried by ``pack``. A text must
fit a task. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowhunt.llm.common import small_batches, whole
from flowhunt.session import materialize

CAPACITY = 2048
END = 0
GROUP = 20_000  # pieces that one task packs
REDEALT = 8  # at most one in so many pieces is pooled for the next round
PATIENCE = 64  # emptiest bins in a row that the search may fail to improve
PAIRED = 24  # bins of more pieces are paired by neighbouring lengths only

_ROUND_BITS, _TASK_BITS = 56, 28


class TextIds:
    """Token ids of texts, without added tokens."""

    def __init__(self, tokenizer_file: str, rank_file: str | None = None, pattern: str | None = None) -> None:
        self.tokenizer = tokenizers.Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = None
        if rank_file:
            with open(rank_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranked = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.ranked is None or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(
    docs: DataFrame, tokenizer_file: str, rank_file: str | None = None, pattern: str | None = None,
    key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END,
) -> DataFrame:
    """Rows key, piece, start, length, ids (little-endian unsigned 32-bit). The files lie on every machine."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TextIds(tokenizer_file, rank_file, pattern)
        for batch in batches:
            rows, pieces, starts, lengths, ids = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = np.array([*encode(text), end], "<u4")
                for piece, (start, length) in enumerate(cuts(len(found), capacity)):
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(length)
                    ids.append(found[start : start + length].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                names=["id", "piece", "start", "length", "ids"],
            )

    kind = docs.schema[key].dataType.simpleString()
    read = docs.select(F.col(key).alias("id"), whole(text).alias("body"))
    found = read.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary")
    return found.withColumnRenamed("id", key)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of each bin: longest first, each into the fullest bin that still holds it."""
    with_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_spaces = 0  # bit s is set where a bin has s left
    bins: list[list[int]] = []
    for item in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        size = sizes[item]
        fits = open_spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            chosen = with_space[space].pop()
            if not with_space[space]:
                open_spaces ^= 1 << space
        else:
            space, chosen = capacity, len(bins)
            bins.append([])
        bins[chosen].append(item)
        left = space - size
        with_space[left].append(chosen)
        open_spaces |= 1 << left
    return bins


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound for the number of bins (Martello and Toth): long items exclude each other."""
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=capacity + 1)
    count, total = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    small = np.arange(1, half + 1)
    alone = count[capacity] - count[capacity - small]
    between = count[capacity - small] - count[half]
    room = between * capacity - (total[capacity - small] - total[half])
    rest = total[half] - total[small - 1]
    bound = alone + between + np.maximum(0, -(-(rest - room) // capacity))
    return max(int(bound.max()), -(-int(total[capacity]) // capacity))


class _Search:
    """Local search over the underfull bins of one group.

    What a bin offers for an exchange (nothing, one item, two items) is filed by its room: the size that
    fits in after the offer is taken out. A size then looks for the least room that holds it, among offers
    smaller than itself. Entries of a bin that has changed since are dropped when they are met.
    """

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int) -> None:
        self.bins, self.sizes, self.capacity = bins, sizes.tolist(), capacity
        self.fill = [sum(self.sizes[i] for i in b) for b in bins]
        self.version = [0] * len(bins)
        self.offers: list[list[list[tuple]]] = [[[] for _ in range(capacity + 1)] for _ in range(3)]
        self.smallest = np.full((3, capacity + 1), capacity + 1)

    def _given(self, b: int, most: int) -> dict[int, tuple[int, ...]]:
        """Sizes that one or ``most`` = two items of a bin add up to, with the items."""
        items = sorted(self.bins[b], key=self.sizes.__getitem__)
        found = {self.sizes[i]: (i,) for i in items}
        if most == 2:
            pairs = combinations(items, 2) if len(items) <= PAIRED else pairwise(items)
            found = {self.sizes[i] + self.sizes[j]: (i, j) for i, j in pairs}
        return found

    def _file(self, b: int) -> None:
        """Enter what a bin offers."""
        space = self.capacity - self.fill[b]
        if not self.bins[b] or not space:
            return
        for kind, found in enumerate(({0: ()}, self._given(b, 1), self._given(b, 2))):
            for size, items in found.items():
                heappush(self.offers[kind][size + space], (size, b, self.version[b], items))
                self.smallest[kind, size + space] = min(size, self.smallest[kind, size + space])

    def _find(self, kind: int, size: int, below: int) -> tuple[int, tuple] | None:
        """The offer smaller than ``size`` with the least room that holds it, if that leaves less than ``below``."""
        while True:
            fits = self.smallest[kind, size : size + below] < size
            left = int(fits.argmax()) if fits.size else 0
            if not fits.size or not fits[left]:
                return None
            heap = self.offers[kind][size + left]
            while heap and heap[0][2] != self.version[heap[0][1]]:
                heappop(heap)
            self.smallest[kind, size + left] = heap[0][0] if heap else self.capacity + 1
            if heap and heap[0][0] < size:
                return left, heap[0]

    def _step(self, donor: int) -> bool:
        """The exchange that leaves another bin the least space, if that raises the sum of squared fills.

        With fills d and f and d - x, f + x afterwards, the sum rises where f + x > d.
        """
        left, choice = self.capacity - self.fill[donor], None
        for given, kinds in ((self._given(donor, 1), (0, 1, 2)), (self._given(donor, 2), (1,))):
            for size, items in given.items():
                for kind in kinds:
                    found = self._find(kind, size, left)
                    if found:
                        left, choice = found[0], (items, found[1])
                    if left == 0:
                        break
                if left == 0:
                    break
            if left == 0:
                break
        if choice is None:
            return False
        give, (_, target, _, take) = choice
        self.bins[donor] = [i for i in self.bins[donor] if i not in give] + list(take)
        self.bins[target] = [i for i in self.bins[target] if i not in take] + list(give)
        for b in (donor, target):
            self.fill[b] = sum(self.sizes[i] for i in self.bins[b])
            self.version[b] += 1
        self._file(target)
        return True

    def run(self, least: int) -> list[list[int]]:
        live = len(self.bins)
        for b in range(live):
            self._file(b)
        waiting = [(f, b) for b, f in enumerate(self.fill) if f < self.capacity]
        heapify(waiting)
        failed: list[int] = []
        while live > least and len(failed) < PATIENCE and waiting:
            fill, donor = heappop(waiting)
            if fill != self.fill[donor]:  # has changed since
                if self.fill[donor] < self.capacity:
                    heappush(waiting, (self.fill[donor], donor))
                continue
            self.version[donor] += 1  # its own offers are off while it gives
            while self.bins[donor] and self._step(donor):
                pass
            if self.bins[donor]:
                self._file(donor)
                failed.append(donor)
                continue
            live -= 1
            for b in failed:
                heappush(waiting, (self.fill[b], b))
            failed = []
        return [b for b in self.bins if b]


def pack_group(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of each bin of one group."""
    bins = best_fit(sizes.tolist(), capacity)
    least = least_bins(sizes, capacity)
    return bins if len(bins) <= least else _Search(bins, sizes, capacity).run(least)


def _pack_round(items: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """key, length, sequence_id, offset, closed: one packed group per task."""
    last = groups == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [b for b in batches if b.num_rows]
        if not read:
            return
        table = pa.Table.from_batches(read)
        keys, sizes = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "length"))
        if len(sizes) and (sizes.max() > capacity or sizes.min() < 1):
            raise ValueError(f"lengths lie in 1..{capacity}")
        first = (turn << _ROUND_BITS) | (TaskContext.get().partitionId() << _TASK_BITS)
        order, names, offsets, closed = [], [], [], []
        bins = sorted(pack_group(sizes, capacity), key=lambda b: int(sizes[b].sum()))
        pooled = 0
        for n, items in enumerate(bins):
            full = int(sizes[items].sum()) == capacity
            pooled += len(items)
            keep = last or full or pooled > len(sizes) // REDEALT
            order += items
            names += [first + n] * len(items)
            offsets += np.cumsum([0, *sizes[items[:-1]].tolist()]).tolist()
            closed += [keep] * len(items)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[order]), pa.array(sizes[order]), pa.array(names, pa.int64()), pa.array(offsets, pa.int64()), pa.array(closed)],
            names=["key", "length", "sequence_id", "offset", "closed"],
        )

    dealt = items.repartition(groups)
    packed = dealt.mapInArrow(run, "key long, length long, sequence_id long, offset long, closed boolean")
    return materialize(packed, "packed")


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (place in the sequence, gapless from 0)."""
    keyed = materialize(
        pieces.select(F.struct(*pieces.columns).alias("row"), F.col(length).cast("long").alias("length"),
                      F.monotonically_increasing_id().alias("key")),
        "pieces",
    )
    full = keyed.filter(F.col("length") == capacity).select("row", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = keyed.filter(F.col("length") != capacity)
    items, done, turn = rest.select("key", "length"), [], 0
    while True:
        groups, turn = max(1, math.ceil(items.count() / group)), turn + 1
        packed = _pack_round(items, groups, turn, capacity)
        done.append(packed.filter("closed").select("key", "sequence_id", "offset"))
        if groups == 1:
            break
        items = packed.filter(~F.col("closed")).select("key", "length")
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return rest.join(placed, "key").select("row.*", "sequence_id", "offset").unionByName(full.select("row.*", "sequence_id", "offset"))
