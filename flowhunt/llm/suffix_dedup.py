"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``length`` bytes around it also starts in a document with a smaller id.

Comparing the suffix arrays of all document shards with each other would grow with the square of their
number. So suffixes that could be equal are first brought together. Each string of ``length`` bytes names an
anchor: the leftmost of its substrings of ``GRAM`` bytes with the smallest hash. Equal strings name equal
anchors, and the strings of one anchor follow one another, so a document is cut into runs of strings of
one anchor, one anchor in about 17 bytes.

1. Document shards sort the hashes of their anchors. Per bucket of hashes, those of all shards are counted
   in one sort, and each shard learns which of its anchors occur in another document, and which are hot.
2. For those, each shard sends the run's bytes (at most 82), equal runs once with their smallest id, to the
   suffix shard of the anchor's hash. An anchor with one run there is decided by the smallest id. For the others a
   suffix shard builds the suffix array of the runs by Larsson-Sadakane refinement, as deep as ``length`` bytes, and
   counts the common bytes of neighbours; those with ``length`` form a class, whose smallest id decides its strings.
3. The decisions, a bit a string, go back to the document shards, which cover and cut their texts.

Hashes only bring strings together; whether two are equal is always decided on the bytes. A passage
that very many documents hold is one run a shard. A short string that very many documents hold in different
contexts would bring all of those to one suffix shard: the runs of such a hot anchor are taken apart, and each
string goes where its own digest says, once a shard. The dealt texts are shuffled once; the three steps read
that one exchange. The number of shards follows the bytes of the table.

Defined cases: null text is empty. Texts shorter than ``length`` keep everything. Rows with equal ids never
remove each other's bytes. A null id counts as larger than all others. Other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from flowhunt.llm.common import whole

LENGTH = 50
GRAM = 18
SHARD_BYTES = 8_000_000
SUFFIX_SHARDS = 4  # for each document shard
HOT = 20_000  # occurrences of an anchor from which its strings travel one by one
BLOCK = 1 << 16  # strings looked at at once: arrays of this size stay in the processor's cache

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_LOW = np.uint64((1 << 24) - 1)
_LAST = np.iinfo(np.int64).max


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _C1
    out ^= b
    out *= _C2
    out ^= out >> np.uint64(31)
    return out


def _words(codes: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each place on as a number, zero behind the end."""
    padded = np.r_[codes, np.zeros(8, np.uint8)]
    return np.ndarray(len(codes) + 1, f"{order}u8", padded, strides=(1,))


def gram_hashes(codes: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of all substrings of ``size`` bytes, eight or more, put together from words of eight; the last overlaps."""
    words, n = _words(codes), len(codes) - size + 1
    out = words[size - 8 : size - 8 + n].astype(np.uint64)
    for at in range(0, size - 8, 8):
        out = _join(out, words[at : at + n])
    return _join(out, np.uint64(size))


def anchored_runs(codes: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK):
    """Runs of strings with one anchor: first string, number of strings, anchor hash. ``ends``: the documents' ends."""
    span = length - gram + 1
    fits = np.ones(len(codes), bool)  # strings that end in their document
    for k in range(1, length):
        fits[ends[ends >= k] - k] = False
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, max(0, len(codes) - length + 1), block):
        hashes = gram_hashes(codes[at : at + block + length - 1], gram)
        least = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        inside = fits[at : at + len(least)]
        first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])])
        count = np.diff(np.r_[first, len(least)])[inside[first]]
        first = first[inside[first]]
        found.append((first + at, count, hashes[(least[first] & _LOW).astype(np.int64)]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, and which of them each key is."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


def suffix_array(codes: np.ndarray, enough: int | None = None) -> np.ndarray:
    """Larsson-Sadakane: groups of equal prefixes are refined by the ranks ``depth`` further on, depth doubling;
    groups of one suffix are left alone. ``enough``: so many bytes suffice; suffixes that share them are side by side."""
    n = len(codes)
    keys = _words(codes, ">")[:n].astype(np.uint64)
    long = max(0, n - 7)
    order = np.argsort(keys[:long])
    # A zero byte must differ from the end: suffixes shorter than the key go before those that begin like them.
    short = np.array(sorted(range(long, n), key=lambda i: (keys[i], -i)), np.int64)
    order = np.insert(order, np.searchsorted(keys[order], keys[short]), short)
    new = np.ones(n, bool)
    if n:
        sorted_keys, tail = keys[order], order >= long
        new[1:] = (sorted_keys[1:] != sorted_keys[:-1]) | tail[1:] | tail[:-1]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    depth = 8
    while enough is None or depth < enough:
        # Slots of a group follow one another, and those left out were groups of one.
        heads = new[slots]
        slots = slots[~(heads & np.r_[heads[1:], True])] if slots.size else slots
        if not slots.size:
            break
        who = order[slots]
        further = np.where(who + depth < n, rank[np.minimum(who + depth, n - 1)] + 1, 0)
        both = rank[who] * (n + 1) + further
        moved = np.argsort(both)
        who, both = who[moved], both[moved]
        order[slots] = who
        new[slots[1:]] |= both[1:] != both[:-1]
        rank[who] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        depth *= 2
    return order


_PLACES = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)  # a bit in each byte of a word


def common_prefixes(codes: np.ndarray, order: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """Common bytes, up to ``limit``, of each suffix with the one before it in ``order``, in words of eight.

    All neighbours are compared on their bytes; ``starts``, where the pieces of the text begin, does not matter.
    """
    n, words = len(codes), _words(codes)
    out = np.zeros(n, np.int64)
    going, a, b = np.arange(1, n), order[1:], order[:-1]
    for at in range(0, limit, 8):
        apart = words[np.minimum(a + at, n)] ^ words[np.minimum(b + at, n)]
        differs = apart != 0
        # The lowest bit that differs lies in the first byte that differs.
        lowest = apart[differs]
        lowest &= ~lowest + np.uint64(1)
        out[going[differs]] = at + np.searchsorted(_PLACES, lowest, side="right") - 1
        going, a, b = (x[~differs] for x in (going, a, b))
    out[going] = limit
    out[1:] = np.minimum(out[1:], np.minimum(limit, n - np.maximum(order[1:], order[:-1])))
    return out


_WIDTH = -(-(2 * LENGTH - GRAM + 1) // 8) * 8  # bytes of a run's row: whole words, and room for one byte more


_INSIDE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first bytes of a word


def byte_rows(codes: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int = _WIDTH) -> np.ndarray:
    """The ``sizes`` bytes from ``first`` on as rows of ``width`` bytes, zero behind them; read in words of eight."""
    words, at = _words(np.r_[codes, np.zeros(width, np.uint8)]), np.arange(0, width, 8)
    rows = words[first[:, None] + at]
    rows &= _INSIDE[np.clip(sizes[:, None] - at, 0, 8)]
    return rows.view(np.uint8).reshape(len(first), width)


def digests(rows: np.ndarray) -> np.ndarray:
    """A hash of each row; the rows' width is a multiple of eight bytes."""
    words = np.ascontiguousarray(rows).view("<u8").reshape(len(rows), rows.shape[1] // 8)
    out = words[:, 0].copy()
    for k in range(1, words.shape[1]):
        out = _join(out, words[:, k])
    return out


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each content, and the content of each row. Digests sort them, the bytes decide."""
    _, kept, which = distinct(digests(rows))
    if not np.array_equal(rows, rows[kept[which]]):  # two contents with one digest
        _, kept, which = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return kept, which


class _Shard:
    """The documents of a shard as one array of bytes."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by("id")
        self.ids_out = table.column("id")
        self.ids = self.ids_out.fill_null(_LAST).to_numpy()
        bodies = table.column("body").to_pylist()
        self.codes = np.frombuffer(b"".join(bodies), np.uint8)
        self.sizes = np.array([len(b) for b in bodies], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.first, self.count, self.hashes = anchored_runs(self.codes, self.ends)
        self.owner = np.repeat(self.ids, np.diff(np.searchsorted(self.first, self.ends), prepend=0))

    def anchors(self, buckets: int):
        """Distinct anchor hashes, which of them each run has, and their rows for each bucket."""
        hashes, _, which = distinct(self.hashes)
        return hashes, which, _slices(_bucket(hashes, buckets))

    def runs(self, masks: dict[int, tuple[bytes, bytes]], buckets: int):
        """Runs with a shared anchor, those of hot anchors string by string.

        First string and owner of each, which distinct content it has, and of the contents in sending order: bytes,
        number of strings, smallest id, bucket.
        """
        hashes, anchor, parts = self.anchors(buckets)
        state = np.zeros(len(hashes), np.uint8)  # 1 shared, 2 hot
        for b, r in parts:
            if b in masks:
                state[r] = sum(np.unpackbits(np.frombuffer(m, np.uint8), count=len(r)) for m in masks[b] if m)
        of = state[anchor]
        rows, hot = np.flatnonzero(of == 1), np.flatnonzero(of == 2)
        first, count, owner, hashed = self.first[rows], self.count[rows], self.owner[rows], self.hashes[rows]
        if hot.size:
            n = self.count[hot]
            single = np.repeat(self.first[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            apart = digests(byte_rows(self.codes, single, np.full(len(single), LENGTH)))
            first, count = np.r_[first, single], np.r_[count, np.ones(len(single), np.int64)]
            owner, hashed = np.r_[owner, np.repeat(self.owner[hot], n)], np.r_[hashed, apart]
        content = byte_rows(self.codes, first, count + LENGTH - 1, _WIDTH + 8)
        content[:, _WIDTH - 1] = count
        content.view("<u8")[:, -1] = hashed
        kept, which = distinct_rows(content)
        # Contents that begin alike side by side: they compress better. Stable, as the steps that send and cut must agree
        # on the order, whatever processors they run on.
        order = np.argsort(content[kept, :8].copy().view(">u8").ravel().astype(np.uint64), kind="stable")
        place = np.empty(len(kept), np.int64)
        place[order] = np.arange(len(kept))
        kept, which = kept[order], place[which]
        least = np.full(len(kept), _LAST)
        np.minimum.at(least, which, owner)
        return first, owner, which, content[kept, :_WIDTH], count[kept], least, _bucket(hashed[kept], buckets)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def _slices(numbers: np.ndarray):
    """(number, its rows) for each value, in order."""
    # Two bytes are sorted by counting.
    order = np.argsort(numbers.astype(np.uint16) if numbers.max(initial=0) < 1 << 16 else numbers, kind="stable")
    cuts = np.flatnonzero(np.diff(numbers[order], prepend=-1))
    return [(int(numbers[r[0]]), r) for r in np.split(order, cuts[1:])] if len(order) else []


def _anchors(buckets: int):
    def work(table: pa.Table) -> pa.Table:
        shard = _Shard(table)
        hashes, at, parts = shard.anchors(buckets)
        low, high = np.full(len(hashes), _LAST), np.full(len(hashes), np.iinfo(np.int64).min)
        np.minimum.at(low, at, shard.owner)
        np.maximum.at(high, at, shard.owner)
        # One where a single document has it, else how often it occurs.
        counts = np.where(low < high, np.minimum(np.bincount(at, minlength=len(hashes)), 65_535), 1).astype(np.uint16)
        return pa.table({
            "bucket": pa.array([b for b, _ in parts], pa.int64()),
            "shard": pa.array([table.column("shard")[0].as_py()] * len(parts), pa.int64()),
            "keys": pa.array([hashes[r].tobytes() for _, r in parts], pa.binary()),
            "counts": pa.array([counts[r].tobytes() for _, r in parts], pa.binary()),
        })

    return work


def _shared(hot: int):
    def work(table: pa.Table) -> pa.Table:
        """Of each shard two bits for each of its anchors: whether another document has it too, and whether it is hot."""
        shards = table.column("shard").to_pylist()
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, np.uint16) for c in table.column("counts").to_pylist()])
        merged, _, which = distinct(np.concatenate(keys))
        total = np.bincount(which, counts, len(merged))[which]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        masks, hottest = np.split(total > 1, cuts), np.split(total > hot, cuts)
        some = [i for i, m in enumerate(masks) if m.any()]
        bucket = table.column("bucket").to_pylist()
        return pa.table({
            "shard": pa.array([shards[i] for i in some], pa.int64()),
            "bucket": pa.array([bucket[i] for i in some], pa.int64()),
            "mask": pa.array([np.packbits(masks[i]).tobytes() for i in some], pa.binary()),
            "hot": pa.array([np.packbits(hottest[i]).tobytes() if hottest[i].any() else b"" for i in some], pa.binary()),
        })

    return work


def _masks(table: pa.Table) -> dict[int, tuple[bytes, bytes]]:
    """Per bucket the shared and the hot anchors, where the bucket has any."""
    rows = zip(*(table.column(c).to_pylist() for c in ("bucket", "mask", "hot")))
    return {b: (mask, hot) for b, mask, hot in rows if mask}


def _send(buckets: int):
    def work(docs: pa.Table, shared: pa.Table) -> pa.Table:
        shard, pack = _Shard(docs), zstandard.ZstdCompressor(level=3)
        masks = _masks(shared)
        _, _, _, content, count, least, bucket = shard.runs(masks, buckets)
        rows = dict(_slices(bucket))
        # A bucket all of whose anchors are hot gets no run, but its bits must come back.
        named = sorted(masks.keys() | rows.keys())
        parts = [rows.get(b, np.zeros(0, np.int64)) for b in named]
        at = np.arange(content.shape[1])
        return pa.table({
            "bucket": pa.array(named, pa.int64()),
            "shard": pa.array([docs.column("shard")[0].as_py()] * len(named), pa.int64()),
            "mask": pa.array([masks.get(b, (b"", b""))[0] for b in named], pa.binary()),
            "hot": pa.array([masks.get(b, (b"", b""))[1] for b in named], pa.binary()),
            "codes": pa.array([pack.compress(content[r][at < count[r, None] + (LENGTH - 1)].tobytes()) for r in parts], pa.binary()),
            "counts": pa.array([count[r].astype(np.uint8).tobytes() for r in parts], pa.binary()),
            "least": pa.array([least[r].tobytes() for r in parts], pa.binary()),
        })

    return work


def decide(codes: np.ndarray, counts: np.ndarray, least: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For the strings of all runs in order: whether a run with a smaller id holds the string too.

    ``codes``: the runs' bytes one after the other, ``counts``: strings a run, ``least``: id a run.
    """
    sizes = counts + length - 1
    # Equal runs of several shards count once.
    width = -(-(int(sizes.max(initial=0)) + 1) // 8) * 8
    rows = byte_rows(codes, np.cumsum(sizes) - sizes, sizes, width)
    rows[:, -1] = counts
    kept, which = distinct_rows(rows)
    ids = np.full(len(kept), _LAST)
    np.minimum.at(ids, which, least)

    # Equal strings have equal anchors: a content with an anchor of its own shares no string with others.
    own_counts, own_sizes = counts[kept], sizes[kept]
    text = rows[kept][np.arange(width) < own_sizes[:, None]]
    ends = np.cumsum(own_sizes)
    first, _, hashes = anchored_runs(text, ends)
    of = np.searchsorted(ends, first, side="right")
    # A run is cut where blocks meet: such neighbours count once.
    once = np.ones(len(of), bool)
    once[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    of, (_, _, at) = of[once], distinct(hashes[once])
    meets = np.zeros(len(kept), bool)
    meets[of[np.bincount(at)[at] > 1]] = True
    smallest, place = _smallest_ids(text, own_counts, own_sizes, ids, np.flatnonzero(meets), length)

    decided = np.repeat(ids[which], counts)
    shared = np.flatnonzero(meets[which])
    n, begin = counts[shared], (np.cumsum(counts) - counts)[shared]
    ahead = np.cumsum(n) - n
    step = np.arange(n.sum())
    decided[np.repeat(begin - ahead, n) + step] = smallest[np.repeat(place[which[shared]] - ahead, n) + step]
    return decided < np.repeat(least, counts)


def _smallest_ids(text, counts, sizes, ids, members, length) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of any string at each place of the ``members``' bytes, and where each member's bytes begin."""
    begins = np.cumsum(sizes) - sizes
    place = np.zeros(len(sizes), np.int64)
    if not members.size:
        return np.zeros(0, np.int64), place
    own = sizes[members]
    starts = np.cumsum(own) - own
    place[members] = starts
    owner = np.repeat(np.arange(len(members)), own)
    inner = np.arange(len(owner)) - starts[owner]
    codes = text[begins[members][owner] + inner]
    order = suffix_array(codes, length)
    prefixes = common_prefixes(codes, order, starts, length)
    group = np.empty(len(codes), np.int64)
    group[order] = np.cumsum(prefixes < length)
    is_string = inner < counts[members][owner]
    smallest = np.full(len(codes) + 1, _LAST)
    np.minimum.at(smallest, group[is_string], ids[members][owner[is_string]])
    return smallest[group], place


def _decide(table: pa.Table) -> pa.Table:
    counts = [np.frombuffer(x, np.uint8).astype(np.int64) for x in table.column("counts").to_pylist()]
    unpack = zstandard.ZstdDecompressor()
    bits = decide(
        np.frombuffer(b"".join(map(unpack.decompress, table.column("codes").to_pylist())), np.uint8), np.concatenate(counts),
        np.frombuffer(b"".join(table.column("least").to_pylist()), np.int64),
    )
    cuts = np.cumsum([c.sum() for c in counts])[:-1]
    return pa.table({
        **{c: table.column(c) for c in ("shard", "bucket", "mask", "hot")},
        "bits": pa.array([np.packbits(b).tobytes() for b in np.split(bits, cuts)], pa.binary()),
    })


def _cut(buckets: int):
    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        shard = _Shard(docs)
        gone = np.zeros(len(shard.codes) + 1, np.int8)  # at most ``LENGTH`` strings lie over a byte
        if answers.num_rows:
            bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()))
            first, owner, which, _, count, least, bucket = shard.runs(_masks(answers), buckets)
            begin = np.zeros(len(count), np.int64)
            flags, done = [np.zeros(0, bool)], 0
            for b, r in _slices(bucket):
                own = count[r]
                flags.append(np.unpackbits(np.frombuffer(bits[b], np.uint8), count=int(own.sum())).astype(bool))
                begin[r] = done + np.cumsum(own) - own
                done += int(own.sum())
            flat = np.concatenate(flags)
            n = count[which]
            ahead = np.cumsum(n) - n
            step = np.arange(n.sum())
            # The smallest id of a run was judged; every larger one repeats that run.
            repeated = flat[np.repeat(begin[which] - ahead, n) + step] | np.repeat(owner > least[which], n)
            strings = (np.repeat(first - ahead, n) + step)[repeated]
            # A string is in one run.
            gone[strings] += 1
            gone[strings + LENGTH] -= 1
        covered = np.cumsum(gone[:-1], dtype=np.int8) > 0
        out = []
        for end, size in zip(shard.ends, shard.sizes):
            mask = covered[end - size : end]
            removed = int(np.count_nonzero(mask))
            spans = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(bool(size and mask[0])) if removed else 0
            kept = shard.codes[end - size : end]
            kept = (kept[~mask] if removed else kept).tobytes()
            out.append((int(size), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        n_bytes, n_removed, n_spans, digests_, texts = zip(*out)
        return pa.table({
            "id": shard.ids_out, "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests_, pa.string()),
            "kept": pa.array(texts, pa.binary()),
        })

    return work


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, hot: int = HOT
) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    buckets = shards * SUFFIX_SHARDS
    dealt = docs.select(
        F.col(key).cast("long").alias("id"), F.encode(whole(text), "UTF-8").alias("body"),
        F.pmod(F.xxhash64(F.col(key), F.xxhash64(text)), F.lit(shards)).alias("shard"),
    ).repartition(shards, "shard")

    def to_shards(rows: DataFrame):
        return rows.repartition(shards, "shard").groupBy("shard")

    anchors = dealt.groupBy("shard").applyInArrow(_anchors(buckets), "bucket long, shard long, keys binary, counts binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared(hot), "shard long, bucket long, mask binary, hot binary")
    runs = dealt.groupBy("shard").cogroup(to_shards(shared)).applyInArrow(
        _send(buckets), "bucket long, shard long, mask binary, hot binary, codes binary, counts binary, least binary"
    )
    answers = runs.groupBy("bucket").applyInArrow(_decide, "shard long, bucket long, mask binary, hot binary, bits binary")
    out = dealt.groupBy("shard").cogroup(to_shards(answers)).applyInArrow(
        _cut(buckets), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    return out.withColumn("id", F.col("id").cast(docs.schema[key].dataType)).withColumnRenamed("id", key)
