"""N-gram Jaccard self-join by chosen paths.

A document is the set of its word 5-grams. Documents with the same set form one class, represented by its
smallest id, and only representatives are joined. Inside the join a document is named by its place in the stored
signatures, so ids may be null or repeated.

Candidates. A run walks a tree of random hash functions: at a node, a set moves into the branch of each
of its tokens whose hash is below 1 / (threshold * set size), about one branch in all, so two sets with
Jaccard similarity s >= threshold share a branch with probability of about 1 - exp(-s / threshold) a level.
A set's branches depend on nothing but the set, so each document writes down those below the roots itself. Buckets of at most ``SMALL`` sets stop there, and so do larger ones whose sets are mostly alike; others
are split at the next level (there, a set's tokens are its min-hashes). What is still large at the last
level is compared in blocks: no bucket is cut. ``runs_for`` repeats runs until a pair at the threshold is
missed with at most the stated probability, even if all buckets it shares above the last level are split.

Inside a bucket min-hash sketches are compared: a search from row to row over those not reached yet, which
finds the same components as all pairs. A bucket gives back a spanning forest, never all pairs, and
the forests' connected components become candidate groups.

Verification. The sets of the candidates are made again from the texts and sent to their group, which is cut into blocks; each pair of blocks
is one group of the shuffle. There every pair is compared exactly on the whole sets; each set gets its
number of links and the verified pairs again give a forest. Its components are the result.

Defined cases: words are maximal runs of letters and digits, lower-cased. A text with fewer than five words is
the set of one token, all its words; a text without a word (null, empty) is its own class, with no
link. Rows with equal id and text are one document; rows that share only the id, a null one too, are documents of
their own. A null id is larger than all others: a class has a null id only if all its documents have. Other
columns are not read; empty tables give empty results. Ids are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowhunt.llm.common import small_batches, whole
from flowhunt.llm.components import components
from flowhunt.session import materialize

WORDS = 5
THRESHOLD = 0.8
MISS = 1e-5
DEPTH = 3
SMALL = 512
SKETCH = 128
SLACK = 0.17  # a sketch of 128 estimates 0.8 with a standard error of 0.035
BUCKET_BLOCK = 16_384  # sketches compared in one task
BLOCK, BLOCK_TOKENS = 3072, 1_500_000  # whole sets compared in one task: at most so many sets and tokens, twice
_STEP, _ROWS = 2048, 512  # columns and rows of a product
MANY, SALTS = 1000, 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WEYL = np.uint64(0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _BASE
    x = (x ^ (x >> np.uint64(29))) * _WEYL
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; of all words together if there are fewer."""
    n = len(words) - size + 1
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    width, n = (size, n) if n > 0 else (len(words), 1)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mix(out + words[i : i + n] + np.uint64(i + 1))
    return np.unique(out)


def runs_for(miss: float = MISS, threshold: float = THRESHOLD, levels: int = DEPTH) -> int:
    """Runs after which a pair at the threshold shares no branch of the last level with probability ``miss``.

    A pair shares about one branch of the root, and below each node as many as its equal min-hashes over those of
    a pair at the threshold; equal ones are the same in all runs, so the mean is over their number.
    """
    need = math.ceil((threshold - SLACK) * SKETCH)  # with fewer the sketches part the pair
    equal = [(k, math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k)) for k in range(need, SKETCH + 1)]
    extinct = []
    for k, chance in equal:
        lost = 0.0
        for level in range(levels):  # from the last level up to the root
            lost = math.exp((1 if level == levels - 1 else k / (SKETCH * threshold)) * (lost - 1))
        extinct.append((lost, chance))
    runs = 1
    while sum(chance * lost**runs for lost, chance in extinct) > miss:
        runs += 1
    return runs


def sketch(tokens: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Low bytes of ``size`` min-hashes."""
    out = np.empty(size, np.uint8)
    seeds = mix(np.arange(1, size + 1, dtype=np.uint64))
    for i in range(0, size, 16):
        keys = (tokens[None, :] ^ seeds[i : i + 16, None]) * _BASE
        keys ^= keys >> np.uint64(33)
        keys *= _WEYL
        least = keys.min(axis=1)
        out[i : i + 16] = (least >> np.uint64(40)) & np.uint64(255)
    return out


def first_branches(tokens: np.ndarray, runs: int, threshold: float = THRESHOLD) -> np.ndarray:
    """Nodes that a set moves into below the root of each run: those of its tokens with a small hash."""
    roots = mix(np.arange(1, runs + 1, dtype=np.uint64))
    hashed = mix(tokens[None, :] ^ roots[:, None])
    run, token = np.nonzero(hashed <= _limit(threshold, len(tokens)))
    return mix(hashed[run, token] + roots[run])


def next_branches(nodes: np.ndarray, codes: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """The same below ``nodes``, for many sets at once; a set's tokens are its min-hashes. Rows and new nodes."""
    tokens = codes.astype(np.uint64) | (np.arange(codes.shape[1], dtype=np.uint64) << np.uint64(8))
    hashed = mix(mix(tokens) ^ nodes[:, None])
    row, token = np.nonzero(hashed <= _limit(threshold, codes.shape[1]))
    return row, mix(hashed[row, token] + nodes[row])


def _limit(threshold: float, size: int) -> np.uint64:
    return np.uint64(min(2.0**64 - 2049, 2.0**64 / (threshold * size)))


def _words(docs: DataFrame, key: str, text: str, *more: str | Column) -> DataFrame:
    small_batches(docs.sparkSession)
    pieces = F.filter(F.split(F.lower(whole(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return docs.select(F.col(key).cast("long").alias("id"), F.transform(pieces, lambda w: F.xxhash64(w)).alias("words"), *more)


def _mark(text: str) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(whole(text))


def _sets(column: pa.ListArray, size: int) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return [shingles(x, size) for x in np.split(flat, ends[:-1])] if len(ends) else []


def set_key(tokens: np.ndarray) -> str:
    """Order-free fingerprint of a set: two 64-bit sums and the size; empty for the empty set."""
    if not tokens.size:
        return ""
    sums = [int(mix(tokens + mix(np.array([seed], np.uint64))).sum(dtype=np.uint64)) for seed in (1, 2)]
    return f"{sums[0]:016x}{sums[1]:016x}{len(tokens):x}"


def signatures(docs: DataFrame, key: str, text: str, runs: int, threshold: float) -> DataFrame:
    """id, mark, set_key, sketch, nodes: all that candidate search needs of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column(1), WORDS)
            nodes = [first_branches(x, runs, threshold) if x.size else x for x in sets]
            flat = (np.concatenate(nodes) if nodes else np.zeros(0, np.uint64)).view(np.int64)
            offsets = pa.array(np.cumsum([0, *map(len, nodes)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array([set_key(x) for x in sets], pa.string()),
                    pa.array([sketch(x).tobytes() if x.size else b"" for x in sets], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(flat)),
                ],
                names=["id", "mark", "set_key", "sketch", "nodes"],
            )

    return _words(docs, key, text, _mark(text).alias("mark")).mapInArrow(
        run, "id long, mark long, set_key string, sketch binary, nodes array<long>"
    )


def _split(members: DataFrame, threshold: float) -> DataFrame:
    """Members (id, sketch, lead, node) of large buckets moved into the nodes below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, SKETCH)
            row, node = next_branches(batch.column(3).to_numpy().view(np.uint64), codes, threshold)
            kept = batch.select([0, 1, 2]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(node.view(np.int64))], names=["id", "sketch", "lead", "node"])

    return members.select("id", "sketch", "lead", "node").mapInArrow(run, "id long, sketch binary, lead binary, node long")


def _whole_groups(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """``work`` gets Arrow tables that hold whole groups, in the order of ``keys``, and gives back a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            numbers = group_numbers(table, keys)
            cut = int(np.searchsorted(numbers, numbers[-1]))  # the last group may go on
            if held and group_numbers(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table.slice(0, 1)]), keys)[-1]:
                yield from work(pa.concat_tables(held).combine_chunks()).to_batches()
                held = []
            if cut:
                yield from work(pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks()).to_batches()
                held = []
            held.append(table.slice(cut))
        if held:
            yield from work(pa.concat_tables(held).combine_chunks()).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def group_numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    """0, 1, ... for the runs of equal keys."""
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        values = table.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def spread(n: int, close_to) -> np.ndarray:
    """Root (first row) of each row's component. ``close_to(rows, others)`` says which others are close to any row.

    A search that only ever looks at rows not reached yet: a group whose rows are all alike takes one step.
    """
    root = np.full(n, -1)
    waiting = np.arange(n)
    while waiting.size:
        first, frontier, waiting = waiting[0], waiting[:1], waiting[1:]
        root[first] = first
        while frontier.size and waiting.size:
            found = close_to(frontier, waiting)
            frontier, waiting = waiting[found], waiting[~found]
            root[frontier] = first
    return root


def _edges(ids: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its component), for ids that are not the smallest."""
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, root, ids)
    moved = ids != low[root]
    return ids[moved], low[root][moved]


def _edges_of_buckets(members: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Forests (a, b) of the sketch pairs within each group of ``keys``; members hold columns id, sketch."""
    need = math.ceil(least * SKETCH)

    def work(table: pa.Table) -> pa.Table:
        ids, group = table.column("id").to_numpy(), group_numbers(table, keys)
        codes = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), SKETCH)
        cuts = np.r_[np.flatnonzero(np.diff(group, prepend=-1)), len(group)]
        found = [pair_edges(ids, codes, group, cuts, need)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi - lo <= 2:
                continue
            part = codes[lo:hi]

            def close_to(rows: np.ndarray, others: np.ndarray, part=part) -> np.ndarray:
                out = np.zeros(len(others), bool)
                for r in rows:
                    left = np.flatnonzero(~out)
                    if not left.size:
                        break
                    out[left] = (part[others[left]] == part[r]).sum(axis=1) >= need
                return out

            found.append(_edges(ids[lo:hi], spread(hi - lo, close_to)))
        high, low = (np.concatenate(x) for x in zip(*found))
        return pa.table({"a": pa.array(high, pa.int64()), "b": pa.array(low, pa.int64())})

    return _whole_groups(members, keys, work, "a long, b long")


def pair_edges(ids, codes, group, cuts, need) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all groups of two rows at once; most buckets are such."""
    a = cuts[:-1][np.diff(cuts) == 2]
    a = a[(codes[a] == codes[a + 1]).sum(axis=1) >= need]
    return np.maximum(ids[a], ids[a + 1]), np.minimum(ids[a], ids[a + 1])


def _blocked(members: DataFrame, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks of its group that it takes part in: columns left, right, own."""
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = F.transform(others, lambda x: F.struct(F.least("own", x).alias("left"), F.greatest("own", x).alias("right")))
    return (
        members.withColumn("blocks", blocks.cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("pair", F.explode(pair))
        .select(*members.columns, "own", "pair.left", "pair.right")
    )


def close_sets(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs reach the threshold: intersection sizes by matrix products over slices of the shared tokens."""
    tokens, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    kept = counts[number] > 1
    sizes = np.array([len(x) for x in sets], np.float64)
    owner, at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[kept], column[number][kept]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    n = int((counts > 1).sum())
    shared = np.zeros((len(sets), len(sets)), np.uint16 if sizes.max() < 65_536 else np.uint32)
    for i in range(0, n, _STEP):
        lo, hi = np.searchsorted(at, [i, i + _STEP])
        held = np.zeros((len(sets), min(_STEP, n - i)), np.float32)
        held[owner[lo:hi], at[lo:hi] - i] = 1
        for r in range(0, len(sets), _ROWS):
            shared[r : r + _ROWS] += (held[r : r + _ROWS] @ held.T).astype(shared.dtype)
    close = np.zeros(shared.shape, bool)
    for r in range(0, len(sets), _ROWS):
        part = shared[r : r + _ROWS].astype(np.float64)
        close[r : r + _ROWS] = part >= threshold * (sizes[r : r + _ROWS, None] + sizes[None, :] - part) - 1e-9
    np.fill_diagonal(close, False)
    return close


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """Exact comparison inside (group, left, right): rows (id, other, links, copies); other is the forest's edge."""
    keys = ["group", "left", "right"]

    def one(ids: np.ndarray, own: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], across: bool):
        close = close_sets(sets, threshold)
        if across:
            close &= own[:, None] != own[None, :]
        links = [close[r : r + _ROWS] @ copies.astype(np.float64) for r in range(0, len(sets), _ROWS)]
        root = spread(len(ids), lambda rows, others: close[np.ix_(rows, others)].any(axis=0))
        return np.concatenate(links).round().astype(np.int64), _edges(ids, root)

    def work(table: pa.Table) -> pa.Table:
        group, ids, own, copies = group_numbers(table, keys), *(table.column(c).to_numpy() for c in ("id", "own", "copies"))
        across = table.column("left").to_numpy() != table.column("right").to_numpy()
        column = table.column("tokens").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        sets = np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1])
        cuts = np.r_[np.flatnonzero(np.diff(group, prepend=-1)), len(group)]
        parts = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows = lo + np.unique(ids[lo:hi], return_index=True)[1]  # repeated rows of a document count once
            links, (high, low) = one(ids[rows], own[rows], copies[rows], [sets[i] for i in rows], bool(across[lo]))
            other = dict(zip(high.tolist(), low.tolist()))
            parts.append((ids[rows], [other.get(x) for x in ids[rows].tolist()], links, copies[rows]))
        return pa.table({
            "id": pa.array(np.concatenate([p[0] for p in parts]), pa.int64()),
            "other": pa.array([x for p in parts for x in p[1]], pa.int64()),
            "links": pa.array(np.concatenate([p[2] for p in parts]), pa.int64()),
            "copies": pa.array(np.concatenate([p[3] for p in parts]), pa.int64()),
        })

    return _whole_groups(members, keys, work, "id long, other long, links long, copies long")


def _salt(copies: str) -> Column:
    """Documents of a class with many copies are dealt over ``SALTS`` keys."""
    return F.when(F.col(copies) > MANY, F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).otherwise(0)


def _salts(copies: str) -> Column:
    return F.explode(F.when(F.col(copies) > MANY, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))


def _classes(rows: DataFrame) -> DataFrame:
    """doc, id, mark, set_key, lead, copies: a document's class is led by the smallest id with the same set.

    ``lead`` holds (nameless, id, doc) of that document: the order in which documents stand for others.
    """
    lead = F.struct(F.col("id").isNull().alias("nameless"), "id", "doc")
    rows = rows.withColumn("lead", lead)
    several = rows.filter("set_key <> ''").groupBy("set_key").agg(F.min("lead").alias("first"), F.count("*").alias("copies"))
    several = several.filter("copies > 1").select(
        "set_key", "first", "copies", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    return dealt.join(several, ["set_key", "salt"], "left").select(
        "doc", "id", "mark", "set_key", F.coalesce("first", "lead").alias("lead"), F.coalesce("copies", F.lit(1)).alias("copies")
    )


def candidate_groups(signed: DataFrame, reps: DataFrame, threshold: float, small: int) -> DataFrame:
    """Rows (id, component) of the representatives that share a bucket with a similar sketch."""
    own = signed.join(reps.select("doc"), "doc").select(F.col("doc").alias("id"), "sketch", "nodes")
    lead = F.substring("sketch", 1, 2)
    walks = own.select("id", lead.alias("lead"), F.explode(F.array_distinct("nodes")).alias("node"))
    edges = None
    for level in range(DEPTH):
        # A bucket is alike if two min-hashes agree in half of it; searching it costs little, splitting nothing gains.
        counts = materialize(
            walks.groupBy("node", "lead").agg(F.count("*").alias("n"))
            .groupBy("node").agg(F.sum("n").alias("n"), (F.max("n") * 2 >= F.sum("n")).alias("alike")).filter("n > 1"),
            "buckets",
        )
        leaf = F.lit(True) if level == DEPTH - 1 else (F.col("n") <= small) | F.col("alike")
        members = walks.join(counts.filter(leaf), "node")
        if level == 0:
            members = members.join(own.select("id", "sketch"), "id")
        blocked = _blocked(members.select("id", "sketch", "node", "n"), F.ceil(F.col("n") / BUCKET_BLOCK))
        found = _edges_of_buckets(blocked, ["node", "left", "right"], threshold - SLACK)
        edges = found if edges is None else edges.unionByName(found)
        if level == DEPTH - 1 or counts.filter(~leaf).isEmpty():
            break
        large = walks.join(counts.filter(~leaf).select("node"), "node", "left_semi")
        if level == 0:
            large = large.join(own.select("id", "sketch"), "id")
        walks = materialize(_split(large, threshold), "split-buckets")
    return components(edges)


def _linked(
    docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD, miss: float = MISS, small: int = SMALL, block: int = BLOCK,
) -> DataFrame:
    """One row per document: doc, id, mark, lead of its copies, lead of its linked documents, links."""
    signed = signatures(docs, key, text, runs_for(miss, threshold), threshold)
    signed = materialize(signed.withColumn("doc", F.monotonically_increasing_id()), "signatures")
    distinct = signed.groupBy("id", "mark").agg(F.min("doc").alias("doc"), F.min("set_key").alias("set_key"))
    members = materialize(_classes(distinct), "set-classes")
    reps = members.filter("doc = lead.doc AND set_key <> ''").select("doc", "id", "mark", "set_key", "copies", "lead")

    groups = candidate_groups(signed, reps, threshold, small)
    n_tokens = F.conv(F.substring("set_key", 33, 16), 16, 10).cast("long")  # a set's key ends with its size
    placed = reps.join(groups.withColumnRenamed("id", "doc"), "doc").withColumn("n_tokens", n_tokens)
    weights = placed.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    blocks = F.greatest(F.ceil(F.col("rows") / block), F.ceil(F.col("tokens") / BLOCK_TOKENS))
    wanted = placed.join(weights.select("component", blocks.alias("size")), "component").select(
        "doc", F.col("id").alias("wanted_id"), F.col("mark").alias("wanted_mark"), F.col("set_key").alias("wanted_key"), "copies",
        F.col("component").alias("group"), "size",
    )
    texts = docs.select(F.col(key).cast("long").alias("id"), _mark(text).alias("mark"), F.col(text).alias("body"))
    same = F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("mark") == F.col("wanted_mark"))
    texts = texts.join(wanted.hint("shuffle_hash"), same)
    checked = materialize(_verified(_blocked(_with_tokens(texts), F.col("size")), threshold), "verified-links")

    joined = components(checked.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    # A component is led like a class of copies: by its smallest id.
    joined = joined.withColumnRenamed("id", "doc").join(reps.select("doc", "lead"), "doc")
    heads = joined.groupBy("component").agg(F.min("lead").alias("head"))
    outcome = (
        checked.groupBy(F.col("id").alias("doc")).agg(F.sum("links").alias("links"), F.max("copies").alias("n"))
        .join(joined.select("doc", "component"), "doc", "left").join(heads, "component", "left")
        .select(F.col("doc").alias("rep"), "head", "links", _salts("n").alias("salt"))
    )
    found = members.withColumns({"salt": _salt("copies"), "rep": F.col("lead.doc")}).join(outcome, ["rep", "salt"], "left")
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    return found.select("doc", "id", "mark", "lead", F.coalesce("head", "lead").alias("head"), links.alias("links"))


def join_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: key, copy_id (smallest id with the same set), class_id (smallest id of the linked
    documents), n_links (documents with similarity at least ``threshold``, copies included, itself not).

    Options: ``threshold``, ``miss``, ``small`` and ``block``.
    """
    kind = docs.schema[key].dataType
    return _linked(docs, key, text, **options).select(
        F.col("id").cast(kind).alias(key), F.col("lead.id").alias("copy_id"), F.col("head.id").alias("class_id"),
        F.col("links").alias("n_links"),
    )


def _with_tokens(texts: DataFrame) -> DataFrame:
    """id (of the document in the join), tokens, copies, group, size of the rows whose set is the one that was signed."""
    rows = _words(texts, "doc", "body", "wanted_key", "copies", "group", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column(1), WORDS)
            same = pa.array([set_key(x) == k for x, k in zip(sets, batch.column(2).to_pylist())], pa.bool_())
            offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            tokens = (np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(tokens)), *batch.columns[3:]],
                names=["id", "tokens", "copies", "group", "size"],
            ).filter(same)

    return rows.mapInArrow(run, "id long, tokens array<long>, copies long, group long, size long")


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class, with all columns. Of texts that share
    that id one stays; rows that repeat its id and text stay with it."""
    kept = _linked(docs, key, text, **options).filter("doc = head.doc").select(F.col("id").alias("_kept_id"), F.col("mark").alias("_kept_mark"))
    same = F.col(key).cast("long").eqNullSafe(F.col("_kept_id")) & (_mark(text) == F.col("_kept_mark"))
    return docs.join(kept, same, "left_semi").select(*docs.columns)
