"""Resampling, packing and hard negatives against plain brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from flowhunt.llm import hard_negatives, importance, packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, id string, row string, score string, rank int, length int, key string, weight string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "i", "r", "s", 1, 2, "k", "w") for i, t in rows], DOCS)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "Straße", "日本語", "x1", "É" * 40, "long" * 50, "z" * 5000, "q", "ÀB"]
    rows = [(i, rng.choice([" ", ", ", "\n", "\0", "--"]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "\0\0"), (3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, None)]


def plain_features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_importance(rows, target):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % 10000

    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for counts, table in ((s, rows), (t, target)):
        for _, text in table:
            for f in plain_features(text)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (int(s.sum()) + 10000) / ((int(s[b]) + 1) * (int(t.sum()) + 10000)))) for b in range(10000)]
    out = []
    for key, text in rows:
        words, features = plain_features(text)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    for r in out:
        r.append(None)
    for place, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[5] = place
    return sorted(map(tuple, out), key=repr)


def test_importance_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(importance, "JOINED_BYTES", 3000)
    rows, target = texts(1, 300), texts(2, 40)
    docs = documents(spark, rows).repartition(3)
    got = importance.importance(docs, documents(spark, target))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_importance(rows, target)
    drawn = importance.resample(docs, documents(spark, target))
    assert drawn.columns == docs.columns
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r[0] for r in plain_importance(rows, target) if r[5])


def test_importance_of_little(spark):
    none = documents(spark, [])
    assert importance.importance(none, none).count() == 0
    alike = documents(spark, [(7, "same words here " * 10)] * 60)
    ranks = [r.rank for r in importance.importance(alike, none).collect()]
    assert sorted(r for r in ranks if r) == [1, 2, 3]


def test_checksums_of_appended_words():
    append, rng = importance._Append(), random.Random(3)
    pairs = [(rng.randbytes(rng.randint(1, 9)), rng.randbytes(rng.choice([1, 5, 63, 64, 65, 130, 5000, 100_000]))) for _ in range(200)]
    head, tail = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    got = append(head, tail, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b" " + b) for a, b in pairs]


def test_ids_equal_the_library():
    library, ids = tokenizers.Tokenizer.from_file(JSON), packing.TextIds(JSON, RANKS, public_tokenizers.PATTERN)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    runs = ["".join(f"a{c} 1{c}{c}." for c in points[i : i + 400]) for i in range(0, len(points), 400)]
    special = ["<|endoftext|>", "x <|endoftext|> y <|endoftext|", "", "  a\n\n b\t", "a" * 20_000, "don't I'LL 3.14 " * 2000, " " * 5000]
    wanted = library.encode_batch_fast(runs + special, add_special_tokens=False)
    assert [ids(t) for t in runs + special] == [w.ids for w in wanted]


@pytest.mark.parametrize("group", [20_000, 60])
def test_packing_is_whole_and_gapless(spark, group):
    library, rng = tokenizers.Tokenizer.from_file(JSON), random.Random(5)
    rows = [(i, " ".join(rng.choice(["one", "two", "antidisestablishment", "7"]) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "w " * 1000), (303, "a b c d" * 16), (304, "<|endoftext|>"), (5, rows[5][1]), (None, "no id"), (None, None)]
    capacity = 64
    pieces = packing.token_pieces(documents(spark, rows).repartition(4), JSON, RANKS, public_tokenizers.PATTERN, capacity=capacity)
    packed = packing.pack(pieces.withColumn("sequence", F.lit("x")).withColumn("closed", F.lit(1)), capacity=capacity, group=group)
    assert packed.columns == [*pieces.columns, "sequence", "closed", "sequence_id", "offset"]
    got = packed.collect()
    docs = {}
    for r in got:
        assert r.length == len(r.ids) // 4 and 1 <= r.length <= capacity
        if r.doc_id not in (5, None):
            docs.setdefault(r.doc_id, []).append(r)
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows if i not in (5, None)}
    assert docs.keys() == want.keys()
    for i, found in docs.items():
        found.sort(key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found)))
        assert [r.start for r in found] == np.cumsum([0] + [r.length for r in found[:-1]]).tolist()
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in found]).tolist() == want[i]
        assert all(r.length == capacity for r in found[1:]) and len(found) == -(-len(want[i]) // capacity)
    assert sum(r.doc_id == 5 for r in got) == 2 * -(-len(library.encode(rows[5][1]).ids + [0]) // capacity) and sum(r.doc_id is None for r in got) == 2
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0] + [n for _, n in b[:-1]]).tolist() and sum(n for _, n in b) <= capacity
    least = packing.least_bins(np.array([r.length for r in got]), capacity)
    assert len(bins) <= least * (1.02 if group > 1000 else 1.06) + 1
    nothing = packing.pack(packing.token_pieces(documents(spark, []), JSON))
    assert nothing.count() == 0
    with pytest.raises(Exception, match="lengths lie in"):
        packing.pack(spark.createDataFrame([(70,)], "length long"), capacity=capacity).count()


def plain_least(sizes, capacity):
    """Fewest bins by trying everything."""
    best = len(sizes)

    def place(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(sizes):
            best = len(fills)
            return
        for k in range(len(fills)):
            if fills[k] + sizes[i] <= capacity:
                place(i + 1, [*fills[:k], fills[k] + sizes[i], *fills[k + 1 :]])
        place(i + 1, [*fills, sizes[i]])

    place(0, [])
    return best


def test_local_search():
    rng, gained = np.random.default_rng(7), 0
    for _ in range(60):
        sizes = rng.integers(1, 40, rng.integers(0, 9))
        bins = packing.pack_group(sizes, 40)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sizes[b].sum() <= 40 for b in bins)
        assert packing.least_bins(sizes, 40) <= plain_least(sizes.tolist(), 40) <= len(bins)
    for low, high in ((500, 1000), (300, 1400), (600, 720)):
        sizes = rng.integers(low, high, 1500)
        first = packing.best_fit(sizes.tolist(), 2048)
        search = packing._Search([list(b) for b in first], sizes, 2048)
        seen = [sum(f * f for f in search.fill)]
        step = search._step

        def watched(donor):
            done = step(donor)
            seen.append(sum(f * f for f in search.fill))
            assert not done or seen[-1] > seen[-2]
            return done

        search._step = watched
        bins = search.run(packing.least_bins(sizes, 2048))
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sizes[b].sum() <= 2048 for b in bins)
        assert len(bins) <= len(first)
        gained += len(first) - len(bins)
    assert gained > 20


def plain_negatives(rows):
    usable = set()
    for key, vec, label in rows:
        if key is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if key % 7 == 0 else label
        usable.add((key, label, tuple(math.floor(256 * x) for x in vec)))
    out = []
    for a, a_label, x in usable:
        if a % 100:
            continue
        scored = [(-sum(map(int.__mul__, x, y)), k, label) for k, label, y in usable if k != a]
        for p, pk, _ in sorted(s for s in scored if s[2] == a_label)[:5]:
            fits = sorted(s for s in scored if s[2] != a_label and 30 * -p <= 100 * -s[0] <= 90 * -p)
            out += [(a, pk, r, nk, -p, -n) for r, (n, nk, _) in enumerate(fits[:10], 1)]
    return sorted(out)


def vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        vec = [float(np.float32(v)) for v in rng.normal(0, 0.2, dims) + (0.3 if i % 3 == 0 else 0.0) * (np.arange(dims) < 5)]
        rows.append((i, vec, int(rng.integers(0, 10))))
    hot = rows[1][1]
    rows += [(n + i, hot, i % 3) for i in range(n // 3)]  # ties
    rows += [(None, hot, 1), (2 * n, None, 1), (2 * n + 1, hot, None), (2 * n + 2, [None] * dims, 1), (2 * n + 3, [float("nan")] * dims, 2)]
    rows += [(2 * n + 4, [float("inf")] * dims, 2), (2 * n + 5, [0.0] * dims, 3), rows[0], rows[0], (100, [0.0] * dims, 4)]
    return rows


@pytest.mark.parametrize(("dims", "sample", "block"), [(24, 50, 3), (7, 2000, 8192), (40, 1, 8192)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, dims, sample, block):
    monkeypatch.setattr(hard_negatives, "SHARD", 64)
    rows = vectors(dims, 450, dims)
    schema = "vec_id long, embedding array<float>, label int, id string, win string, score string, mark string"
    table = spark.createDataFrame([(*r, "i", "w", "s", "m") for r in rows], schema).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(table, F.col("id") % 100 == 0, label=label, sample=sample, block=block)
    # Anchor 100 stands for two vectors here, so its rows are compared as a multiset.
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_hard_negatives_of_little(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, [1.0], 1), (1, [1.0], 1)], [(100, [], 1), (1, [], 1), (2, [], 2)]):
        got = hard_negatives.hard_negatives(spark.createDataFrame(rows, schema), F.col("id") % 100 == 0)
        assert sorted(map(tuple, got.collect())) == plain_negatives([(k, v, label) for k, v, label in rows])


def test_pruned_scores_are_whole():
    rng = np.random.default_rng(11)
    x, y = rng.integers(-90, 90, (30, 50)).astype(float), rng.integers(-60, 60, (500, 50)).astype(float)
    x[3], y[5] = 0, 0
    scale = np.sort(rng.random(50)) ** 3
    x, y = np.floor(x * scale), np.floor(y * scale)
    allowed = rng.random((30, 500)) < 0.8
    scores = x @ y.T
    for low in (np.full(30, -np.inf), np.quantile(scores, 0.9, axis=1), np.quantile(scores, 0.999, axis=1), np.zeros(30), scores.max(axis=1)):
        a, b, s = hard_negatives.live_pairs(x, low, y, allowed)
        assert set(zip(a, b)) == set(zip(*np.nonzero(allowed & (scores >= low[:, None])))) and (s == scores[a, b]).all()
