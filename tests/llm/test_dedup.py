"""Exact, near and substring duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from flowhunt.llm import chosen_path, exact_dedup, suffix_dedup
from flowhunt.llm.components import components

SCHEMA = "doc_id long, text string, digest string, salt string, keep_id string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "d", "s", "k") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def test_exact_groups(spark):
    rng = random.Random(1)
    texts = [rng.choice([None, "", "a", "b", "é" * 5000, "A", " a"]) for _ in range(300)] + ["hot"] * 400 + ["once"]
    got = {r.doc_id: r for r in exact_dedup.mark_copies(frame(spark, texts), salts=4).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    for i, t in enumerate(texts):
        g = groups[t or ""]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), i == max(g))
        assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    kept = exact_dedup.keep_one(frame(spark, texts), salts=4).collect()
    assert sorted(r.doc_id for r in kept) == sorted(max(g) for g in groups.values())
    assert all(r.text == texts[r.doc_id] and r.digest == "d" for r in kept)


def test_exact_repeated_rows_null_ids_and_empty(spark):
    docs = frame(spark, ["x", "x", "y", "y"], [5, 5, None, 2])
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark_copies(docs).collect())
    assert got == [("2", 2, 2, True), ("5", 5, 2, True), ("5", 5, 2, True), ("None", 2, 2, False)]
    assert exact_dedup.keep_one(docs).count() == 2
    none = frame(spark, [])
    assert exact_dedup.mark_copies(none).count() == exact_dedup.keep_one(none).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {x: find(x) for x in parent}
    assert len(got) == len(parent)


def near_texts(seed=3):
    rng = random.Random(seed)
    texts = [None, "", "one two", "one two", "One, TWO!", "three"]
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 160))]
        for _ in range(rng.choice([1, 1, 2, 9])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def brute_links(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    links = [[] for _ in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i].append(j)
    label = list(range(len(sets)))
    for _ in sets:
        for i, js in enumerate(links):
            label[i] = min([label[i], *(label[j] for j in js)])
    return links, label


@pytest.mark.parametrize("small, block, bucket", [(512, 1024, 4096), (3, 2, 2), (0, 3, 3)])
def test_jaccard_join(spark, small, block, bucket, monkeypatch):
    monkeypatch.setattr(chosen_path, "BUCKET_BLOCK", bucket)
    texts = near_texts()
    links, label = brute_links(texts)
    got = chosen_path.join_similar(frame(spark, texts), small=small, block=block, miss=1e-9).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: (label[i], len(links[i])) for i in range(len(texts))}
    assert len(got) == len(texts)


def test_jaccard_join_keeps_one_and_takes_empty(spark):
    texts = near_texts(4)
    _, label = brute_links(texts)
    kept = chosen_path.keep_one_of_each(frame(spark, texts))
    assert kept.columns == ["doc_id", "text", "digest", "salt", "keep_id"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    assert chosen_path.join_similar(frame(spark, [])).count() == 0


def test_jaccard_join_with_null_and_repeated_ids(spark):
    rng = random.Random(12)
    words = [[f"w{rng.randrange(5000)}" for _ in range(60)] for _ in range(5)]
    base = [" ".join(w) for w in words]
    near = [" ".join([*w[:-1], "other"]) for w in words]
    rows = [
        (5, base[0]), (5, base[1]), (6, base[1]),  # one id, two texts: the second is that of id 6
        (None, base[2]), (9, near[2]), (None, "alone and without any other document"), (None, None),
        (None, base[3]), (None, near[3]), (7, base[4]), (7, base[4]), (8, near[4]), (7, base[4].upper()),
    ]
    docs = spark.createDataFrame([(i, t, "d", "s", "k") for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.copy_id, r.class_id, r.n_links) for r in chosen_path.join_similar(docs, miss=1e-9).collect()), key=repr)
    want = [
        (5, 5, 5, 0), (5, 5, 5, 1), (6, 5, 5, 1), (None, None, 9, 1), (9, 9, 9, 1), (None, None, None, 0), (None, None, None, 0),
        (None, None, None, 1), (None, None, None, 1), (7, 7, 7, 2), (8, 8, 7, 2), (7, 7, 7, 2),
    ]
    assert got == sorted(want, key=repr)
    kept = [(r.doc_id, r.text) for r in chosen_path.keep_one_of_each(docs, miss=1e-9).collect()]
    assert sum(i is None for i, _ in kept) == 3 and (9, near[2]) in kept and (6, base[1]) not in kept
    assert (5, base[0]) in kept and (5, base[1]) in kept
    # Rows that repeat id and text stay together; of the texts of one id in a class one stays.
    assert [t.lower() for i, t in kept if i == 7] in ([base[4]], [base[4]] * 2) and len({t for i, t in kept if i == 7}) == 1
    assert len([t for t in kept if t[1] in (base[3], near[3])]) == 1


def test_branches_meet_for_similar_sets():
    rng = np.random.default_rng(0)
    runs = chosen_path.runs_for(1e-3)
    first = below = 0
    for _ in range(300):
        both = rng.integers(0, 2**63, 80).astype(np.uint64)
        a, b = (np.unique(np.r_[both, rng.integers(0, 2**63, 10).astype(np.uint64)]) for _ in range(2))
        na, nb = (chosen_path.first_branches(x, runs) for x in (a, b))
        first += bool(set(na.tolist()) & set(nb.tolist()))
        nodes = rng.integers(0, 2**63, runs).astype(np.uint64)
        ca, cb = (np.tile(chosen_path.sketch(x), (runs, 1)) for x in (a, b))
        ra, rb = (chosen_path.next_branches(nodes, c)[1].tolist() for c in (ca, cb))
        below += bool(set(ra) & set(rb))
    assert first >= 298 and below >= 298


def test_runs_reach_the_last_level():
    rng = np.random.default_rng(3)
    runs = chosen_path.runs_for()
    missed = 0
    for _ in range(3000):
        a = rng.integers(0, 2**63, 150).astype(np.uint64)
        b = a[:120]  # similarity 0.8 by containment
        codes = [chosen_path.sketch(x)[None, :] for x in (a, b)]
        nodes = np.intersect1d(*(chosen_path.first_branches(x, runs) for x in (a, b)))
        for _ in range(chosen_path.DEPTH - 1):
            below = [chosen_path.next_branches(nodes, np.repeat(c, len(nodes), axis=0))[1] for c in codes]
            nodes = np.intersect1d(*below)
        missed += not nodes.size
    assert missed == 0


def test_jaccard_join_over_split_buckets(spark, monkeypatch):
    rng = random.Random(11)
    passages = [[f"p{i}w{j}" for j in range(12)] for i in range(20)]
    texts = []
    for _ in range(600):  # each passage stands in about 600 of 1200 documents
        words = sum((passages[i] for i in sorted(rng.sample(range(20), 10))), [])
        texts += [" ".join(words), " ".join(words[: int(len(words) * 0.81)])]
    sets = [np.unique(list(map(hash, s))) for s in ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts))]
    held = np.zeros((len(texts), len(tokens := np.unique(np.concatenate(sets)))), np.float32)
    for i, x in enumerate(sets):
        held[i, np.searchsorted(tokens, x)] = 1
    both, sizes = held @ held.T, held.sum(axis=1)
    close = both >= 0.8 * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    np.fill_diagonal(close, False)
    split = []
    monkeypatch.setattr(chosen_path, "_split", lambda m, t, f=chosen_path._split: split.append(m.count()) or f(m, t))
    got = {r.doc_id: r.n_links for r in chosen_path.join_similar(frame(spark, texts)).collect()}
    assert split and split[0] > chosen_path.SMALL
    assert got == {i: int(n) for i, n in enumerate(close.sum(axis=1))}


def test_spread_equals_components_of_all_pairs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 200):
        close = rng.random((n, n)) < 0.6 / n
        close |= close.T
        root = chosen_path.spread(n, lambda rows, others: close[np.ix_(rows, others)].any(axis=0))
        label = np.arange(n)
        for _ in range(n):
            for i in range(n):
                label[i] = min([label[i], *label[close[i]]])
        assert root.tolist() == label.tolist()


def brute_cut(ids, texts):
    first = {}
    for i, t in zip(ids, texts):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in zip(ids, texts):
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [10**9, 3000])
def test_suffix_dedup(spark, shard_bytes):
    rng = random.Random(6)

    def prose(n):
        return "".join(rng.choice("abé d\n\0") for _ in range(n))

    passages = [prose(rng.randint(45, 200)) for _ in range(6)] + ["ab" * 60, "a" * 130]
    texts = [None, "", "short", "x" * 49, "x" * 50, "x" * 51, "\0" * 60, "\0" * 70]
    for _ in range(50):
        texts.append("".join(rng.choice(passages) if rng.random() < 0.5 else prose(rng.randint(0, 90)) for _ in range(6)))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids += [ids[9], ids[10]]  # repeated rows
    texts += [texts[9], texts[10]]
    got = suffix_dedup.remove_repeats(frame(spark, texts, ids), shard_bytes=shard_bytes).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_cut(ids, texts)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [3, 20_000])
def test_hot_anchors_are_split(spark, monkeypatch, hot):
    """One 40-byte string in different contexts: its runs do not meet in one suffix shard."""
    rng = random.Random(9)
    common = "https://a.very.common.prefix.example/path"
    texts = ["".join(rng.choice("abcdefgh") for _ in range(60)) + common + "".join(rng.choice("ijklmnop") for _ in range(60)) for _ in range(300)]
    texts += texts[:20] + [common * 3] * 5 + [texts[40][30:130]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = suffix_dedup.remove_repeats(frame(spark, texts, ids), shard_bytes=4000, hot=hot).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_cut(ids, texts)
    # The largest suffix shard of the runs one shard would send to 64 of them.
    table = pa.table({"id": pa.array(ids, pa.int64()), "body": pa.array([t.encode() for t in texts], pa.binary()), "shard": pa.array([0] * len(ids), pa.int64())})
    anchors = suffix_dedup._anchors(64)(table)
    merged = [suffix_dedup._shared(hot)(anchors.filter(pa.compute.equal(anchors.column("bucket"), b))) for b in set(anchors.column("bucket").to_pylist())]
    sent = suffix_dedup._send(64)(table, pa.concat_tables(merged))
    largest = max(len(c) for c in sent.column("counts").to_pylist())
    total = sum(len(c) for c in sent.column("counts").to_pylist())
    assert (largest < 300 and largest < total / 16) if hot == 3 else largest >= 300


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "digests", lambda rows: np.zeros(len(rows), np.uint64))
    rows = np.random.default_rng(1).integers(0, 2, (50, 8)).astype(np.uint8)
    kept, which = suffix_dedup.distinct_rows(rows)
    assert np.array_equal(rows[kept[which]], rows) and len(kept) == len({bytes(r) for r in rows})


@pytest.mark.parametrize("letters, n", [("ab", 300), ("a", 90), ("abcdefgh\0", 500), ("\0", 40), ("a", 1), ("a", 0)])
def test_suffix_array_and_common_prefixes(letters, n):
    rng = random.Random(7)
    text = "".join(rng.choice(letters) for _ in range(n)).encode()
    codes = np.frombuffer(text, np.uint8)
    order = suffix_dedup.suffix_array(codes)
    assert order.tolist() == sorted(range(n), key=lambda i: text[i:])
    starts = np.array(sorted({0, *(rng.randrange(n) for _ in range(5))}) if n else [], np.int64)
    got = suffix_dedup.common_prefixes(codes, order, starts, 20) if n else np.zeros(0)
    for slot in range(1, n):
        a, b = text[order[slot] :], text[order[slot - 1] :]
        common = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert got[slot] == min(20, common)


def test_suffix_array_stops_at_enough_bytes(monkeypatch):
    """Long repeats cost no more than ``enough`` bytes: suffixes that share them are side by side, in few sorts."""
    rng = random.Random(10)
    passage = "".join(rng.choice("ab\0") for _ in range(3000))
    text = (passage + "x" + passage + "y" + "a" * 500 + "\0" * 60).encode()
    codes, sorts, sort = np.frombuffer(text, np.uint8), [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(len(a[0])) or sort(*a, **k))
    order = suffix_dedup.suffix_array(codes, 50)
    assert len([n for n in sorts if n > 100]) <= 4  # by 8 bytes, then by 16, 32 and 64
    heads = [text[i : i + 50] for i in order]
    assert sorted(order.tolist()) == list(range(len(text))) and heads == sorted(heads)
    common = suffix_dedup.common_prefixes(codes, order, np.zeros(1, np.int64), 50)
    assert [k == 50 for k in common[1:]] == [len(a) == 50 and a == b for a, b in zip(heads, heads[1:])]


def test_runs_do_not_depend_on_the_order_of_ties(monkeypatch):
    """The steps that send and cut may run on processors that sort ties differently; their runs must agree."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abc") for _ in range(9)) for _ in range(30)]
    texts = ["".join(rng.choice(words) for _ in range(30)).encode() for _ in range(60)]
    texts += texts[:20]
    table = pa.table({"id": pa.array(range(len(texts)), pa.int64()), "body": pa.array(texts, pa.binary()), "shard": pa.array([0] * len(texts), pa.int64())})
    anchors = suffix_dedup._anchors(4)(table)
    masks = suffix_dedup._masks(pa.concat_tables(
        suffix_dedup._shared(50)(anchors.filter(pa.compute.equal(anchors.column("bucket"), b))) for b in range(4)
    ))
    here, sort = suffix_dedup._Shard(table).runs(masks, 4), np.argsort

    def other(keys, kind=None, **k):
        return sort(keys, kind=kind, **k) if kind == "stable" else len(keys) - 1 - sort(keys[::-1], kind="stable", **k)

    monkeypatch.setattr(np, "argsort", other)
    there = suffix_dedup._Shard(table).runs(masks, 4)
    assert len(here[0]) > 100 and all(np.array_equal(x, y) for x, y in zip(here, there))


def test_runs_cover_every_string_once():
    rng = np.random.default_rng(8)
    codes = rng.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([10, 60, 60, 3000, 5000])
    expected = [p for s, e in zip([0, 10, 60, 60, 3000], ends) for p in range(s, e - 49)]
    for block in (64, 10**6):
        first, count, _ = suffix_dedup.anchored_runs(codes, ends, block=block)
        assert [p for f, c in zip(first, count) for p in range(f, f + c)] == expected
