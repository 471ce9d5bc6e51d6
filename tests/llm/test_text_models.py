"""Language, toxicity, pieces, token counts and decontamination on small fixtures."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from flowhunt.llm import decontaminate, language_id, piece_coding, token_counts, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, score string, id string"
EN = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split()
SPECIAL = [None, "", " ", "  two  spaces ", "12 345", "\n\t", "▁mark", "😀 日本語 \0 é", "<s> </s> <0x41>", "a" * 3000, "word " * 3000]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "x") for i, t, lang in rows], SCHEMA)


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, (EN, DE)[i % 2], 40), ("en", "de")[i % 2]) for i in range(200)]
    train = frame(spark, rows)
    usable = language_id.labelled(train)
    assert 0 < usable.count() < 200 and usable.filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).count() == 0
    model = language_id.fit_dictionaries(usable)
    assert sorted(model) == ["de", "en"]
    tests = [(1, prose(rng, EN, 30), None), (2, prose(rng, DE, 30).upper(), None), (3, prose(rng, DE, 9000), None)]
    tests += [(10 + i, t, None) for i, t in enumerate(SPECIAL)]
    docs = frame(spark, tests)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["en", "de", "de"]
    for i, t in enumerate(SPECIAL):
        letters = any(c.isalpha() for c in t or "")
        assert (got[10 + i].lang_pred == "und") == (not letters) and 0 <= got[10 + i].score <= 1
        assert letters or got[10 + i].rejected
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.rejected}
    none = frame(spark, [])
    assert language_id.fit_dictionaries(none) == {} and language_id.identify(none, {}).count() == 0
    assert language_id.identify(docs, {}).filter("lang_pred <> 'und'").count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_close_terms_are_those_within_the_distance(distance):
    rng = random.Random(2)
    terms = ["abcab", "bcabc", "abcabc", "aab"]
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(400)} | set(terms))
    got = toxicity.close_terms(words, toxicity.build_trie(terms), distance)
    for w in words:
        near = [
            (d, t) for t in terms
            if (d := edits(w, t)) <= (distance if len(t) >= toxicity.SHORTEST_FUZZY else 0)
        ]
        assert got.get(w) == ((min(near)[1], min(near)[0]) if near else None)
    assert toxicity.close_terms([], toxicity.build_trie(terms)) == {}
    assert toxicity.close_terms(words, toxicity.build_trie([])) == {}


def test_toxicity(spark):
    rng = random.Random(3)
    bad = ["idiotface", "scumbag"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(EN) for _ in range(30)]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(30), rng.choice(bad))
        rows.append((i, " ".join(words), None))
        labels.append((i, int(i % 4 == 0)))
    docs, table = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, table)
    terms = toxicity.learn_lexicon(sample)
    assert terms == sorted(bad)
    weights = toxicity.fit(sample, terms)
    tests = [(1, "you are an idiotfase and an idotface", None), (2, "the cat sat", None), (3, "you idiotface", None)]
    tests += [(10 + i, t, None) for i, t in enumerate(SPECIAL)]
    got = {r.doc_id: r for r in toxicity.score(frame(spark, tests), terms, weights).collect()}
    assert got[1].n_misspelled == 2 and (got[2].predicted, got[3].predicted) == (0, 1)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    scored = toxicity.score(docs, terms, weights).join(table, "doc_id")
    assert scored.filter("predicted <> toxic").count() == 0
    assert toxicity.learn_lexicon(sample.limit(0)) == [] and toxicity.score(docs.limit(0), [], weights).count() == 0
    assert len({r.score for r in toxicity.score(docs.limit(3), [], toxicity.fit(sample.limit(0), [])).collect()}) == 1


def test_quotation_windows():
    assert toxicity.is_quoted('he "scum" went', 4, 8) and toxicity.is_quoted("the word scum is", 9, 13)
    assert not toxicity.is_quoted('"a" scum "b"', 4, 8) and not toxicity.is_quoted("you scum", 4, 8)


def best_score(coder, text):
    """Plain Viterbi over the marked text."""
    scores = {p.piece: p.score for p in proto().pieces if p.type == 1}
    marked = ("▁" + text.replace(" ", "▁")) if text else ""
    best = [0.0] + [-np.inf] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - coder.longest), end):
            s = scores.get(marked[start:end], coder.unknown_score if end == start + 1 else None)
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


def proto():
    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    return model


def test_pieces_are_the_best_segmentation_and_round_trip():
    rng = random.Random(4)
    coder = piece_coding.PieceCoder(MODEL)
    scores = [p.score for p in proto().pieces]
    texts = [t or "" for t in SPECIAL[:9]] + [
        "".join(rng.choice("thean or.é\n日") for _ in range(rng.randint(1, 40))) for _ in range(200)
    ]
    for text, ids in zip(texts, coder.encode(texts)):
        assert coder.decode(ids) == text.replace("▁", " ")
        spelled = np.array([not coder.is_byte[i] for i in ids], bool)
        unknown = sum(c not in known_characters() for c in ("▁" + text.replace(" ", "▁") if text else ""))
        assert sum(scores[i] for i in ids[spelled]) + unknown * coder.unknown_score == pytest.approx(best_score(coder, text))
    with pytest.raises(ValueError):
        coder.decode(np.array([32_000]))


def known_characters():
    if not hasattr(known_characters, "found"):
        known_characters.found = {p.piece for p in proto().pieces if p.type == 1 and len(p.piece) == 1}
    return known_characters.found


def test_piece_table(spark):
    docs = frame(spark, [(i, t, None) for i, t in enumerate(SPECIAL)] + [(3, SPECIAL[3], None)])
    got = piece_coding.encode_documents(docs, MODEL).collect()
    assert len(got) == len(SPECIAL) + 1
    for r in got:
        assert r.round_trip and len(r.ids) == r.n_pieces
    assert piece_coding.encode_documents(frame(spark, []), MODEL).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(64, 8), (200, 32), (32_768, 256)])
def test_chunked_encoding_equals_the_library(chunk, overlap):
    rng = random.Random(5)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    coder = token_counts.ChunkedEncoder(MODEL, chunk, overlap)
    assert coder.stable
    texts = [t or "" for t in SPECIAL] + ["x" * 700, " " * 700, "é" * 300 + " " + "日本" * 300, "▁" * 100 + "a b" * 100]
    for _ in range(60):
        texts.append("".join(rng.choice(["the ", "erin", " ", "\n", "é", "😀", "ation", ", "]) for _ in range(rng.randint(0, 400))))
    for t in texts:
        assert coder.encode(t).tolist() == sp.encode(t)
    assert coder.counts(texts) == [len(sp.encode(t)) for t in texts]
    coder.stable = False  # without the proof whole texts are encoded
    assert coder.encode(texts[-1]).tolist() == sp.encode(texts[-1])


def test_token_count_table(spark):
    docs = frame(spark, [(i, t, None) for i, t in enumerate(SPECIAL)] * 2)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.token_counts(docs, MODEL, limit=1000).collect()
    assert len(got) == 2 * len(SPECIAL)
    for r in got:
        t = SPECIAL[r.doc_id] or ""
        n = len(sp.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1000)
    assert token_counts.token_counts(frame(spark, []), MODEL).count() == 0


QUESTION = "A train leaves Berlin at 7 and travels 120 km at a constant speed to reach Hamburg in 3 hours today."
OTHER = "The shop sold 14 apples and 9 pears to Anna before noon, and each apple cost 2 euros in that week."


@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
def test_decontamination(spark, bits, monkeypatch):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    monkeypatch.setattr(decontaminate, "BITS_EACH", 64 if bits > 1 << 15 else 1)
    swapped = QUESTION.replace("7", "9").replace("120 km", "300 miles").replace("Hamburg", "Dresden").replace("Berlin", "Munich")
    mixed = OTHER.replace("14", "5").replace("9 pears", "5 pears")  # two values became one
    texts = [
        None, "", QUESTION, f"Intro words here. {swapped} More words.", mixed, "A train leaves. Nothing else of it.",
        OTHER.upper(), " ".join(f"plain{i}" for i in range(3000)), "1 2 3 4 5 6 7 8 9 10 11 12", "What is the capital of France",
    ]
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)] + [(2, QUESTION, None)])
    items = spark.createDataFrame(
        [(1, QUESTION, "x"), (2, OTHER, "x"), (3, None, "x"), (4, "two words", "x"), (5, "What is the capital of France?", "x"), (1, QUESTION, "y")],
        "item_id long, text string, body string",
    )
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, items).collect()}
    assert set(got) == {(2, 1), (3, 1), (9, 5)} | ({(6, 2)} & set(got))
    assert got[2, 1].verbatim and not got[3, 1].verbatim and got[3, 1].n_slots >= 4
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert {0, 1, 4, 5, 7, 8} <= {r.doc_id for r in kept.collect()} <= set(range(10)) - {2, 3, 9}
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_a_slot_clash_takes_no_other_window_away(spark, tmp_path):
    import corpus_pipeline
    from flowhunt.llm.queries import QUERIES

    item = "Each morning the baker puts 3 loaves and 3 rolls on the long wooden table near the old door for 4 guests."
    texts = [
        OTHER.replace("14", "5").replace("9 pears", "5 pears"),  # two values became one; the tail is a copy
        item.replace("3 loaves", "6 loaves").replace("3 rolls", "8 rolls"),  # one value became two
        "Then we saw how she puts 5 loaves and 6 rolls on the floor of the hall.",  # the clash is inside the only window
    ]
    frame(spark, [(i, t, None) for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(1, OTHER), (2, item), (3, "puts 3 loaves and 3 rolls on the")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.verbatim for r in QUERIES["op3_decontaminate"](spark, str(tmp_path)).collect()}
    assert got[0, 1] is not None and got[1, 2] is not None
    assert set(got) == {(0, 1), (1, 2)}
    kept = corpus_pipeline.drop_leaks(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert [r.doc_id for r in kept.collect()] == [2]


@pytest.mark.parametrize("per_window", [False, True])
def test_short_items_and_windows_of_slots_match_exactly(spark, per_window):
    items = ["What is 12 plus 30?", "Compute 3 + 5 * 7 - 2", "Name two primes", "Quokka", "In Rome with Anna Bob 1 2 3 4 5 6 7 8 9", "", "?!"]
    texts = [
        "First: what is 12 plus 30? Then more.", "What is 12 plus 31?", "compute 3 5 7 2", "Compute 3 + 5 * 7 - 4", "please name two primes now",
        "name two numbers", "the Quokka sleeps", "quokkas sleep", "so 1 2 3 4 5 6 7 8 9 it goes", "so 1 2 3 4 5 6 7 9 8 it goes", "", None,
    ]
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.leaks(docs, benchmark, per_window=per_window).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 0), (2, 1), (4, 2), (6, 3), (8, 4)} and all(r.verbatim for r in got)


def plain_leaks(docs, items, window=8, shortest=5):
    """All pairs of windows, without hashes, filters or joins."""
    known = {}
    for item, text in items:
        tokens, values = decontaminate.template(text or "")
        plain = [values.get(i, t) for i, t in enumerate(tokens)]
        size = min(window, len(tokens))
        for at in range(len(tokens) - size + 1) if tokens else ():
            part = tokens[at : at + size]
            exact = size < shortest or sum(t[0] != "<" for t in part) < decontaminate.LEAST_WORDS
            body = tuple(plain[at : at + size] if exact else part)
            known.setdefault((exact, size, body), set()).add((item, at, tuple(values.get(at + j, "-") for j in range(size))))
    matches = {}
    for doc, text in docs:
        tokens, values = decontaminate.template(text or "")
        plain = [values.get(i, t) for i, t in enumerate(tokens)]
        for size in range(1, window + 1):
            for at in range(len(tokens) - size + 1):
                for exact, words in ((False, tokens), (True, plain)):
                    body = tuple(words[at : at + size])
                    for item, item_at, was in known.get((exact, size, body), ()):
                        kinds = ("=" + body[0], *body[1:]) if exact else body
                        now = body if exact else [values.get(at + j, "-") for j in range(size)]
                        slots = {(k, w, n) for k, w, n in zip(kinds, was, now) if w != "-"}
                        matches.setdefault((doc, text or "", item, at - item_at), {}).setdefault(item_at, []).append(slots)
    out = {}
    for (doc, text, item, _), windows in matches.items():
        flat = [(at, slots) for at, found in windows.items() for slots in found]
        sure = [(at, s) for at, s in flat if all(w == n for _, w, n in s)]
        rest = [(at, s) for at, s in flat if (at, s) not in sure]
        votes = {}
        for at, s in rest:
            for k, w, n in s:
                votes.setdefault((k, w), {}).setdefault(n, set()).add(at)
        chosen = {o: max(v, key=lambda n: (len(v[n]), n)) for o, v in votes.items()}
        good = sure + [(at, s) for at, s in rest if all(chosen[k, w] == n for k, w, n in s)]
        if good:
            pairs = {(w, n) for _, s in good for _, w, n in s}
            a, b, c = out.get((doc, text, item), (0, 0, False))
            out[doc, text, item] = (max(a, len({at for at, _ in good})), max(b, len(pairs)), c or all(w == n for w, n in pairs))
    return sorted((doc, item, *found) for (doc, _, item), found in out.items())


def test_leaks_equal_all_pairs(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    rng = random.Random(2)
    given = [(r.item_id, r.text) for r in items.collect()]
    edited = []
    for k, (_, text) in enumerate(given):  # questions with other numbers, some of them contradicting themselves
        words = [str(rng.randint(2, 9)) if w.isdigit() and rng.random() < 0.7 else w for w in text.split()]
        edited.append((10**6 + k, " ".join(["Before", *words, "after"])))
    edited += [(10**7, "if you buy 7 pens and then pay 9 coins for all of them now you have none"), (10**7 + 1, None), (10**7 + 2, "")]
    given += [(10**5, "if you buy 3 pens and then pay 3 coins for all of them now you have none"), (10**5 + 1, "3 plus 4 is 7"), (10**5 + 2, None)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + edited
    got = decontaminate.leaks(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(given, "item_id long, text string"), per_window=True
    )
    found = sorted((r.doc_id, r.item_id, r.n_windows, r.n_slots, r.verbatim) for r in got.collect())
    assert found == plain_leaks(rows, given)
    # Two values for one original: the windows that hold only the one most of them name.
    windows = {(d, i): n for d, i, n, *_ in found}
    assert windows[10**7, 10**5] == 7  # five with the second value, two without any


def unbroken(kind, n):
    rng = random.Random(n)
    letters = {"base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "same": "a", "mixed": "aab日é😀q0"}[kind]
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("kind, n", [("base64", 1_000_000), ("same", 100_000), ("mixed", 300_000)])
def test_texts_without_spaces(kind, n):
    """Whole texts without a space: counts equal the library's, pieces the best segmentation, in time that grows with the length."""
    text = unbroken(kind, n)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert token_counts.ChunkedEncoder(MODEL).counts([text]) == [len(library.encode(text))]
    coder = piece_coding.PieceCoder(MODEL)
    ids = coder.encode([text])[0]
    assert coder.decode(ids) == text
    # The cuts and the search by position change nothing: words that advance together give the same pieces.
    short = unbroken(kind, 700)
    cut = coder.encode([short])[0].tolist()
    codes = np.frombuffer(("▁" + short).encode("utf-32-le"), np.uint32)
    together = coder._equal_length(codes[None, :])[0]
    scores = np.array([p.score for p in proto().pieces])
    spelled = [~coder.is_byte[np.array(x)] for x in (cut, together)]
    assert scores[np.array(cut)[spelled[0]]].sum() == pytest.approx(scores[np.array(together)[spelled[1]]].sum())
    assert coder._alone(codes)[0].tolist() == together.tolist()
