"""The pipeline against its stages written in plain Python, and the catalogue's contract."""

import os
import re

import pandas as pd
import pytest
import sentencepiece  # noqa: F401  the package's tests need it as the operators do

import corpus_pipeline
from flowhunt.llm import decontaminate, language_id, piece_coding
from flowhunt.llm.queries import ORACLE, PIECE_MODEL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def shingle_set(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def test_run_equals_plain_python(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    model = language_id.Classifier(language_id.fit_dictionaries(language_id.labelled(docs)))
    kept = [r for r in docs.collect() if not model.judge(r.text)[2]]
    by_text = {}
    for r in kept:
        by_text[r.text] = max(by_text.get(r.text, -1), r.doc_id)
    texts = {i: t for t, i in by_text.items()}

    sets = {i: shingle_set(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    for _ in texts:
        before = dict(label)
        for i, a in sets.items():
            for j, b in sets.items():
                if i < j and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    texts = {i: t for i, t in texts.items() if label[i] == i}

    def windows(text):
        tokens, _ = decontaminate.template(text)
        return {tuple(tokens[i : i + 8]) for i in range(len(tokens) - 7)}

    leaked = set().union(*(windows(r.text) for r in items))
    texts = {i: t for i, t in texts.items() if not windows(t) & leaked}
    coder = piece_coding.PieceCoder(public_tokenizers.path(PIECE_MODEL))
    expected = {i: coder.encode([t])[0].tolist() for i, t in texts.items()}
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id: r.ids for r in got} == expected and len(got) == len(expected)


def test_stages_take_hard_rows(spark):
    rows = [(1, None, "en", None, 0), (2, "", None, "a", 0), (3, "same text of a few words", "en", "a", 1)]
    rows += [(3, "same text of a few words", "en", "a", 1), (4, "same text of a few words", "en", "b", 1), (None, "no id here", "en", "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF_DIR)
            assert out.count() <= frame.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == frame.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "jaccard_join", "decontaminate", "piece_coding"
    ]


def test_catalogue():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = con.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, SF_DIR).toPandas()[want.columns]

    def rows(frame):
        return sorted(str([None if pd.isna(v) else v for v in r]) for r in frame.astype(object).itertuples(index=False))

    def plain(frame):
        return frame.apply(lambda c: c.astype(float) if pd.api.types.is_numeric_dtype(c) else c)

    assert rows(plain(got)) == rows(plain(want))
