"""License scan with DataFrame operations only.

Words are maximal runs of ASCII letters, digits and characters beyond ASCII, compared with A-Z lowered.

Base labels: places where the words of a fixed phrase stand one after the other.

Method labels: an exact set-similarity join of text blocks (lines) with license templates. The tokens of
the templates are ordered by how many rows of the whole table hold them, rarest first. A block that
contains at least ``threshold`` of a template's tokens must (prefix filter) hold one of the first
|T| - need + 1 of them, (length filter) hold ``need`` template tokens at all, and (positional filter)
have enough tokens left behind the first shared one, in its own order and in the template's. What passes
is verified. The index of prefixes is as small as the templates and is the only thing broadcast.

A notice wrapped over several lines is found in its paragraph: what stands between lines without a word, so
comment marks are no words and end nothing but their own line. A paragraph's words are cut into stretches that
overlap by the longest window; the same join runs on them, and a stretch is verified window by window. A window
is an eighth longer than its template. It must hold all numbers of the template: in prose of several lines a
version cannot be among the tokens that ``threshold`` forgives.

Defined cases: null counts as empty: no words, no labels, score 0. Rows are told apart by id and text, so
repeated rows repeat their result. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from flowhunt.llm.common import whole

# Phrases and labels of the contract, then short notices as their licenses word them.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation, version 2"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
)
THRESHOLD = 0.9  # short notices need every token
STRETCH = 64  # words of a paragraph in which a window may start

_GAP = "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def joined_words(text: Column) -> Column:
    """The words in their order, a space before, between and behind them; a single space without any."""
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), _GAP, " ")


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _places(joined: Column, phrase: str) -> Column:
    """Count, first and last start of a phrase, as one struct; null without a place."""
    pattern = f"(?i)(?<= ){phrase}(?= )"
    parts = F.split(joined, pattern, -1)
    size, behind = len(phrase.split()), _spaces(F.element_at(parts, -1)) - 1
    return F.when(
        joined.rlike(pattern),
        F.struct(
            (F.size(parts) - 1).cast("long").alias("n"),
            (_spaces(parts[0]) - 1).cast("long").alias("first"),
            (_spaces(joined) - 1 - behind - size).cast("long").alias("last"),
        ),
    )


def _tokens(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[0-9a-z]+", text.lower())))


def _lowered_words(text: Column) -> Column:
    return F.split(F.translate(F.trim(joined_words(text)), _UPPER, _LOWER), " ")


def token_order(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> list[str]:
    """All template tokens, rarest in the table first; ties by the token."""
    vocabulary = sorted({t for _, body in templates for t in _tokens(body)})
    held = F.array_intersect(F.split(F.lower(joined_words(whole(text))), " "), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(held).alias("token")).groupBy("token").count().collect()  # a row a token at most
    counts = {r["token"]: r["count"] for r in rows}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def matching_blocks(
    docs: DataFrame, order: list[str], keys: list[str], templates=TEMPLATES, text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Blocks and the templates they contain: keys, block (line number), label, template, containment."""
    details = _details(order, templates, threshold)
    lines = _with_prefix(docs, details, keys, text).select(*keys, F.posexplode(F.split("body", "\n")).alias("block", "line"))
    matches = _matches(lines.select(*keys, "block", _lowered_words(F.col("line")).alias("words")), order, details, [*keys, "block"])
    return matches.select(*keys, "block", "label", "template", (F.size("shared") / F.col("size")).alias("containment"))


def wrapped_blocks(
    docs: DataFrame, order: list[str], keys: list[str], templates=TEMPLATES, text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Templates found in a window of a paragraph of several lines: keys, label, template, containment."""
    details = _details(order, templates, threshold)
    longest = max(d["span"] for d in details)
    words = F.col("words")
    stretches = F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(STRETCH)), lambda i: F.slice(words, i + 1, STRETCH + longest))
    several = F.col("body").contains("\n")
    paragraphs = (
        _with_prefix(docs, details, keys, text).filter(several)
        .select(*keys, F.explode(F.split("body", f"\n{_GAP[:-1]}*\n")).alias("body")).filter(several)
    )
    blocks = _with_prefix(paragraphs, details, keys, "body").select(*keys, _lowered_words(F.col("body")).alias("words"))
    matches = _matches(blocks.select(*keys, F.explode(stretches).alias("words")), order, details, keys)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - F.col("span") + 1))

    def held(start: Column) -> Column:
        window = F.slice("words", start, F.col("span"))
        return F.when(F.size(F.array_except("numbers", window)) == 0, F.size(F.array_intersect("tokens", window)))

    return (
        matches.withColumn("most", F.array_max(F.transform(starts, held)))
        .filter(F.col("most") >= F.col("need"))
        .select(*keys, "label", "template", (F.col("most") / F.col("size")).alias("containment"))
    )


def _details(order: list[str], templates, threshold: float) -> list[dict]:
    rank = {t: i for i, t in enumerate(order)}
    details = []
    for n, (label, body) in enumerate(templates):
        tokens, length = sorted(_tokens(body), key=rank.__getitem__), len(re.findall(r"[0-9a-z]+", body.lower()))
        details.append({
            "template": n, "label": label, "size": len(tokens), "need": math.ceil(threshold * len(tokens)), "tokens": tokens,
            "numbers": [t for t in tokens if t.isdigit()], "span": length + math.ceil(length / 8),
        })
    return details


def _prefix(detail: dict) -> list[str]:
    return detail["tokens"][: detail["size"] - detail["need"] + 1]


def _with_prefix(docs: DataFrame, details: list[dict], keys: list[str], text: str) -> DataFrame:
    """keys and body of the rows that hold a prefix token; without any there is no match."""
    union = "|".join(sorted({t for d in details for t in _prefix(d)}))
    return docs.select(*keys, whole(text).alias("body")).filter(
        F.col("body").rlike(f"(?i)(?<![0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}])(?:{union})(?![0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}])")
    )


def _matches(blocks: DataFrame, order: list[str], details: list[dict], keys: list[str]) -> DataFrame:
    """Blocks (columns ``keys``, words) that hold enough tokens of a template, with its details and the tokens shared."""
    index = [(t, i, *d.values()) for d in details for i, t in enumerate(_prefix(d))]
    prefixes = blocks.sparkSession.createDataFrame(
        index, "token string, at int, template int, label string, size int, need int, tokens array<string>, "
        "numbers array<string>, span int"
    )
    blocks = blocks.withColumn("held", F.array_intersect(F.array(*map(F.lit, order)), "words")).filter(
        F.size("held") >= min(d["need"] for d in details)
    )
    candidates = (
        blocks.select(*keys, "words", "held", F.posexplode("held").alias("here", "token"))
        .join(F.broadcast(prefixes), "token")
        .filter(F.size("held") >= F.col("need"))
        .filter(1 + F.least(F.size("held") - F.col("here") - 1, F.col("size") - F.col("at") - 1) >= F.col("need"))
    )
    # The pair is verified where it meets first: at the earliest of its shared tokens.
    shared = F.array_intersect("tokens", "held")
    return candidates.withColumn("shared", shared).filter(F.col("shared")[0] == F.col("token")).filter(F.size("shared") >= F.col("need"))


def scan_licenses(
    docs: DataFrame, order: list[str], key: str = "doc_id", text: str = "text", templates=TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(F.col(key).alias("id"), whole(text).alias("body")).withColumn("print", F.xxhash64("body"))
    keys = ["id", "print"]
    blocks = [find(rows, order, keys, templates, "body", threshold) for find in (matching_blocks, wrapped_blocks)]
    found = (
        blocks[0].drop("block").unionByName(blocks[1])
        .groupBy("id", "print")
        .agg(F.collect_set("label").alias("added"), F.max("containment").alias("best"))
    )
    joined = joined_words(F.col("body"))
    places = [_places(F.col("joined"), phrase).alias(f"p{i}") for i, (phrase, _) in enumerate(PHRASES)]
    base = rows.select("id", "print", joined.alias("joined")).select(
        "id", "print", (_spaces(F.col("joined")) - 1).cast("long").alias("n_words"), *places
    )
    each = [F.col(f"p{i}") for i in range(len(PHRASES))]
    labels = F.array_compact(F.array(*[F.when(p.isNotNull(), F.lit(label)) for p, (_, label) in zip(each, PHRASES)]))
    base = base.select(
        "id", "print", "n_words",
        sum((F.coalesce(p["n"], F.lit(0)) for p in each), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[p["first"] for p in each]).alias("first_word"),
        F.greatest(*[p["last"] for p in each]).alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("named"),
    )
    same = F.col("b.id").eqNullSafe(F.col("f.id")) & (F.col("b.print") == F.col("f.print"))
    none = F.array().cast("array<string>")
    return base.alias("b").join(found.alias("f"), same, "left").select(
        F.col("b.id").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join("named", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("named", F.coalesce("added", none))), ",").alias("labels"),
        F.when(F.size("named") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
