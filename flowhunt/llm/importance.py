"""Target-distribution importance resampling on hashed word n-grams.

Features are runs of one to three words, hashed into buckets. A bucket's gain is the log ratio of its
smoothed shares in the target and in the documents; a document's weight is the sum over its features, and
Gumbel noise from a digest of its id turns the highest scores into a draw without replacement.

A batch of texts is joined with a separator byte and searched by one pattern. The separator is no word
byte, so no word crosses it; the place of each word among the document offsets (searchsorted) then masks
the n-grams that would. Checksums of n-grams come from those of their words: a CRC is linear in what stands
before, so appending a word is a table lookup by its length and an exclusive or. Counts are one bincount.

Patterns work on UTF-8 bytes: every byte of a character beyond ASCII lies above 0x7F, as the character
itself does, so words are the same as on characters.

Defined cases: null counts as empty; texts without words have no features and weight 0; rows below the
least number of words are never drawn. Ties go to the smaller key, a null key (noise of an empty id) last,
rows alike in all of that in any order. Every row of repeated rows counts and may be drawn. Without
target texts the gains still follow from the smoothing. Extra columns of any name are not read; ``resample``
carries them. A text must fit a task. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowhunt.llm.common import small_batches, whole
from flowhunt.operators.ordering import number_rows
from flowhunt.session import materialize

BUCKETS = 10_000
LONGEST = 3
SHARE = 5
MIN_WORDS = 20
SEED = 42
JOINED_BYTES = 1 << 22  # texts are joined up to this size; a longer one stands alone
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SEPARATOR = b"\0"
_TABLED = 64  # words up to this many bytes are appended by one lookup


class _Append:
    """CRC-32 of ``head + b" " + tail`` from the values of both and the tail's length, on whole arrays."""

    def __init__(self) -> None:
        self.space = np.uint32(zlib.crc32(b" "))
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
        self.byte = byte
        table = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None])
        tables = [table]
        for _ in range(_TABLED):
            tables.append(self._zero(tables[-1]))
        self.by_length = np.stack(tables)
        self.by_power = [tables[_TABLED]]

    def _zero(self, value: np.ndarray) -> np.ndarray:
        """The value after one more zero byte."""
        return (value >> 8) ^ self.byte[value & 255]

    @staticmethod
    def _apply(table: np.ndarray, value: np.ndarray) -> np.ndarray:
        return table[0][value & 255] ^ table[1][value >> 8 & 255] ^ table[2][value >> 16 & 255] ^ table[3][value >> 24]

    def _shift(self, value: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The value after ``length`` more zero bytes."""
        flat, at = self.by_length.reshape(-1), (length % _TABLED) * 1024
        out = flat[at + (value & 255)]
        for k in (1, 2, 3):
            out = out ^ flat[at + 256 * k + (value >> (8 * k) & 255)]
        rest, power = length // _TABLED, 0
        while rest.any():
            if power == len(self.by_power):
                self.by_power.append(self._apply(self.by_power[-1], self.by_power[-1]))
            odd = np.flatnonzero(rest & 1)
            out[odd] = self._apply(self.by_power[power], out[odd])
            rest, power = rest >> 1, power + 1
        return out

    def __call__(self, head: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self._shift(self._zero(head) ^ self.space, length) ^ tail


class _Buckets:
    """Buckets of all features of a batch of texts."""

    def __init__(self, buckets: int, longest: int) -> None:
        self.buckets, self.longest, self.append = buckets, longest, _Append()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each feature, its text, words of each text)."""
        joined = SEPARATOR.join(texts).lower()
        offsets = np.cumsum([0] + [len(t) + len(SEPARATOR) for t in texts[:-1]])
        found = [(m.start(), m[0]) for m in WORD.finditer(joined)]
        starts = np.fromiter((s for s, _ in found), np.int64, len(found))
        length = np.fromiter((len(w) for _, w in found), np.int64, len(found))
        word = np.fromiter((zlib.crc32(w) for _, w in found), np.uint32, len(found))
        text = np.searchsorted(offsets, starts, "right") - 1
        values, owners, run = [word], [text], word
        for n in range(1, min(self.longest, len(found))):
            run = self.append(run[:-1], word[n:], length[n:])
            inside = text[n:] == text[:-n]
            values.append(run[inside])
            owners.append(text[n:][inside])
        bucket = (np.concatenate(values) % np.uint32(self.buckets)).astype(np.int64)
        return bucket, np.concatenate(owners), np.bincount(text, minlength=len(texts))


def _joinable(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts of a batch, up to the size that is joined, with the place of the first."""
    first, size, texts = 0, 0, []
    for i, text in enumerate(column.cast(pa.binary()).to_pylist()):
        if texts and size + len(text) > JOINED_BYTES:
            yield first, texts
            first, size, texts = i, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Rows (bucket, n) of all features of all texts; each task sends one row a bucket at most."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = _Buckets(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _joinable(batch.column(0)):
                total += np.bincount(features(texts)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    counted = docs.select(whole(text).alias("body")).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of each bucket from the two tables of counts (``buckets`` rows at most)."""
    s, t = ({r.bucket: r.n for r in counts.collect()} for counts in (source, target))
    source_all, target_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    return [
        math.floor(1000 * math.log(float((t.get(b, 0) + 1) * source_all) / float((s.get(b, 0) + 1) * target_all)))
        for b in range(buckets)
    ]


def weigh(
    docs: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text", longest: int = LONGEST, carry: bool = False
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_features, weight; with ``carry`` also all columns as ``row``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, value = _Buckets(len(gain), longest), np.array(gain, np.float64)
        for batch in batches:
            words, n, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, texts in _joinable(batch.column(0)):
                bucket, owner, met = features(texts)
                here = slice(first, first + len(texts))
                words[here] = met
                n[here] = np.bincount(owner, minlength=len(texts))
                weight[here] = np.bincount(owner, value[bucket], len(texts))  # whole numbers below 2^53
            arrays = [*batch.columns[1:], *(pa.array(a) for a in (words, n, weight))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[1:], "n_words", "n_features", "weight"])

    kept = [F.col(key).alias("id")] + ([F.struct(*docs.columns).alias("row")] if carry else [])
    read = docs.select(whole(text).alias("body"), *kept)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema.fields[1:])
    return read.mapInArrow(run, f"{schema}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Noise of a row in thousandths, from a digest of its key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def draw(weighed: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Add ``score`` and ``rank``: 1 is the highest score, null is not drawn. ``weighed`` is stored and sorted once."""
    stored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "weighed")
    able = F.col("n_words") >= min_words
    drawn = share * stored.filter(able).count() // 100
    # Rows alike in score and key are still dealt over the sort by their place in the stored table.
    ordered = stored.withColumns({
        "_unable": ~able, "_down": -F.col("score"), "_nameless": F.col("id").isNull(), "_tie": F.monotonically_increasing_id()
    })
    placed = number_rows(ordered, ["_unable", "_down", "_nameless", "id", "_tie"], "_nth", "ranked")
    rank = F.when(~F.col("_unable") & (F.col("_nth") <= drawn), F.col("_nth"))
    return placed.withColumn("rank", rank).select(*stored.columns, "rank")


def importance(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
    longest: int = LONGEST, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, carry: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_features, weight, score, rank."""
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, text, buckets, longest), buckets)
    ranked = draw(weigh(docs, gain, key, text, longest, carry), share, min_words, seed)
    return ranked if carry else ranked.withColumnRenamed("id", key)


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; options as in :func:`importance`."""
    return importance(docs, target, carry=True, **options).filter(F.col("rank").isNotNull()).select("row.*")
