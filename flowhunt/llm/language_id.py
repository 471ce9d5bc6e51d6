"""Language identification by compression.

Each language is a zstandard raw-content dictionary cut from labelled texts. A text is compressed with
every dictionary, in chunks so that the dictionary and not the text itself supplies the matches, and the
language with the smallest total wins. The margin over the runner-up is the score; a margin below
``min_margin`` is a rejection.

Fitting reads every labelled row but keeps a bounded sample: ``slots`` excerpts of ``excerpt`` characters
per language, one per hash slot, from all over the texts. The dictionaries are at most that large.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected. Equal sizes go to
the language that sorts first. With one known language its margin is 1; with none every text is ``und``.
Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from flowhunt.llm.common import fold, small_batches

UNKNOWN = "und"
SLOTS = 400
EXCERPT = 256
CHUNK = 16_384
LEVEL = 5
MIN_MARGIN = 0.002
# A frame that would gain a few bytes only is stored raw, which hides the differences of very short texts: they
# are compressed behind a run of zero bytes that always gains.
SHORT, CARRIER = 256, bytes(64)

_LETTER = re.compile(r"[^\W\d_]")
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def normalise(text: str) -> bytes:
    """Lower-cased UTF-8 with ASCII characters other than letters as single spaces."""
    return b" ".join(text.lower().encode().translate(_TO_SPACE).split())


def labelled(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Rows that may be learned from: labelled and not held out."""
    return docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(key, 3) != 1))


def fit_dictionaries(
    train: DataFrame, lang: str = "lang", text: str = "text", slots: int = SLOTS, excerpt: int = EXCERPT
) -> dict[str, bytes]:
    """Language to dictionary bytes. The sample is the excerpt of smallest hash in each (language, slot)."""
    place = F.pmod(F.xxhash64(F.col(text)), F.greatest(F.length(text) - excerpt + 1, F.lit(1)).cast("long"))
    rows = (
        train.select(F.col(lang).alias("lang"), F.col(text).substr((place + 1).cast("int"), F.lit(excerpt)).alias("part"))
        .withColumn("order", F.xxhash64("part"))
        .groupBy("lang", F.pmod(F.xxhash64("part", F.lit(1)), F.lit(slots)).alias("slot"))
        .agg(F.min_by("part", F.struct("order", "part")).alias("part"))
        .collect()
    )
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        parts.setdefault(r.lang, []).append((r.slot, r.part))
    return {k: b" ".join(normalise(t) for _, t in sorted(v)) for k, v in sorted(parts.items())}


class Classifier:
    """The dictionaries ready for use; built once in each Python worker."""

    def __init__(self, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> None:
        self.names = sorted(dictionaries)
        self.min_margin = min_margin
        self.coders = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.coders.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False
                )
            )

    def sizes(self, text: str) -> list[int]:
        body = normalise(text)
        if len(body) < SHORT:
            body = CARRIER + b" " + body + b" "
        chunks = [body[i : i + CHUNK] for i in range(0, len(body), CHUNK)]
        return [sum(len(c.compress(x)) for x in chunks) for c in self.coders]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, margin over the runner-up (0 to 1), rejected."""
        if not text or not self.names or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        best, second = np.argsort(sizes, kind="stable")[:2]
        margin = 1.0 - sizes[best] / sizes[second]
        return self.names[best], margin, margin < self.min_margin


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id", text: str = "text",
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """One row per row of ``docs``: key, lang_pred, score, rejected."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries, min_margin)
        for batch in batches:
            found = [model.judge(t) for t in batch.column(1).to_pylist()]
            pred, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("id"), F.col(text).alias("body")).mapInArrow(
        run, f"id {kind}, lang_pred string, score double, rejected boolean"
    )
    return out.withColumnRenamed("id", key)


def keep_identified(
    docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN
) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all columns."""
    small_batches(docs.sparkSession)
    position = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries, min_margin)
        for batch in batches:
            rejected = [model.judge(t)[2] for t in batch.column(position).to_pylist()]
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
