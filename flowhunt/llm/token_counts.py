"""Token counts of whole documents under a SentencePiece model.

A huge document is encoded in overlapping chunks. Token ends become byte offsets of the text, and two
neighbouring chunks are spliced at an offset inside their overlap that ends a token in both and is
proven stable. Stable means that no piece of the vocabulary can cover it: two characters that stand side by side in
no piece are never joined, whatever stands around them, so what lies on either side is encoded alike in
any context. (No piece has a space mark behind another character, so all steps from a non-space to a space are
stable; in scripts and codes without spaces most pairs of characters are.) The pairs are taken from the
vocabulary when the model is loaded; should the model rewrite characters, whole documents are encoded. An overlap
without a common stable offset is doubled, at last to the whole chunk; then the chunk itself is doubled, so a text
without any stable pair is encoded about twice in all.

Defined cases: null counts as empty, which has no tokens. Special strings inside texts are ordinary
text, as in the library's default. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

from flowhunt.llm.common import small_batches, whole

CHUNK = 32_768
OVERLAP = 256
LIMIT = 4096
SPACE = "▁"


class ChunkedEncoder:
    """Encodes texts of any length; equal to the library's encoding of the whole text."""

    def __init__(self, model_file: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        if not 0 < overlap < chunk:
            raise ValueError("0 < overlap < chunk")
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.n_bytes = np.array(
            [1 if self.sp.is_byte(i) else len(p.replace(SPACE, " ").encode()) for i, p in enumerate(pieces)], np.int64
        )
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        self.stable = (
            norm.name == "identity" and not norm.remove_extra_whitespaces and norm.add_dummy_prefix
            and self.sp.is_byte(self.sp.piece_to_id("<0x00>"))
        )
        spelled = [p.replace(SPACE, " ") for i, p in enumerate(pieces) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        joined = {pair for p in spelled for pair in zip(p, p[1:])}
        self.joined = np.array(sorted((ord(a) << 32) | ord(b) for a, b in joined), np.int64)

    def _chunk(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of text[start:end] and the byte offsets in it at which they end."""
        ids = np.array(self.sp.encode(text[start:end]), np.int64)
        return ids, np.cumsum(self.n_bytes[ids]) - 1  # one byte for the mark set before every chunk

    def _common(self, text: str, a: int, a_ends: np.ndarray, b: int, b_ends: np.ndarray, end: int) -> int | None:
        """Last stable character position in text[b:end] that ends a token in both chunks."""
        codes = np.frombuffer(text[b:end].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pairs = (codes[:-1] << 32) | codes[1:]
        at = np.minimum(np.searchsorted(self.joined, pairs), len(self.joined) - 1)
        stable = np.flatnonzero(self.joined[at] != pairs) + 1
        offsets = np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))[stable - 1]  # in UTF-8 bytes
        before = len(text[a:b].encode())
        found = stable[np.isin(offsets, b_ends) & np.isin(offsets + before, a_ends)]
        return b + int(found[-1]) if found.size else None

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.chunk or not self.stable:
            return np.array(self.sp.encode(text), np.int64)
        text = text.replace(SPACE, " ")  # the library treats both alike
        done: list[np.ndarray] = []
        a, a_from, a_end = 0, 0, self.chunk  # chunk, and the position from which its tokens count
        ids, ends = self._chunk(text, a, a_end)
        while a_end < len(text):
            overlap, splice = self.overlap, None
            while splice is None and a_end - overlap > a_from:
                b = a_end - overlap
                b_end = min(len(text), b + self.chunk + overlap)
                b_ids, b_ends = self._chunk(text, b, b_end)
                splice = self._common(text, a, ends, b, b_ends, a_end)
                overlap *= 2
            if splice is None or splice <= a_from:  # no stable position: a chunk twice as long
                a_end = min(len(text), a + 2 * (a_end - a))
                ids, ends = self._chunk(text, a, a_end)
                continue
            done.append(self._between(text, a, ids, ends, a_from, splice))
            a, a_from, a_end, ids, ends = b, splice, b_end, b_ids, b_ends
        done.append(self._between(text, a, ids, ends, a_from, a_end))
        return np.concatenate(done)

    @staticmethod
    def _between(text: str, a: int, ids: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> np.ndarray:
        low = len(text[a:lo].encode()) if lo > a else -1  # a chunk's start also takes its set mark
        high = len(text[a:hi].encode())
        return ids[(ends > low) & (ends <= high)]

    def counts(self, texts: list[str]) -> list[int]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        out = [0] * len(texts)
        for i, ids in zip(short, self.sp.encode([texts[i] for i in short], num_threads=1)):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = len(self.encode(t))
        return out


def token_counts(
    docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT,
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_tokens, over_limit. ``model_file`` lies on every machine."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkedEncoder(model_file, chunk, overlap)
        for batch in batches:
            counts = coder.counts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(key).alias("id"), F.octet_length(whole(text)).cast("long").alias("n_bytes"), whole(text).alias("body"))
        .mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
        .select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
