"""SentencePiece encoding and decoding in batched numpy.

The best-scoring segmentation of a text into pieces (the sum of the model file's piece scores) is found by
Viterbi over its words. A word is a run of non-spaces with the space marks before it; when no piece of the
vocabulary has a space mark behind another character, the best segmentation of a text is that of its words.
Distinct words of a batch are sorted into groups of equal length, and the words of a group advance together:
for each end position, rolling hashes of the substrings that end there are probed in the sorted hashes of
the pieces, hits are compared character by character, and the best start is kept as backpointer. Long words
are first cut between characters that stand side by side in no piece, which no segmentation can cross; a
long rest that is alone with its length is probed at all its positions at once instead. A
character that no piece covers costs the lowest score minus ``UNKNOWN_PENALTY`` and is written as byte pieces.
Equal scores go to the longest last piece.

The file's scores are used as they are: the result is the best-scoring segmentation, which for a model
trained by merges is not the order of its merges. Merge counts are the token-count operator's subject.

Defined cases: null counts as empty and has no pieces. Decoding returns the text with every space mark as a
space (a mark written in the input reads as a space too). Ids outside the vocabulary raise. Other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

from flowhunt.llm.common import small_batches, whole

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
ENCODE_ROWS = 1024  # rows a batch: more rows share more distinct words
REMEMBERED = 500_000  # words a worker keeps between batches
LONG = 64  # characters from which a word is cut, and its rest probed by position where few share its length
FEW = 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_NORMAL, _BYTE = 1, 6  # piece types of the model file


class PieceCoder:
    def __init__(self, model_file: str) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        self.pieces = [p.piece for p in proto.pieces]
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        self.byte_ids = np.full(256, -1, np.int64)
        self.is_byte = np.zeros(len(self.pieces), bool)
        usable = []
        for i, p in enumerate(proto.pieces):
            if p.type == _BYTE:
                self.byte_ids[int(p.piece[3:-1], 16)] = i
                self.is_byte[i] = True
            elif p.type == _NORMAL:
                usable.append(i)
        if (self.byte_ids < 0).any():
            raise ValueError("the model needs a piece for every byte")
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable):
            raise ValueError("a piece crosses the start of a word")
        scores = np.array([p.score for p in proto.pieces], np.float64)
        self.unknown_score = scores[usable].min() - UNKNOWN_PENALTY
        self.longest = max(len(self.pieces[i]) for i in usable)
        codes = np.zeros((len(usable), self.longest), np.uint32)
        sizes = np.array([len(self.pieces[i]) for i in usable])
        for row, i in enumerate(usable):
            codes[row, : sizes[row]] = np.frombuffer(self.pieces[i].encode("utf-32-le"), np.uint32)
        keys = np.zeros(len(usable), np.uint64)
        for j in range(self.longest):
            keys = np.where(j < sizes, self._extend(keys, codes[:, j]), keys)
        order = np.argsort(keys)
        self.keys, self.codes, self.sizes = keys[order], codes[order], sizes[order]
        self.ids, self.scores = np.array(usable)[order], scores[usable][order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        joined = {pair for i in usable for pair in zip(self.pieces[i], self.pieces[i][1:])}
        self.joined = np.array(sorted((ord(a) << 32) | ord(b) for a, b in joined), np.int64)
        self._forget()
        spelled = [bytes([int(p[3:-1], 16)]) if self.is_byte[i] else p.encode() for i, p in enumerate(self.pieces)]
        self.piece_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.piece_sizes = np.array([len(x) for x in spelled])
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes

    @staticmethod
    def _extend(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
        mixed = (keys ^ codes.astype(np.uint64)) * _BASE
        return mixed ^ (mixed >> np.uint64(29))

    def _probe(self, keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Row of the piece equal to each part, or -1."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = (self.keys[at] == keys) & (self.sizes[at] == parts.shape[1])
        rows = np.flatnonzero(hit)
        hit[rows] = (self.codes[at[rows], : parts.shape[1]] == parts[rows]).all(axis=1)
        return np.where(hit, at, -1)

    def _equal_length(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after the other, and how many a word, of words given as rows of code points."""
        n, length = codes.shape
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.zeros((n, length + 1), np.int64)
        piece = np.full((n, length + 1), -1, np.int64)
        for start in range(length):  # starts ascend, so of equal scores the longest last piece stays
            keys = np.zeros(n, np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                keys = self._extend(keys, codes[:, end - 1])
                found = self._probe(keys, codes[:, start:end])
                score = best[:, start] + np.where(found >= 0, self.scores[found], -np.inf)
                if end == start + 1:
                    score = np.where(found >= 0, score, best[:, start] + self.unknown_score)
                better = score > best[:, end]
                best[better, end] = score[better]
                back[better, end] = start
                piece[better, end] = found[better]
        # All words walk back together; the steps, last first, are then dealt to their words.
        at = np.full(n, length)
        live = np.arange(n)
        steps = []
        while live.size:
            starts = back[live, at[live]]
            steps.append((live, starts, piece[live, at[live]]))
            at[live] = starts
            live = live[starts > 0]
        who, start, row = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((start, who))
        return self._spell(codes, who[order], start[order], row[order])

    def _alone(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long word: pieces are probed at all its positions at once, a length at a time."""
        length = len(codes)
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(length + 1)]
        keys = np.zeros(length, np.uint64)
        for size in range(1, min(self.longest, length) + 1):
            keys = self._extend(keys[: length - size + 1], codes[size - 1 :])
            found = self._probe(keys, np.lib.stride_tricks.sliding_window_view(codes, size))
            hits = np.flatnonzero(found >= 0) if size > 1 else np.arange(length)
            scores = np.where(found >= 0, self.scores[found], self.unknown_score)[hits]
            for start, score, row in zip(hits.tolist(), scores.tolist(), found[hits].tolist()):
                ends[start + size].append((start, score, row))
        best, back = [0.0] * (length + 1), [(0, -1)] * (length + 1)
        for end in range(1, length + 1):
            top = -np.inf
            for start, score, row in reversed(ends[end]):  # long pieces first: of equal scores they stay
                if best[start] + score > top:
                    top, back[end] = best[start] + score, (start, row)
            best[end] = top
        steps, at = [], length
        while at:
            steps.append(back[at])
            at = back[at][0]
        start, row = (np.array(x, np.int64) for x in zip(*reversed(steps)))
        return self._spell(codes[None, :], np.zeros(len(start), np.int64), start, row)

    def _spell(self, codes: np.ndarray, who: np.ndarray, start: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number a word, from the pieces (rows, or -1 for a character without one) in order."""
        n = len(codes)
        ids = np.where(row >= 0, self.ids[row], -1)
        sizes = np.bincount(who, minlength=n)
        lost = np.flatnonzero(row < 0)
        if lost.size:  # characters that no piece covers become their bytes
            spelled = [self.byte_ids[list(chr(codes[w, s]).encode())] for w, s in zip(who[lost], start[lost])]
            width = np.ones(len(ids), np.int64)
            width[lost] = [len(x) for x in spelled]
            sizes = np.bincount(who, weights=width, minlength=n).astype(np.int64)
            ids = np.repeat(ids, width)
            ids[ids < 0] = np.concatenate(spelled)
        return ids, sizes

    def _learn(self, words: list[str]) -> None:
        groups: dict[int, list[str]] = {}
        for w in words:
            groups.setdefault(len(w), []).append(w)
        flats, counts = [self.flat], [self.counts]
        for length, group in sorted(groups.items()):
            if length > LONG and len(group) < FEW:
                for w in group:
                    ids, sizes = self._alone(np.frombuffer(w.encode("utf-32-le"), np.uint32))
                    flats.append(ids)
                    counts.append(sizes)
                    self.known[w] = len(self.known)
                continue
            step = max(1, 4_000_000 // (length + 1))  # bounds the score tables
            for i in range(0, len(group), step):
                part = group[i : i + step]
                codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(len(part), length)
                ids, sizes = self._equal_length(codes)
                flats.append(ids)
                counts.append(sizes)
                self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))
        self.flat, self.counts = np.concatenate(flats), np.concatenate(counts)
        self.starts = np.cumsum(self.counts) - self.counts

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.counts, self.starts = (np.zeros(0, np.int64) for _ in range(3))

    def words(self, text: str) -> list[str]:
        """Words with the marks before them; their concatenation is the marked text."""
        if not text:
            return []
        marked = text.replace(" ", SPACE)
        if self.dummy_prefix:
            marked = SPACE + marked
        parts = marked.split(SPACE)
        out, marks = [], 0
        for i, part in enumerate(parts):
            marks += i > 0
            if part:
                out.append(SPACE * marks + part)
                marks = 0
        if marks:
            out.append(SPACE * marks)
        return out

    def _parts(self, word: str) -> list[str]:
        """A long word, cut where no piece can lie."""
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
        pairs = (codes[:-1] << 32) | codes[1:]
        at = np.minimum(np.searchsorted(self.joined, pairs), len(self.joined) - 1)
        cuts = [0, *(np.flatnonzero(self.joined[at] != pairs) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [[p for w in self.words(t) for p in ((w,) if len(w) <= LONG else self._parts(w))] for t in texts]
        self._learn(sorted({w for words in split for w in words} - self.known.keys()))
        every = np.fromiter((self.known[w] for words in split for w in words), np.int64)
        sizes = self.counts[every]
        flat = _gather(self.flat, self.starts[every], sizes)
        ends = np.cumsum([len(words) for words in split])
        cuts = np.concatenate([[0], np.cumsum(sizes)])[ends]
        if len(self.known) > REMEMBERED:
            self._forget()
        return np.split(flat, cuts)[:-1] if texts else []

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if ids.size and not (0 <= ids.min() and ids.max() < len(self.pieces)):
            raise ValueError("an id lies outside the vocabulary")
        raw = _gather(self.piece_bytes, self.piece_starts[ids], self.piece_sizes[ids])
        text = raw.tobytes().decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices values[start : start + size], one after the other."""
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return values[np.arange(len(shift)) + shift]


def encode_documents(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ids, n_pieces, n_byte_pieces, round_trip (decoding gives the text back)."""
    small_batches(docs.sparkSession, ENCODE_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(model_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = coder.encode(texts)
            sizes = [len(x) for x in ids]
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat))
            same = [coder.decode(x) == t.replace(SPACE, " ") for x, t in zip(ids, texts)]
            in_bytes = [int(coder.is_byte[x].sum()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.array(sizes, pa.int64()), pa.array(in_bytes, pa.int64()), pa.array(same, pa.bool_())],
                names=["id", "ids", "n_pieces", "n_byte_pieces", "round_trip"],
            )

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("id"), whole(text).alias("body")).mapInArrow(
        run, f"id {kind}, ids array<int>, n_pieces long, n_byte_pieces long, round_trip boolean"
    )
    return out.withColumnRenamed("id", key)
