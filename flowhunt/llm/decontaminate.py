"""Benchmark decontamination through canonical templates.

Texts become template tokens: words in lower case, numbers, units behind a number and names (capitalised
inside a sentence) as typed placeholders; what a placeholder stood for is kept as its slot value. Windows
of ``window`` template tokens are hashed and joined with the windows of the benchmark. Matching windows of
one document, item and offset form an alignment; it counts if its slot values map one to one, so a question
with other numbers or names is caught while text that only shares the form is not.

With ``per_window``, as in the query and the pipeline, an alignment's windows need not all agree. Windows without
slots, or with the item's own values, count at once. Of the others each names a new value for each original value
of a kind; for every original the value that most windows name is taken (the larger text of equally many), and the
windows that agree with all of it form the consistent set. One window is enough for a leak; ``n_windows`` says how many agree.

The hashes of the benchmark's windows set bits in a filter of at most ``FILTER_BITS``, which every task looks
windows up in; what passes is joined with the benchmark on hash and text, so neither the filter nor a collision
adds or loses anything. There is one plan for benchmarks of any size.

Items shorter than a window are matched as one window of their own length. Windows of an item that hold fewer
than ``LEAST_WORDS`` ordinary words, and items of fewer than ``shortest`` tokens, are compared exactly, with the
slot values in place of the placeholders and whatever the document's tokens count as. So an item of one word is
found wherever the word stands.

Defined cases: null texts count as empty and match nothing. Rows with equal ids are told apart by their text;
repeated rows give one result row. An empty benchmark or table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowhunt.llm.common import small_batches, whole
from flowhunt.session import materialize

WINDOW = 8
SHORTEST = 5
LEAST_WORDS = 4
FILTER_BITS = 1 << 27  # 16 MB at most are broadcast
BITS_EACH = 64  # bits for each benchmark window while they suffice
_BITMAP = 32_768  # bits of one of Spark's bitmaps

NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
# Units that count behind a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft feet foot yd yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre "
    "litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents km/h mph degree degrees".split()
)
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def template(text: str) -> tuple[list[str], dict[int, str]]:
    """Template tokens, and the slot values by position."""
    tokens: list[str] = []
    values: dict[int, str] = {}
    starts_sentence = True
    for t in _TOKEN.findall(text):
        if t in ".!?\n":
            starts_sentence = True
            continue
        kind = t
        if t[0].isdigit():
            kind = NUMBER
        elif tokens and tokens[-1] == NUMBER and t.lower() in UNITS:
            kind = UNIT
        elif not t.islower():
            named = not starts_sentence and len(t) > 1 and t[0].isupper() and t[1:].islower()
            kind = NAME if named else t.lower()
        if kind[0] == "<":
            values[len(tokens)] = t.lower()
        tokens.append(kind)
        starts_sentence = False
    return tokens, values


class Hasher:
    """64-bit hashes of tokens, remembered up to a bound."""

    def __init__(self, remembered: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.remembered = remembered

    def __call__(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > self.remembered:
            self.known = {}
        for t in set(tokens) - self.known.keys():
            self.known[t] = xxhash.xxh64_intdigest(t)
        return np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(tokens) - size + 1), np.uint64)
    for i in range(size if out.size else 0):
        out = (out ^ tokens[i : i + len(out)]) * _BASE
        out ^= out >> np.uint64(31)
    return out


_FOUND = pa.schema(
    [("size", pa.int32()), ("at", pa.int32()), ("hash", pa.int64()), ("body", pa.string()), ("slots", pa.string())]
)


Wanted = dict[bool, list[int]]  # sizes of the exact and of the template windows to look for


def _salt(exact: bool, size: int) -> np.uint64:
    """Keeps windows of different kind and size apart."""
    return np.uint64((2 * size + exact) * 0xD1B54A32D192ED03 % (1 << 64))


def filter_positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def _passes(filtered: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    out = np.ones(len(hashes), bool)
    for at in filter_positions(hashes, 8 * len(filtered)):
        out &= (filtered[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def window_filter(items: DataFrame, column: str = "hash") -> np.ndarray:
    """Bytes of the filter, put together from Spark's bitmaps; its size follows the number of windows up to a bound."""
    n = items.count()
    bits = min(FILTER_BITS, max(_BITMAP, 1 << (BITS_EACH * n - 1).bit_length()))
    hashes = F.col(column)
    places = F.array(hashes.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(hashes, 32).bitwiseAND(F.lit(bits - 1)))
    each = items.select(F.explode(places).alias("at")).select((F.col("at") + 1).alias("at"))
    maps = each.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in maps.collect():
        start = (r["b"] - 1) * _BITMAP // 8
        out[start : start + len(r["m"])] = np.frombuffer(r["m"], np.uint8)
    return out


def _find(texts: list[str], hasher: Hasher, wanted: Wanted, own_size: bool, shortest: int, filtered: np.ndarray | None):
    """Text of each window found, and the columns of ``_FOUND``. All texts of a batch are hashed at once.

    The body of an exact window starts with "=". With ``own_size`` a text gives its own windows, not what ``filtered`` lets pass.
    """
    parts = [template(t) for t in texts]
    tokens = [t for part, _ in parts for t in part]
    lengths = np.array([len(part) for part, _ in parts], np.int64)
    owner = np.repeat(np.arange(len(parts)), lengths)
    first = np.cumsum(lengths) - lengths
    hashes = hasher(tokens)
    slots = [(int(first[who]) + at, value) for who, (_, values) in enumerate(parts) for at, value in values.items()]
    plain, plain_hashes = list(tokens), hashes.copy()
    for at, value in slots:
        plain[at] = value
    if slots and wanted[True]:
        plain_hashes[[at for at, _ in slots]] = hasher([value for _, value in slots])
    owners: list[int] = []
    out: list[tuple] = []
    for exact, size in [(exact, size) for exact, sizes in wanted.items() for size in sizes]:
        keys = window_hashes(plain_hashes if exact else hashes, size) ^ _salt(exact, size)
        ok = owner[: len(keys)] == owner[size - 1 :] if len(keys) else np.zeros(0, bool)
        if own_size:  # a text shorter than the longest window is one window
            ok &= np.minimum(lengths, max(wanted[True]))[owner[: len(keys)]] == size
        if filtered is not None:
            ok &= _passes(filtered, keys)
        for i in np.flatnonzero(ok).tolist():
            body = tokens[i : i + size]
            enough = size >= shortest and sum(t[0] != "<" for t in body) >= LEAST_WORDS
            if enough if exact and own_size else not enough and not exact:
                continue
            who = int(owner[i])
            at = i - int(first[who])
            values = parts[who][1]
            if exact:
                body = plain[i : i + size]
            # A document's window found exactly has the item's values, whatever they count as there.
            now = " ".join(body) if exact and not own_size else " ".join(values.get(at + j, "-") for j in range(size))
            owners.append(who)
            out.append((size, at, int(keys[i].view(np.int64)), "=" * exact + " ".join(body), now))
    return owners, list(zip(*out)) if out else [()] * len(_FOUND)


def _windows(
    rows: DataFrame, key: str, text: str, wanted: Wanted, own_size: bool, shortest: int, filtered: np.ndarray | None = None
) -> DataFrame:
    """id, print and the columns of ``_FOUND``, one row per window."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(filtered)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            owners, columns = _find(batch.column(2).to_pylist(), hasher, wanted, own_size, shortest, shared.value)
            part = batch.select([0, 1]).take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *[pa.array(c, f.type) for c, f in zip(columns, _FOUND)]],
                names=["id", "print", *_FOUND.names],
            )

    return rows.select(F.col(key).alias("id"), F.xxhash64(whole(text)).alias("print"), whole(text).alias("body")).mapInArrow(
        run, f"id {kind}, print long, size int, at int, hash long, body string, slots string"
    )


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, shortest: int = SHORTEST, per_window: bool = False,
) -> DataFrame:
    """One row per leaked item of a document: key, print (hash of its text), item, n_windows, n_slots, verbatim."""
    every = list(range(1, window + 1))
    items = materialize(
        _windows(benchmark, item, item_text, {False: every, True: every}, True, shortest).select(
            F.col("id").alias("item"), "size", F.col("at").alias("item_at"), "hash", "body", F.col("slots").alias("item_slots")
        ),
        "benchmark-windows",
    )
    sizes = items.select(F.col("body").startswith("=").alias("exact"), "size").distinct().collect()  # at most twice window of them
    wanted = {kind: sorted(r["size"] for r in sizes if r["exact"] == kind) for kind in (False, True)}
    windows = _windows(docs, key, text, wanted, False, shortest, window_filter(items))
    # One struct names an alignment: null ids are equal in it.
    pairs = windows.join(items.drop("size"), ["hash", "body"]).select(
        F.struct("id", "print", "item", (F.col("at") - F.col("item_at")).alias("offset")).alias("k"), "item_at",
        F.array_distinct(F.filter(
            F.arrays_zip(
                F.split("body", " ").alias("kind"), F.split("item_slots", " ").alias("was"), F.split("slots", " ").alias("now")
            ),
            lambda s: s["was"] != "-",
        )).alias("slots"),
    )
    if per_window:
        pairs = _consistent(materialize(pairs, "matching-windows"))
    # An alignment has at most one row per window of its item.
    slots = F.array_distinct(F.flatten(F.collect_set(F.transform("slots", lambda s: F.struct(s["was"].alias("was"), s["now"].alias("now"))))))
    one_to_one = (F.size(F.array_distinct(F.col("slots.was"))) == F.size("slots")) & (
        F.size(F.array_distinct(F.col("slots.now"))) == F.size("slots")
    )
    aligned = (
        pairs.groupBy("k")
        .agg(F.countDistinct("item_at").alias("n_windows"), slots.alias("slots"))
        .filter(F.lit(True) if per_window else one_to_one)
        .withColumn("verbatim", F.forall("slots", lambda s: s["was"] == s["now"]))
    )
    return aligned.groupBy("k.id", "k.print", "k.item").agg(
        F.max("n_windows").alias("n_windows"), F.max(F.size("slots")).alias("n_slots"), F.max("verbatim").alias("verbatim")
    ).select(F.col("id").alias(key), "print", F.col("item").alias(item), "n_windows", "n_slots", "verbatim")


def _consistent(pairs: DataFrame) -> DataFrame:
    """The windows that count: those as in the item, and of each alignment's others the ones that agree with its most
    named values. A window that names two values for one original agrees with none."""
    sure = F.forall("slots", lambda s: s["was"] == s["now"])
    named = pairs.filter(~sure).select("k", "item_at", F.explode("slots").alias("s")).select("k", "item_at", "s.*")
    votes = named.groupBy("k", "kind", "was", "now").agg(F.countDistinct("item_at").alias("n"))
    chosen = votes.groupBy("k", "kind", "was").agg(F.max(F.struct("n", "now")).alias("top"))
    against = named.join(chosen, ["k", "kind", "was"]).filter(F.col("now") != F.col("top.now")).select("k", "item_at").distinct()
    return pairs.filter(sure).unionByName(pairs.filter(~sure).join(against, ["k", "item_at"], "left_anti"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all columns."""
    found = leaks(docs, benchmark, key, text, **options).select(F.col(key).alias("l_id"), "print").distinct().alias("l")
    same = F.col(f"d.{key}").eqNullSafe(F.col("l.l_id")) & (F.xxhash64(whole(f"d.{text}")) == F.col("l.print"))
    return docs.alias("d").join(found, same, "left_anti").select(*[F.col(f"d.{c}") for c in docs.columns])
