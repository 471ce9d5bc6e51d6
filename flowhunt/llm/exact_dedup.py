"""Exact deduplication that stays balanced when one text makes up much of the table.

1. Rows are grouped by (digest, salt, text). Spark's map-side combine removes the copies inside each
   task; what is left of one text is dealt over ``salts`` groups.
2. The winners of the salts are grouped by (digest, text), at most ``salts`` rows a text and task.
Both stages carry the whole text as a grouping key, so equality is always decided on the content; the
digest only deals the rows. Membership rows (id, SHA-256, salt) then look their group up, again per salt.

Defined cases: a null text counts as empty, so null and empty texts are one group. A null id never wins
against another id. Rows that repeat both id and text belong to one group and are all marked kept;
``keep_one`` returns just one of them. An empty table gives an empty result. Other columns, whatever
their names, are not read (``keep_one`` carries them along; they must be orderable).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowhunt.llm.common import whole

SALTS = 32


def _keyed(docs: DataFrame, key: str, text: str, salts: int) -> DataFrame:
    return docs.select(
        F.col(key).alias("id"),
        whole(text).alias("body"),
        F.unhex(F.sha2(whole(text), 256)).alias("digest"),
        F.pmod(F.xxhash64(F.col(key)), F.lit(salts)).cast("int").alias("salt"),
    )


def text_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per different text: digest, keep_id (largest id), group_size, salts_used (bit set)."""
    if not 1 <= salts <= 62:
        raise ValueError("salts must lie in 1..62")
    salted = (
        _keyed(docs, key, text, salts)
        .groupBy("digest", "salt", "body")
        .agg(F.max("id").alias("top"), F.count("*").alias("n"))
    )
    return (
        salted.withColumn("bit", F.expr("shiftleft(1L, salt)"))
        .groupBy("digest", "body")
        .agg(
            F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or("bit").alias("salts_used")
        )
        .select("digest", "keep_id", "group_size", "salts_used")
    )


def mark_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256."""
    groups = text_groups(docs, key, text, salts).filter("group_size > 1")
    per_salt = groups.select(
        "digest", "keep_id", "group_size",
        F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> getbit(salts_used, s) = 1)")).alias("salt"),
    )
    members = _keyed(docs, key, text, salts).select("id", "digest", "salt")
    return members.join(per_salt, ["digest", "salt"], "left").select(
        F.col("id").alias(key),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of equal texts the row with the largest id."""
    positions = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    row = F.struct(F.col(key).alias("id"), *[F.col(c).alias(p) for c, p in positions.items()])
    keyed = docs.select(
        row.alias("row"),
        whole(text).alias("body"),
        F.xxhash64(whole(text)).alias("digest"),
        F.pmod(F.xxhash64(F.col(key)), F.lit(salts)).cast("int").alias("salt"),
    )
    # The text travels as the grouping key; the row carries only the rest and whether it was null.
    lean = keyed.withColumn(
        "row", F.col("row").withField(positions[text], F.col(f"row.{positions[text]}").isNotNull())
    )
    salted = lean.groupBy("digest", "salt", "body").agg(F.max("row").alias("row"))
    top = salted.groupBy("digest", "body").agg(F.max("row").alias("row"))
    return top.select(
        *[
            (F.when(F.col(f"row.{p}"), F.col("body")) if c == text else F.col(f"row.{p}")).alias(c)
            for c, p in positions.items()
        ]
    )
