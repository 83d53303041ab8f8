"""Exact dedup by two-pass Bloom filtering; DataFrame functions only.

Pass 1 counts the rows of each filter slot (two hash functions, each with a
table of slots of its own) and keeps the slots with two rows or more as
bitmaps. Pass 2 tests each row's two slots. A row with a slot of its own is
unique and passes straight through. Only the others, all repeated rows and a
few by chance, are shuffled by their SHA-256 and grouped.

The bitmaps take SLOT_BITS_PER_ROW bits a row and table, at most
2 * MAX_SLOTS / 8 bytes (64 MiB) in all, so that broadcasting them is bounded.
Beyond that size more rows are taken for repeated and shuffled; the result
stays the same. A text is read and hashed once: the digests (id, SHA-256) go
to the shared folder, and both passes read those.

Defined results: a null text counts as empty; equal texts keep the row with
the smallest id (null ids last); of rows that repeat id and text exactly one is
kept; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm.common import BITMAP_SHIFT, bit, bitmaps, materialize, table

SPACE = r"[\x20\x09-\x0D]+"
SLOT_BITS_PER_ROW = 16
MIN_SLOTS, MAX_SLOTS = 1 << 16, 1 << 28
LAST_ID = (1 << 63) - 1
SALTS = 8


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row for each row: id, SHA-256 of the normalised text, a row number that is unique."""
    return df.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normalized(F.col(text_col)).cast("binary"), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def slot_count(rows: int) -> int:
    wanted = max(1, rows * SLOT_BITS_PER_ROW)
    return min(MAX_SLOTS, max(MIN_SLOTS, 1 << (wanted - 1).bit_length()))


def _slots(key: str, slots: int) -> list[Column]:
    first = F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(slots))
    second = F.pmod(F.xxhash64(F.lit(2), F.col(key)), F.lit(slots)) + F.lit(slots)
    return [first, second]


def repeated_slots(df: DataFrame, key: str, slots: int) -> DataFrame:
    """Pass 1: the bitmaps (bucket, bits) of the slots that two rows or more fall into."""
    slot = df.select(F.explode(F.array(*_slots(key, slots))).alias("slot"))
    return bitmaps(slot.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"))


def flag_repeated(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Pass 2: adds ``maybe_repeated``, false only for keys that occur once."""
    slots = slot_count(rows)
    crowded = F.broadcast(repeated_slots(df, key, slots))  # at most 2 * MAX_SLOTS / 8 bytes
    out = df
    for k, slot in enumerate(_slots(key, slots)):
        side = crowded.select(F.col("bucket").alias(f"bucket_{k}"), F.col("bits").alias(f"bits_{k}"))
        out = out.withColumn(f"slot_{k}", slot)
        out = out.join(side, F.shiftright(f"slot_{k}", BITMAP_SHIFT) == F.col(f"bucket_{k}"), "left")
    both = bit(F.col("bits_0"), F.col("slot_0")) & bit(F.col("bits_1"), F.col("slot_1"))
    return out.select(*df.columns, both.alias("maybe_repeated"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = materialize(digests(df, id_col, text_col), "digests")
    flagged = flag_repeated(hashed, "text_sha256", hashed.count())
    alone = flagged.where(~F.col("maybe_repeated")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    crowd = flagged.where("maybe_repeated").drop("maybe_repeated")
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias("rank"), F.col("row_no"), F.col("doc_id"))
    groups = crowd.groupBy("text_sha256").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    # Each group meets the salted shares of its rows, which the skew join may split further.
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    crowd = crowd.withColumn("salt", F.pmod("row_no", F.lit(SALTS)).cast("int"))
    met = crowd.join(groups, ["text_sha256", "salt"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("first.row_no")).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(met)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {
    "op2_exact_dedup": r"""
        WITH hashed AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, text_sha256
        FROM hashed WINDOW same AS (PARTITION BY text_sha256)"""
}
