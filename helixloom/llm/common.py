"""What the corpus operators share: the shared folder and its files, the learning split, row sources, bounded filters."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.session import fresh_path, materialize, scratch, shared_dir

__all__ = ["Appender", "bit", "bitmaps", "fresh_path", "held_out", "materialize", "may_hold", "scratch", "shared_dir", "store", "table"]

HELD_OUT_FOLDS, HELD_OUT_FOLD = 4, 2
BITMAP_SHIFT = 15  # bitmap_construct_agg makes bitmaps of 2**15 bits
ROLL_BYTES = 256 << 20
BITS_PER_KEY, MIN_BITS, MAX_BITS = 8, 1 << 16, 1 << 28


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the rows that nothing may be learned from: crc32(doc_id as text) mod 4 is 2."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_FOLDS == HELD_OUT_FOLD, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder of the cluster, and the folder's path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Appender:
    """Files of a task that grow by whole members."""

    def __init__(self, folder: str, suffix: str):
        self.fs, self.folder = store(folder)
        self.suffix, self.out, self.name, self.size = suffix, None, "", 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.size >= ROLL_BYTES:
            self.close()
            self.name, self.size = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{self.suffix}", 0
            self.fs.create_dir(self.folder, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        at, self.size = self.size, self.size + len(data)
        self.out.write(data)
        return self.name, at, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def bitmaps(slots: DataFrame) -> DataFrame:
    """Rows (bucket, bits): the bitmaps of the rows (slot)."""
    return slots.groupBy(F.shiftright("slot", BITMAP_SHIFT).alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND((1 << BITMAP_SHIFT) - 1)).alias("bits"))


def bit(bits: Column, slot: Column) -> Column:
    """Whether the slot is set in the bitmap of its bucket."""
    at = slot.bitwiseAND((1 << BITMAP_SHIFT) - 1)
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1, F.lit(False))


def may_hold(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with the boolean ``name``: true for each row whose hash ``key`` is among ``keys`` (key), and by chance for few others.

    The filter is at most MAX_BITS / 8 bytes (32 MiB), so broadcasting it is bounded; beyond
    MAX_BITS / BITS_PER_KEY keys more rows are true by chance.
    """
    wanted = max(1, keys.count() * BITS_PER_KEY)
    size = min(MAX_BITS, max(MIN_BITS, 1 << (wanted - 1).bit_length()))
    slot, bucket, bits = f"{name}_slot", f"{name}_bucket", f"{name}_bits"
    side = F.broadcast(bitmaps(keys.select(F.pmod("key", F.lit(size)).alias("slot"))).select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)))
    met = df.withColumn(slot, F.pmod(key, F.lit(size))).join(side, F.shiftright(slot, BITMAP_SHIFT) == F.col(bucket), "left")
    return met.withColumn(name, bit(F.col(bits), F.col(slot))).drop(slot, bucket, bits)
