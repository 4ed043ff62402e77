"""Sharding by jump consistent hashing (Lamping and Veach, 2014), as Spark column expressions.

A stable 64-bit key and the number of shards alone decide a row's shard, so no ring table exists and
appending a shard moves only the rows that land in the new one (about 1 in n+1).

Defined cases: a null key counts as key 0; null text has size 1 and the CRC-32 of the empty text;
repeated rows are placed one by one and get slots of their own; an empty table gives an empty result;
other columns of the input are ignored by :func:`place`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.text import let

# The paper's 64-bit generator: key = key * MULTIPLIER + 1 (modulo 2**64).
MULTIPLIER = 2862933555777941757
LOW = (1 << 22) - 1
TOP = (1 << 20) - 1
M0, M1, M2 = MULTIPLIER & LOW, MULTIPLIER >> 22 & LOW, MULTIPLIER >> 44


def _next_key(s: Column) -> Column:
    """One generator step on limbs of 22, 22 and 20 bits, whose products cannot overflow a long."""
    t0 = s["k0"] * M0 + 1

    def middle(c0):
        return s["k1"] * M0 + s["k0"] * M1 + F.shiftright(c0, 22)

    return let(
        t0,
        lambda c0: let(
            middle(c0),
            lambda c1: F.struct(
                c0.bitwiseAND(LOW).alias("k0"),
                c1.bitwiseAND(LOW).alias("k1"),
                (s["k2"] * M0 + s["k1"] * M1 + s["k0"] * M2 + F.shiftright(c1, 22)).bitwiseAND(TOP).alias("k2"),
            ),
        ),
    )


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (0 to ``shards`` - 1) of a long key."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        key.bitwiseAND(LOW).alias("k0"),
        F.shiftrightunsigned(key, 22).bitwiseAND(LOW).alias("k1"),
        F.shiftrightunsigned(key, 44).alias("k2"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def step(s: Column, _: Column) -> Column:
        def jumped(k: Column) -> Column:
            high = F.shiftright(k["k1"], 11).bitwiseOR(F.shiftleft(k["k2"], 11))  # key >> 33
            ahead = (s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1).cast("double"))
            return F.struct(k["k0"].alias("k0"), k["k1"].alias("k1"), k["k2"].alias("k2"), s["j"].alias("b"), F.floor(ahead).cast("long").alias("j"))

        return F.when(s["j"] >= shards, s).otherwise(let(_next_key(s), jumped))

    # Every jump goes ahead by one shard at least, so `shards` steps always suffice.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def place(docs: DataFrame, shards: int = 16, blocks: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every row: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    Slots are gapless from 0 in each shard. They come from two levels: rows are numbered inside one of
    ``blocks`` hash blocks of their shard, and the blocks' row counts, at most shards x blocks numbers,
    are summed ahead of each block. No task ever holds a whole shard.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = rows.select(
        "*",
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
        # size and checksum spread rows whose keys are equal or null
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(blocks)).alias("block"),
    )
    ahead = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
        .select("shard", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(inside))
    return numbered.join(starts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("place") - 1).alias("slot"), "grown_shard",
    )


def brute_force(key: int, shards: int) -> int:
    """The published loop on one key, for tests."""
    key, b, j = key & ((1 << 64) - 1), -1, 0
    while j < shards:
        b = j
        key = (key * MULTIPLIER + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b
