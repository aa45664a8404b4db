"""Operator 5: sharding by jump consistent hashing, in DataFrame functions only.

The published generator steps a 64-bit state by ``key * 2862933555777941757 + 1``. Spark's long arithmetic raises on
overflow, so the state is held as three limbs of 20, 22 and 22 bits, whose products fit a long.

Defined results: a null key counts as one fixed key; equal keys share a shard; null texts have no bytes; rows that
agree in key, size and checksum take neighbouring slots in any order; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The generator's multiplier, in limbs of 20, 22 and 22 bits.
MULTIPLIER = 2862933555777941757
LOW = (1 << 22) - 1
TOP = (1 << 20) - 1
C0, C1, C2 = MULTIPLIER & LOW, MULTIPLIER >> 22 & LOW, MULTIPLIER >> 44 & TOP
#: Jumps tried on every row. A row that needs more (hardly any) goes through the rest, up to one for each shard.
JUMPS = 40
#: Rows for each numbered block of a shard, about.
BLOCK_ROWS = 20_000


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key, 0 to ``shards`` - 1; one more shard moves rows only into itself."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(
        key.bitwiseAND(long(LOW)).alias("k0"),
        F.shiftrightunsigned(key, 22).bitwiseAND(long(LOW)).alias("k1"),
        F.shiftrightunsigned(key, 44).alias("k2"),
        long(-1).alias("b"),
        long(0).alias("j"),
    )

    def step(s: Column, _: Column) -> Column:
        p0 = s["k0"] * C0 + 1
        p1 = s["k0"] * C1 + s["k1"] * C0 + F.shiftright(p0, 22)
        p2 = s["k0"] * C2 + s["k1"] * C1 + s["k2"] * C0 + F.shiftright(p1, 22)
        k0, k1, k2 = p0.bitwiseAND(long(LOW)), p1.bitwiseAND(long(LOW)), p2.bitwiseAND(long(TOP))
        high = k2 * 2048 + F.shiftright(k1, 11)  # the state's upper 31 bits
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1).cast("double")))
        return F.when(s["j"] >= shards, s).otherwise(F.struct(k0.alias("k0"), k1.alias("k1"), k2.alias("k2"), s["j"].alias("b"), j.alias("j")))

    first = min(JUMPS, shards)
    state = F.aggregate(F.sequence(F.lit(1), F.lit(first)), start, step)
    if first == shards:
        return F.aggregate(F.sequence(F.lit(1), F.lit(first)), start, step, lambda s: s["b"].cast("int"))
    rest = lambda s: F.aggregate(F.sequence(F.lit(first + 1), F.lit(shards)), s, step)["b"]
    return F.element_at(F.transform(F.array(state), lambda s: F.when(s["j"] >= shards, s["b"]).otherwise(rest(s))), 1).cast("int")


def stable_key(column: Column) -> Column:
    """A well-mixed 64-bit key of any value; null has a key of its own."""
    return F.xxhash64(F.coalesce(column.cast("string"), F.lit("null key")))


def numbered(df: DataFrame, group: str, order: list[str], rows: int) -> DataFrame:
    """Adds ``slot``: 0, 1, ... within each ``group``, without bringing a group's rows into one task.

    Rows of a group are dealt to blocks by a hash; counts by block (a small table) give each block its first number.
    """
    blocks = max(32, -(-rows // BLOCK_ROWS))
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    counts = dealt.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(group, "_block").orderBy(*order))
    return dealt.withColumn("_row", within).join(first, [group, "_block"]).withColumn("slot", F.col("_first") + F.col("_row") - 1).drop("_block", "_row", "_first")


def shard_by_key(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, gapless slot in it, and the shard after one more is appended, for every row."""
    raw = F.encode(F.col(text), "utf-8")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        stable_key(F.col(key)).alias("_key"),
    )
    placed = rows.select("doc_id", "size", "text_crc32", jump_hash(F.col("_key"), shards).alias("shard"), jump_hash(F.col("_key"), shards + 1).alias("grown_shard"))
    # the count is read from the files' footers
    return numbered(placed, "shard", ["doc_id", "size", "text_crc32"], -(-docs.count() // shards))


def op5_jump(docs: DataFrame, shards: int = 24) -> DataFrame:
    """All documents in shards 0 to 23 by the law ``key``."""
    out = shard_by_key(docs, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
