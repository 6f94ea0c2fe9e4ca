"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard bids for a key with -weight / ln(u), u in (0, 1) from a hash of key and shard; the highest bid takes it. A
shard that is added only takes what it outbids the others for, so no other record moves; a larger weight takes in proportion.

A null key hashes like a key of its own and so has one shard. Rows that repeat a key share its shard and have slots of
their own. An empty table gives no rows, an empty or null text a size of 1. Texts of any length are only measured and
hashed. Columns besides the key are not returned, whatever their names; the assignment joins back by the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import Store

#: Parts that the rows of a shard are numbered in: at 100 TB some millions of rows each; the broadcast counts are 24 bytes
#: for each part and shard.
BUCKETS = 2048
#: Slots that one row of a repeated record is given at once.
PIECE = 100_000


def bid(key: Column, shard: int, weight: float) -> Column:
    """Of 53 hash bits, halfway between two steps so that neither 0 nor 1 occurs."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(2**53)
    return -F.lit(float(weight)) / F.ln(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest bid; the lower number if two bids are equal. Weights must be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    bids = [F.struct(bid(key, s, w).alias("bid"), F.lit(-s).alias("minus")) for s, w in enumerate(weights)]
    return (-(F.greatest(*bids) if len(bids) > 1 else bids[0])["minus"]).cast("int")


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, piece: int = PIECE) -> DataFrame:
    """Per row: key, size, text_crc32, shard, slot (gapless from 0 in each shard), grown_shard (with the weights `grown`).

    Slots come in two steps, as a shard may hold a third of all rows: keys fall into `buckets` buckets by hash, rows are
    numbered inside (shard, bucket), and the buckets' row counts (a small table) give each its first slot. They depend on
    the rows, the weights and the number of buckets, and on no setting of the session.
    """
    raw = F.col(text).cast("string").cast("binary")
    rows = docs.select(F.col(key), (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"))
    placed = rows.groupBy(key, "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    placed = placed.withColumn("shard", shard_of(F.col(key), weights)).withColumn("grown_shard", shard_of(F.col(key), grown) if grown else F.lit(None).cast("int"))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(buckets)).cast("int"))
    held = placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("held"))
    first = held.withColumn("first", F.sum("held").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("held")).select("shard", "bucket", "first")
    inside = Window.partitionBy("shard", "bucket").orderBy(key, "text_crc32", "size")
    numbered = placed.withColumn("before", F.sum("copies").over(inside) - F.col("copies")).join(F.broadcast(first), ["shard", "bucket"])  # shards x buckets rows
    # a row that stands often is numbered in pieces, each a row of its own when they are dealt to tasks
    numbered = Store(docs.sparkSession, "slots").put(numbered)
    many = numbered.where(F.col("copies") > piece).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / piece)))).repartition(key, "piece")
    last = F.least(F.col("copies"), (F.col("piece") + 1) * piece) - 1
    slots = numbered.where(F.col("copies") <= piece).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    slots = slots.unionByName(many.withColumn("nth", F.explode(F.sequence(F.col("piece") * piece, last))).drop("piece"))
    return slots.select(key, "size", "text_crc32", "shard", (F.col("first") + F.col("before") + F.col("nth")).alias("slot"), "grown_shard")
