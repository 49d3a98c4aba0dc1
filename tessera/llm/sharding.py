"""Sharding by jump consistent hashing, in DataFrame functions only.

A row's key seeds the 64-bit linear congruential generator of the published
method; its outputs give the shard counts at which the key would move. The shard
for ``n`` is the last of those below ``n``, so with one more shard a key stays or
moves into the new one. No ring table exists and no row depends on another.

Slots number the rows of a shard without gaps. Rows of a shard are dealt into
hash buckets, numbered inside a bucket by a window, and shifted by the sum of the
bucket sizes before it; no task ever holds a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one bucket holds on average at most.
BUCKET_ROWS = 50_000
#: Buckets per shard at least.
LEAST_BUCKETS = 64
#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757


def jump_hash(key: Column, n: int) -> Column:
    """struct(shard for n shards, grown shard for n + 1). A null key counts as key 0."""
    k = F.coalesce(key.cast("bigint"), F.lit(0)).cast("decimal(20,0)")
    seed = F.when(k < 0, k + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(k).cast("decimal(20,0)")

    def step(acc: Column, _: Column) -> Column:
        product = acc["key"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")
        return F.struct(
            F.when(acc["j"] < n, acc["j"]).otherwise(acc["b"]).alias("b"),
            acc["j"].alias("g"),
            acc["j"].alias("j"),
            F.pmod(product, F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)").alias("key"),
        )

    def jumped(acc: Column) -> Column:
        high = F.floor(acc["key"] / F.lit("8589934592").cast("decimal(10,0)")).cast("bigint")
        # the quotient is below 2^31, so the division's rounding can't reach the next whole number
        j = F.floor((acc["j"] + 1) * (F.lit(2147483648.0) / (high + 1).cast("double"))).cast("bigint")
        return F.struct(acc["b"].alias("b"), acc["g"].alias("g"), j.alias("j"), acc["key"].alias("key"))

    start = F.struct(F.lit(-1).cast("bigint").alias("b"), F.lit(-1).cast("bigint").alias("g"), F.lit(0).cast("bigint").alias("j"), seed.alias("key"))
    # every step raises j by one at least, so n + 1 steps always suffice; finished rows only pass through
    return F.aggregate(F.sequence(F.lit(1), F.lit(n + 1)), start, lambda acc, x: F.when(acc["j"] > n, acc).otherwise(jumped(step(acc, x))))


def assign_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, slot and sizes of every row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    * null text: size 16, checksum 0, as for an empty text
    * null id: key 0; it is numbered before other ids of its bucket; buckets within a shard are dealt by id and text
    * repeated ids share a shard; equal rows get different slots, all the same in the set of results
    * an empty table gives no rows; other columns of the input are not read
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(raw).cast("bigint") + 16).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        jump_hash(F.col(id_col), n_shards).alias("jump"),
    )
    rows = rows.select("doc_id", "size", "text_crc32", F.col("jump.b").cast("int").alias("shard"), F.col("jump.g").cast("int").alias("grown_shard"))
    n = docs.count()
    buckets = max(LEAST_BUCKETS, -(-n // (n_shards * BUCKET_ROWS)))
    # by id and text: rows of one id, or of none, spread over all buckets
    digest = F.substring(F.md5(F.concat_ws(":", "doc_id", "text_crc32").cast("binary")), 1, 8)
    rows = rows.withColumn("bucket", (F.conv(digest, 16, 10).cast("bigint") % buckets).cast("int"))
    sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("at")).cast("bigint").alias("slot"), "grown_shard"
    )
