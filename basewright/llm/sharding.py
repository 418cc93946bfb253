"""Sharding by weighted rendezvous hashing of stable record keys.

Each (key, shard) pair gets a uniform draw u from a digest; the shard with the
smallest ``-ln(u) / weight`` takes the record. A shard's draws don't depend on
the other shards, so adding one moves rows only into it, and the share of a
shard is its weight over the sum of weights.

Edge cases: a null key counts as the empty key; equal keys go to one shard;
null text has no bytes; an empty table gives an empty result; input columns
named like an output are left out of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewright.llm.common import small, stored, table

#: Rows that one slot bucket holds on average.
BUCKET_ROWS = 20_000


def _cost(key: Column, shard: Column, weight: Column, salt: str) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(salt), F.coalesce(key.cast("string"), F.lit("")), shard.cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.ln(u) / weight


def rendezvous(key: Column, weights: Sequence[float], salt: str = "") -> Column:
    """The shard number (0 to ``len(weights) - 1``) of ``key``; weights are positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    costs = F.transform(shards, lambda s: F.struct(_cost(key, s["shard"], s["weight"], salt).alias("cost"), s["shard"].alias("shard")))
    return F.array_min(costs)["shard"].cast("int")


def assign_shards(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    weights: Sequence[float] = (1.0,) * 24,
    salt: str = "",
    grown_weight: float = 1.0,
) -> DataFrame:
    """Per row: key, size, text_crc32, shard, slot and the shard under one more shard.

    ``slot`` numbers the rows of a shard without gaps, in the order of a digest of
    key and checksum. Rows are numbered inside
    (shard, bucket) groups of bounded size and shifted by the counts of the
    buckets before, so no task sees a whole shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    buckets = max(1, df.count() // (BUCKET_ROWS * len(weights)) + 1)
    rows = df.select(
        F.col(key).alias(key),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights, salt).alias("shard"),
    )
    extra = _cost(F.col(key), F.lit(len(weights)), F.lit(float(grown_weight)), salt)
    chosen = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("shard") + 1)
    rows = rows.withColumn("grown_shard", F.when(extra < _cost(F.col(key), F.col("shard"), chosen, salt), F.lit(len(weights))).otherwise(F.col("shard")).cast("int"))
    # the checksum spreads a key that fills many rows; buckets are ranges of the order
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("text_crc32").cast("string")).cast("binary"))
    bucket = F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / float(2**32) * buckets).cast("long")
    rows = stored(rows.withColumn("_order", order).withColumn("_bucket", bucket), "shards")
    sizes = rows.groupBy("shard", "_bucket").count()
    before = sizes.select("shard", "_bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("count")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_order", key, "size"))
    return (
        rows.withColumn("_place", place)
        .join(small(stored(before, "slots")), ["shard", "_bucket"])
        .select(key, "size", "text_crc32", "shard", (F.col("_before") + F.col("_place") - 1).cast("long").alias("slot"), "grown_shard")
    )


def write_shards(df: DataFrame, path: str, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 24, salt: str = "") -> None:
    """Write ``df`` as Parquet folders ``shard=N``; the rows of a shard may span files."""
    df.withColumn("shard", rendezvous(F.col(key), weights, salt)).repartition("shard").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
