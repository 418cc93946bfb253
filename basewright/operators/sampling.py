"""Sampling, ordering and batching (F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewright.functions import draw


def round_robin(df: DataFrame, source: str, order: str) -> DataFrame:
    """``turn`` and, by (turn, source), the interleaved order of all sources until all are used up."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(source).orderBy(order)))


def weighted_draws(df: DataFrame, source: str, order: str, weights: dict[str, float], steps: int | None, seed: int) -> DataFrame:
    """step, source and its next row, sources drawn with replacement by weight.

    Names without a weight take that of ``*`` (1 if unset); empty sources have
    no share; a source that runs out starts again. Without ``steps`` an epoch
    is as long as the longest source. Sources are few; their table is the bins
    of a range join on the draw.
    """
    spark = df.sparkSession
    sizes = df.groupBy(source).agg(F.count("*").alias("n"))
    weight = F.lit(float(weights.get("*", 1.0)))
    for name, w in weights.items():
        if name != "*":
            weight = F.when(F.col(source) == name, float(w)).otherwise(weight)
    bins = sizes.withColumn("w", weight).where("w > 0")
    by_name = Window.orderBy(source)  # one row a source
    total = F.sum("w").over(Window.partitionBy())
    bins = bins.withColumn("hi", F.sum("w").over(by_name) / total).withColumn("lo", F.coalesce(F.lag("hi").over(by_name), F.lit(0.0)))
    bins = bins.withColumn("hi", F.when(F.lead("hi").over(by_name).isNull(), 1.0).otherwise(F.col("hi")))
    epoch = steps if steps is not None else sizes.agg(F.max("n")).first()[0] or 0
    ticks = spark.range(epoch).select(F.col("id").alias("step"), draw.uniform(seed, F.col("id")).alias("u"))
    picked = ticks.join(F.broadcast(bins.select(source, "n", "lo", "hi")), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    nth = F.row_number().over(Window.partitionBy(source).orderBy("step")) - 1
    picked = picked.withColumn("pos", (nth % F.col("n")).cast("int")).select("step", source, "pos")
    rows = df.withColumn("pos", (F.row_number().over(Window.partitionBy(source).orderBy(order)) - 1).cast("int"))
    return picked.join(rows, [source, "pos"])


def stratum_weights(df: DataFrame, gc: str = "gc") -> DataFrame:
    """one file's weight is 1 over the number of files in its GC decade; unknown GC counts as 50."""
    decade = (F.floor(F.coalesce(gc, F.lit(50.0)) / 10) * 10).cast("int")
    return df.withColumn("gc_bin", decade).withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("gc_bin")))


def length_batches(df: DataFrame, length: str, key: str, size: int, seed: int, skip: int = 0) -> DataFrame:
    """batches of neighbours in length order; ``batch_rank`` is the drawn order of batches from 0.

    The first ``skip`` batches of that order are left out (resuming). A
    partition's first place follows from counts per length, so no task orders
    all rows; equal lengths are numbered inside their length.
    """
    counts = df.groupBy(length).agg(F.count("*").alias("_c"))
    starts = counts.select(F.col(length).alias("_l"), (F.sum("_c").over(Window.orderBy(length)) - F.col("_c")).alias("_s"))  # one row a length
    rows = df.join(starts, F.col(length) == F.col("_l")).withColumn("_i", F.row_number().over(Window.partitionBy(length).orderBy(key)))
    rows = rows.withColumn("batch", F.floor((F.col("_s") + F.col("_i") - 1) / size).cast("long")).drop("_l", "_s", "_i")
    order = rows.select("batch").distinct().withColumn("batch_rank", (F.row_number().over(Window.orderBy(draw.uniform(seed, F.col("batch")), "batch")) - 1).cast("int"))
    return rows.join(order, "batch").where(F.col("batch_rank") >= skip)


def collate(df: DataFrame, batch: str, ids: str, max_length: int | None = None) -> DataFrame:
    """``ids`` padded with 0 to the longest of the batch, or to ``max_length``; ``mask`` says what is real."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    width = longest if max_length is None else F.greatest(longest, F.lit(max_length))
    fill = lambda n: F.array_repeat(F.lit(0), n)
    rows = df.withColumn("_w", width).withColumn("_p", F.col("_w") - F.size(ids))
    return rows.withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.size(ids)), fill(F.col("_p")))).withColumn(ids, F.concat(F.col(ids), fill(F.col("_p")))).drop("_w", "_p")


def reservoir(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows, every subset equally likely, whatever the partitioning."""
    return df.orderBy(draw.uniform(seed, F.col(key)), key).limit(k)


def every_nth(df: DataFrame, key: str, n: int, most: int | None = None) -> DataFrame:
    """rows whose key is a multiple of ``n``, at most so many in key order."""
    rows = df.where(F.col(key) % n == 0)
    return rows.orderBy(key).limit(most) if most is not None else rows


def resume(df: DataFrame, step: str, done: int) -> DataFrame:
    """F8: what is left of an epoch after ``done`` steps."""
    return df.where(F.col(step) >= done)


def class_weights(labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id, n, weight = mean(n) / n over the whole vocabulary, unseen ids counting as one."""
    counts = labels.groupBy("id").agg(F.count("*").alias("c"))
    rows = vocabulary.select("id").join(counts, "id", "left").withColumn("n", F.greatest(F.coalesce("c", F.lit(0)), F.lit(1)))
    return rows.select("id", "n", (F.avg("n").over(Window.partitionBy()) / F.col("n")).alias("weight"))


def mix_fractions(df: DataFrame, bucket: Column, label: str) -> DataFrame:
    """per step bucket the share of each label."""
    rows = df.groupBy(bucket.alias("bucket"), label).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("bucket")))
