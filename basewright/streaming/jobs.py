"""Structured Streaming forms of the incremental operators (T).

Every function takes a streaming DataFrame and returns one; ``run_available``
drains what is there into a Parquet table and gives it back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from basewright.functions import dna
from basewright.operators.base import scratch


def stream_table(spark: SparkSession, sf_dir: str, name: str, per_trigger: int = 1000) -> DataFrame:
    """A table of the input folder as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{sf_dir}/{name}.parquet*")


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Process all that is available; exactly-once by batch number.

    ``append``: a batch's rows go to a folder of their own that a retry
    overwrites. ``complete``: each batch replaces the result.
    """
    spark = df.sparkSession
    base = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        folder = f"{base}/out/batch={number if mode != 'complete' else 0}"
        batch.write.mode("overwrite").parquet(folder)

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/batch=*").drop("batch")


def first_by_hash(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The first arrival of each strand-invariant hash."""
    return df.withColumn("hash", dna.canonical_hash(F.col(seq))).dropDuplicates(["hash"])


def quota(df: DataFrame, key: str, order: str, size: str, cap: int) -> DataFrame:
    """Rows accepted under a cap per key (E11); the running total is the state. Rows of a batch go in ``order``."""
    out = f"{key} {dict(df.dtypes)[key]}, {order} long, {size} double"

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values(order)
        kept = []
        for row in rows[[key, order, size]].itertuples(index=False):
            if total + row[2] <= cap:
                total += row[2]
                kept.append(row)
        state.update((total,))
        yield pd.DataFrame(kept, columns=[key, order, size])

    return df.groupBy(key).applyInPandasWithState(fold, out, "total double", "append", GroupStateTimeout.NoTimeout)


def running_best(df: DataFrame, key: str, step: str, loss: str) -> DataFrame:
    """Best and latest so far per run (J5, J12); complete mode."""
    return df.groupBy(key).agg(F.min(loss).alias("best_loss"), F.max(step).alias("latest_step"), F.count("*").alias("rows"))


def step_buckets(df: DataFrame, step: str, interval: int, *by: str) -> DataFrame:
    """T4: counters per step bucket (F11); complete mode."""
    return df.groupBy(F.floor(F.col(step) / interval).cast("long").alias("bucket"), *by).count().withColumnRenamed("count", "n")


def windowed(df: DataFrame, time: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """T5 (an extension): counts and sums per tumbling or sliding event-time window; late rows go by the watermark."""
    rows = df.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    span = F.window("_t", length, slide) if slide else F.window("_t", length)
    out = rows.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(df: DataFrame, time: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """T5 (an extension): sessions of a key, split by a gap of event time."""
    rows = df.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = rows.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "n")


def history_sink(df: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Append transformed rows to a history, once per batch."""
    return run_available(transform(df))
