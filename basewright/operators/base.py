"""Tables and the sequence view that the operators work on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str, keep_r: bool = False) -> DataFrame:
    """file, domain, record_idx, seq derived from ``documents``; ``keep_r`` leaves R in every 17th record."""
    docs = table(spark, sf_dir, "documents")
    seq = F.regexp_replace(F.upper("text"), "[^ACGTN]", "")
    if keep_r:
        seq = F.when(F.col("doc_id") % 17 == 0, F.regexp_replace(F.upper("text"), "[^ACGTNR]", "")).otherwise(seq)
    # a generator keeps the optimizer from copying the expression into every filter and column that uses it
    return docs.select(F.col("source").alias("file"), F.col("lang").alias("domain"), F.col("doc_id").alias("record_idx"), F.explode(F.array(seq)).alias("seq"))


_folders: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that executors share: spark.checkpoint.dir, or a temporary one where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return f"{found.rstrip('/')}/basewright"
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = tempfile.mkdtemp(prefix="basewright-")
    return _folders[app]


#: Ranges that a distributed running total cuts its order into.
RANGES = 256


def running_total(df: DataFrame, order: str, values: dict[str, str], ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with, by name, the total of a column over all rows up to and including this one in ``order`` (a number).

    Ranges of about equal numbers of rows are summed first; a window then runs
    inside each range and adds what came before, so no task sees all rows.
    ``ties`` order equal values; without them equal values share a total.
    """
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    bounds = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    rows = df.withColumn("_range", F.size(F.filter(bounds, lambda b: b < F.col(order))))
    sums = rows.groupBy("_range").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in values.items()])
    over = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    starts = sums.select("_range", *[F.coalesce(F.sum(f"_s_{n}").over(over), F.lit(0)).alias(f"_b_{n}") for n in values])
    inside = Window.partitionBy("_range").orderBy(order, *ties)
    rows = rows.join(F.broadcast(starts), "_range")
    return rows.withColumns({n: F.col(f"_b_{n}") + F.sum(c).over(inside) for n, c in values.items()}).drop("_range", *[f"_b_{n}" for n in values])
