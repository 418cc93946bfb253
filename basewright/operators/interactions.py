"""Interaction analysis: attention matrices as (i, j, w) rows (I)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mean_attention(df: DataFrame) -> DataFrame:
    """Layer, head, i, j, w averaged over the heads of each layer, then over layers."""
    per_layer = df.groupBy("layer", "i", "j").agg(F.avg("w").alias("w"))
    return per_layer.groupBy("i", "j").agg(F.avg("w").alias("w"))


def compressed_spans(tokens: DataFrame, stride: int, positions: int) -> DataFrame:
    """I, start, stop of each compressed position from pos, start, stop, attention; (0, 0) without bases."""
    real = tokens.where((F.col("attention") == 1) & (F.col("stop") > F.col("start")))
    spans = real.groupBy(F.floor(F.col("pos") / stride).cast("int").alias("i")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.sparkSession.range(positions).select(F.col("id").cast("int").alias("i")).join(spans, "i", "left").select("i", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("stop", F.lit(0)).alias("stop"))


def position_classes(tokens: DataFrame, stride: int) -> DataFrame:
    """I and its class: padding, special (only special tokens), mixed (special and bases) or bases."""
    real = F.col("attention") == 1
    base = real & (F.col("stop") > F.col("start"))
    rows = tokens.groupBy(F.floor(F.col("pos") / stride).cast("int").alias("i")).agg(F.sum(real.cast("int")).alias("r"), F.sum(base.cast("int")).alias("b"))
    return rows.select("i", F.when(F.col("r") == 0, "padding").when(F.col("b") == 0, "special").when(F.col("b") < F.col("r"), "mixed").otherwise("bases").alias("class"))


def normalize_rows(df: DataFrame) -> DataFrame:
    """Weights divided by their row's sum; rows that sum to 0 stay 0."""
    total = df.groupBy("i").agg(F.sum("w").alias("_t"))
    return df.join(total, "i").withColumn("w", F.coalesce(F.col("w") / F.nullif(F.col("_t"), F.lit(0.0)), F.lit(0.0))).drop("_t")


def remove_positions(df: DataFrame, removed: DataFrame) -> DataFrame:
    """I4: positions (i) removed as sources and as targets become 0; rows are normalised again."""
    out = removed.select("i").distinct().withColumn("_x", F.lit(True))
    rows = df.join(out, "i", "left").withColumnRenamed("_x", "_xi").join(out.withColumnRenamed("i", "j"), "j", "left")
    return normalize_rows(rows.select("i", "j", F.when(F.col("_xi").isNull() & F.col("_x").isNull(), F.col("w")).otherwise(0.0).alias("w")))


def uniform_bins(df_session: DataFrame, length: int, max_bins: int) -> DataFrame:
    """b, lo, hi: min(max_bins, length) bins of equal width."""
    n = max(1, min(max_bins, length))
    return df_session.sparkSession.range(n).select(F.col("id").cast("int").alias("b"), (F.col("id") * float(length) / n).alias("lo"), ((F.col("id") + 1) * float(length) / n).alias("hi"))


def bin_overlaps(spans: DataFrame, length: int, max_bins: int) -> DataFrame:
    """I, b, share of the span that lies in the bin.

    A span knows the first and last bin it meets, so it is exploded into them
    instead of compared with all bins.
    """
    n = max(1, min(max_bins, length))
    width = float(length) / n
    first = F.greatest(F.floor(F.col("start") / width), F.lit(0)).cast("int")
    last = F.least(F.ceil(F.col("stop") / width) - 1, F.lit(n - 1)).cast("int")
    rows = spans.where((F.col("stop") > F.col("start")) & (F.col("start") < length)).select("i", "start", "stop", F.explode(F.sequence(first, last)).alias("b"))
    overlap = F.least(F.col("stop"), (F.col("b") + 1) * width) - F.greatest(F.col("start"), F.col("b") * width)
    return rows.select("i", "b", (overlap / (F.col("stop") - F.col("start"))).alias("p")).where("p > 0")


def project(df: DataFrame, overlaps: DataFrame, normalize: bool = True) -> DataFrame:
    """The matrix between bins, transposed overlaps times weights times overlaps, rows normalised."""
    left = df.join(overlaps.select("i", F.col("b").alias("bi"), F.col("p").alias("pi")), "i").groupBy("bi", "j").agg(F.sum(F.col("w") * F.col("pi")).alias("w"))
    right = overlaps.select(F.col("i").alias("j"), F.col("b").alias("bj"), F.col("p").alias("pj"))
    rows = left.join(right, "j").groupBy(F.col("bi").alias("i"), F.col("bj").alias("j")).agg(F.sum(F.col("w") * F.col("pj")).alias("w"))
    return normalize_rows(rows) if normalize else rows


def hide_edges(df: DataFrame, n: int, edge: int) -> DataFrame:
    """Weights of the outer ``edge`` rows and columns become null (at most half of them)."""
    e = min(edge, n // 2)
    inside = F.col("i").between(e, n - 1 - e) & F.col("j").between(e, n - 1 - e)
    return df.withColumn("w", F.when(inside, F.col("w")))


def top_pairs(df: DataFrame, k: int) -> DataFrame:
    """I8: the k pairs of largest weight with their rank; ties by (i, j)."""
    best = df.where(F.col("w").isNotNull() & ~F.isnan("w")).orderBy(F.desc("w"), "i", "j").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("w"), "i", "j")))  # k rows


def colour_bounds(df: DataFrame, percentile: float = 0.99) -> DataFrame:
    """Least positive and the percentile of the positive weights, exact."""
    good = df.where((F.col("w") > 0) & (F.col("w") < float("inf")))
    return good.agg(F.min("w").alias("vmin"), F.percentile("w", F.lit(percentile)).alias("vmax"))
