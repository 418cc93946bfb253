"""Evaluation metrics (H). Inputs are rows of label, prediction and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewright.operators.base import running_total

EDGES = 10


def token_loss(df: DataFrame, *by: str) -> DataFrame:
    """H1: tokens, mean loss, accuracy and perplexity (infinite where it overflows)."""
    rows = df.groupBy(*by).agg(F.count("*").alias("tokens"), F.avg("loss").alias("loss"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))
    return rows.withColumn("ppl", F.exp("loss"))


def base_loss(df: DataFrame, *by: str) -> DataFrame:
    """H2: loss per base, bits per base and base perplexity; rows have ``loss`` and ``base_len``."""
    rows = df.groupBy(*by).agg(F.sum("base_len").alias("bases"), F.sum("loss").alias("_l"))
    rows = rows.withColumn("base_loss", F.coalesce(F.col("_l") / F.nullif(F.col("bases"), F.lit(0)), F.lit(0.0)))
    return rows.withColumn("bits_per_base", F.col("base_loss") / F.ln(F.lit(2.0))).withColumn("base_ppl", F.exp("base_loss")).drop("_l")


def calibration_error(df: DataFrame, *by: str) -> DataFrame:
    """H3: ECE over ten confidence buckets; rows have ``conf`` and ``correct`` (0 or 1)."""
    bucket = F.least(F.floor(F.col("conf") * EDGES), F.lit(EDGES - 1)).cast("int").alias("_b")
    rows = df.groupBy(*by, bucket).agg(F.count("*").alias("_n"), F.avg("conf").alias("_c"), F.avg("correct").alias("_a"))
    return rows.groupBy(*by).agg((F.sum(F.col("_n") * F.abs(F.col("_c") - F.col("_a"))) / F.sum("_n")).alias("ece"))


def per_class_accuracy(df: DataFrame, classes: list[str]) -> DataFrame:
    """H4: class, support, accuracy; a class without support has a null accuracy."""
    known = F.broadcast(df.sparkSession.createDataFrame([(c,) for c in classes], "class string"))
    rows = df.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))
    return known.join(rows, F.col("class") == F.col("label"), "left").select("class", F.coalesce("n", F.lit(0)).alias("support"), "accuracy")


def classification(df: DataFrame) -> DataFrame:
    """H5: n, accuracy, macro F1 over all classes seen, and multi-class MCC (0 where it is undefined)."""
    pairs = df.groupBy("label", "pred").agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("t")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("t")))).alias("x"), "n", (F.col("label") == F.col("pred")).alias("hit"))
    per = sides.groupBy("x.c").agg(
        F.sum(F.when(F.col("x.t") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("x.t") == 0, F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("hit") & (F.col("x.t") == 1), F.col("n")).otherwise(0)).alias("tp"),
    )
    d = lambda c: F.col(c).cast("double")
    f1 = F.coalesce(2 * d("tp") / F.nullif(d("t") + d("p"), F.lit(0.0)), F.lit(0.0))
    total = per.agg(F.sum("t").cast("double").alias("s"), F.sum("tp").cast("double").alias("c"), F.avg(f1).alias("macro_f1"), F.sum(d("t") * d("p")).alias("tp"), F.sum(d("t") * d("t")).alias("tt"), F.sum(d("p") * d("p")).alias("pp"))
    s, c = F.col("s"), F.col("c")
    under = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    mcc = F.coalesce((c * s - F.col("tp")) / F.nullif(under, F.lit(0.0)), F.lit(0.0))
    return total.select(s.cast("long").alias("n"), (c / s).alias("accuracy"), "macro_f1", mcc.alias("mcc"))


def _score_levels(df: DataFrame) -> DataFrame:
    """Counts of positives and negatives per distinct score, with those of all scores not below it."""
    levels = df.groupBy("score").agg(F.sum("label").cast("double").alias("pos"), F.sum(1 - F.col("label")).cast("double").alias("neg"))
    return running_total(levels.withColumn("_down", -F.col("score")), "_down", {"pos_upto": "pos", "neg_upto": "neg"})


def ranking(df: DataFrame) -> DataFrame:
    """H6: AUROC (ties count half) and average precision (step-wise); null unless both classes occur.

    ``df``: score, label (0 or 1).
    """
    rows = _score_levels(df)
    total = rows.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum(F.col("neg") * (F.col("pos_upto") - F.col("pos") / 2)).alias("u"), F.sum(F.col("pos") * F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))).alias("a"))
    both = (F.col("p") > 0) & (F.col("q") > 0)
    return total.select(F.when(both, F.col("u") / (F.col("p") * F.col("q"))).alias("auroc"), F.when(both, F.col("a") / F.col("p")).alias("auprc"))


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """H9: 0-based ranks, ties averaged. Counted per distinct value, then joined."""
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    below = F.col("_upto") - F.col("_n")
    ranks = running_total(counts, "_v", {"_upto": "_n"}).select("_v", (below + (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, F.col(value) == F.col("_v")).drop("_v")


def regression(df: DataFrame) -> DataFrame:
    """H7: n, r2, pearson, spearman of y and pred; null for fewer than two rows or no variance."""
    ranked = average_ranks(average_ranks(df, "y", "_ry"), "pred", "_rp")
    one = ranked.agg(
        F.count("*").alias("n"),
        F.var_pop("y").alias("_vy"),
        F.var_pop("pred").alias("_vp"),
        F.avg((F.col("y") - F.col("pred")) ** 2).alias("_e"),
        F.covar_pop("y", "pred").alias("_c"),
        F.covar_pop("_ry", "_rp").alias("_cr"),
        F.var_pop("_ry").alias("_vry"),
        F.var_pop("_rp").alias("_vrp"),
    )
    ok = (F.col("n") >= 2) & (F.col("_vy") > 0) & (F.col("_vp") > 0)
    r2 = F.when((F.col("n") >= 2) & (F.col("_vy") > 0), 1 - F.col("_e") / F.col("_vy"))
    return one.select("n", r2.alias("r2"), F.when(ok, F.col("_c") / F.sqrt(F.col("_vy") * F.col("_vp"))).alias("pearson"), F.when(ok, F.col("_cr") / F.sqrt(F.col("_vry") * F.col("_vrp"))).alias("spearman"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def vector_agreement(a: Column, b: Column) -> Column:
    """struct(cosine, l2): cosine similarity and distance over the root of the dimension."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = _sum(F.zip_with(x, y, lambda p, q: p * q))
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda p: p * p)))
    l2 = F.sqrt(_sum(F.zip_with(x, y, lambda p, q: (p - q) * (p - q))) / F.size(x))
    return F.struct((dot / F.greatest(norm(x) * norm(y), F.lit(1e-12))).alias("cosine"), l2.alias("l2"))


def pooled(df: DataFrame, by: str, vector: str, mask: str | None = None, mode: str = "mean", order: str | None = None) -> DataFrame:
    """One vector per group: masked mean, or the first (cls) or last row's."""
    if mode in ("cls", "last"):
        pick = F.min_by if mode == "cls" else F.max_by
        return df.groupBy(by).agg(pick(vector, order).alias("pooled"))
    keep = df if mask is None else df.where(F.col(mask) == 1)
    each = keep.select(by, F.posexplode(vector).alias("pos", "v")).groupBy(by, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("pooled"))


def distillation(df: DataFrame, teacher: str, student: str) -> DataFrame:
    """Mean Kullback-Leibler divergence of two probability arrays."""
    term = F.zip_with(teacher, student, lambda p, q: F.when(p > 0, p * (F.ln(p) - F.ln(F.greatest(q, F.lit(1e-12))))).otherwise(0.0))
    return df.agg(F.avg(_sum(term)).alias("kl"))


def weighted_bce(df: DataFrame) -> DataFrame:
    """Mean binary cross-entropy of ``prob`` for ``label``, positives weighted by negatives over positives, at most 100."""
    n = df.agg(F.sum(F.col("label").cast("double")).alias("_p"), F.count("*").alias("_n"))
    rows = df.crossJoin(F.broadcast(n)).withColumn("_w", F.least((F.col("_n") - F.col("_p")) / F.greatest(F.col("_p"), F.lit(1.0)), F.lit(100.0)))
    p = F.least(F.greatest("prob", F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = -(F.col("_w") * F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p))
    return rows.agg(F.avg(loss).alias("bce"), F.max("_w").alias("pos_weight"))


def mean_squared(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean squared difference of two vectors."""
    return df.agg(F.avg(_sum(F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda p, q: (p - q) * (p - q))) / F.size(a)).alias("mse"))
