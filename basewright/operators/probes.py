"""Fitted probes and the scorer interface."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.functions import draw
from basewright.operators import metrics, tokens, windows
from basewright.operators.base import scratch


def train_test(df: DataFrame, label: str, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    rows = windows.stratified_split(df, label, key, seed)
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")


def _scaled(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    vec = lambda d: d.withColumn("_v", array_to_vector(F.col("features").cast("array<double>")))
    model = StandardScaler(inputCol="_v", outputCol="_x", withMean=True).fit(vec(train))
    return model.transform(vec(train)), model.transform(vec(test))


def unseen_labels(train: DataFrame, test: DataFrame) -> DataFrame:
    """H8: labels of the test side that the train side lacks."""
    return test.select("label").distinct().exceptAll(train.select("label").distinct())


def classification_probe(train: DataFrame, test: DataFrame) -> DataFrame:
    """H8: scale, balanced logistic regression, then n, accuracy, macro_f1, mcc on the test side."""
    if missing := [r[0] for r in unseen_labels(train, test).limit(5).collect()]:
        raise ValueError(f"test labels without training rows: {missing}")
    index = StringIndexer(inputCol="label", outputCol="_y").fit(train)
    a, b = (index.transform(d) for d in _scaled(train, test))
    counts = a.groupBy("_y").agg(F.count("*").alias("_c"))
    n, k = a.count(), counts.count()
    a = a.join(F.broadcast(counts), "_y").withColumn("_w", F.lit(float(n)) / (k * F.col("_c")))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / n, maxIter=200, standardization=False).fit(a)
    return metrics.classification(model.transform(b).select(F.col("_y").alias("label"), F.col("prediction").alias("pred")))


def regression_probe(train: DataFrame, test: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Scale, ridge regression, then n, r2, pearson, spearman on the test side."""
    a, b = _scaled(train, test)
    model = LinearRegression(featuresCol="_x", labelCol="y", solver="normal", regParam=alpha / max(1, a.count()), elasticNetParam=0.0, standardization=False).fit(a)
    return metrics.regression(model.transform(b).select("y", F.col("prediction").alias("pred")))


def handcrafted_suite(df: DataFrame, label_columns: list[str], seed: int = 3) -> DataFrame:
    """One row per label column: the probe on length, GC and 3-mer shares, and on drawn features."""
    path = f"{scratch(df.sparkSession)}/probes-{uuid.uuid4().hex}"

    def stored(rows: DataFrame, name: str) -> DataFrame:
        """Written and read back, since each step of each fit reads its rows anew."""
        rows.write.parquet(f"{path}/{name}")
        return df.sparkSession.read.schema(rows.schema).parquet(f"{path}/{name}")

    feats = tokens.kmer_features(df).select("file", "record_idx", F.concat(F.array(F.col("length").cast("double"), "gc"), F.col("freqs")).alias("handcrafted"))
    noise = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: draw.uniform(seed, F.col("record_idx"), i))
    feats = stored(feats.withColumn("random", noise), "features")
    labels, out = stored(df.select("file", "record_idx", *label_columns), "labels"), None
    for i, name in enumerate(label_columns):
        rows = labels.select("file", "record_idx", F.col(name).alias("label"))
        split = windows.stratified_split(rows, "label", "record_idx", seed).join(feats, ["file", "record_idx"])
        split = stored(split, f"split-{i}")
        for kind in ("handcrafted", "random"):
            train, test = (split.where(F.col("split") == side).select("label", F.col(kind).alias("features")) for side in ("train", "test"))
            one = classification_probe(train, test).select(F.lit(name).alias("dataset"), F.lit(kind).alias("probe"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def scorer(fn: Callable[[list[str]], list[np.ndarray]], name: str = "log_probs"):
    """K: wrap ``fn`` (sequences to one log-probability a position) as an Arrow UDF."""

    @F.pandas_udf("array<double>")
    def run(seqs: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, float).tolist() for x in fn([s or "" for s in seqs])])

    return run


_TOKENIZERS: dict[str, Callable] = {}


def register_tokenizer(name: str, factory: Callable) -> None:
    """K: make a tokenizer factory known by name; ``factory()`` gives a Column function."""
    _TOKENIZERS[name] = factory


def tokenizer(name: str):
    if name not in _TOKENIZERS:
        raise ValueError(f"no tokenizer named {name}; known: {sorted(_TOKENIZERS)}")
    return _TOKENIZERS[name]()


register_tokenizer("base", lambda: tokens.encode_base)


def markov_model(df: DataFrame, k: int = 3) -> dict[str, float]:
    """The reference scorer: log shares of the last base given the ones before it, from k-mer counts (at most 4^k)."""
    counts = {r["kmer"]: r["n"] for r in tokens.kmer_counts(df.select(F.lit("").alias("file"), "record_idx", "seq"), k).collect()}
    words = [""]
    for _ in range(k):
        words = [w + b for w in words for b in "ACGT"]
    total = {w[:-1]: 0 for w in words}
    for w in words:
        total[w[:-1]] += counts.get(w, 0) + 1
    return {w: float(np.log((counts.get(w, 0) + 1) / total[w[:-1]])) for w in words}


def markov_scores(model: dict[str, float]):
    k = len(next(iter(model)))

    def run(seqs: list[str]) -> list[np.ndarray]:
        return [np.array([model.get(s[i - k + 1 : i + 1], np.log(0.25)) if i >= k - 1 else np.log(0.25) for i in range(len(s))]) for s in seqs]

    return run


def pseudo_nll(df: DataFrame, key: str, model: dict[str, float]) -> DataFrame:
    """Positions and mean negative log probability over the bases of each sequence; empty ones are left out."""
    rows = df.where(F.length("seq") > 0).select(key, scorer(markov_scores(model))(F.col("seq")).alias("_l"))
    total = F.aggregate("_l", F.lit(0.0), lambda a, x: a + x)
    return rows.select(key, F.size("_l").alias("positions"), (-total / F.size("_l")).alias("nll"))


def point_variants(df: DataFrame, seed: int) -> DataFrame:
    """record_idx, ref_seq, alt_seq, label: one drawn base changed."""
    at = draw.integer(seed, F.length("seq"), F.col("record_idx"), F.lit("at"))
    turned = F.translate(F.substring("seq", at + 1, F.lit(1)), "ACGTN", "CGTAA")
    alt = F.concat(F.substring("seq", F.lit(1), at), turned, F.substring("seq", at + 2, F.length("seq")))
    return df.where(F.length("seq") > 0).select("record_idx", F.col("seq").alias("ref_seq"), alt.alias("alt_seq"), "label")


def variant_effect(df: DataFrame, model: dict[str, float]) -> DataFrame:
    """Samples, AUROC and AUPRC of NLL(alt) - NLL(ref) for a binary label."""
    score = scorer(markov_scores(model))
    rows = df.where((F.length("ref_seq") > 0) & (F.length("alt_seq") > 0)).select("label", score("ref_seq").alias("r"), score("alt_seq").alias("a"))
    mean = lambda c: -F.aggregate(c, F.lit(0.0), lambda t, x: t + x) / F.size(c)
    rows = rows.select("label", F.round(mean("a") - mean("r"), 12).alias("score"))
    return metrics.ranking(rows).crossJoin(rows.agg(F.count("*").alias("samples")))
