"""Queries of the evaluation metrics (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basewright.operators import metrics, probes
from basewright.operators.base import sequences, table
from basewright.plans.registry import add

# Predictions derived from tables: events carry a class, a predicted class, a loss and a confidence.
_K = "json_extract_string(props, '$.k')::INT"
_EV = f"""ev AS (SELECT event_id, user_id, substr('ACGT', (event_id % 4 + 1)::INT, 1) AS label, substr('ACGT', (CASE WHEN {_K} % 3 = 0 THEN event_id % 4 ELSE {_K} % 4 END + 1)::INT, 1) AS pred,
  value / 50.0 AS loss, least(value / 100.0, 1.0) AS conf, ({_K} % 5 + 1) AS base_len FROM events)"""


def _events(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    letter = lambda i: F.substring(F.lit("ACGT"), (i + 1).cast("int"), F.lit(1))
    pred = F.when(k % 3 == 0, F.col("event_id") % 4).otherwise(k % 4)
    rows = table(spark, sf, "events").select("event_id", "user_id", letter(F.col("event_id") % 4).alias("label"), letter(pred).alias("pred"), (F.col("value") / 50.0).alias("loss"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("conf"), (k % 5 + 1).alias("base_len"))
    return rows.withColumn("correct", (F.col("label") == F.col("pred")).cast("double"))


def _round(df, *cols, digits=8):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@add("h01_token_loss", f"WITH {_EV} SELECT user_id, count(*) AS tokens, round(avg(loss), 8) AS loss, round(avg((label = pred)::INT), 8) AS accuracy, round(exp(avg(loss)), 6) AS ppl FROM ev GROUP BY user_id")
def h01(spark, sf):
    return _round(_round(metrics.token_loss(_events(spark, sf), "user_id"), "loss", "accuracy"), "ppl", digits=6)


@add("h02_base_loss", f"WITH {_EV}, s AS (SELECT user_id, sum(base_len)::BIGINT AS bases, sum(loss) / sum(base_len) AS b FROM ev GROUP BY user_id) SELECT user_id, bases, round(b, 8) AS base_loss, round(b / ln(2.0), 8) AS bits_per_base, round(exp(b), 8) AS base_ppl FROM s")
def h02(spark, sf):
    return _round(metrics.base_loss(_events(spark, sf), "user_id"), "base_loss", "bits_per_base", "base_ppl")


@add("h03_calibration_error", f"WITH {_EV}, b AS (SELECT user_id, least(floor(conf * 10), 9) AS k, count(*) AS n, avg(conf) AS c, avg((label = pred)::INT) AS a FROM ev GROUP BY 1, 2) SELECT user_id, round(sum(n * abs(c - a)) / sum(n), 8) AS ece FROM b GROUP BY user_id")
def h03(spark, sf):
    return _round(metrics.calibration_error(_events(spark, sf), "user_id"), "ece")


@add("h04_per_class_accuracy", f"WITH {_EV}, c AS (SELECT unnest(['A', 'C', 'G', 'T', 'X']) AS class) SELECT class, count(label) AS support, round(avg((label = pred)::INT), 8) AS accuracy FROM c LEFT JOIN ev ON label = class GROUP BY class")
def h04(spark, sf):
    return _round(metrics.per_class_accuracy(_events(spark, sf), ["A", "C", "G", "T", "X"]), "accuracy")


@add(
    "h05_classification",
    f"""WITH {_EV}, c AS (SELECT DISTINCT label AS k FROM ev UNION SELECT DISTINCT pred FROM ev),
p AS (SELECT k, (SELECT count(*) FROM ev WHERE label = k)::DOUBLE AS t, (SELECT count(*) FROM ev WHERE pred = k)::DOUBLE AS p, (SELECT count(*) FROM ev WHERE label = k AND pred = k)::DOUBLE AS tp FROM c),
s AS (SELECT sum(t) AS s, sum(tp) AS c, avg(CASE WHEN t + p > 0 THEN 2 * tp / (t + p) ELSE 0 END) AS f, sum(t * p) AS x, sum(t * t) AS tt, sum(p * p) AS pp FROM p)
SELECT s::BIGINT AS n, round(c / s, 8) AS accuracy, round(f, 8) AS macro_f1, round((c * s - x) / sqrt((s * s - pp) * (s * s - tt)), 8) AS mcc FROM s""",
)
def h05(spark, sf):
    return _round(metrics.classification(_events(spark, sf)), "accuracy", "macro_f1", "mcc")


_LABELLED = "l AS (SELECT quality AS label, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


@add(
    "h06_ranking",
    f"""WITH {_LABELLED}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM l),
a AS (SELECT (sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label)::DOUBLE * (count(*) - sum(label))) AS auroc FROM r),
g AS (SELECT score, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM l GROUP BY score), c AS (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY score DESC))
SELECT round(auroc, 8) AS auroc, (SELECT round(sum(p * cp / cn) / sum(p), 8) FROM c) AS auprc FROM a""",
)
def h06(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"))
    return _round(metrics.ranking(rows), "auroc", "auprc")


@add(
    "h07_regression",
    """WITH d AS (SELECT l_quantity AS y, l_extendedprice / 2000.0 AS p FROM lineitem), r AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM d)
SELECT count(*) AS n, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(corr(y, p), 6) AS pearson, round(corr(ry, rp), 6) AS spearman FROM r""",
)
def h07(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 2000.0).alias("pred"))
    return _round(metrics.regression(rows), "r2", "pearson", "spearman", digits=6)


@add("h09_average_ranks", "SELECT o_orderkey, rank() OVER (ORDER BY o_custkey) - 1 + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0::DOUBLE AS rank FROM orders")
def h09(spark, sf):
    return metrics.average_ranks(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "rank")


@add(
    "h14_vector_agreement",
    """WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_dot_product(x, y) / greatest(sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)), 1e-12), 6) AS cosine, round(list_distance(x, y) / sqrt(len(x)), 6) AS l2 FROM p""",
)
def h14(spark, sf):
    e = table(spark, sf, "embeddings")
    both = e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    rows = both.select("vec_id", metrics.vector_agreement(F.col("x"), F.col("y")).alias("a"))
    return rows.select("vec_id", F.round("a.cosine", 6).alias("cosine"), F.round("a.l2", 6).alias("l2"))


@add(
    "h15_masked_pooling",
    """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings WHERE embedding[1] > 0) SELECT label, pos::INT AS pos, round(avg(v), 6) AS v FROM e GROUP BY label, pos""",
)
def h15(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("mask", F.when(F.get("embedding", F.lit(0)) > 0, 1).otherwise(0))
    return metrics.pooled(rows, "label", "embedding", "mask").select("label", F.posexplode("pooled").alias("pos", "v")).select("label", "pos", F.round("v", 6).alias("v"))


@add("h15_last_pooling", "SELECT label, unnest(range(64))::INT AS pos, round(unnest(arg_max(embedding, vec_id))::DOUBLE, 6) AS v FROM embeddings GROUP BY label")
def h15l(spark, sf):
    rows = metrics.pooled(table(spark, sf, "embeddings"), "label", "embedding", mode="last", order="vec_id")
    return rows.select("label", F.posexplode("pooled").alias("pos", "v")).select("label", "pos", F.round(F.col("v").cast("double"), 6).alias("v"))


@add("h16_weighted_bce", f"WITH {_LABELLED}, w AS (SELECT *, 1 / (1 + exp(-(score - 1500) / 1000)) AS p, least((count(*) OVER () - sum(label) OVER ()) / greatest(sum(label) OVER (), 1)::DOUBLE, 100) AS w FROM l) SELECT round(avg(-(w * label * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - label) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)))), 6) AS bce, round(max(w), 6) AS pos_weight FROM w")
def h16(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.col("quality").alias("label"), (1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1000.0))).alias("prob"))
    return _round(metrics.weighted_bce(rows), "bce", "pos_weight", digits=6)


@add("h16_mean_squared", "WITH p AS (SELECT a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT round(avg(list_distance(x, y) ** 2 / len(x)), 6) AS mse FROM p")
def h16m(spark, sf):
    e = table(spark, sf, "embeddings")
    both = e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return _round(metrics.mean_squared(both, "x", "y"), "mse", digits=6)


@add("h16_distillation", "WITH p AS (SELECT (event_id % 7 + 1) / 8.0::DOUBLE AS a, (event_id % 5 + 1) / 6.0::DOUBLE AS b FROM events) SELECT round(avg(a * (ln(a) - ln(b)) + (1 - a) * (ln(1 - a) - ln(1 - b))), 8) AS kl FROM p")
def h16d(spark, sf):
    a, b = (F.col("event_id") % 7 + 1) / 8.0, (F.col("event_id") % 5 + 1) / 6.0
    return _round(metrics.distillation(table(spark, sf, "events").select(F.array(a, 1 - a).alias("t"), F.array(b, 1 - b).alias("s")), "t", "s"), "kl")


@add("h08_classification_probe")
def h08(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"), F.col("label").cast("string").alias("label"))
    return probes.classification_probe(*probes.train_test(rows, "label", "vec_id", 3))


@add("h10_regression_probe")
def h10(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"), F.get("embedding", F.lit(0)).cast("double").alias("y")).withColumn("stratum", F.lit(0))
    return probes.regression_probe(*probes.train_test(rows, "stratum", "vec_id", 3))


@add("h11_probe_suite")
def h11(spark, sf):
    docs = sequences(spark, sf).join(table(spark, sf, "labels"), F.col("record_idx") == F.col("doc_id"))
    return probes.handcrafted_suite(docs.select("file", "record_idx", "seq", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic")), ["quality", "toxic"])


@add("h12_pseudo_nll")
def h12(spark, sf):
    seqs = sequences(spark, sf).select("record_idx", "seq")
    return probes.pseudo_nll(seqs, "record_idx", probes.markov_model(seqs, 3)).select("record_idx", "positions", F.round("nll", 6).alias("nll"))


@add("h13_variant_effect")
def h13(spark, sf):
    seqs = sequences(spark, sf).join(table(spark, sf, "labels"), F.col("record_idx") == F.col("doc_id")).select("record_idx", "seq", F.col("quality").alias("label"))
    return probes.variant_effect(probes.point_variants(seqs, 59), probes.markov_model(seqs, 3))
