"""Queries of the interaction analysis (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basewright.operators import interactions as ia
from basewright.operators.base import table
from basewright.plans.registry import add

# Embeddings read as attention: 64 vectors are the rows of a layer, their sign tells the head.
_ATT = """att AS (SELECT vec_id // 64 AS layer, vec_id % 2 AS head, (vec_id % 64)::INT AS i, unnest(range(64))::INT AS j, abs(unnest(embedding)::DOUBLE) AS w FROM embeddings),
mean AS (SELECT i, j, avg(w) AS w FROM (SELECT layer, i, j, avg(w) AS w FROM att GROUP BY ALL) GROUP BY i, j)"""
# Tokens of two bases each; the first and the last two are special, the last one is padding.
_TOK = """tok AS (SELECT pos::INT AS pos, CASE WHEN pos IN (0, 61, 62, 63) THEN 0 ELSE (pos - 1) * 2 END::INT AS start, CASE WHEN pos IN (0, 61, 62, 63) THEN 0 ELSE pos * 2 END::INT AS stop, CASE WHEN pos = 63 THEN 0 ELSE 1 END AS attention FROM range(64) t(pos))"""
_SPAN = "span AS (SELECT pos AS i, start, stop FROM tok)"
_BINS = "bins AS (SELECT b::INT AS b, b * 120.0::DOUBLE / 16 AS lo, (b + 1) * 120.0::DOUBLE / 16 AS hi FROM range(16) t(b)), ov AS (SELECT i, b, (least(stop, hi) - greatest(start, lo)) / (stop - start) AS p FROM span, bins WHERE start < hi AND stop > lo AND stop > start)"
_PROJ = "pr AS (SELECT x.b AS i, y.b AS j, sum(x.p * m.w * y.p) AS w FROM mean m JOIN ov x ON x.i = m.i JOIN ov y ON y.i = m.j GROUP BY x.b, y.b), pn AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM pr)"


def _attention(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = e.select(F.floor(F.col("vec_id") / 64).alias("layer"), (F.col("vec_id") % 2).alias("head"), (F.col("vec_id") % 64).cast("int").alias("i"), F.posexplode("embedding").alias("j", "w"))
    return ia.mean_attention(rows.withColumn("w", F.abs(F.col("w").cast("double"))))


def _tokens(spark):
    pos = F.col("id").cast("int")
    special = pos.isin(0, 61, 62, 63)
    return spark.range(64).select(pos.alias("pos"), F.when(special, 0).otherwise((pos - 1) * 2).alias("start"), F.when(special, 0).otherwise(pos * 2).alias("stop"), F.when(pos == 63, 0).otherwise(1).alias("attention"))


def _overlaps(spark):
    return ia.bin_overlaps(_tokens(spark).select(F.col("pos").alias("i"), "start", "stop"), 120, 16)


def _projected(spark, sf):
    return ia.project(_attention(spark, sf), _overlaps(spark))


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@add("i01_mean_attention", f"WITH {_ATT} SELECT i, j, round(w, 9) AS w FROM mean")
def i01(spark, sf):
    return _r(_attention(spark, sf), "w")


@add("i02_compressed_spans", f"WITH {_TOK}, s AS (SELECT pos // 4 AS i, min(start) AS start, max(stop) AS stop FROM tok WHERE attention = 1 AND stop > start GROUP BY 1) SELECT p::INT AS i, coalesce(start, 0) AS start, coalesce(stop, 0) AS stop FROM range(16) t(p) LEFT JOIN s ON s.i = p")
def i02(spark, sf):
    return ia.compressed_spans(_tokens(spark), 4, 16)


@add("i03_position_classes", f"WITH {_TOK}, c AS (SELECT (pos // 2)::INT AS i, sum(attention) AS r, sum((attention = 1 AND stop > start)::INT) AS b FROM tok GROUP BY 1) SELECT i, CASE WHEN r = 0 THEN 'padding' WHEN b = 0 THEN 'special' WHEN b < r THEN 'mixed' ELSE 'bases' END AS class FROM c")
def i03(spark, sf):
    return ia.position_classes(_tokens(spark), 2)


@add("i04_remove_positions", f"WITH {_ATT}, z AS (SELECT i, j, CASE WHEN i IN (0, 61, 62, 63) OR j IN (0, 61, 62, 63) THEN 0 ELSE w END AS w FROM mean) SELECT i, j, round(coalesce(w / nullif(sum(w) OVER (PARTITION BY i), 0), 0), 9) AS w FROM z")
def i04(spark, sf):
    gone = _tokens(spark).where("stop <= start").select(F.col("pos").alias("i"))
    return _r(ia.remove_positions(_attention(spark, sf), gone), "w").select("i", "j", "w")


@add("i05_bin_overlaps", f"WITH {_TOK}, {_SPAN}, {_BINS} SELECT i, b, round(p, 9) AS p FROM ov")
def i05(spark, sf):
    return _r(_overlaps(spark), "p")


@add("i05_interval_join", "WITH s AS (SELECT doc_id AS i, (doc_id * 37 % 5000)::INT AS start, (doc_id * 37 % 5000 + n_chars % 400 + 1)::INT AS stop FROM documents), b AS (SELECT b::INT AS b, b * 100.0::DOUBLE AS lo, (b + 1) * 100.0::DOUBLE AS hi FROM range(50) t(b)) SELECT i, b, round((least(stop, hi) - greatest(start, lo)) / (stop - start), 9) AS p FROM s, b WHERE start < hi AND stop > lo")
def i05j(spark, sf):
    start = (F.col("doc_id") * 37 % 5000).cast("int")
    spans = table(spark, sf, "documents").select(F.col("doc_id").alias("i"), start.alias("start"), (start + F.col("n_chars") % 400 + 1).cast("int").alias("stop"))
    return _r(ia.bin_overlaps(spans, 5000, 50), "p")


@add("i06_projection", f"WITH {_ATT}, {_TOK}, {_SPAN}, {_BINS}, {_PROJ} SELECT i, j, round(w, 9) AS w FROM pn")
def i06(spark, sf):
    return _r(_projected(spark, sf), "w").select("i", "j", "w")


@add("i07_hidden_edges", f"WITH {_ATT}, {_TOK}, {_SPAN}, {_BINS}, {_PROJ} SELECT i, j, CASE WHEN i BETWEEN 2 AND 13 AND j BETWEEN 2 AND 13 THEN round(w, 9) END AS w FROM pn")
def i07(spark, sf):
    return _r(ia.hide_edges(_projected(spark, sf), 16, 2), "w").select("i", "j", "w")


@add("i08_top_pairs", f"WITH {_ATT}, {_TOK}, {_SPAN}, {_BINS}, {_PROJ}, r AS (SELECT i, j, round(w, 9) AS w FROM pn) SELECT i, j, w, row_number() OVER (ORDER BY w DESC, i, j)::INT AS rank FROM r ORDER BY w DESC, i, j LIMIT 20")
def i08(spark, sf):
    return ia.top_pairs(_r(_projected(spark, sf), "w"), 20).select("i", "j", "w", "rank")


@add("i09_colour_bounds", f"WITH {_ATT}, {_TOK}, {_SPAN}, {_BINS}, {_PROJ} SELECT round(min(w), 9) AS vmin, round(quantile_cont(w, 0.99), 9) AS vmax FROM pn WHERE w > 0")
def i09(spark, sf):
    return _r(ia.colour_bounds(_projected(spark, sf)), "vmin", "vmax")
