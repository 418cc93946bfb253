"""Queries of augmentation and masking (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basewright.functions import dna
from basewright.operators import controls, masking, tokens
from basewright.operators.base import sequences
from basewright.plans.registry import add
from basewright.plans.shared_sql import SEQS, rc, uniform

_TEXT = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def _encoded(spark, sf):
    """Truncated and padded single-base encodings of 128 tokens."""
    rows = sequences(spark, sf).select("record_idx", tokens.encode_base(F.col("seq"), 128, pad=True).alias("e"))
    return rows.select("record_idx", F.col("e.input_ids").alias("ids"), F.col("e.attention_mask").alias("attention"))


_ENC = f"""{SEQS}, b AS (SELECT record_idx, list_transform(range(1, length(seq) + 1), lambda i: strpos('ACGTN', substr(seq, i::INT, 1)) + 4) AS a FROM seqs),
c AS (SELECT record_idx, CASE WHEN len(a) + 2 > 128 THEN list_concat([2], a[1:126], [3]) ELSE list_concat([2], a, [3]) END AS a FROM b),
p AS (SELECT record_idx, list_concat(a, list_transform(range(128 - len(a)), lambda i: 0::BIGINT)) AS a, len(a) AS n FROM c),
t AS (SELECT record_idx, n, unnest(a)::INT AS x, unnest(range(128))::INT AS i FROM p),
m AS (SELECT *, x > 4 AND {uniform(41, "record_idx::VARCHAR", "i::VARCHAR", "'mask'")} < 0.3 * CASE x WHEN 9 THEN 0.0 WHEN 6 THEN 2.0 ELSE 1.0 END AS mask FROM t)"""
_WEIGHTS = {9: 0.0, 6: 2.0}


def _masked(spark, sf):
    rows = _encoded(spark, sf)
    return rows.withColumn("mask", masking.independent_mask(F.col("ids"), 0.3, 41, F.col("record_idx"), weights=_WEIGHTS))


_RCU, _IU = uniform("epoch2", "record_idx::VARCHAR", "'rc'"), uniform("epoch2", "record_idx::VARCHAR", "'indel'")
_D = lambda w: uniform("epoch2", "record_idx::VARCHAR", f"'{w}'")


@add(
    "g01_augment",
    f"""WITH {SEQS}, a AS (SELECT record_idx, CASE WHEN {_RCU} < 0.5 THEN {rc("seq")} ELSE seq END AS s, length(seq) AS n FROM seqs),
d AS (SELECT *, {_IU} AS u, {_D("kind")} AS kind, floor({_D("at")} * (n + 1))::INT AS ins, floor({_D("at")} * n)::INT AS del, floor({_D("base")} * 4)::INT AS b FROM a)
SELECT record_idx, CASE WHEN u >= 0.3 OR n < 2 THEN s WHEN kind < 0.5 THEN substr(s, 1, ins) || substr('ACGT', b + 1, 1) || substr(s, ins + 1) ELSE substr(s, 1, del) || substr(s, del + 2) END AS seq FROM d""",
)
def g01(spark, sf):
    return controls.augment(sequences(spark, sf), 2, 0.5, 0.3).select("record_idx", "seq")


@add("g02_paired_view", f"WITH {SEQS}, r AS (SELECT record_idx, string_split({rc('seq')}, '') AS a FROM seqs) SELECT record_idx, array_to_string(list_transform(list_filter(a, lambda c: c <> ''), lambda c: strpos('ACGTN', c) + 4), ' ') AS ids_rc FROM r")
def g02(spark, sf):
    return sequences(spark, sf).select("record_idx", _TEXT(tokens.base_ids(dna.reverse_complement(F.col("seq")))).alias("ids_rc"))


@add("g03_independent_mask", f"WITH {_ENC} SELECT record_idx, string_agg(mask::INT, '' ORDER BY i) AS mask FROM m GROUP BY record_idx")
def g03(spark, sf):
    return _masked(spark, sf).select("record_idx", F.array_join(F.transform("mask", lambda x: x.cast("int").cast("string")), "").alias("mask"))


@add("g04_span_mask")
def g04(spark, sf):
    rows = masking.span_mask(_encoded(spark, sf), "ids", "attention", "record_idx", 0.2, 3, 43)
    count = F.size(F.filter("mask", lambda x: x))
    return rows.select("record_idx", count.alias("masked"), masking.target_count(F.size(F.filter("ids", lambda x: x > 4)), 0.2).alias("target"))


@add("g05_bounded_fraction", "SELECT event_id, round(least(greatest(value / 100, 0.2), 0.4), 9) AS fraction FROM events")
def g05(spark, sf):
    from basewright.operators.base import table

    return table(spark, sf, "events").select("event_id", F.round(masking.bounded_fraction(F.col("value") / 100, 0.4, 0.2), 9).alias("fraction"))


_HOW, _REPL = uniform(47, "record_idx::VARCHAR", "i::VARCHAR", "'how'"), uniform(47, "record_idx::VARCHAR", "i::VARCHAR", "'repl'")


@add("g06_replacement", f"WITH {_ENC} SELECT record_idx, string_agg(CASE WHEN NOT mask THEN x WHEN {_HOW} < 0.8 THEN 4 WHEN {_HOW} < 0.9 THEN floor({_REPL} * 5)::INT + 5 ELSE x END, ' ' ORDER BY i) AS ids FROM m GROUP BY record_idx")
def g06(spark, sf):
    return _masked(spark, sf).select("record_idx", _TEXT(masking.replaced(F.col("ids"), F.col("mask"), 10, 47, F.col("record_idx"))).alias("ids"))


@add("g07_labels", f"WITH {_ENC} SELECT record_idx, string_agg(CASE WHEN mask THEN x ELSE -100 END, ' ' ORDER BY i) AS labels FROM m GROUP BY record_idx")
def g07(spark, sf):
    return _masked(spark, sf).select("record_idx", _TEXT(masking.labels(F.col("ids"), F.col("mask"))).alias("labels"))


@add(
    "g08_kmer_mask",
    f"WITH {_ENC}, k AS (SELECT record_idx, i, x, bool_or(mask) OVER (PARTITION BY record_idx ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS any3 FROM m) SELECT record_idx, string_agg(CASE WHEN any3 THEN 0 ELSE x END, ' ' ORDER BY i) AS kmers FROM k GROUP BY record_idx",
)
def g08(spark, sf):
    return _masked(spark, sf).select("record_idx", _TEXT(masking.mask_kmers(F.col("ids"), F.col("mask"), 3)).alias("kmers"))


@add(
    "g09_boundary_labels",
    f"""WITH {_ENC}, k AS (SELECT record_idx, i, i >= n AS pad, coalesce(lag(mask) OVER w <> mask, FALSE) OR coalesce(lead(mask) OVER w <> mask, FALSE) AS edge FROM m WINDOW w AS (PARTITION BY record_idx ORDER BY i))
SELECT record_idx, string_agg(CASE WHEN pad THEN -1 WHEN edge THEN 1 ELSE 0 END, ' ' ORDER BY i) AS labels FROM k GROUP BY record_idx""",
)
def g09(spark, sf):
    return _masked(spark, sf).select("record_idx", _TEXT(masking.boundary_labels(F.col("mask"), F.col("attention"))).alias("labels"))


@add("g10_negative_controls")
def g10(spark, sf):
    return controls.with_controls(sequences(spark, sf).select("file", "record_idx", "seq"), "dinucleotide", 53)
