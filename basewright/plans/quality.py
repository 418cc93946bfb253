"""Queries of the filters and quality control (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basewright.functions import dna
from basewright.operators import qc
from basewright.operators.base import sequences, table
from basewright.plans.registry import add
from basewright.plans.shared_sql import SEQS, SEQS_R, count_of, entropy, rc

# Parameters under which the derived records reach every branch.
LIMITS = {"min_length": 100, "n_percent": 36.0, "min_entropy": 1.69}

CLASSIFIED = f"""
WITH {SEQS_R},
e AS (SELECT *, round({entropy("seq")}, 9) AS ent, {count_of("seq", "N")} AS nn FROM seqs),
r AS (SELECT *, CASE WHEN length(seq) < 100 THEN 'length' WHEN regexp_matches(seq, '[^ACGTN]') THEN 'ambiguous'
   WHEN 100.0::DOUBLE * nn / length(seq) > 36.0 THEN 'n' WHEN ent < 1.69 THEN 'entropy' END AS r0 FROM e),
c AS (SELECT *, CASE WHEN r0 IS NOT NULL THEN r0 WHEN row_number() OVER (PARTITION BY r0, sha256(least(seq, {rc("seq")})) ORDER BY file, record_idx) > 1 THEN 'dup' END AS reason FROM r)
"""


def _classified(spark, sf):
    return qc.classify(sequences(spark, sf, keep_r=True), **LIMITS)


@add(
    "b01_contig_filter",
    f"""WITH {SEQS} SELECT file, record_idx, length(seq)::BIGINT AS len FROM seqs
WHERE length(seq) >= 200 AND {count_of("seq", "N")} / length(seq)::DOUBLE <= 0.35 AND NOT upper(file || ' ' || domain) LIKE '%PLASMID%'""",
)
def b01(spark, sf):
    header = F.concat_ws(" ", "file", "domain")
    return sequences(spark, sf).where(qc.contig_passes(header, F.col("seq"), 200, 0.35, True)).select("file", "record_idx", F.length("seq").cast("long").alias("len"))


@add("b02_foreign_symbols", f"WITH {SEQS_R} SELECT file, record_idx FROM seqs WHERE regexp_matches(seq, '[^ACGTN]')")
def b02(spark, sf):
    return sequences(spark, sf, keep_r=True).where(qc.has_foreign(F.col("seq"))).select("file", "record_idx")


@add(
    "b03_strict_violations",
    f"""WITH {SEQS_R} SELECT file, record_idx, CASE WHEN seq LIKE '%N%' AND seq LIKE '%R%' THEN 'N,R' WHEN seq LIKE '%N%' THEN 'N' ELSE 'R' END AS symbols
FROM seqs WHERE regexp_matches(seq, '[^ACGT]')""",
)
def b03(spark, sf):
    rows = sequences(spark, sf, keep_r=True).where(qc.has_foreign(F.col("seq"), "ACGT"))
    return rows.select("file", "record_idx", F.array_join(qc.foreign_symbols(F.col("seq")), ",").alias("symbols"))


@add("b04_qc_classify", CLASSIFIED + "SELECT file, record_idx, coalesce(reason, 'ok') AS reason FROM c")
def b04(spark, sf):
    return _classified(spark, sf).select("file", "record_idx", F.coalesce("reason", F.lit("ok")).alias("reason"))


@add("b05_entropy", f"WITH {SEQS} SELECT file, record_idx, round({entropy('seq')}, 9) AS entropy FROM seqs")
def b05(spark, sf):
    return sequences(spark, sf).select("file", "record_idx", F.round(dna.entropy(F.col("seq")), 9).alias("entropy"))


@add(
    "b06_canonical_dedup",
    f"""WITH {SEQS} SELECT file, record_idx, hash FROM (SELECT file, record_idx, sha256(least(seq, {rc("seq")})) AS hash,
row_number() OVER (PARTITION BY sha256(least(seq, {rc("seq")})) ORDER BY file, record_idx) AS n FROM seqs) WHERE n = 1""",
)
def b06(spark, sf):
    return qc.first_by_hash(sequences(spark, sf)).where("is_first").select("file", "record_idx", "hash")


_COUNTERS = f"""count(*) AS total_seqs, sum(length(seq))::BIGINT AS total_bases,
  count(*) FILTER (reason IS NULL) AS kept_seqs, coalesce(sum(length(seq)) FILTER (reason IS NULL), 0)::BIGINT AS kept_bases,
  count(*) FILTER (reason = 'length') AS removed_length, count(*) FILTER (reason = 'ambiguous') AS removed_ambiguous, count(*) FILTER (reason = 'n') AS removed_n,
  count(*) FILTER (reason = 'entropy') AS removed_entropy, count(*) FILTER (reason = 'dup') AS removed_dup,
  round(coalesce(avg(ent) FILTER (reason IS NULL), 0), 6) AS mean_entropy, count(*) FILTER (reason IS NOT NULL) AS removed_total,
  round(coalesce(100.0::DOUBLE * sum({count_of("seq", "GC")}) FILTER (reason IS NULL) / nullif(sum(length(seq)) FILTER (reason IS NULL), 0), 0), 6) AS gc_percent,
  round(coalesce(100.0::DOUBLE * sum(nn) FILTER (reason IS NULL) / nullif(sum(length(seq)) FILTER (reason IS NULL), 0), 0), 6) AS n_percent,
  round(100.0::DOUBLE * count(*) FILTER (reason IS NOT NULL) / count(*), 6) AS percent_removed"""


@add("b07_qc_counters", CLASSIFIED + f"SELECT file, {_COUNTERS} FROM c GROUP BY file")
def b07(spark, sf):
    return qc.counters(_classified(spark, sf))


@add("b08_percent_removed", CLASSIFIED + "SELECT file, count(*) FILTER (reason IS NOT NULL) AS removed_total, round(100.0::DOUBLE * count(*) FILTER (reason IS NOT NULL) / count(*), 6) AS percent_removed FROM c GROUP BY file")
def b08(spark, sf):
    return qc.counters(_classified(spark, sf)).select("file", "removed_total", "percent_removed")


@add("b09_qc_summary", CLASSIFIED + f"SELECT file, {_COUNTERS} FROM c GROUP BY GROUPING SETS ((file), ())")
def b09(spark, sf):
    return qc.counters(_classified(spark, sf), total=True)


_GC, _N = f"round(coalesce(100.0::DOUBLE * {count_of('seq', 'GC')} / nullif(length(seq), 0), 0), 6)", f"round(coalesce(100.0::DOUBLE * {count_of('seq', 'N')} / nullif(length(seq), 0), 0), 6)"


@add(
    "b10_descriptive_summary",
    f"""WITH {SEQS}, r AS (SELECT {_GC} AS gc, {_N} AS n, length(seq) AS length FROM seqs)
SELECT count(*) AS records, {", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, round(avg({c}), 6) AS mean_{c}, round(median({c}), 6) AS median_{c}" for c in ("gc", "n", "length"))} FROM r""",
)
def b10(spark, sf):
    return qc.describe(sequences(spark, sf))


@add("b10_length_histogram", f"WITH {SEQS} SELECT (length(seq) // 500 * 500)::BIGINT AS bucket, count(*) AS records FROM seqs GROUP BY 1")
def b10h(spark, sf):
    return qc.length_histogram(sequences(spark, sf))


@add("b10_composition", f"WITH {SEQS} SELECT domain, {', '.join(f'sum({count_of("seq", s)})::BIGINT AS n_{s.lower()}' for s in 'ACGTN')} FROM seqs GROUP BY domain")
def b10c(spark, sf):
    return qc.composition(sequences(spark, sf), "domain")


@add(
    "b11_qc_gate",
    CLASSIFIED
    + """, s AS (SELECT file, CASE domain WHEN 'en' THEN 'bacteria' WHEN 'de' THEN 'archaea' WHEN 'fr' THEN 'eukaryotes' ELSE domain END AS domain, count(*) AS t, count(*) FILTER (reason IS NOT NULL) AS r FROM c GROUP BY 1, 2),
g AS (SELECT domain, sum(t)::BIGINT AS total, sum(r)::BIGINT AS removed, count(*) FILTER (100.0 * r / t > 90) AS bad_files, CASE WHEN domain = 'eukaryotes' THEN 50.0 ELSE 40.0 END AS lim FROM s GROUP BY domain)
SELECT domain, total, removed, round(100.0::DOUBLE * removed / total, 6) AS percent_removed, lim::DOUBLE AS "limit", bad_files, round(100.0::DOUBLE * removed / total, 6) <= lim AND bad_files = 0 AS passed FROM g""",
)
def b11(spark, sf):
    name = F.expr("CASE domain WHEN 'en' THEN 'bacteria' WHEN 'de' THEN 'archaea' WHEN 'fr' THEN 'eukaryotes' ELSE domain END")
    rows = _classified(spark, sf).groupBy("file", name.alias("domain")).agg(F.count("*").alias("total_seqs"), F.count("reason").alias("removed_total"))
    return qc.gate(rows)


@add(
    "b12_prefix_check",
    f"""WITH {SEQS}, h AS (SELECT * FROM seqs QUALIFY row_number() OVER (PARTITION BY file ORDER BY record_idx) <= 1000)
SELECT file, count(*) AS records, sum(length(seq))::BIGINT AS bases, sum({count_of("seq", "N")})::BIGINT AS n_bases,
  round(100.0::DOUBLE * sum({count_of("seq", "N")}) / sum(length(seq)), 6) AS n_percent, round(100.0::DOUBLE * sum({count_of("seq", "N")}) / sum(length(seq)), 6) <= 37 AS passed FROM h GROUP BY file""",
)
def b12(spark, sf):
    return qc.prefix_check(sequences(spark, sf), 37.0)


@add("b13_size_check", f"WITH {SEQS} SELECT domain, sum(length(seq))::BIGINT AS bases, sum(length(seq)) BETWEEN 160000 AND 240000 AS within FROM seqs GROUP BY domain")
def b13(spark, sf):
    return qc.size_check(sequences(spark, sf).groupBy("domain").agg(F.sum(F.length("seq")).alias("bases")), 200_000)


@add(
    "b14_preflight",
    """WITH h AS (SELECT user_id, event_id AS step, value AS loss, (json_extract_string(props, '$.k'))::INT AS batches FROM events)
SELECT user_id, count(*) AS rows, arg_min(loss, step) AS first_loss, arg_max(loss, step) AS last_loss, bool_and(isfinite(loss)) AS finite, bool_and(batches > 0 AND batches <= 80) AS batches_ok,
  count(*) >= 2 AND bool_and(isfinite(loss)) AND arg_max(loss, step) <= arg_min(loss, step) AND bool_and(batches > 0 AND batches <= 80) AS passed FROM h GROUP BY user_id""",
)
def b14(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("event_id").alias("step"), F.col("value").alias("loss"), F.get_json_object("props", "$.k").cast("int").alias("batches"), F.lit(80).alias("max_batches"))
    return qc.preflight(rows, "user_id")


@add("b15_already_processed", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def b15(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@add("b16_reference_filter", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%' OR p_type LIKE '%STEEL%'")
def b16(spark, sf):
    return table(spark, sf, "part").where(F.col("p_brand").startswith("Brand#1") | F.col("p_type").contains("STEEL")).select("p_partkey", "p_brand")


@add("b17_split_membership", "SELECT o_orderkey, CASE WHEN lower(trim(o_orderstatus)) IN ('f', 'train') THEN 'train' WHEN lower(trim(o_orderstatus)) IN ('o', 'test') THEN 'test' ELSE 'fallback' END AS split FROM orders")
def b17(spark, sf):
    value = F.lower(F.trim("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", F.when(value.isin("f", "train"), "train").when(value.isin("o", "test"), "test").otherwise("fallback").alias("split"))
