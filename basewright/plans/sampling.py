"""Queries of sampling, ordering and batching (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basewright.functions import dna
from basewright.operators import sampling, tokens
from basewright.operators.base import sequences, table
from basewright.plans.registry import add
from basewright.plans.shared_sql import SEQS, count_of, uniform


@add("f01_round_robin", f"WITH {SEQS}, r AS (SELECT file, record_idx, row_number() OVER (PARTITION BY file ORDER BY record_idx)::INT AS turn FROM seqs) SELECT file, record_idx, turn FROM r ORDER BY turn, file")
def f01(spark, sf):
    return sampling.round_robin(sequences(spark, sf), "file", "record_idx").select("file", "record_idx", "turn").orderBy("turn", "file")


@add(
    "f02_weighted_draws",
    f"""WITH {SEQS}, s AS (SELECT file, count(*) AS n, CASE file WHEN 'src0' THEN 5.0 WHEN 'src1' THEN 0.0 ELSE 1.0 END AS w FROM seqs GROUP BY file),
b AS (SELECT file, n, sum(w) OVER (ORDER BY file) / sum(w) OVER () AS hi FROM s WHERE w > 0), c AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY file), 0) AS lo, lead(hi) OVER (ORDER BY file) IS NULL AS top FROM b),
t AS (SELECT id AS step, {uniform(23, "id::VARCHAR")} AS u FROM range(5000) x(id)),
p AS (SELECT step, file, (row_number() OVER (PARTITION BY file ORDER BY step) - 1) % n AS pos FROM t JOIN c ON u >= lo AND (u < hi OR top)),
r AS (SELECT file, record_idx, row_number() OVER (PARTITION BY file ORDER BY record_idx) - 1 AS pos FROM seqs)
SELECT step, file, record_idx FROM p JOIN r USING (file, pos)""",
)
def f02(spark, sf):
    rows = sequences(spark, sf).select("file", "record_idx")
    return sampling.weighted_draws(rows, "file", "record_idx", {"src0": 5.0, "src1": 0.0, "*": 1.0}, 5000, 23).select("step", "file", "record_idx")


@add(
    "f03_stratum_weights",
    f"""WITH {SEQS}, g AS (SELECT file, 100.0::DOUBLE * sum({count_of("seq", "GC")}) / sum(length(seq)) AS gc FROM seqs GROUP BY file), h AS (SELECT file, (floor(coalesce(CASE WHEN file <> 'src3' THEN gc END, 50) / 10) * 10)::INT AS gc_bin FROM g)
SELECT file, gc_bin, round(1.0 / count(*) OVER (PARTITION BY gc_bin), 9) AS weight FROM h""",
)
def f03(spark, sf):
    rows = sequences(spark, sf).groupBy("file").agg((100.0 * F.sum(dna.count_of(F.col("seq"), "GC")) / F.sum(F.length("seq"))).alias("gc"))
    rows = rows.withColumn("gc", F.when(F.col("file") != "src3", F.col("gc")))
    return sampling.stratum_weights(rows).select("file", "gc_bin", F.round("weight", 9).alias("weight"))


@add(
    "f04_length_batches",
    f"""WITH {SEQS}, b AS (SELECT record_idx, ((row_number() OVER (ORDER BY length(seq), record_idx) - 1) // 16)::BIGINT AS batch FROM seqs),
o AS (SELECT batch, row_number() OVER (ORDER BY {uniform(29, "batch::VARCHAR")}, batch) - 1 AS batch_rank FROM (SELECT DISTINCT batch FROM b))
SELECT record_idx, batch, batch_rank::INT AS batch_rank FROM b JOIN o USING (batch) WHERE batch_rank >= 3""",
)
def f04(spark, sf):
    rows = sequences(spark, sf).select("record_idx", F.length("seq").alias("len"))
    return sampling.length_batches(rows, "len", "record_idx", 16, 29, skip=3).select("record_idx", "batch", "batch_rank")


@add(
    "f05_collate",
    """WITH t AS (SELECT conv_id, turn, list_transform(range(1, length(role) + 1), lambda i: ascii(substr(role, i::INT, 1))) AS ids FROM conversations), w AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS width FROM t)
SELECT conv_id, turn, array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda i: 0)), ' ') AS ids, array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(width - len(ids)), lambda i: 0)), ' ') AS mask FROM w""",
)
def f05(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.transform(F.filter(F.split("role", ""), lambda c: c != ""), F.ascii).alias("ids"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return sampling.collate(rows, "conv_id", "ids").select("conv_id", "turn", text("ids"), text("mask"))


@add("f06_reservoir", f"WITH {SEQS} SELECT file, record_idx FROM seqs WHERE length(seq) >= 100 ORDER BY {uniform(31, 'record_idx::VARCHAR')}, record_idx LIMIT 200")
def f06(spark, sf):
    return sampling.reservoir(sequences(spark, sf).where(F.length("seq") >= 100), "record_idx", 200, 31).select("file", "record_idx")


@add("f07_every_nth", "SELECT doc_id FROM documents WHERE doc_id % 10 = 0 ORDER BY doc_id LIMIT 50")
def f07(spark, sf):
    return sampling.every_nth(table(spark, sf, "documents").select("doc_id"), "doc_id", 10, 50)


@add("f08_resume", f"WITH {SEQS}, r AS (SELECT file, record_idx, row_number() OVER (PARTITION BY file ORDER BY record_idx)::INT AS turn FROM seqs) SELECT file, record_idx, turn FROM r WHERE turn >= 20")
def f08(spark, sf):
    return sampling.resume(sampling.round_robin(sequences(spark, sf).select("file", "record_idx"), "file", "record_idx"), "turn", 20)


@add("f09_record_cap", f"WITH {SEQS} SELECT file, record_idx FROM seqs ORDER BY file, record_idx LIMIT 100")
def f09(spark, sf):
    return sequences(spark, sf).orderBy("file", "record_idx").limit(100).select("file", "record_idx")


@add(
    "f10_class_weights",
    f"""WITH {SEQS}, l AS (SELECT strpos('ACGTN', unnest(string_split(seq, ''))) + 4 AS id FROM seqs WHERE seq <> ''), v AS (SELECT unnest(range(10)) AS id),
c AS (SELECT v.id, greatest(count(l.id), 1) AS n FROM v LEFT JOIN l ON l.id = v.id GROUP BY v.id) SELECT id::INT AS id, n, round(avg(n) OVER () / n, 9) AS weight FROM c""",
)
def f10(spark, sf):
    labels = sequences(spark, sf).select(F.explode(tokens.base_ids(F.col("seq"))).alias("id"))
    return sampling.class_weights(labels, tokens.base_vocabulary(spark)).select("id", "n", F.round("weight", 9).alias("weight"))


@add("f11_mix_fractions", "SELECT (event_id // 1000)::BIGINT AS bucket, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_id // 1000)::DOUBLE, 9) AS share FROM events GROUP BY event_id // 1000, event_type")
def f11(spark, sf):
    rows = sampling.mix_fractions(table(spark, sf, "events"), F.floor(F.col("event_id") / 1000).cast("long"), "event_type")
    return rows.select("bucket", "event_type", "n", F.round("share", 9).alias("share"))
