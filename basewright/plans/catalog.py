"""Queries of the run catalogue (J, C22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basewright.operators import catalog, corpus, tokens
from basewright.operators.base import sequences, table
from basewright.plans.registry import add
from basewright.plans.shared_sql import SEQS, SEQS_R

# Events as a run history: the user is the run, the event id the step, the value the loss.
_RUNS = """runs AS (SELECT user_id AS run, event_id AS step, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS loss, event_id % 97 = 0 AS is_best_file, event_id % 89 = 0 AS is_latest_file, (json_extract_string(props, '$.k')::INT + 1)::BIGINT AS size FROM events)"""


def _runs(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.when(F.col("event_type") != "error", F.col("value")).alias("loss"),
        (F.col("event_id") % 97 == 0).alias("is_best_file"), (F.col("event_id") % 89 == 0).alias("is_latest_file"), (F.get_json_object("props", "$.k").cast("int") + 1).cast("long").alias("size"),
    )


@add("c22_flatten_json", "SELECT event_id, 'benchmark/k' AS metric, (json_extract_string(props, '$.k'))::DOUBLE AS value FROM events UNION ALL SELECT event_id, 'benchmark/run/loss', value FROM events")
def c22(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "ok": true, "checkpoint": {"x": 1}, "tags": [1], "run": {"loss": '), F.col("value").cast("string"), F.lit("}}")).alias("j"))
    return e.select("event_id", F.explode(catalog.flattened(F.col("j"))).alias("metric", "value"))


@add("j01_history_payload", "SELECT event_id AS step, k AS metric, round(v, 9) AS value FROM (SELECT event_id, unnest(['global_step', 'epoch', 'eval/loss', 'eval/acc']) AS k, unnest([event_id::DOUBLE, (event_id // 1000)::DOUBLE, CASE WHEN event_type = 'error' THEN NULL ELSE value END, value / 100]) AS v FROM events) WHERE v IS NOT NULL")
def j01(spark, sf):
    e = table(spark, sf, "events")
    nan = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    rows = catalog.history_record(e.select(F.col("event_id").alias("step"), F.floor(F.col("event_id") / 1000).alias("epoch"), nan.alias("loss"), F.lit(None).cast("double").alias("ppl"), (F.col("value") / 100).alias("acc")))
    return rows.select("step", F.explode("payload").alias("metric", "value")).select("step", "metric", F.round("value", 9).alias("value"))


@add("j02_display_loss", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN value + 1 WHEN 2 THEN value + 2 WHEN 3 THEN value + 3 END AS loss FROM events")
def j02(spark, sf):
    v, case = F.col("value"), F.col("event_id") % 5
    nan, none = F.lit(float("nan")), F.lit(None).cast("double")
    metrics = F.map_from_arrays(
        F.array(*map(F.lit, ("eval.loss", "eval_loss", "best.eval_loss", "best_loss_so_far"))),
        F.array(F.when(case == 0, v).when(case == 3, nan), F.when(case == 1, v + 1).when(case == 3, v), F.when(case == 2, v + 2), none),
    )
    best = F.when(case == 3, v + 3).when(case == 4, F.lit(float("inf")))
    return table(spark, sf, "events").select("event_id", catalog.display_loss(metrics, best).alias("loss"))


@add("j03_as_of_backfill", "WITH e AS (SELECT user_id, event_id AS step, value FROM events WHERE event_type = 'purchase') SELECT c.user_id, c.event_id AS step, e.value AS eval_loss FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN e ON c.user_id = e.user_id AND c.event_id >= e.step")
def j03(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("step"), "value", "event_type")
    left = e.where("event_type = 'click'").select("user_id", "step")
    return catalog.as_of(left, e.where("event_type = 'purchase'").select("user_id", "step", "value"), "user_id", "step", "value", "eval_loss")


@add("j04_sorted_runs", f"WITH {_RUNS} SELECT run, step, loss FROM runs ORDER BY loss NULLS LAST, step")
def j04(spark, sf):
    return catalog.sorted_runs(_runs(spark, sf), "loss").select("run", "step", "loss")


@add("j05_best_latest", f"WITH {_RUNS}, b AS (SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY loss, CASE WHEN is_best_file THEN 0 ELSE 1 END, step) AS r FROM runs WHERE loss IS NOT NULL) SELECT runs.run, max(b.step) AS best_step, min(loss) AS best_loss, max(runs.step) AS latest_step FROM runs LEFT JOIN b ON b.run = runs.run AND r = 1 GROUP BY runs.run")
def j05(spark, sf):
    return catalog.best_and_latest(_runs(spark, sf), "run")


@add("j06_retention_plan", f"WITH {_RUNS} SELECT run, step, CASE WHEN is_best_file OR is_latest_file OR row_number() OVER (PARTITION BY run ORDER BY step DESC) <= 5 THEN 'keep' ELSE 'delete' END AS action FROM runs")
def j06(spark, sf):
    return catalog.retention_plan(_runs(spark, sf), "run", 5).select("run", "step", "action")


@add("j07_run_summary", f"WITH {_RUNS} SELECT run, count(*) AS checkpoints, sum(size)::BIGINT AS total_size, min(loss) AS best_loss, max(step) AS latest_step FROM runs GROUP BY run")
def j07(spark, sf):
    return catalog.run_summary(_runs(spark, sf), "run")


@add(
    "j07_comparison",
    """WITH m AS (SELECT event_type AS k, avg(value) AS mean_value, min(value) AS min_value FROM events GROUP BY 1), l AS (SELECT k, 'mean_value' AS metric, round(mean_value, 6) AS v FROM m UNION ALL SELECT k, 'min_value', round(min_value, 6) FROM m)
SELECT metric, max(v) FILTER (k = 'click') AS click, max(v) FILTER (k = 'purchase') AS purchase, arg_min(k, v) FILTER (k IN ('click', 'purchase')) AS best FROM l GROUP BY metric""",
)
def j07c(spark, sf):
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.min("value"), 6).alias("min_value"))
    return catalog.comparison(rows, "event_type", ["click", "purchase"], ["mean_value", "min_value"])


@add("j08_weighted_average", "WITH e AS (SELECT label, vec_id // 10 AS name, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS pos FROM embeddings WHERE label IN (1, 2)) SELECT name::VARCHAR AS name, pos::INT AS pos, round(sum(v * CASE label WHEN 1 THEN 0.25 ELSE 0.75 END), 6) AS value FROM e GROUP BY 1, 2")
def j08(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("model"), F.floor(F.col("vec_id") / 10).cast("string").alias("name"), F.col("embedding").alias("values"))
    return catalog.weighted_average(rows, {"1": 0.25, "2": 0.75}).select("name", "pos", F.round("value", 6).alias("value"))


@add(
    "j09_upsert",
    """WITH a AS (SELECT user_id, event_type, event_id AS ts, value, 0 AS n FROM events WHERE value < 50 UNION ALL SELECT user_id, event_type, event_id + 100, value, 1 FROM events WHERE value >= 50)
SELECT user_id, event_type, ts, value FROM a QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, n DESC) = 1""",
)
def j09(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("ts"), "value")
    return catalog.upsert(e.where("value < 50"), e.where("value >= 50").withColumn("ts", F.col("ts") + 100), ["user_id", "event_type"], "ts")


@add("j10_long_metrics", "SELECT user_id, unnest(['mean', 'max']) AS metric, unnest([round(avg(value), 9), max(value)]) AS value FROM events GROUP BY user_id")
def j10(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.create_map(F.lit("mean"), F.round(F.avg("value"), 9), F.lit("max"), F.max("value")).alias("metrics"))
    return catalog.long_metrics(rows)


@add("j11_schedule_lookup", """WITH s AS (SELECT * FROM (VALUES (0, 1000), (2000, 500), (5000, 250)) t(start, every)) SELECT event_id AS step, every::BIGINT AS every, event_id > 0 AND event_id % every = 0 AS due FROM events ASOF JOIN s ON event_id >= start""")
def j11(spark, sf):
    return catalog.due_flags(table(spark, sf, "events").select(F.col("event_id").alias("step")), tokens.schedule(spark, "0:1000,2000:500,5000:250"))


@add("j12_running_best", f"WITH {_RUNS} SELECT run, step, best_before, best_before IS NULL OR coalesce(loss < best_before, FALSE) AS improved FROM (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM runs)")
def j12(spark, sf):
    return catalog.running_best(_runs(spark, sf), "run", "step", "loss").select("run", "step", "best_before", F.coalesce("improved", F.lit(False)).alias("improved"))


@add(
    "j13_moving_average",
    """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), f AS (SELECT user_id, i, value AS ema FROM o WHERE i = 1
UNION ALL SELECT o.user_id, o.i, least(0.99, (o.i + 1.0) / (o.i + 10.0)) * f.ema + (1 - least(0.99, (o.i + 1.0) / (o.i + 10.0))) * o.value FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, max(i)::INT AS updates, round(arg_max(ema, i), 6) AS ema FROM f GROUP BY user_id""",
)
def j13(spark, sf):
    return catalog.moving_average(table(spark, sf, "events"), "user_id", "event_id", "value", 0.99).select("user_id", "updates", F.round("ema", 6).alias("ema"))


@add("j14_manifest", f"""WITH {SEQS}, f AS (SELECT domain, file, count(*) AS records, sum(length(seq))::BIGINT AS bases FROM seqs GROUP BY 1, 2) SELECT domain, sum(records)::BIGINT AS records, sum(bases)::BIGINT AS bases, '[' || string_agg('{{"file":"' || file || '","records":' || records || ',"bases":' || bases || '}}', ',' ORDER BY file) || ']' AS files FROM f GROUP BY domain""")
def j14(spark, sf):
    return catalog.manifest(sequences(spark, sf), "domain")


@add("j15_concat", f"WITH {SEQS} SELECT domain, count(*) AS records, sum(length(seq))::BIGINT AS bases FROM (SELECT * FROM seqs WHERE domain = 'en' UNION ALL SELECT * FROM seqs WHERE domain <> 'en' UNION ALL SELECT * FROM seqs WHERE domain = 'en') GROUP BY domain")
def j15(spark, sf):
    rows = sequences(spark, sf)
    return catalog.concat_corpora(rows.where("domain = 'en'"), rows.where("domain <> 'en'"), rows.where("domain = 'en'")).groupBy("domain").agg(F.count("*").alias("records"), F.sum(F.length("seq")).alias("bases"))


@add("j17_inspection", """SELECT l_suppkey AS checkpoint, l_suppkey * 100 AS step, (CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey * 100 // 300 ELSE 7 END)::BIGINT AS epoch, sum(l_quantity::BIGINT)::BIGINT AS parameters, sum(l_quantity::BIGINT * 4)::BIGINT AS bytes, bool_or(l_returnflag = 'A') AS has_ema FROM lineitem GROUP BY l_suppkey""")
def j17(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("checkpoint"), (F.col("l_suppkey") * 100).alias("step"), F.when(F.col("l_suppkey") % 2 == 0, 0).otherwise(7).cast("long").alias("epoch"),
        F.col("l_quantity").cast("long").alias("numel"), F.lit(4).alias("itemsize"), F.when(F.col("l_returnflag") == "A", "ema.w").otherwise("w").alias("name"),
    )
    return catalog.inspect_parameters(rows, 300)


@add("j18_gate_telemetry", "SELECT event_type, round(avg(value / 100), 8) AS mean, round(stddev_pop(value / 100), 8) AS std, round(avg((value / 100 > 0.9 OR value / 100 < 0.1)::INT), 8) AS saturation FROM events GROUP BY event_type")
def j18(spark, sf):
    rows = catalog.gate_telemetry(table(spark, sf, "events").withColumn("gate", F.col("value") / 100), "event_type", "gate")
    return rows.select("event_type", *[F.round(c, 8).alias(c) for c in ("mean", "std", "saturation")])


_RC = "reverse(translate(piece, 'ACGTacgt', 'TGCAtgca'))"


@add(
    "j16_corpus_build",
    f"""WITH RECURSIVE {SEQS_R}, g AS (SELECT file AS species, record_idx, regexp_split_to_array(seq, 'N+') AS a FROM seqs
  WHERE length(seq) >= 100 AND (length(seq) - length(translate(seq, 'N', ''))) / length(seq)::DOUBLE <= 0.4 AND NOT regexp_matches(seq, '[^ACGTN]')),
p AS (SELECT species, record_idx, unnest(a) AS piece, unnest(range(len(a))) AS i FROM g),
h AS (SELECT species, record_idx * 1000000 + i * 1000 AS ord, length(piece) AS n, row_number() OVER (PARTITION BY species, sha256(least(piece, {_RC})) ORDER BY record_idx, i) AS d FROM p WHERE length(piece) >= 6),
o AS (SELECT species, n, row_number() OVER (PARTITION BY species ORDER BY ord) AS i FROM h WHERE d = 1),
f AS (SELECT species, n, i, CASE WHEN n <= 600 THEN n ELSE 0 END AS total, n <= 600 AS kept FROM o WHERE i = 1
  UNION ALL SELECT o.species, o.n, o.i, CASE WHEN f.total + o.n <= 600 THEN f.total + o.n ELSE f.total END, f.total + o.n <= 600 FROM f JOIN o ON o.species = f.species AND o.i = f.i + 1)
SELECT species, count(*) AS pieces, sum(n)::BIGINT AS bases, sum(n) >= 300 AS passed FROM f WHERE kept GROUP BY species""",
)
def j16(spark, sf):
    return corpus.build_summary(corpus.accepted_pieces(sequences(spark, sf, keep_r=True), 100, 0.4, 6, 10_000_000, 600), 300)
