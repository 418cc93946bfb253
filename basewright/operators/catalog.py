"""Run catalogue: histories, as-of lookups, best, retention, averages (J)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewright.functions.dna import bind
from basewright.functions.text import metric_key_part


def finite(x: Column) -> Column:
    """The number if it is finite, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def history_record(df: DataFrame) -> DataFrame:
    """The flat payload of an evaluation: a map of metric names without nulls.

    ``df``: step, epoch, loss, ppl, acc, ece and optional further doubles.
    """
    names = {"step": "global_step", "epoch": "epoch", "loss": "eval/loss", "ppl": "eval/ppl", "acc": "eval/acc", "ece": "eval/ece"}
    pairs = [F.struct(F.lit(names.get(c, f"eval/{c}")).alias("k"), finite(F.col(c).cast("double")).alias("v")) for c in df.columns if c not in ("run",)]
    kept = F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())
    return df.withColumn("payload", F.map_from_entries(kept))


def display_loss(metrics: Column, best_loss: Column) -> Column:
    """Eval.loss, else eval_loss; else best.eval_loss, else best_loss_so_far; else best_loss; the first finite one.

    Within a pair the nested value wins by being there, whether or not it is finite.
    """
    pair = lambda a, b: finite(F.coalesce(metrics[a], metrics[b]))
    return F.coalesce(pair("eval.loss", "eval_loss"), pair("best.eval_loss", "best_loss_so_far"), finite(best_loss))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, name: str) -> DataFrame:
    """Per left row the ``value`` of the latest right row of the same ``by`` with ``at`` not later."""
    rows = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    rows = rows.unionByName(right.select(by, at, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True)
    last = F.last("_v", ignorenulls=True).over(Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(name, last).where("_side = 1").drop("_v", "_side")


def sorted_runs(df: DataFrame, by: str) -> DataFrame:
    """Order by step, epoch, time or loss (missing losses last, then step)."""
    orders = {"step": ["step"], "epoch": ["epoch", "step"], "time": ["time", "step"], "loss": [F.asc_nulls_last("loss"), "step"]}
    if by not in orders:
        raise ValueError(f"unknown order: {by}")
    return df.orderBy(*orders[by])


def best_and_latest(df: DataFrame, run: str) -> DataFrame:
    """Per run the best checkpoint (an explicit best file wins ties) and the latest."""
    ranked = F.struct(F.coalesce("loss", F.lit(float("inf"))).alias("l"), F.when(F.col("is_best_file"), 0).otherwise(1).alias("b"), F.col("step").alias("s"))
    return df.groupBy(run).agg(F.min(F.when(F.col("loss").isNotNull(), ranked))["s"].alias("best_step"), F.min("loss").alias("best_loss"), F.max("step").alias("latest_step"))


def retention_plan(df: DataFrame, run: str, keep: int) -> DataFrame:
    """Every checkpoint with ``action`` keep or delete: best file, latest file and the last ``keep`` by step stay."""
    place = F.row_number().over(Window.partitionBy(run).orderBy(F.desc("step")))
    protected = F.col("is_best_file") | F.col("is_latest_file") | (F.col("_p") <= keep)
    return df.withColumn("_p", place).withColumn("action", F.when(protected, "keep").otherwise("delete")).drop("_p")


def run_summary(df: DataFrame, run: str) -> DataFrame:
    """Count, total size, best and latest per run."""
    return df.groupBy(run).agg(F.count("*").alias("checkpoints"), F.sum("size").alias("total_size"), F.min("loss").alias("best_loss"), F.max("step").alias("latest_step"))


def comparison(df: DataFrame, key: str, names: list[str], metrics: list[str]) -> DataFrame:
    """One row per metric, one column per named checkpoint, and which of these is best (least; missing values never, ties by name)."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select(key, "x.metric", "x.v")
    wide = long.groupBy("metric").pivot(key, names).agg(F.first("v"))
    known = F.col("v").isNotNull() & F.col(key).isin(names)
    best = long.groupBy("metric").agg(F.min(F.when(known, F.struct("v", F.col(key).cast("string").alias("k"))))["k"].alias("best"))
    return wide.join(best, "metric")


def weighted_average(df: DataFrame, weights: dict[str, float], model: str = "model") -> DataFrame:
    """Name, pos, value averaged over models; ``df``: model, name, values (array)."""
    if not weights or abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    w = F.lit(None).cast("double")
    for m, x in weights.items():
        w = F.when(F.col(model).cast("string") == m, float(x)).otherwise(w)
    rows = df.withColumn("_w", w).where("_w is not null").select("name", "_w", F.posexplode("values").alias("pos", "v"))
    return rows.groupBy("name", "pos").agg(F.sum(F.col("_w") * F.col("v").cast("double")).alias("value"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest ``order``; new rows win ties."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return rows.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i", "_new")


def long_metrics(df: DataFrame, metrics: str = "metrics") -> DataFrame:
    """One row per metric of a map column."""
    return df.select(*[c for c in df.columns if c != metrics], F.explode(metrics).alias("metric", "value"))


def running_best(df: DataFrame, by: str, order: str, loss: str) -> DataFrame:
    """The best loss before each row and whether the row improves on it."""
    before = F.min(loss).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("best_before", before).withColumn("improved", F.col("best_before").isNull() | (F.col(loss) < F.col("best_before")))


def moving_average(df: DataFrame, by: str, order: str, value: str, decay: float) -> DataFrame:
    """Exponential moving average per group with warm-up decay min(decay, (1 + n) / (10 + n)): its last value."""
    rows = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_r"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("ema"))

    def step(a, x):
        n = a["n"] + 1
        d = F.least(F.lit(decay), (n + 1.0) / (n + 10.0))
        return F.struct(n.alias("n"), F.coalesce(d * a["ema"] + (1 - d) * x[value], x[value].cast("double")).alias("ema"))

    return rows.select(by, F.aggregate("_r", zero, step).alias("_a")).select(by, F.col("_a.n").alias("updates"), F.col("_a.ema").alias("ema"))


def due_flags(df: DataFrame, schedule: DataFrame) -> DataFrame:
    """The interval in force at each step and whether something is due; a schedule has few rows."""
    edges = schedule.withColumn("stop", F.lead("start").over(Window.orderBy("start")))
    hit = (F.col("step") >= F.col("start")) & (F.col("stop").isNull() | (F.col("step") < F.col("stop")))
    return df.join(F.broadcast(edges), hit, "left").withColumn("due", F.coalesce((F.col("step") > 0) & (F.col("step") % F.col("every") == 0), F.lit(False))).drop("start", "stop")


def manifest(df: DataFrame, by: str) -> DataFrame:
    """One row per domain with totals and its files as a JSON array."""
    each = df.groupBy(by, "file").agg(F.count("*").alias("records"), F.sum(F.length("seq")).cast("long").alias("bases"))
    return each.groupBy(by).agg(F.sum("records").alias("records"), F.sum("bases").alias("bases"), F.to_json(F.array_sort(F.collect_list(F.struct("file", "records", "bases")))).alias("files"))


def concat_corpora(*parts: DataFrame) -> DataFrame:
    """UNION ALL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def inspect_parameters(df: DataFrame, steps_per_epoch: int) -> DataFrame:
    """Per checkpoint parameters, bytes, whether averages are kept, and its epoch (step over steps per epoch if 0)."""
    rows = df.groupBy("checkpoint", "step", "epoch").agg(F.sum("numel").alias("parameters"), F.sum(F.col("numel") * F.col("itemsize")).alias("bytes"), F.bool_or(F.col("name").startswith("ema.")).alias("has_ema"))
    return rows.withColumn("epoch", F.when(F.col("epoch") == 0, F.floor(F.col("step") / steps_per_epoch)).otherwise(F.col("epoch")))


def resolve_mode(mode: str) -> tuple[str, int | str | None]:
    """``best``, ``latest``, ``epoch:N`` or a path."""
    if mode in ("best", "latest"):
        return mode, None
    if m := re.fullmatch(r"epoch:(\d+)", mode):
        return "epoch", int(m[1])
    return "path", mode


def gate_telemetry(df: DataFrame, by: str, gate: str) -> DataFrame:
    """Mean, population standard deviation and saturation of a gate."""
    return df.groupBy(by).agg(F.avg(gate).alias("mean"), F.stddev_pop(gate).alias("std"), F.avg(((F.col(gate) > 0.9) | (F.col(gate) < 0.1)).cast("double")).alias("saturation"))


#: Members that hold no metrics.
_SKIPPED = ("checkpoint", "supported_manifest_sections")
_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def flattened(text: Column, prefix: str = "benchmark", levels: int = 8) -> Column:
    """The numeric leaves of a JSON object, by slash-delimited keys; an empty map for what is no JSON.

    The text becomes a variant; each level opens the objects of the one before. Of keys that become equal the last by name counts.
    """
    kind = lambda v: F.schema_of_variant(v)
    leaf = lambda path, v: F.struct(path.alias("path"), v.alias("v"))

    def opened(x: Column) -> Column:
        members = F.filter(F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>")), lambda m: ~m["key"].isin(*_SKIPPED))
        inner = F.transform(members, lambda m: leaf(F.concat(x["path"], F.lit("/"), metric_key_part(m["key"])), m["value"]))
        return F.when(kind(x["v"]).startswith("OBJECT"), inner).otherwise(F.array(x))

    found = F.array(leaf(metric_key_part(F.lit(prefix)), F.try_parse_json(text)))
    for _ in range(levels):
        found = F.flatten(F.transform(found, opened))
    numbers = F.transform(F.filter(found, lambda x: kind(x["v"]).rlike(_NUMBER)), lambda x: F.struct(x["path"].alias("path"), F.try_variant_get(x["v"], "$", "double").alias("value")))

    def last_of_each(rows: Column) -> Column:
        names = F.array_distinct(F.transform(rows, lambda x: x["path"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(rows, lambda x: x["path"] == n), -1)["value"]))

    finite_ones = F.filter(numbers, lambda x: F.abs(x["value"]) < float("inf"))
    return F.when(F.try_parse_json(text).isNull(), F.create_map().cast("map<string,double>")).otherwise(bind(finite_ones, last_of_each))
