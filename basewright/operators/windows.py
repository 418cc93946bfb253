"""Windows, splits, caps and quotas (E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewright.functions import draw
from basewright.operators.base import running_total


def default_minimum(max_length: int) -> int:
    return max(64, max_length // 4)


def window_count(length: Column, max_length: int, stride: int, min_length: int | None = None) -> Column:
    """How many windows a record of this length has."""
    least = default_minimum(max_length) if min_length is None else min_length
    last = F.least(length - least, stride * F.ceil((length - max_length) / float(stride)))
    many = F.floor(last / stride) + 1
    return F.when(length < least, 0).when(length <= max_length, 1).otherwise(many).cast("long")


def window_starts(length: Column, max_length: int, stride: int, min_length: int | None = None) -> Column:
    """The start positions: every ``stride`` until a window reaches the end or too little is left."""
    n = window_count(length, max_length, stride, min_length)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))


def sliding_windows(df: DataFrame, max_length: int, stride: int, min_length: int | None = None, with_seq: bool = False) -> DataFrame:
    """One row per window: the record's columns, window_idx, start, stop and, if wanted, its bases."""
    n = F.length("seq")
    rows = df.select(*[c for c in df.columns if with_seq or c != "seq"], n.alias("_n"), F.posexplode(window_starts(n, max_length, stride, min_length)).alias("window_idx", "start"))
    rows = rows.withColumn("stop", F.least(F.col("start") + max_length, F.col("_n"))).drop("_n")
    return rows.withColumn("seq", F.substring("seq", F.col("start") + 1, F.col("stop") - F.col("start"))) if with_seq else rows


def _ordered(*cols: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*cols)))


def split_records(df: DataFrame, train_ratio: float) -> DataFrame:
    """File, record_idx, wc to split (train or eval); ``df`` has file, record_idx, wc.

    A fold in record order: what fits the train target goes to train; a record
    across it goes to train if more than half of it is missing there; the rest
    is eval. Then an empty train side takes the first record, an empty eval
    side the train record with the fewest windows. Only ids and counts of one
    file meet in a row; records without windows take no part.
    """
    rows = df.where("wc > 0").groupBy("file").agg(_ordered("record_idx", "wc").alias("r"), F.sum("wc").alias("total"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<boolean>").alias("train"))
    target = F.floor(F.col("total") * train_ratio).cast("long")

    def step(a, x):
        fits = a["sum"] + x["wc"] <= target
        closer = (a["sum"] < target) & ((target - a["sum"]) > x["wc"] / 2)
        take = fits | closer
        return F.struct((a["sum"] + F.when(take, x["wc"]).otherwise(0)).alias("sum"), F.concat(a["train"], F.array(take)).alias("train"))

    rows = rows.withColumn("t", F.aggregate("r", zero, step)["train"])
    rows = rows.withColumn("t", F.when(F.exists("t", lambda x: x), F.col("t")).otherwise(F.transform("t", lambda _, i: i == 0)))
    least = F.array_min(F.transform("r", lambda x, i: F.struct(x["wc"].alias("wc"), i.alias("i"))))["i"]
    lone = F.forall("t", lambda x: x) & (F.size("t") > 1)
    rows = rows.withColumn("t", F.when(lone, F.transform("t", lambda _, i: i != least)).otherwise(F.col("t")))
    each = rows.select("file", F.explode(F.arrays_zip("r", "t")).alias("x"))
    return each.select("file", F.col("x.r.record_idx").alias("record_idx"), F.col("x.r.wc").alias("wc"), F.when(F.col("x.t"), "train").otherwise("eval").alias("split"))


def keep_under_cap(df: DataFrame, by: str, order: tuple[str, ...], size: str, cap: Column | str, keep_first: bool = True) -> DataFrame:
    """``df`` rows of (by, order columns, size) that a greedy pass accepts.

    In the given order a row is skipped if it would exceed the cap; later
    smaller rows may still fit. ``keep_first`` accepts the first in any case.
    """
    limit = F.col(cap) if isinstance(cap, str) else cap
    rows = df.withColumn("_cap", limit).groupBy(by).agg(_ordered(*order, size).alias("r"), F.first("_cap").alias("_cap"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("i"))

    def step(a, x):
        fits = a["sum"] + x[size] <= F.col("_cap")
        take = fits | (F.size(a["kept"]) == 0) if keep_first else fits
        return F.struct(
            (a["sum"] + F.when(take, x[size]).otherwise(0)).cast("long").alias("sum"), F.when(take, F.concat(a["kept"], F.array(a["i"]))).otherwise(a["kept"]).alias("kept"), (a["i"] + 1).alias("i")
        )

    kept = rows.withColumn("k", F.aggregate("r", zero, step)["kept"])
    each = kept.select(by, F.explode(F.transform("k", lambda i: F.get("r", i))).alias("x"))
    return each.select(by, *[F.col(f"x.{c}").alias(c) for c in (*order, size)])


def cap_of(file: Column, caps: dict[str, int], default: int) -> Column:
    """The cap of a file: its own, that of ``*``, or the global one."""
    out = F.lit(caps.get("*", default))
    for name, cap in caps.items():
        if name != "*":
            out = F.when(file == name, cap).otherwise(out)
    return out


def trim_eval(df: DataFrame, kept_windows: int, ratio: float, seed: int) -> DataFrame:
    """Eval records in drawn order until their windows reach ``kept * (1 - ratio) / ratio`` (at least one)."""
    target = max(1, round(kept_windows * (1 - ratio) / ratio))
    rows = df.withColumn("_u", draw.uniform(seed, F.col("file"), F.col("record_idx")))
    rows = running_total(rows, "_u", {"_upto": "wc"}, ("file", "record_idx"))
    return rows.where(F.col("_upto") - F.col("wc") < target).drop("_upto", "_u")


def head_tail_split(df: DataFrame, by: str, order: str, share: float = 0.8) -> DataFrame:
    """Split per group: the first rows train, the others test; a lone group lends its first row to test."""
    w, all_ = Window.partitionBy(by).orderBy(order), Window.partitionBy(by)
    rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(all_))
    cut = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share)).cast("int"))
    rows = rows.withColumn("_c", cut)
    main = rows.withColumn("split", F.when(F.col("_i") <= F.col("_c"), "train").otherwise("test"))
    lent = rows.where((F.col("_c") >= F.col("_n")) & (F.col("_i") == 1)).withColumn("split", F.lit("test"))
    return main.unionByName(lent).drop("_i", "_n", "_c")


def stratified_split(df: DataFrame, label: str, key: str, seed: int, train: float = 0.75) -> DataFrame:
    """Per label the first share of the drawn order trains; one class or a class of one splits without strata."""
    u = draw.uniform(seed, F.col(key))
    ok = df.groupBy(label).count().agg(F.min("count").alias("_m"), F.count("*").alias("_k"))
    rows = df.crossJoin(F.broadcast(ok)).withColumn("_s", F.when(F.col("_m") >= 2, F.col(label).cast("string")).otherwise(F.lit("")))
    w = Window.partitionBy("_s")
    rank = F.row_number().over(w.orderBy("_u", key))
    rows = rows.withColumn("_u", u).withColumn("_i", rank).withColumn("_n", F.count("*").over(w))
    return rows.withColumn("split", F.when(F.col("_i") <= F.ceil(F.col("_n") * train), "train").otherwise("test")).drop("_s", "_m", "_k", "_u", "_i", "_n")


def quota_append(df: DataFrame, cap: int) -> DataFrame:
    """Contigs accepted per species: duplicates and contigs over the cap are skipped.

    A contig skipped for the cap doesn't count as seen. ``df``: species, ord, hash, n.
    Equal hashes have equal lengths, so a later copy of a skipped contig is
    skipped as well, and only first copies matter.
    """
    firsts = df.groupBy("species", "hash").agg(F.min("ord").alias("ord"), F.first("n").alias("n"))
    return keep_under_cap(firsts.select("species", "ord", "n"), "species", ("ord",), "n", F.lit(cap), keep_first=False)


def overshoot_append(df: DataFrame, quota: int, overshoot: int) -> DataFrame:
    """Contigs in order until the quota is met; one that would overshoot by too much is skipped."""
    rows = df.groupBy("species").agg(_ordered("ord", "n").alias("r"))
    zero = F.struct(F.lit(quota).cast("long").alias("left"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("i"))

    def step(a, x):
        take = (a["left"] > 0) & ~((x["n"] > a["left"]) & (x["n"] - a["left"] > overshoot))
        return F.struct((a["left"] - F.when(take, x["n"]).otherwise(0)).cast("long").alias("left"), F.when(take, F.concat(a["kept"], F.array(a["i"]))).otherwise(a["kept"]).alias("kept"), (a["i"] + 1).alias("i"))

    kept = rows.withColumn("k", F.aggregate("r", zero, step)["kept"])
    return kept.select("species", F.explode(F.transform("k", lambda i: F.get("r", i))).alias("x")).select("species", "x.ord", "x.n")


def top_up(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose hash is neither in the existing corpus nor earlier among the new."""
    firsts = new.groupBy("hash").agg(F.min("ord").alias("ord"))
    return firsts.join(existing.select("hash").distinct(), "hash", "left_anti")


def rank_assemblies(df: DataFrame, by: str, levels: list[str]) -> DataFrame:
    """Rank within ``by``: level priority (unknown last), reference first, size descending, id."""
    place = F.lit(len(levels) + 1)
    for i, level in enumerate(levels):
        place = F.when(F.lower("level") == level.lower(), i).otherwise(place)
    category = F.when(F.coalesce(F.length("category"), F.lit(0)) > 0, 0).otherwise(1)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(place, category, F.desc("size"), "id")))


def scale_targets(df: DataFrame, total: float, by: str = "domain") -> DataFrame:
    """Targets scaled so that each domain sums to ``total``."""
    whole = F.sum("target").over(Window.partitionBy(by))
    return df.withColumn("scaled", F.col("target") * total / F.greatest(whole, F.lit(1e-9)))


def use_token_store(complete: bool, paired: bool, turned: bool, indel: bool) -> bool:
    """The token store serves only if it is complete and no view needs the bases."""
    return complete and not (paired or turned or indel)
