"""Filters and quality control of sequence records (B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewright.functions import dna

# The share of removed records that a domain tolerates, and its least entropy.
DOMAIN_LIMITS = (("bacteria", 40.0, 1.3), ("archaea", 40.0, 1.4), ("eukaryotes", 50.0, 1.5))
REASONS = ("length", "ambiguous", "n", "entropy", "dup")


def contig_passes(header: Column, seq: Column, min_length: int, max_n_share: float, exclude_plasmids: bool) -> Column:
    """B1; a negative ``max_n_share`` means no limit."""
    ok = (F.length(seq) >= min_length) & (F.length(seq) > 0)
    if max_n_share >= 0:
        ok &= dna.fraction_of(seq, "N") <= max_n_share
    return ok & ~F.upper(header).contains("PLASMID") if exclude_plasmids else ok


def has_foreign(seq: Column, alphabet: str = "ACGTN") -> Column:
    """A symbol outside the alphabet occurs."""
    return seq.rlike(f"[^{alphabet}]")


def foreign_symbols(seq: Column, alphabet: str = "ACGT") -> Column:
    """The distinct symbols outside the alphabet, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(seq, ""), lambda c: (c != "") & ~c.isin(*alphabet))))


def first_by_hash(df: DataFrame, seq: str = "seq", order: tuple[str, ...] = ("file", "record_idx"), digest: str = "hash") -> DataFrame:
    """Mark the first record of each strand-invariant hash as ``is_first``.

    Only digests and the order keys are shuffled, aggregated before the exchange,
    so a hash that fills many rows costs one row a task; sequences stay put.
    """
    hashed = df.withColumn(digest, dna.canonical_hash(F.col(seq)))
    heads = hashed.groupBy(F.col(digest).alias("_h")).agg(F.min(F.struct(*order)).alias("_first"))
    return hashed.join(heads, F.col(digest) == F.col("_h")).withColumn("is_first", F.struct(*order) == F.col("_first")).drop("_h", "_first")


def classify(df: DataFrame, min_length: int = 100, n_percent: float = 5.0, min_entropy: float = 1.5, dedupe: bool = True, trim_n: bool = False) -> DataFrame:
    """``df`` (file, record_idx, seq) with trimmed, reason (null: kept), entropy.

    The first reason wins: length, ambiguous, n, entropy, dup. Duplicates are
    looked for among the records that pass the rest.
    """
    seq = dna.strip_n(F.col("seq")) if trim_n else F.col("seq")
    rows = df.withColumn("trimmed", F.upper(seq)).withColumn("entropy", F.round(dna.entropy(F.col("trimmed")), 9))
    reason = (
        F.when(F.length("trimmed") < min_length, "length")
        .when(has_foreign(F.col("trimmed")), "ambiguous")
        .when(100.0 * dna.fraction_of(F.col("trimmed"), "N") > n_percent, "n")
        .when(F.col("entropy") < min_entropy, "entropy")
    )
    rows = rows.withColumn("reason", reason)
    if not dedupe:
        return rows
    rows = rows.withColumn("hash", F.when(F.col("reason").isNull(), dna.canonical_hash(F.col("trimmed"))))
    heads = rows.where("hash is not null").groupBy(F.col("hash").alias("_h")).agg(F.min(F.struct("file", "record_idx")).alias("_first"))
    rows = rows.join(heads, F.col("hash") == F.col("_h"), "left")
    late = F.col("_first").isNotNull() & (F.struct("file", "record_idx") != F.col("_first"))
    return rows.withColumn("reason", F.when(late, "dup").otherwise(F.col("reason"))).drop("_h", "_first", "hash")


def counters(classified: DataFrame, total: bool = False) -> DataFrame:
    """Counters per file; ``total`` adds a row with a null file over all."""
    kept = F.col("reason").isNull()
    when = lambda c, v: F.sum(F.when(c, v).otherwise(0)).cast("long")
    t = F.col("trimmed")
    aggs = [
        F.count("*").alias("total_seqs"),
        F.sum(F.length("seq")).cast("long").alias("total_bases"),
        when(kept, 1).alias("kept_seqs"),
        when(kept, F.length(t)).alias("kept_bases"),
        *[when(F.col("reason") == r, 1).alias(f"removed_{r}") for r in REASONS],
        when(kept, dna.count_of(t, "GC")).alias("_gc"),
        when(kept, dna.count_of(t, "N")).alias("_n"),
        F.round(F.coalesce(F.avg(F.when(kept, F.col("entropy"))), F.lit(0.0)), 6).alias("mean_entropy"),
    ]
    grouped = classified.groupingSets([["file"], []], "file") if total else classified.groupBy("file")
    rows = grouped.agg(*aggs)
    share = lambda c, d: F.round(F.coalesce(100.0 * F.col(c) / F.nullif(F.col(d), F.lit(0)), F.lit(0.0)), 6)
    rows = rows.withColumn("removed_total", F.col("total_seqs") - F.col("kept_seqs"))
    rows = rows.withColumns({"gc_percent": share("_gc", "kept_bases"), "n_percent": share("_n", "kept_bases"), "percent_removed": share("removed_total", "total_seqs")})
    return rows.drop("_gc", "_n")


def gate(stats: DataFrame, file_limit: float = 90.0) -> DataFrame:
    """Per domain total, removed, percent, bad_files and passed; ``stats`` has domain, total_seqs, removed_total."""
    limits = stats.sparkSession.createDataFrame([(d, p) for d, p, _ in DOMAIN_LIMITS], "limit_domain string, max_removed double")
    default = dict((d, p) for d, p, _ in DOMAIN_LIMITS)["bacteria"]
    bad = (F.col("total_seqs") > 0) & (100.0 * F.col("removed_total") / F.col("total_seqs") > file_limit)
    rows = stats.groupBy("domain").agg(F.sum("total_seqs").alias("total"), F.sum("removed_total").alias("removed"), F.sum(bad.cast("long")).alias("bad_files"))
    rows = rows.join(F.broadcast(limits), F.col("domain") == F.col("limit_domain"), "left").withColumn("limit", F.coalesce("max_removed", F.lit(default)))
    percent = F.round(F.coalesce(100.0 * F.col("removed") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 6)
    rows = rows.withColumn("percent_removed", percent)
    return rows.select("domain", "total", "removed", "percent_removed", "limit", "bad_files", ((F.col("total") > 0) & (F.col("percent_removed") <= F.col("limit")) & (F.col("bad_files") == 0)).alias("passed"))


def describe(df: DataFrame) -> DataFrame:
    """One row of count, min, max, mean and exact median of GC, N and length."""
    seq = F.col("seq")
    rows = df.select(F.round(100 * dna.fraction_of(seq, "GC"), 6).alias("gc"), F.round(100 * dna.fraction_of(seq, "N"), 6).alias("n"), F.length(seq).alias("length"))
    aggs = [f(c).alias(f"{name}_{c}") for c in ("gc", "n", "length") for name, f in (("min", F.min), ("max", F.max))]
    aggs += [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("gc", "n", "length")]
    aggs += [F.round(F.median(c), 6).alias(f"median_{c}") for c in ("gc", "n", "length")]
    return rows.agg(F.count("*").alias("records"), *aggs)


def length_histogram(df: DataFrame, width: int = 500) -> DataFrame:
    """Records per length bucket."""
    return df.groupBy((F.floor(F.length("seq") / width) * width).cast("long").alias("bucket")).agg(F.count("*").alias("records"))


def composition(df: DataFrame, *by: str) -> DataFrame:
    """Symbol counts per group."""
    return df.groupBy(*by).agg(*[F.sum(dna.count_of(F.col("seq"), s)).cast("long").alias(f"n_{s.lower()}") for s in "ACGTN"])


def prefix_check(df: DataFrame, max_n_percent: float = 1.0, min_records: int = 1, first: int = 1000) -> DataFrame:
    """Records and N share over the first records of each file, and whether they pass."""
    w = Window.partitionBy("file").orderBy("record_idx")
    head = df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= first)
    rows = head.groupBy("file").agg(F.count("*").alias("records"), F.sum(F.length("seq")).cast("long").alias("bases"), F.sum(dna.count_of(F.col("seq"), "N")).cast("long").alias("n_bases"))
    percent = F.round(F.coalesce(100.0 * F.col("n_bases") / F.nullif(F.col("bases"), F.lit(0)), F.lit(0.0)), 6)
    return rows.withColumn("n_percent", percent).withColumn("passed", (F.col("records") >= min_records) & (F.col("n_percent") <= max_n_percent))


def size_check(sizes: DataFrame, target: float, tolerance: float = 0.2) -> DataFrame:
    """Domain, bases and whether they lie within the tolerance of the target."""
    return sizes.withColumn("within", F.col("bases").between(target * (1 - tolerance), target * (1 + tolerance)))


def preflight(history: DataFrame, by: str, min_rows: int = 2) -> DataFrame:
    """Per run rows, first and last loss, worst batch excess and whether it passes."""
    finite = ~F.isnan("loss") & (F.abs("loss") < float("inf"))
    rows = history.groupBy(by).agg(
        F.count("*").alias("rows"),
        F.min_by("loss", "step").alias("first_loss"),
        F.max_by("loss", "step").alias("last_loss"),
        F.coalesce(F.bool_and(finite), F.lit(False)).alias("finite"),
        F.coalesce(F.bool_and((F.col("batches") > 0) & (F.col("batches") <= F.col("max_batches"))), F.lit(True)).alias("batches_ok"),
    )
    return rows.withColumn("passed", (F.col("rows") >= min_rows) & F.col("finite") & (F.col("last_loss") <= F.col("first_loss")) & F.col("batches_ok"))
