"""Queries of windows, splits, caps and quotas (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basewright.functions import dna
from basewright.operators import windows
from basewright.operators.base import sequences, table
from basewright.plans.registry import add
from basewright.plans.shared_sql import SEQS, rc, uniform

_COUNT = "CASE WHEN n < 16 THEN 0 WHEN n <= 64 THEN 1 ELSE floor(least(n - 16, 32 * ceil((n - 64) / 32.0)) / 32)::BIGINT + 1 END"
_WC = f"{SEQS}, l AS (SELECT file, record_idx, length(seq) AS n FROM seqs), wc AS (SELECT file, record_idx, {_COUNT} AS wc FROM l)"


def _counts(spark, sf):
    return sequences(spark, sf).select("file", "record_idx", windows.window_count(F.length("seq"), 64, 32, 16).alias("wc"))


@add(
    "e01_sliding_windows",
    f"""WITH RECURSIVE {SEQS}, w AS (SELECT file, record_idx, length(seq) AS n, 0 AS i, 0 AS s FROM seqs WHERE length(seq) >= 16
UNION ALL SELECT file, record_idx, n, i + 1, s + 32 FROM w WHERE s + 64 < n AND s + 32 <= n - 16)
SELECT file, record_idx, i::INT AS window_idx, s::INT AS start, least(s + 64, n)::INT AS stop FROM w""",
)
def e01(spark, sf):
    return windows.sliding_windows(sequences(spark, sf), 64, 32, 16).select("file", "record_idx", "window_idx", "start", "stop")


@add("e02_window_count", f"WITH {_WC} SELECT file, record_idx, wc::BIGINT AS wc FROM wc")
def e02(spark, sf):
    return _counts(spark, sf)


@add(
    "e03_window_bases",
    f"""WITH RECURSIVE {SEQS}, w AS (SELECT record_idx, seq, length(seq) AS n, 0 AS s FROM seqs WHERE length(seq) >= 64
UNION ALL SELECT record_idx, seq, n, s + 128 FROM w WHERE s + 256 < n AND s + 128 <= n - 64)
SELECT record_idx, s::INT AS start, substr(seq, s + 1, least(s + 256, n) - s) AS seq FROM w""",
)
def e03(spark, sf):
    return windows.sliding_windows(sequences(spark, sf), 256, 128, with_seq=True).select("record_idx", "start", "seq")


_SPLIT = """t AS (SELECT file, floor(sum(wc) * 0.9)::BIGINT AS target FROM wc WHERE wc > 0 GROUP BY file),
o AS (SELECT file, record_idx, wc, row_number() OVER (PARTITION BY file ORDER BY record_idx) AS i, target FROM wc JOIN t USING (file) WHERE wc > 0),
f AS (SELECT file, record_idx, wc, i, target, 0::BIGINT AS before, wc <= target OR (target > 0 AND target > wc / 2.0) AS train FROM o WHERE i = 1
  UNION ALL SELECT o.file, o.record_idx, o.wc, o.i, o.target, f.before + CASE WHEN f.train THEN f.wc ELSE 0 END,
    f.before + CASE WHEN f.train THEN f.wc ELSE 0 END + o.wc <= o.target OR (f.before + CASE WHEN f.train THEN f.wc ELSE 0 END < o.target AND o.target - (f.before + CASE WHEN f.train THEN f.wc ELSE 0 END) > o.wc / 2.0)
  FROM f JOIN o ON o.file = f.file AND o.i = f.i + 1)"""


@add(
    "e04_record_split",
    f"""WITH RECURSIVE {_WC}, {_SPLIT},
a AS (SELECT *, bool_or(train) OVER (PARTITION BY file) AS any_train FROM f),
b AS (SELECT file, record_idx, wc, CASE WHEN any_train THEN train ELSE i = 1 END AS train FROM a),
c AS (SELECT *, bool_and(train) OVER (PARTITION BY file) AND count(*) OVER (PARTITION BY file) > 1 AS lone, row_number() OVER (PARTITION BY file ORDER BY wc, record_idx) AS r FROM b)
SELECT file, record_idx, wc::BIGINT AS wc, CASE WHEN lone AND r = 1 THEN 'eval' WHEN train THEN 'train' ELSE 'eval' END AS split FROM c""",
)
def e04(spark, sf):
    return windows.split_records(_counts(spark, sf), 0.9)


@add("e05_split_repair", "SELECT 'a' AS file, 0::BIGINT AS record_idx, 5::BIGINT AS wc, 'train' AS split UNION ALL SELECT 'a', 1, 9, 'eval' UNION ALL SELECT 'b', 0, 9, 'train' UNION ALL SELECT 'b', 1, 3, 'eval' UNION ALL SELECT 'c', 7, 4, 'train'")
def e05(spark, sf):
    # a: nothing fits a tiny target; b: both fit; c: a lone record
    rows = spark.createDataFrame([("a", 0, 5), ("a", 1, 9)], "file string, record_idx long, wc long")
    more = spark.createDataFrame([("b", 0, 9), ("b", 1, 3), ("c", 7, 4)], "file string, record_idx long, wc long")
    return windows.split_records(rows, 0.01).unionByName(windows.split_records(more, 1.0))


@add(
    "e06_cap_by_file",
    f"""WITH RECURSIVE {_WC}, o AS (SELECT file, record_idx, wc, row_number() OVER (PARTITION BY file ORDER BY -wc, record_idx) AS i, CASE file WHEN 'src0' THEN 900 WHEN 'src1' THEN 40 ELSE 300 END AS cap FROM wc WHERE wc > 0),
f AS (SELECT file, record_idx, wc, i, cap, wc::BIGINT AS total, TRUE AS kept FROM o WHERE i = 1
  UNION ALL SELECT o.file, o.record_idx, o.wc, o.i, o.cap, CASE WHEN f.total + o.wc <= o.cap THEN f.total + o.wc ELSE f.total END, f.total + o.wc <= o.cap FROM f JOIN o ON o.file = f.file AND o.i = f.i + 1)
SELECT file, record_idx, wc::BIGINT AS wc FROM f WHERE kept""",
)
def e06(spark, sf):
    rows = _counts(spark, sf).where("wc > 0").withColumn("neg", -F.col("wc")).withColumn("cap", windows.cap_of(F.col("file"), {"src0": 900, "src1": 40, "*": 300}, 1000))
    return windows.keep_under_cap(rows, "file", ("neg", "record_idx"), "wc", "cap").select("file", "record_idx", "wc")


@add(
    "e07_eval_trim",
    f"""WITH {_WC}, u AS (SELECT file, record_idx, wc, {uniform(13, "file", "record_idx::VARCHAR")} AS u FROM wc WHERE wc > 0),
b AS (SELECT *, sum(wc) OVER (ORDER BY u, file, record_idx) - wc AS before FROM u) SELECT file, record_idx, wc::BIGINT AS wc FROM b WHERE before < 1000""",
)
def e07(spark, sf):
    return windows.trim_eval(_counts(spark, sf).where("wc > 0"), 9000, 0.9, 13)


@add("e08_min_length", f"WITH {SEQS} SELECT file, record_idx, length(seq)::INT AS len FROM seqs WHERE length(seq) >= 256")
def e08(spark, sf):
    return sequences(spark, sf).where(F.length("seq") >= 256).select("file", "record_idx", F.length("seq").alias("len"))


@add(
    "e09_head_tail_split",
    """WITH r AS (SELECT n_name AS grp, s_suppkey AS id, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY n_name) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey),
c AS (SELECT *, greatest(1, round_even(n * 0.8, 0)) AS cut FROM r) SELECT grp, id, CASE WHEN i <= cut THEN 'train' ELSE 'test' END AS split FROM c UNION ALL SELECT grp, id, 'test' FROM c WHERE cut >= n AND i = 1""",
)
def e09(spark, sf):
    rows = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("grp"), F.col("s_suppkey").alias("id"))
    return windows.head_tail_split(rows, "grp", "id")


@add(
    "e10_stratified_split",
    f"""WITH u AS (SELECT doc_id, quality, {uniform(17, "doc_id::VARCHAR")} AS u FROM labels)
SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY u, doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * 0.75) THEN 'train' ELSE 'test' END AS split FROM u""",
)
def e10(spark, sf):
    return windows.stratified_split(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 17)


@add(
    "e11_quota_append",
    f"""WITH RECURSIVE {SEQS}, h AS (SELECT file AS species, record_idx AS ord, length(seq) AS n, row_number() OVER (PARTITION BY file, sha256(least(seq, {rc("seq")})) ORDER BY record_idx) AS d FROM seqs),
o AS (SELECT species, ord, n, row_number() OVER (PARTITION BY species ORDER BY ord) AS i FROM h WHERE d = 1),
f AS (SELECT species, ord, n, i, CASE WHEN n <= 20000 THEN n ELSE 0 END AS total, n <= 20000 AS kept FROM o WHERE i = 1
  UNION ALL SELECT o.species, o.ord, o.n, o.i, CASE WHEN f.total + o.n <= 20000 THEN f.total + o.n ELSE f.total END, f.total + o.n <= 20000 FROM f JOIN o ON o.species = f.species AND o.i = f.i + 1)
SELECT species, ord, n::INT AS n FROM f WHERE kept""",
)
def e11(spark, sf):
    rows = sequences(spark, sf).select(F.col("file").alias("species"), F.col("record_idx").alias("ord"), dna.canonical_hash(F.col("seq")).alias("hash"), F.length("seq").alias("n"))
    return windows.quota_append(rows, 20_000)


@add(
    "e12_overshoot",
    f"""WITH RECURSIVE {SEQS}, o AS (SELECT file AS species, record_idx AS ord, length(seq) AS n, row_number() OVER (PARTITION BY file ORDER BY record_idx) AS i FROM seqs),
f AS (SELECT species, ord, n, i, 20000::BIGINT AS avail, NOT (n > 20000 AND n - 20000 > 300) AS kept FROM o WHERE i = 1
  UNION ALL SELECT o.species, o.ord, o.n, o.i, f.avail - CASE WHEN f.kept THEN f.n ELSE 0 END,
    f.avail - CASE WHEN f.kept THEN f.n ELSE 0 END > 0 AND NOT (o.n > f.avail - CASE WHEN f.kept THEN f.n ELSE 0 END AND o.n - (f.avail - CASE WHEN f.kept THEN f.n ELSE 0 END) > 300) FROM f JOIN o ON o.species = f.species AND o.i = f.i + 1)
SELECT species, ord, n::INT AS n FROM f WHERE kept""",
)
def e12(spark, sf):
    rows = sequences(spark, sf).select(F.col("file").alias("species"), F.col("record_idx").alias("ord"), F.length("seq").alias("n"))
    return windows.overshoot_append(rows, 20_000, 300)


@add(
    "e13_top_up",
    f"""WITH {SEQS}, h AS (SELECT domain, record_idx AS ord, sha256(least(seq, {rc("seq")})) AS hash FROM seqs)
SELECT hash, min(ord) AS ord FROM h WHERE domain = 'en' AND hash NOT IN (SELECT hash FROM h WHERE domain <> 'en') GROUP BY hash""",
)
def e13(spark, sf):
    rows = sequences(spark, sf).select("domain", F.col("record_idx").alias("ord"), dna.canonical_hash(F.col("seq")).alias("hash"))
    return windows.top_up(rows.where("domain <> 'en'"), rows.where("domain = 'en'"))


@add(
    "e14_assembly_rank",
    """SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE split_part(p_type, ' ', 1) WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 3 END, CASE WHEN p_size > 25 THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey)::INT AS rank FROM part""",
)
def e14(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("id"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("level"), F.when(F.col("p_size") > 25, "yes").alias("category"), F.col("p_retailprice").alias("size"))
    return windows.rank_assemblies(rows, "p_brand", ["promo", "economy"]).select("p_brand", F.col("id").alias("p_partkey"), "rank")


@add("e15_scaled_targets", "SELECT s_suppkey, s_nationkey, round(abs(s_acctbal) * 1000 / greatest(sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey), 1e-9), 6) AS scaled FROM supplier")
def e15(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.abs("s_acctbal").alias("target"))
    return windows.scale_targets(rows, 1000, "s_nationkey").select("s_suppkey", "s_nationkey", F.round("scaled", 6).alias("scaled"))
