"""Queries of the scalar functions (C)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewright.functions import curves, dna, draw, text
from basewright.operators import controls, tokens
from basewright.operators.base import sequences, table
from basewright.plans.registry import add
from basewright.plans.shared_sql import SEQS, count_of, rc, uniform

_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')"


@add("c01_normalize", f"SELECT doc_id, regexp_replace(upper({_ASCII}), '[^ACGTN]', 'N', 'g') AS seq FROM documents")
def c01(spark, sf):
    # letters beyond ASCII change their length in upper case, and engines differ there
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    return table(spark, sf, "documents").select("doc_id", dna.normalize(plain).alias("seq"))


@add("c02_drop_foreign", f"WITH {SEQS} SELECT record_idx, seq FROM seqs")
def c02(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("record_idx"), dna.drop_foreign(F.col("text")).alias("seq"))


@add("c03_reverse_complement", f"WITH {SEQS} SELECT record_idx, {rc('seq')} AS rc, {rc('lower(seq)')} AS rc_lower FROM seqs")
def c03(spark, sf):
    return sequences(spark, sf).select("record_idx", dna.reverse_complement(F.col("seq")).alias("rc"), dna.reverse_complement(F.lower("seq")).alias("rc_lower"))


@add("c04_canonical_hash", f"WITH {SEQS} SELECT record_idx, least(seq, {rc('seq')}) AS canonical, sha256(least(seq, {rc('seq')})) AS hash FROM seqs")
def c04(spark, sf):
    return sequences(spark, sf).select("record_idx", dna.canonical(F.col("seq")).alias("canonical"), dna.canonical_hash(F.col("seq")).alias("hash"))


@add("c05_base_counts", f"WITH {SEQS} SELECT record_idx, {', '.join(f'{count_of("seq", s)}::BIGINT AS n_{s.lower()}' for s in 'ACGTN')}, round(coalesce({count_of('seq', 'GC')} / nullif(length(seq), 0)::DOUBLE, 0), 9) AS gc FROM seqs")
def c05(spark, sf):
    seq = F.col("seq")
    return sequences(spark, sf).select("record_idx", *[dna.count_of(seq, s).cast("long").alias(f"n_{s.lower()}") for s in "ACGTN"], F.round(dna.fraction_of(seq, "GC"), 9).alias("gc"))


@add("c06_strip_n", f"WITH {SEQS} SELECT record_idx, trim(seq, 'N') AS seq FROM seqs")
def c06(spark, sf):
    return sequences(spark, sf).select("record_idx", dna.strip_n(F.col("seq")).alias("seq"))


@add(
    "c07_split_on_n",
    f"""WITH {SEQS}, p AS (SELECT record_idx, regexp_split_to_array(seq, 'N+') AS a FROM seqs),
q AS (SELECT record_idx, len(a) AS n, unnest(a) AS piece, unnest(range(len(a))) AS i FROM p)
SELECT record_idx, i::INT AS piece_idx, piece, CASE WHEN n > 1 THEN record_idx || '_chunk_' || i ELSE record_idx::VARCHAR END AS name FROM q WHERE length(piece) >= 5""",
)
def c07(spark, sf):
    return tokens.contig_pieces(sequences(spark, sf), min_length=5).select("record_idx", "piece_idx", "piece", "name")


@add(
    "c08_chunk_long",
    f"""WITH {SEQS}, c AS (SELECT record_idx, seq, unnest(range(0, length(seq), 700)) AS s FROM seqs)
SELECT record_idx, s::INT AS start, least(s + 700, length(seq))::INT AS stop, substr(seq, s + 1, 700) AS chunk,
  CASE WHEN length(seq) > 700 THEN record_idx || '_' || s || '_' || least(s + 700, length(seq)) ELSE record_idx::VARCHAR END AS name
FROM c WHERE least(s + 700, length(seq)) - s >= 50""",
)
def c08(spark, sf):
    return tokens.long_chunks(sequences(spark, sf), size=700, min_length=50).select("record_idx", "start", "stop", "chunk", "name")


_DIGITS = "list_reduce(list_transform(range(1, 7), lambda i: (strpos('ACGT', substr(kmer, i::INT, 1)) - 1)::BIGINT), lambda a, b: a * 4 + b)"


@add(
    "c09_kmer_ids",
    f"""WITH {SEQS}, k AS (SELECT DISTINCT substr(seq, i::INT, 6) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 4)) AS i FROM seqs))
SELECT kmer, CASE WHEN kmer LIKE '%N%' THEN 0 ELSE {_DIGITS} + 1 END::INT AS kmer_id FROM k""",
)
def c09(spark, sf):
    each = tokens.kmer_rows(sequences(spark, sf), 6, with_n=True).select("kmer").distinct()
    return each.select("kmer", dna.kmer_id(F.col("kmer")).alias("kmer_id"))


@add(
    "c10_kmer_index",
    f"""WITH {SEQS}, k AS (SELECT DISTINCT substr(seq, i::INT, 6) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 4)) AS i FROM seqs) WHERE kmer NOT LIKE '%N%')
SELECT kmer, ({_DIGITS})::INT AS idx FROM k""",
)
def c10(spark, sf):
    return tokens.kmer_rows(sequences(spark, sf), 6).select("kmer").distinct().select("kmer", dna.kmer_index(F.col("kmer")).alias("idx"))


@add(
    "c11_kmers",
    f"""WITH {SEQS} SELECT record_idx, count(*) AS kmers, count(DISTINCT k) AS distinct_kmers FROM
(SELECT record_idx, substr(seq, i::INT, 6) AS k FROM (SELECT record_idx, seq, unnest(range(1, length(seq) - 4)) AS i FROM seqs)) WHERE k NOT LIKE '%N%' GROUP BY record_idx""",
)
def c11(spark, sf):
    rows = tokens.kmer_rows(sequences(spark, sf), 6)
    return rows.groupBy("record_idx").agg(F.count("*").alias("kmers"), F.count_distinct("kmer").alias("distinct_kmers"))


_U = lambda *k: uniform(7, "record_idx::VARCHAR", *[f"'{x}'" for x in k])


@add(
    "c12_indel",
    f"""WITH {SEQS}, d AS (SELECT record_idx, seq, {_U("kind")} AS u, floor({_U("at")} * (length(seq) + 1))::INT AS ins, floor({_U("at")} * length(seq))::INT AS del, floor({_U("base")} * 4)::INT AS b FROM seqs)
SELECT record_idx, CASE WHEN length(seq) < 2 THEN seq WHEN u < 0.5 THEN substr(seq, 1, ins) || substr('ACGT', b + 1, 1) || substr(seq, ins + 1) ELSE substr(seq, 1, del) || substr(seq, del + 2) END AS seq FROM d""",
)
def c12(spark, sf):
    return sequences(spark, sf).select("record_idx", controls.indel(F.col("seq"), 7, F.col("record_idx")).alias("seq"))


@add("c13_dinucleotide_shuffle")
def c13(spark, sf):
    return controls.dinucleotide_shuffled(sequences(spark, sf), 11).select("record_idx", "shuffled", (controls.pair_profile("seq") == controls.pair_profile("shuffled")).alias("same_pairs"))


@add(
    "c14_gc_matched_random",
    f"""WITH {SEQS}, r AS (SELECT record_idx, coalesce({count_of("seq", "GC")} / nullif(length(seq), 0)::DOUBLE, 0) AS gc, unnest(range(1, length(seq) + 1)) AS i FROM seqs),
d AS (SELECT record_idx, i, gc, {uniform(5, "record_idx::VARCHAR", "i::VARCHAR", "'gc'")} AS u, {uniform(5, "record_idx::VARCHAR", "i::VARCHAR", "'base'")} AS v FROM r)
SELECT record_idx, string_agg(CASE WHEN u < gc THEN CASE WHEN v < 0.5 THEN 'G' ELSE 'C' END ELSE CASE WHEN v < 0.5 THEN 'A' ELSE 'T' END END, '' ORDER BY i) AS seq FROM d GROUP BY record_idx""",
)
def c14(spark, sf):
    return sequences(spark, sf).where("length(seq) > 0").select("record_idx", controls.gc_matched(F.col("seq"), 5, F.col("record_idx")).alias("seq"))


@add(
    "c15_sanitize_name",
    """SELECT page_id, CASE WHEN regexp_full_match(url, '[0-9]+') THEN url ELSE trim(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '_') END AS name FROM pages""",
)
def c15(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.sanitize_name(F.col("url")).alias("name"))


@add(
    "c16_slugs",
    r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(replace(trim(url), '\', '/'), '[^A-Za-z0-9_.@+/-]+', '_', 'g'), '/+', '/', 'g'), '/'), ''), 'unnamed') AS key_part,
  lpad(page_id::VARCHAR, 4, '0') || '_' || coalesce(nullif(substr(trim(regexp_replace(regexp_extract(url, '(\S+)', 1), '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), 1, 80), ''), 'sequence') AS stem,
  'filtered_' || regexp_replace(url, '\.gz$', '') AS filtered FROM pages""",
)
def c16(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.metric_key_part(url).alias("key_part"), text.file_stem(url, F.col("page_id")).alias("stem"), text.filtered_name(url).alias("filtered"))


@add(
    "c17_header_field",
    r"""WITH h AS (SELECT page_id, regexp_replace(replace(replace(url, '?', ' '), '&', '|'), '/', ';', 'g') AS header FROM pages),
p AS (SELECT page_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM (SELECT page_id, regexp_split_to_array(trim(translate(header, '|;', '  ')), '\s+') AS parts FROM h)),
m AS (SELECT page_id, arg_min(substr(part, strpos(part, '=') + 1), i) AS v FROM p WHERE part LIKE '%=%' AND replace(lower(trim(split_part(part, '=', 1))), '-', '_') IN ('page', 'ref', 'utm_source') GROUP BY page_id)
SELECT h.page_id, m.v AS value FROM h LEFT JOIN m USING (page_id)""",
)
def c17(spark, sf):
    header = F.replace(F.replace(F.replace("url", F.lit("?"), F.lit(" ")), F.lit("&"), F.lit("|")), F.lit("/"), F.lit(";"))
    return table(spark, sf, "pages").select("page_id", text.header_field(header, "page", "ref", "utm_source").alias("value"))


@add("c18_clean_key", "SELECT DISTINCT p_type, replace(lower(trim(p_type)), '-', '_') AS key FROM part")
def c18(spark, sf):
    return table(spark, sf, "part").select("p_type", text.clean_key(F.col("p_type")).alias("key")).distinct()


_CASES = " ".join(f"WHEN k LIKE '%{w.replace('_', '~_')}%' ESCAPE '~' THEN '{c}'" for w, c in text.TASK_CATEGORIES)


@add("c19_task_category", f"SELECT doc_id, CASE {_CASES} ELSE 'custom' END AS category FROM (SELECT doc_id, replace(lower(trim(text)), '-', '_') AS k FROM documents)")
def c19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.task_category(F.col("text")).alias("category"))


@add(
    "c20_label_coercion",
    """SELECT event_id, CASE WHEN isfinite(try_cast(v AS DOUBLE)) THEN try_cast(v AS DOUBLE) END AS number, nullif(trim(event_type), '') AS label
FROM (SELECT event_id, event_type, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' ELSE json_extract_string(props, '$.k') END AS v FROM events)""",
)
def c20(spark, sf):
    v = F.expr("CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' ELSE get_json_object(props, '$.k') END")
    return table(spark, sf, "events").select("event_id", text.numeric_label(v).alias("number"), text.text_label(F.col("event_type")).alias("label"))


_WORDS = "list_extract(['Pathogenic ', 'benign', 'TRUE', '0', 'unsure', ' case', 'control'], (c_custkey % 7 + 1)::INT)"
_IN = lambda ws: ", ".join(f"'{w}'" for w in ws)


@add(
    "c21_binary_label",
    f"SELECT c_custkey, CASE WHEN lower(trim({_WORDS})) IN ({_IN(text.POSITIVE)}) THEN 1 WHEN lower(trim({_WORDS})) IN ({_IN(text.NEGATIVE)}) THEN 0 END AS label FROM customer",
)
def c21(spark, sf):
    words = F.array(*map(F.lit, ("Pathogenic ", "benign", "TRUE", "0", "unsure", " case", "control")))
    return table(spark, sf, "customer").select("c_custkey", text.binary_label(F.get(words, (F.col("c_custkey") % 7).cast("int"))).alias("label"))


@add("c23_json_paths", "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS value FROM events")
def c23(spark, sf):
    return table(spark, sf, "events").select("event_id", text.first_path(F.col("props"), "$.missing", "$.k").alias("value"))


@add(
    "c24_checkpoint_step",
    r"""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 2 END, try_cast(nullif(regexp_extract(name, 'checkpoint_step_?(\d+)\.pt$', 1), '') AS BIGINT)) AS step FROM
(SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'runs/checkpoint_step_' || o_orderkey || '.pt' WHEN 2 THEN 'checkpoint_step' || o_orderkey || '.pt' ELSE 'checkpoint_best.pt' END AS name FROM orders)""",
)
def c24(spark, sf):
    name = F.expr("CASE o_orderkey % 4 WHEN 1 THEN concat('runs/checkpoint_step_', o_orderkey, '.pt') WHEN 2 THEN concat('checkpoint_step', o_orderkey, '.pt') ELSE 'checkpoint_best.pt' END")
    recorded = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 2 END")
    return table(spark, sf, "orders").select("o_orderkey", text.checkpoint_step(name, recorded).alias("step"))


@add(
    "c25_fuzzy_name",
    """WITH s AS (SELECT n.n_nationkey, r.r_name, 100.0 * (1 - levenshtein(lower(n_name), lower(r_name)) / greatest(length(n_name), length(r_name))::DOUBLE) + CASE WHEN n_regionkey = r_regionkey THEN 2 ELSE 0 END AS score FROM nation n, region r)
SELECT n_nationkey, r_name AS best, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY score DESC, r_name) = 1""",
)
def c25(spark, sf):
    names = F.broadcast(table(spark, sf, "region"))  # a fixed list of names
    rows = table(spark, sf, "nation").crossJoin(names)
    score = text.name_score(F.col("n_name"), F.col("r_name")) + F.when(F.col("n_regionkey") == F.col("r_regionkey"), 2).otherwise(0)
    best = rows.groupBy("n_nationkey").agg(F.min(F.struct((-score).alias("s"), F.col("r_name").alias("best"))).alias("b"))
    return best.select("n_nationkey", "b.best", F.round(-F.col("b.s"), 6).alias("score"))


@add(
    "c26_exact_pick",
    "SELECT s_nationkey, s_suppkey, s_name FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal > 5000 THEN 0 ELSE 1 END, s_suppkey) = 1",
)
def c26(spark, sf):
    w = Window.partitionBy("s_nationkey").orderBy(F.when(F.col("s_acctbal") > 5000, 0).otherwise(1), "s_suppkey")
    return table(spark, sf, "supplier").withColumn("n", F.row_number().over(w)).where("n = 1").select("s_nationkey", "s_suppkey", "s_name")


@add("c28_schedule", "SELECT * FROM (VALUES (0::BIGINT, 1000::BIGINT), (10000, 5000), (50000, 10000)) t(start, every)")
def c28(spark, sf):
    return tokens.schedule(spark, "10000:5000,0:1000, 50000:10000")


@add("c29_digest", "SELECT page_id, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS bytes FROM pages")
def c29(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"))


@add("c30_token_base_length", "SELECT id::INT AS id, CASE WHEN id BETWEEN 5 AND 9 THEN 1 ELSE 0 END AS base_length FROM range(10) t(id)")
def c30(spark, sf):
    return tokens.base_vocabulary(spark).select("id", "base_length")


@add("c31_decode", f"WITH {SEQS} SELECT record_idx, seq FROM seqs")
def c31(spark, sf):
    ids = tokens.encode_base(F.col("seq"), None)["input_ids"]
    return sequences(spark, sf).select("record_idx", tokens.decode_base(ids).alias("seq"))


@add("c32_epoch_format", "SELECT o_orderkey, strftime(make_timestamp(o_custkey * 86399 * 1000000), '%Y-%m-%d %H:%M:%S') AS day FROM orders")
def c32(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.col("o_custkey") * 86399), F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("day"))


_PI = "pi()"
_RATIO = lambda s: f"(0.1 + 0.9 * 0.5 * (1.0 + cos({_PI} * least(greatest(({s} - 100) / 900.0::DOUBLE, 0.0), 1.0))))"


@add(
    "c33_schedules",
    f"""SELECT s AS step,
  round(CASE WHEN s < 100 THEN s / 100.0::DOUBLE WHEN s >= 900 THEN {_RATIO("900")} + (0.1 - {_RATIO("900")}) * least(greatest((s - 900) / 100.0::DOUBLE, 0.0), 1.0) ELSE greatest(0.1, {_RATIO("s")}) END, 9) AS cosine,
  round(CASE WHEN s < 100 THEN s / 100.0::DOUBLE ELSE greatest(0.0, (1000 - s) / 900.0::DOUBLE) END, 9) AS linear, round(CASE WHEN s < 100 THEN s / 100.0::DOUBLE ELSE 1 END, 9) AS constant,
  round(CASE WHEN s >= 400 THEN 0.3 ELSE 0.15 + 0.15 * 0.5 * (1.0 - cos({_PI} * s / 400.0::DOUBLE)) END, 9) AS mask_fraction, round(0.2 * least(1.0, s / 250.0::DOUBLE), 9) AS consistency
FROM range(1001) t(s)""",
)
def c33(spark, sf):
    step = F.col("id")
    made = {"cosine": curves.cosine(step, 100, 1000, 100), "linear": curves.linear(step, 100, 1000), "constant": curves.constant(step, 100), "mask_fraction": curves.mask_fraction(step, 1000), "consistency": curves.ramp(step, 250, 0.2)}
    return spark.range(1001).select(step.alias("step"), *[F.round(c, 9).alias(n) for n, c in made.items()])


@add("c07_4_uniform_draw", f"SELECT doc_id, {uniform(3, 'doc_id::VARCHAR', 'source')} AS u FROM documents")
def draws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", draw.uniform(3, F.col("doc_id"), F.col("source")).alias("u"))
