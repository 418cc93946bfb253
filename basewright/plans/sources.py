"""Queries of sources and sinks (A)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from basewright.functions import text as tx
from basewright.operators import tokens
from basewright.operators.base import scratch, sequences, table
from basewright.plans.registry import add
from basewright.plans.shared_sql import SEQS
from basewright.sources import fasta, tabular

_HEADED = f"WITH {SEQS} SELECT domain || '|id=' || record_idx || ';len=' || length(seq) AS header, seq FROM seqs"


def _records(spark, sf):
    header = F.concat(F.col("domain"), F.lit("|id="), F.col("record_idx"), F.lit(";len="), F.length("seq"))
    return sequences(spark, sf).select("file", "record_idx", "domain", header.alias("header"), "seq")


@add("a01_fasta_scan", _HEADED)
def a01(spark, sf):
    path = f"{scratch(spark)}/fasta-{uuid.uuid4().hex}"
    fasta.write_fasta(_records(spark, sf), path)
    return fasta.read_fasta(spark, path).select("header", "seq")


@add("a02_gzip_scan", _HEADED)
def a02(spark, sf):
    path = f"{scratch(spark)}/fasta-{uuid.uuid4().hex}"
    fasta.write_fasta(_records(spark, sf), path, "gzip")
    return fasta.read_fasta(spark, path, keep_empty=True).select("header", "seq")


_LINES = "lines AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '>' || role || turn ELSE replace(text, chr(10), ' ') END AS line FROM conversations)"


def _lines(spark, sf):
    line = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(">"), F.col("role"), F.col("turn"))).otherwise(F.replace("text", F.lit("\n"), F.lit(" ")))
    return table(spark, sf, "conversations").select("conv_id", "turn", line.alias("line"))


@add(
    "a03_line_stitching",
    f"""WITH {_LINES}, r AS (SELECT *, sum((line LIKE '>%')::INT) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS record_idx FROM lines)
SELECT conv_id, record_idx::BIGINT AS record_idx, max(substr(line, 2)) FILTER (line LIKE '>%') AS header, coalesce(string_agg(trim(line), '' ORDER BY turn) FILTER (line NOT LIKE '>%'), '') AS seq FROM r WHERE record_idx >= 0 GROUP BY conv_id, record_idx""",
)
def a03(spark, sf):
    return fasta.stitched(_lines(spark, sf), "conv_id", "turn", "line")


@add(
    "a04_record_offsets",
    f"""WITH {_LINES}, r AS (SELECT *, octet_length(encode(line)) + 1 AS n, sum((line LIKE '>%')::INT) OVER w - 1 AS record_idx, sum(octet_length(encode(line)) + 1) OVER w AS e FROM lines WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, record_idx::BIGINT AS record_idx, min(e - n)::BIGINT AS byte_start, max(e)::BIGINT AS byte_end, sum(CASE WHEN line LIKE '>%' THEN 0 ELSE length(trim(line)) END)::BIGINT AS seq_len FROM r WHERE record_idx >= 0 GROUP BY conv_id, record_idx""",
)
def a04(spark, sf):
    return fasta.record_offsets(_lines(spark, sf), "conv_id", "turn", "line")


@add("a05_record_lookup", f"WITH {SEQS} SELECT record_idx, seq FROM seqs WHERE record_idx IN (SELECT doc_id FROM labels WHERE quality = 1)")
def a05(spark, sf):
    wanted = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("record_idx"))
    return fasta.select_records(sequences(spark, sf), wanted, ["record_idx"]).select("record_idx", "seq")


@add(
    "a06_chunked_scan",
    f"""WITH {SEQS}, c AS (SELECT record_idx, seq, unnest(range(0, greatest(length(seq), 1), 500)) AS s FROM seqs)
SELECT record_idx, (s // 500)::INT AS chunk_idx, substr(seq, s + 1, 500) AS chunk, s + 500 >= length(seq) AS is_last FROM c""",
)
def a06(spark, sf):
    return fasta.chunked(sequences(spark, sf), 500).select("record_idx", "chunk_idx", "chunk", "is_last")


@add(
    "a07_file_order",
    """WITH n AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN source || '.fa' ELSE 'filtered_genome' || substr(source, 4) || '.fa' END AS name FROM documents)
SELECT name, row_number() OVER (ORDER BY CASE WHEN name LIKE 'filtered%' THEN 0 ELSE 1 END, CASE WHEN name LIKE 'filtered%' THEN regexp_extract(name, '(\\d+)', 1)::INT ELSE 0 END, name)::INT AS place FROM n""",
)
def a07(spark, sf):
    from pyspark.sql.window import Window

    name = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit(".fa"))).otherwise(F.concat(F.lit("filtered_genome"), F.substring("source", 4, 99), F.lit(".fa")))
    names = table(spark, sf, "documents").select(name.alias("name")).distinct()  # one row a file
    return names.withColumn("place", F.row_number().over(Window.orderBy(tx.number_key(F.col("name")), "name")))


@add("a08_tabular_formats", "SELECT DISTINCT n_name AS name, n_regionkey::VARCHAR AS region, f.format FROM nation, (VALUES ('csv'), ('tsv'), ('jsonl')) f(format)")
def a08(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    base, out = f"{scratch(spark)}/table-{uuid.uuid4().hex}", None
    rows.write.csv(f"{base}.csv", header=True)
    rows.write.csv(f"{base}.tsv", header=True, sep="\t")
    rows.write.json(f"{base}.jsonl")
    for kind in ("csv", "tsv", "jsonl"):
        one = tabular.read_rows(spark, f"{base}.{kind}").select("name", "region", F.lit(kind).alias("format"))
        out = one if out is None else out.unionByName(one)
    return out


@add("a10_targets", "SELECT n_name AS name, NULL::VARCHAR AS tax_id, CASE WHEN n_nationkey % 2 = 0 THEN 100.0 ELSE n_nationkey::DOUBLE END AS target_mb FROM nation")
def a10(spark, sf):
    path = f"{scratch(spark)}/targets-{uuid.uuid4().hex}.csv"
    table(spark, sf, "nation").select(F.col("n_name").alias("species"), F.when(F.col("n_nationkey") % 2 == 1, F.col("n_nationkey")).alias("target_mb")).write.csv(path, header=True)
    return tabular.read_targets(spark, path)


@add("a11_usable_species", "SELECT trim(s_name) AS name, s_suppkey::VARCHAR AS tax_id, CASE s_nationkey % 4 WHEN 0 THEN 'bacteria' WHEN 1 THEN 'archaea' ELSE 'eukaryotes' END AS domain, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 100.0 END AS target_mb FROM supplier WHERE s_nationkey % 4 < 3")
def a11(spark, sf):
    domain = F.expr("CASE s_nationkey % 4 WHEN 0 THEN 'Bacteria ' WHEN 1 THEN 'archaea' WHEN 2 THEN 'Eukaryotes' ELSE 'virus' END")
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("tax_id"), domain.alias("domain"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("target_mb"))
    return tabular.usable_species(rows)


@add("a12_labelled_records", f"WITH {SEQS} SELECT record_idx, CASE WHEN record_idx % 2 = 0 THEN domain ELSE file END AS label FROM seqs")
def a12(spark, sf):
    header = F.when(F.col("record_idx") % 2 == 0, F.concat(F.lit("x|Class="), F.col("domain"), F.lit(";n=1"))).otherwise("plain")
    rows = sequences(spark, sf).select(F.concat(F.lit("/data/"), F.col("file"), F.lit(".fa.gz")).alias("file"), "record_idx", header.alias("header"))
    return fasta.labelled(rows, ["class"]).select("record_idx", "label")


@add("a13_fasta_sink", f"WITH {SEQS} SELECT count(*) AS records, sum(length(seq))::BIGINT AS bases FROM seqs")
def a13(spark, sf):
    path = f"{scratch(spark)}/fasta-{uuid.uuid4().hex}"
    fasta.write_fasta(_records(spark, sf), path)
    return fasta.read_fasta(spark, path).agg(F.count("*").alias("records"), F.sum(F.length("seq")).alias("bases"))


def _stored_tokens(spark, sf):
    path, meta = f"{scratch(spark)}/store-{uuid.uuid4().hex}", tokens.tokenizer_metadata("base", list("ACGTN"), 3)
    fasta.write_token_store(tokens.token_store(sequences(spark, sf)), path, meta)
    return fasta.read_token_store(spark, path, meta)


@add("a14_token_store", f"WITH {SEQS} SELECT file, sum(length(seq))::BIGINT AS tokens, count(*) AS records FROM seqs GROUP BY file")
def a14(spark, sf):
    return _stored_tokens(spark, sf).groupBy("file").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"))


@add("a15_store_violations", f"WITH {SEQS}, s AS (SELECT file, record_idx, length(seq) AS n, sum(length(seq)) OVER (PARTITION BY file ORDER BY record_idx) AS e FROM seqs), b AS (SELECT file, record_idx, e - n + CASE WHEN record_idx % 50 = 7 THEN 1 ELSE 0 END AS token_start FROM s) SELECT file, record_idx, token_start::BIGINT AS token_start FROM b WHERE record_idx % 50 = 7")
def a15(spark, sf):
    broken = tokens.token_store(sequences(spark, sf)).withColumn("token_start", F.col("token_start") + F.when(F.col("record_idx") % 50 == 7, 1).otherwise(0))
    return fasta.store_violations(broken).select("file", "record_idx", "token_start")


@add("a16_report_format", "SELECT s_suppkey, printf('%.2f', s_acctbal) AS balance, printf('%.3f', s_acctbal / 7) AS seventh FROM supplier")
def a16(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), (F.col("s_acctbal") / 7).alias("seventh"))
    return tabular.formatted(rows, two=("balance",), three=("seventh",))


@add("a17_json_report", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS value FROM region""")
def a17(spark, sf):
    path = f"{scratch(spark)}/report-{uuid.uuid4().hex}"
    tabular.write_json(table(spark, sf, "region").select("r_regionkey", "r_name"), path)
    return spark.read.text(path)


@add("a18_tolerant_history", "SELECT CASE WHEN event_id % 7 = 1 THEN -1 ELSE event_id END AS step, value AS loss FROM events WHERE event_id % 7 <> 0")
def a18(spark, sf):
    e = table(spark, sf, "events")
    v = F.col("value").cast("string")
    line = F.when(F.col("event_id") % 7 == 0, '{"step": 1, "lo').when(F.col("event_id") % 7 == 1, F.concat(F.lit('{"loss": '), v, F.lit("}"))).otherwise(F.concat(F.lit('{"step": '), F.col("event_id"), F.lit(', "loss": '), v, F.lit("}")))
    path = f"{scratch(spark)}/history-{uuid.uuid4().hex}"
    e.select(line.alias("value")).write.text(path)
    return tabular.parsed_history(spark.read.text(path), "value")
