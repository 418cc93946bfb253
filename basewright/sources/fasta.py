"""FASTA and class-directory scans, FASTA and token-store sinks."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.window import Window

from basewright.functions import text as tx

SCHEMA = "file string, record_idx long, header string, seq string"


def read_fasta(spark: SparkSession, path: str, mode: str = "strict", keep_empty: bool = True) -> DataFrame:
    """A1, A2, A3: records of FASTA files: file, record_idx, header, seq (stitched, stripped).

    The text source splits files at ``\\n>``, so a record is a row and large
    files are read in parallel; .gz files are inflated by their name. Text
    before the first header: ``strict`` raises, ``drop`` leaves it out,
    ``prepend`` puts it before the first record's bases. ``record_idx`` counts
    all records of a file, also empty ones.
    """
    if mode not in ("strict", "drop", "prepend"):
        raise ValueError(f"unknown mode: {mode}")
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    order = Window.partitionBy("file").orderBy("_b", "_m")
    rows = raw.withColumn("_i", F.row_number().over(order) - 1)
    first = F.col("_i") == 0
    clean = F.regexp_replace("value", r"\r", "")
    headed = ~first | F.col("value").startswith(">")
    body = F.when(first & F.col("value").startswith(">"), F.substring(clean, F.lit(2), F.length(clean))).otherwise(clean)
    header = F.trim(F.substring_index(body, "\n", 1))
    seq = F.regexp_replace(F.when(F.instr(body, "\n") > 0, F.substring(body, F.instr(body, "\n") + 1, F.length(body))).otherwise(""), r"\s+", "")
    orphan = F.regexp_replace(clean, r"\s+", "")
    rows = rows.select("file", "_i", headed.alias("_h"), F.when(headed, header).alias("header"), F.when(headed, seq).otherwise(orphan).alias("seq"))
    w = Window.partitionBy("file")
    rows = rows.withColumn("_lead", F.max(F.when(~F.col("_h"), F.col("seq"))).over(w))
    if mode == "strict":
        bad = F.length(F.coalesce("_lead", F.lit(""))) > 0
        rows = rows.withColumn("seq", F.when(bad, F.raise_error(F.concat(F.lit("sequence before the first header in "), F.col("file"))).cast("string")).otherwise(F.col("seq")))
    shift = F.when(F.col("_lead").isNull(), 0).otherwise(1)
    rows = rows.withColumn("record_idx", (F.col("_i") - shift).cast("long"))
    if mode == "prepend":
        rows = rows.withColumn("seq", F.when((F.col("record_idx") == 0) & F.col("_lead").isNotNull(), F.concat("_lead", "seq")).otherwise(F.col("seq")))
    rows = rows.where("_h").select("file", "record_idx", "header", "seq")
    return rows if keep_empty else rows.where(F.length("seq") > 0)


def write_fasta(df: DataFrame, path: str, compression: str = "none") -> None:
    """``>header`` and the bases on the next line, in record order within each part."""
    df.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("seq")).alias("value")).write.option("compression", compression).text(path)


def stitched(df: DataFrame, group: str, order: str, line: str) -> DataFrame:
    """A3: stitch lines: a line with ``>`` opens a record, the following ones are its bases."""
    w = Window.partitionBy(group).orderBy(order)
    head = F.col(line).startswith(">")
    rows = df.withColumn("record_idx", F.sum(head.cast("int")).over(w) - 1).where("record_idx >= 0")
    parts = F.array_sort(F.collect_list(F.when(~head, F.struct(order, F.trim(line).alias("v")))))
    out = rows.groupBy(group, "record_idx").agg(F.max(F.when(head, F.substring(line, F.lit(2), F.length(line)))).alias("header"), parts.alias("_p"))
    return out.select(group, F.col("record_idx").cast("long").alias("record_idx"), "header", F.array_join(F.transform("_p", lambda p: p["v"]), "").alias("seq"))


def record_offsets(df: DataFrame, group: str, order: str, line: str) -> DataFrame:
    """A4: byte_start, byte_end and base length of each record, lines ending in one byte."""
    w = Window.partitionBy(group).orderBy(order)
    head = F.col(line).startswith(">")
    size = F.octet_length(line) + 1
    rows = df.withColumn("_end", F.sum(size).over(w)).withColumn("record_idx", F.sum(head.cast("int")).over(w) - 1).where("record_idx >= 0")
    return rows.groupBy(group, F.col("record_idx").cast("long").alias("record_idx")).agg(F.min(F.col("_end") - size).alias("byte_start"), F.max("_end").alias("byte_end"), F.sum(F.when(head, 0).otherwise(F.length(F.trim(line)))).cast("long").alias("seq_len"))


def select_records(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """A5: the records that ``wanted`` names."""
    return df.join(wanted.select(*keys).distinct(), keys, "left_semi")


def chunked(df: DataFrame, size: int) -> DataFrame:
    """A record in chunks of ``size`` bases, the last marked; an empty record has one empty chunk."""
    n = F.length("seq")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    rows = df.select("*", F.posexplode(starts).alias("chunk_idx", "start"))
    return rows.withColumn("chunk", F.substring("seq", F.col("start") + 1, F.lit(size))).withColumn("is_last", F.col("start") + size >= n).drop("seq")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """The distinct files that a glob matches: path and name, in the numeric-aware order of names."""
    files = spark.read.format("binaryFile").load(path).select("path").distinct()
    name = F.substring_index("path", "/", -1)
    return files.withColumn("name", name).orderBy(tx.number_key(name), "path")


def read_class_folders(spark: SparkSession, path: str, per_split: int | None = None) -> DataFrame:
    """Split, label, file, seq of ``<split>/<class>/<file>``; header lines are dropped."""
    files = spark.read.text(f"{path}/*/*/*", wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    bases = F.regexp_replace(F.regexp_replace("value", r"(?m)^>.*$", ""), r"\s+", "")
    place = F.split("file", "/")
    rows = files.select(F.element_at(place, -3).alias("split"), F.element_at(place, -2).alias("label"), "file", bases.alias("seq")).where(F.length("seq") > 0)
    if per_split is None:
        return rows
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy("split").orderBy("file"))).where(F.col("_i") <= per_split).drop("_i")


def labelled(df: DataFrame, keys: list[str], default: str | None = None) -> DataFrame:
    """``df`` with ``label``: from the header, else the default, else the stem of the file name."""
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"\.(fa|fasta|fna)(\.gz)?$", "")
    return df.withColumn("label", F.coalesce(tx.header_field(F.col("header"), *keys), F.lit(default), stem))


def write_token_store(df: DataFrame, path: str, metadata: dict, force: bool = False) -> bool:
    """Write a token store unless a compatible one is there; an incompatible one is an error without ``force``."""
    spark = df.sparkSession
    try:
        found = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    except Exception as e:  # the path may be in any store; only a missing one is expected
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = None
    if found == metadata:
        return False
    if found is not None and not force:
        raise ValueError("an incompatible token store is there; use force")
    df.write.mode("overwrite").partitionBy("file").parquet(f"{path}/tokens")
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return True


def read_token_store(spark: SparkSession, path: str, metadata: dict) -> DataFrame:
    """The tokens of a store whose metadata is the wanted one."""
    found = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if found != metadata:
        raise ValueError("the token store was made with another tokenizer")
    return spark.read.parquet(f"{path}/tokens")


def store_violations(df: DataFrame) -> DataFrame:
    """Rows of a store whose offsets are negative, don't fit the counts or leave a gap."""
    before = F.lag("token_end").over(Window.partitionBy("file").orderBy("record_idx"))
    rows = df.withColumn("_before", F.coalesce(before, F.lit(0)))
    bad = (F.col("token_start") < 0) | (F.col("token_end") - F.col("token_start") != F.col("n_tokens")) | (F.size("input_ids") != F.col("n_tokens")) | (F.size("kmer_ids") != F.col("n_tokens")) | (F.col("token_start") != F.col("_before"))
    return rows.where(bad).drop("_before")


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class FastaDataSource(DataSource):
    """``spark.read.format("fasta")`` for files that every executor can open; read_fasta needs no such files."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FastaReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FastaWriter(self.options)


class _FastaReader(DataSourceReader):
    def __init__(self, options) -> None:
        import glob

        self.paths = sorted(set(glob.glob(options["path"])))
        if not self.paths:
            raise FileNotFoundError(options["path"])

    def partitions(self):
        return [_Part(p) for p in self.paths]

    def read(self, partition):
        with (gzip.open if partition.path.endswith(".gz") else open)(partition.path, "rt", encoding="utf-8", errors="replace") as lines:
            header, parts, idx = None, [], -1
            for line in lines:
                line = line.strip()
                if line.startswith(">"):
                    if header is not None:
                        yield partition.path, idx, header, "".join(parts)
                    header, parts, idx = line[1:].strip(), [], idx + 1
                elif line:
                    if header is None:
                        raise ValueError(f"sequence before the first header in {partition.path}")
                    parts.append(line)
            if header is not None:
                yield partition.path, idx, header, "".join(parts)


class _FastaWriter(DataSourceWriter):
    def __init__(self, options) -> None:
        self.path = options["path"]

    def write(self, rows):
        import os
        import uuid

        os.makedirs(self.path, exist_ok=True)
        final = f"{self.path}/part-{uuid.uuid4().hex}.fa"
        with open(f"{final}.tmp", "w", encoding="utf-8") as out:
            for r in rows:
                out.write(f">{r.header}\n{r.seq}\n")
        os.replace(f"{final}.tmp", final)
        return WriterCommitMessage()


def register(spark: SparkSession) -> None:
    """Make the ``fasta`` format known."""
    spark.dataSource.register(FastaDataSource)


