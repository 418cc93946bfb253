"""Tabular and JSON sources, configurations and report sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.functions import text as tx


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV, TSV, TAB, JSON (a list, or an object with ``records`` or ``data``) or JSONL by suffix, also gzipped."""
    name = re.sub(r"\.gz$", "", path.lower())
    if name.endswith(".csv"):
        return spark.read.csv(path, header=True)
    if name.endswith((".tsv", ".tab")):
        return spark.read.csv(path, header=True, sep="\t")
    if name.endswith(".jsonl"):
        return spark.read.json(path)
    if name.endswith(".json"):
        rows = spark.read.json(path, multiLine=True)
        for key in ("records", "data"):
            if rows.columns == [key] or key in rows.columns and dict(rows.dtypes)[key].startswith("array"):
                return rows.select(F.explode(key).alias("_r")).select("_r.*")
        return rows
    raise ValueError(f"unknown table format: {path}")


def column(df: DataFrame, key: str, required: bool = True) -> Column | None:
    """A column by name, or by its cleaned name."""
    clean = lambda s: s.strip().lower().replace("-", "_")
    if key in df.columns:
        return F.col(f"`{key}`")
    for c in df.columns:
        if clean(c) == clean(key):
            return F.col(f"`{c}`")
    if required:
        raise ValueError(f"missing column: {key}")
    return None


def labelled_rows(df: DataFrame, seq: str, label: str, task: str, split: str | None = None, train: tuple = ("train",), test: tuple = ("test",)) -> DataFrame:
    """Seq, label, split (train, test or fallback); rows without bases or label go."""
    from basewright.functions.dna import normalize

    value = tx.numeric_label(column(df, label).cast("string")) if task == "regression" else tx.text_label(column(df, label).cast("string"))
    where = column(df, split, required=False) if split else None
    place = F.lower(F.trim(where)) if where is not None else F.lit(None).cast("string")
    rows = df.select(normalize(column(df, seq)).alias("seq"), value.alias("label"), F.when(place.isin(*train), "train").when(place.isin(*test), "test").otherwise("fallback").alias("split"))
    return rows.where((F.length("seq") > 0) & F.col("label").isNotNull())


def read_targets(spark: SparkSession, path: str, default_mb: float = 100.0) -> DataFrame:
    """A10: name, tax_id, target_mb from a CSV, or from a YAML list of flat entries."""
    if path.endswith((".yaml", ".yml")):
        lines = [r[0] for r in spark.read.text(path).collect()]  # a configuration file
        rows, one = [], {}
        for line in lines:
            if m := re.match(r"\s*(-\s*)?([A-Za-z_]+):\s*(.*?)\s*$", line):
                if m[1] and one:
                    rows.append(one)
                    one = {}
                if m[3]:
                    one[m[2]] = m[3].strip("'\"")
        rows += [one] if one else []
        df = spark.createDataFrame([(r.get("name") or r.get("species"), r.get("tax_id"), r.get("target_mb")) for r in rows], "name string, tax_id string, target_mb string")
    else:
        raw = read_rows(spark, path)
        pick = lambda *names: F.coalesce(*[c for n in names if (c := column(raw, n, required=False)) is not None], F.lit(None).cast("string"))
        df = raw.select(pick("name", "species", "taxon").alias("name"), pick("tax_id").alias("tax_id"), pick("target_mb").alias("target_mb"))
    return df.where("name is not null").withColumn("target_mb", F.coalesce(F.col("target_mb").try_cast("double"), F.lit(default_mb)))


def usable_species(df: DataFrame, default_mb: float = 100.0) -> DataFrame:
    """Name, tax_id, domain, target_mb: rows with a name or tax id and one of the three domains."""
    rows = df.select(F.trim("name").alias("name"), F.trim("tax_id").alias("tax_id"), F.lower(F.trim("domain")).alias("domain"), F.coalesce(F.col("target_mb").cast("double"), F.lit(default_mb)).alias("target_mb"))
    named = (F.coalesce(F.length("name"), F.lit(0)) > 0) | (F.coalesce(F.length("tax_id"), F.lit(0)) > 0)
    return rows.where(named & F.col("domain").isin("bacteria", "archaea", "eukaryotes") & (F.col("target_mb") > 0))


def formatted(df: DataFrame, two: tuple[str, ...] = (), three: tuple[str, ...] = ()) -> DataFrame:
    """Report columns as text with two or three decimals."""
    digits = dict.fromkeys(two, 2) | dict.fromkeys(three, 3)
    return df.withColumns({c: F.printf(F.lit(f"%.{n}f"), F.col(c).cast("double")) for c, n in digits.items()})


def write_report(df: DataFrame, path: str) -> None:
    """One CSV part with a header; the commit protocol makes it appear whole or not at all."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_history(df: DataFrame, path: str) -> None:
    """Append rows to a JSONL history."""
    df.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL history by step (missing: -1); lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.coalesce("step", F.lit(-1)))


def parsed_history(df: DataFrame, text: str) -> DataFrame:
    """The same from a text column with one JSON object a row: step, loss."""
    rows = df.withColumn("_j", F.from_json(text, "step long, loss double", {"mode": "PERMISSIVE"})).where(F.col("_j.step").isNotNull() | F.col("_j.loss").isNotNull())
    return rows.select(F.coalesce("_j.step", F.lit(-1)).alias("step"), F.col("_j.loss").alias("loss"))
