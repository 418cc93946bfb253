"""Scalar expressions over names, headers, labels and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Task categories by the first word that a task's name contains, in this order.
TASK_CATEGORIES = (
    ("splice", "short_range_motif"),
    ("splice_site", "short_range_motif"),
    ("promoter", "short_range_motif"),
    ("tss", "short_range_motif"),
    ("tfbs", "short_range_motif"),
    ("chipseq", "short_range_motif"),
    ("enhancer", "long_range_regulatory"),
    ("ocr", "long_range_regulatory"),
    ("atac", "long_range_regulatory"),
    ("chromatin", "long_range_regulatory"),
    ("accessibility", "long_range_regulatory"),
    ("regulatory", "long_range_regulatory"),
    ("expression", "long_range_expression"),
    ("rna", "long_range_expression"),
    ("biotype", "evolutionary_taxonomy"),
    ("taxonomy", "evolutionary_taxonomy"),
    ("taxon", "evolutionary_taxonomy"),
    ("species", "evolutionary_taxonomy"),
    ("variant", "variant_effect"),
    ("vep", "variant_effect"),
    ("clinvar", "variant_effect"),
)
# Words for binary labels.
POSITIVE = ("1", "true", "positive", "pathogenic", "deleterious", "disease", "case")
NEGATIVE = ("0", "false", "negative", "benign", "neutral", "control")


def sanitize_name(name: Column) -> Column:
    """Digits-only names stay; else runs of other characters become one underscore, none at the ends."""
    slug = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), "_+", "_")
    return F.when(name.rlike("^[0-9]+$"), name).otherwise(F.trim(slug, F.lit("_")))


def metric_key_part(name: Column) -> Column:
    """One part of a slash-delimited metric key."""
    text = F.replace(F.trim(name), F.lit("\\"), F.lit("/"))
    text = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.@+/-]+", "_"), "/+", "/")
    return F.coalesce(F.nullif(F.trim(text, F.lit("/")), F.lit("")), F.lit("unnamed"))


def file_stem(header: Column, index: Column) -> Column:
    """Zero-padded index and the first word of a header, safe in file names."""
    first = F.regexp_extract(header, r"(\S+)", 1)
    label = F.when(header == "", F.concat(F.lit("sequence_"), index.cast("string"))).otherwise(first)
    slug = F.substring(F.trim(F.regexp_replace(label, "[^A-Za-z0-9_.-]+", "_"), F.lit("_")), 1, 80)
    return F.concat(F.lpad(index.cast("string"), 4, "0"), F.lit("_"), F.coalesce(F.nullif(slug, F.lit("")), F.lit("sequence")))


def filtered_name(name: Column) -> Column:
    """The name of a filtered file, without a final .gz."""
    return F.concat(F.lit("filtered_"), F.regexp_replace(name, r"\.gz$", ""))


def clean_key(key: Column) -> Column:
    """A column or field name in its compared form."""
    return F.replace(F.lower(F.trim(key)), F.lit("-"), F.lit("_"))


def header_field(header: Column, *keys: str) -> Column:
    """C17: the value of the first ``key=value`` part of a header whose cleaned key is among ``keys``."""
    parts = F.split(F.trim(F.translate(header, "|;", "  ")), r"\s+")
    hits = F.filter(parts, lambda p: p.contains("=") & clean_key(F.substring_index(p, "=", 1)).isin(*keys))
    hit = F.get(hits, F.lit(0))
    return F.substring(hit, F.instr(hit, "=") + 1, F.length(hit))


def task_category(name: Column, explicit: Column | None = None) -> Column:
    """The category of the first known word in a task's name, else custom."""
    key, out = clean_key(name), None
    for word, category in TASK_CATEGORIES:
        out = F.when(key.contains(word), category) if out is None else out.when(key.contains(word), category)
    out = out.otherwise("custom")
    return out if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), out)


def numeric_label(label: Column) -> Column:
    """C20: a finite number or null."""
    x = label.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def text_label(label: Column) -> Column:
    """C20: trimmed text or null."""
    return F.nullif(F.trim(label), F.lit(""))


def binary_label(label: Column) -> Column:
    """1, 0 or null by common words."""
    word = F.lower(F.trim(label))
    return F.when(word.isin(*POSITIVE), 1).when(word.isin(*NEGATIVE), 0)


def first_path(json: Column, *paths: str) -> Column:
    """The first non-null of alternative JSON paths."""
    return F.coalesce(*[F.get_json_object(json, p) for p in paths])


def checkpoint_step(name: Column, recorded: Column | None = None) -> Column:
    """The recorded step, else the number in a checkpoint's file name, else null."""
    found = F.nullif(F.regexp_extract(name, r"checkpoint_step_?(\d+)\.pt$", 1), F.lit("")).cast("long")
    return found if recorded is None else F.coalesce(recorded, found)


def name_score(query: Column, name: Column) -> Column:
    """Similarity of two names from 0 to 100 by edit distance."""
    a, b = F.lower(query), F.lower(name)
    return 100.0 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def number_key(name: Column) -> Column:
    """Sort key of file names: numbered filtered files by number first, then the others by name."""
    number = F.nullif(F.regexp_extract(name, r"filtered_genome(\d+)", 1), F.lit("")).cast("long")
    return F.struct(F.when(number.isNull(), 1).otherwise(0).alias("kind"), F.coalesce(number, F.lit(0)).alias("number"), F.when(number.isNull(), name).otherwise("").alias("name"))
