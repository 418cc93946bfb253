"""Make the scalar functions and table operators callable from ``spark.sql``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from basewright.operators.base import sequences, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: SQL bodies of the temporary functions; they are inlined, so nothing leaves the JVM.
FUNCTIONS = {
    "dna_normalize(s STRING)": "regexp_replace(upper(s), '[^ACGTN]', 'N')",
    "dna_drop_foreign(s STRING)": "regexp_replace(upper(s), '[^ACGTN]', '')",
    "reverse_complement(s STRING)": "reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))",
    "canonical_strand(s STRING)": "least(s, reverse(translate(s, 'ACGTacgt', 'TGCAtgca')))",
    "canonical_hash(s STRING)": "sha2(least(s, reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))), 256)",
    "gc_fraction(s STRING)": "coalesce((length(s) - length(translate(s, 'GC', ''))) / nullif(length(s), 0), 0.0D)",
    "window_count(n INT, longest INT, stride INT, least_ INT)": "CASE WHEN n < least_ THEN 0 WHEN n <= longest THEN 1 ELSE floor(least(n - least_, stride * ceil((n - longest) / stride)) / stride) + 1 END",
    "hash_draw(seed STRING, key STRING)": "conv(substring(md5(concat_ws(':', seed, key)), 1, 8), 16, 10) / 4294967296.0D",
}


def register(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Create the temporary functions and, for a folder of tables, one view a table and ``seqs``."""
    for signature, body in FUNCTIONS.items():
        kind = " RETURNS STRING" if signature.startswith(("dna_", "reverse", "canonical")) else " RETURNS DOUBLE" if signature.startswith(("gc_", "hash_")) else " RETURNS BIGINT"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature}{kind} RETURN {body}")

    from basewright.operators.controls import shuffle_pairs

    def shuffled(seqs: pd.Series, seeds: pd.Series) -> pd.Series:
        import random

        return pd.Series([shuffle_pairs(s, random.Random(f"{k}")) if s else s for s, k in zip(seqs, seeds)])

    spark.udf.register("dinucleotide_shuffle", F.pandas_udf(shuffled, "string"))
    if sf_dir:
        for name in TABLES:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        sequences(spark, sf_dir).createOrReplaceTempView("seqs")
