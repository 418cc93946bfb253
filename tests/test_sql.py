"""The SQL surface gives what the DataFrame functions give."""

from pyspark.sql import functions as F

from basewright import sql
from basewright.functions import dna
from basewright.operators import windows
from basewright.operators.base import sequences


def test_functions_and_views(spark, sf):
    sql.register(spark, sf)
    got = spark.sql("SELECT record_idx, canonical_hash(seq) AS h, round(gc_fraction(seq), 9) AS gc, window_count(length(seq), 64, 32, 16) AS n FROM seqs")
    seq = F.col("seq")
    want = sequences(spark, sf).select("record_idx", dna.canonical_hash(seq).alias("h"), F.round(dna.fraction_of(seq, "GC"), 9).alias("gc"), windows.window_count(F.length(seq), 64, 32, 16).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.sql("SELECT dinucleotide_shuffle('ACGTACGT', '1') AS s").first().s.startswith("A")
