"""The corpus build as one lazy plan (J16): filter, split, dedup, quota, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.functions import dna
from basewright.operators import qc, tokens, windows


def accepted_pieces(df: DataFrame, min_length: int, max_n_share: float, min_piece: int, max_piece: int, quota: int) -> DataFrame:
    """species, ord, n of the pieces that a build keeps; ``df``: file (species), record_idx, domain, seq.

    B1 and B2 select contigs, C7 and C8 cut them, B6 drops copies within a
    species and E11 fills its quota. The order is (record, piece, chunk), not
    the timing of workers.
    """
    header = F.concat_ws(" ", "file", "domain")
    good = df.where(qc.contig_passes(header, F.col("seq"), min_length, max_n_share, True) & ~qc.has_foreign(F.col("seq")))
    pieces = tokens.contig_pieces(good, min_piece).select(F.col("file").alias("species"), "record_idx", "piece_idx", F.col("piece").alias("seq"))
    chunks = tokens.long_chunks(pieces, max_piece, min_piece)
    place = F.col("record_idx") * F.lit(1_000_000) + F.col("piece_idx") * 1_000 + F.floor(F.col("start") / max_piece)
    rows = chunks.select("species", place.alias("ord"), dna.canonical_hash(F.col("chunk")).alias("hash"), F.length("chunk").alias("n"))
    return windows.quota_append(rows, quota)


def build_summary(accepted: DataFrame, least: int) -> DataFrame:
    """species, pieces, bases, passed: the pass or fail summary of a build."""
    rows = accepted.groupBy("species").agg(F.count("*").alias("pieces"), F.sum("n").cast("long").alias("bases"))
    return rows.withColumn("passed", F.col("bases") >= least)
