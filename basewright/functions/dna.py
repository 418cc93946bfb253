"""Scalar expressions over DNA strings. All take and return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def normalize(seq: Column) -> Column:
    """Upper case, every symbol outside ACGTN becomes N; the length stays."""
    return F.regexp_replace(F.upper(seq), "[^ACGTN]", "N")


def drop_foreign(seq: Column) -> Column:
    """Upper case without the symbols outside ACGTN."""
    return F.regexp_replace(F.upper(seq), "[^ACGTN]", "")


def reverse_complement(seq: Column) -> Column:
    """Reversed and complemented; case stays, other symbols stay themselves."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def canonical(seq: Column) -> Column:
    """C4: the smaller of a sequence and its reverse complement."""
    return F.least(seq, reverse_complement(seq))


def canonical_hash(seq: Column) -> Column:
    """C4: SHA-256 of the canonical strand."""
    return F.sha2(canonical(seq).cast("binary"), 256)


def count_of(seq: Column, symbols: str) -> Column:
    """How many characters of ``seq`` are among ``symbols``."""
    return F.length(seq) - F.length(F.translate(seq, symbols, ""))


def fraction_of(seq: Column, symbols: str) -> Column:
    """Share of ``symbols`` in ``seq``; 0 for an empty one."""
    return F.coalesce(count_of(seq, symbols) / F.nullif(F.length(seq), F.lit(0)), F.lit(0.0))


def strip_n(seq: Column) -> Column:
    """Without leading and trailing N."""
    return F.trim(seq, F.lit("N"))


def entropy(seq: Column, symbols: str = "ACGTN") -> Column:
    """Shannon entropy in bits of the symbol counts; 0 for an empty sequence."""
    n = F.length(seq)
    terms = [F.when((c := count_of(seq, s)) > 0, -(c / n) * F.log2(c / n)).otherwise(0.0) for s in symbols]
    return F.when(n > 0, sum(terms[1:], terms[0])).otherwise(0.0)


def kmer_index(kmer: Column) -> Column:
    """Base-4 number of a k-mer, A 0 to T 3; null if another symbol is in it."""
    digits = F.translate(kmer, BASES, "0123")
    return F.when(kmer.rlike("^[ACGT]+$"), F.conv(digits, 4, 10).cast("int"))


def kmer_id(kmer: Column) -> Column:
    """1 to 4^k; 0 if another symbol is in it."""
    return F.coalesce(kmer_index(kmer) + 1, F.lit(0))


#: Bases cut at a time: finding a position walks a string from its start.
STRETCH = 128


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kmers(seq: Column, k: int) -> Column:
    """C11: all overlapping k-mers, also those with N; empty if shorter than k."""

    def of(part: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(part) - k + 1), lambda i: F.substring(part, i, F.lit(k)))

    starts = F.sequence(F.lit(1), F.length(seq) - k + 1, F.lit(STRETCH))
    parts = F.transform(starts, lambda s: bind(F.substring(seq, s, F.lit(STRETCH + k - 1)), of))
    return F.when(F.length(seq) >= k, F.flatten(parts)).otherwise(F.array().cast("array<string>"))


def split_on_n(seq: Column) -> Column:
    """The pieces between runs of N, empty ones included, in order."""
    return F.split(seq, "N+")
