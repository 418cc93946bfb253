"""Perturbed and control sequences."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewright.functions import dna, draw


def indel(seq: Column, seed: int, *key: Column) -> Column:
    """Insert a base anywhere or delete one, with equal chance; shorter than 2 stays."""
    at = lambda n: draw.integer(seed, n, *key, F.lit("at"))
    n = F.length(seq)
    base = F.substring(F.lit("ACGT"), draw.integer(seed, F.lit(4), *key, F.lit("base")) + 1, F.lit(1))
    spot, gone = at(n + 1), at(n)
    longer = F.concat(F.substring(seq, F.lit(1), spot), base, F.substring(seq, spot + 1, n))
    shorter = F.concat(F.substring(seq, F.lit(1), gone), F.substring(seq, gone + 2, n))
    return F.when(n < 2, seq).when(draw.uniform(seed, *key, F.lit("kind")) < 0.5, longer).otherwise(shorter)


def gc_matched(seq: Column, seed: int, *key: Column) -> Column:
    """C14: a random sequence of the same length, each base G or C with the sequence's GC share."""
    def bases(gc: Column) -> Column:
        def base(i: Column) -> Column:
            strong = draw.uniform(seed, *key, i, F.lit("gc")) < gc
            first = draw.uniform(seed, *key, i, F.lit("base")) < 0.5
            return F.when(strong & first, "G").when(strong, "C").when(first, "A").otherwise("T")

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(seq)), base), "")

    return F.when(F.length(seq) > 0, dna.bind(dna.fraction_of(seq, "GC"), bases)).otherwise("")


def shuffle_pairs(seq: str, rng: random.Random) -> str:
    """Another order of the same overlapping pairs, with the same first symbol.

    A walk over all pairs: last exits form a random tree towards the last symbol,
    the other exits come in random order before them.
    """
    if len(seq) < 3:
        return seq
    exits: dict[str, list[str]] = {}
    for a, b in zip(seq, seq[1:]):
        exits.setdefault(a, []).append(b)
    end = seq[-1]
    while True:
        last = {a: rng.choice(bs) for a, bs in exits.items() if a != end}
        ok = True
        for a in last:
            seen, at = set(), a
            while at != end and at not in seen:
                seen.add(at)
                at = last[at]
            ok &= at == end
        if ok:
            break
    for a, bs in exits.items():
        if a in last:
            bs.remove(last[a])
        rng.shuffle(bs)
        if a in last:
            bs.append(last[a])
    out, at, used = [seq[0]], seq[0], dict.fromkeys(exits, 0)
    while at in exits and used[at] < len(exits[at]):
        used[at] += 1
        at = exits[at][used[at] - 1]
        out.append(at)
    return "".join(out)


def dinucleotide_shuffled(df: DataFrame, seed: int, key: str = "record_idx") -> DataFrame:
    """``df`` with ``shuffled``; the draw depends on the key only."""

    @F.pandas_udf("string")
    def run(seqs: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([shuffle_pairs(s, random.Random(f"{seed}:{k}")) if s else s for s, k in zip(seqs, keys)])

    return df.withColumn("shuffled", run(F.col("seq"), F.col(key).cast("string")))


def pair_profile(column: str, alphabet: str = "ACGTN") -> Column:
    """Counts of all overlapping pairs, in a fixed order."""
    count = lambda pairs, pair: F.size(F.filter(pairs, lambda p: p == pair))
    return dna.bind(dna.kmers(F.col(column), 2), lambda pairs: F.array(*[count(pairs, a + b) for a in alphabet for b in alphabet]))


def augment(df: DataFrame, epoch: int, rc_prob: float, indel_prob: float, key: str = "record_idx") -> DataFrame:
    """G1: reverse complement with one chance, then an indel with another, by (epoch, key)."""
    seed, k = f"epoch{epoch}", F.col(key)
    turned = F.when(draw.uniform(seed, k, F.lit("rc")) < rc_prob, dna.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    rows = df.withColumn("seq", turned)
    return rows.withColumn("seq", F.when(draw.uniform(seed, k, F.lit("indel")) < indel_prob, indel(F.col("seq"), seed, k)).otherwise(F.col("seq")))


def with_controls(df: DataFrame, mode: str, seed: int) -> DataFrame:
    """Real rows and one control for each, labelled ``real`` or the mode."""
    if mode == "dinucleotide":
        fake = dinucleotide_shuffled(df, seed).withColumn("seq", F.col("shuffled")).drop("shuffled")
    elif mode == "gc":
        fake = df.withColumn("seq", gc_matched(F.col("seq"), seed, F.col("record_idx")))
    else:
        raise ValueError(f"unknown control mode: {mode}")
    return df.withColumn("label", F.lit("real")).unionByName(fake.withColumn("label", F.lit(mode)))
