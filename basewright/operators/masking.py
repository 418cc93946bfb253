"""Masking of token arrays (G3 to G9). Draws depend on (seed, key, position) only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewright.functions import draw
from basewright.functions.dna import bind
from basewright.operators.tokens import IGNORE, MASK


def bounded_fraction(x: Column, low: float = 0.20, high: float = 0.40) -> Column:
    """Clamped to [low, high], whichever way round they are given."""
    lo, hi = min(low, high), max(low, high)
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def independent_mask(ids: Column, prob: float, seed: int, *key: Column, weights: dict[int, float] | None = None) -> Column:
    """Booleans; each token above the special ids is masked by chance ``prob`` times its weight, clamped to [0, 1]."""

    def one(x: Column, i: Column) -> Column:
        p = F.lit(prob)
        for token, w in (weights or {}).items():
            p = F.when(x == int(token), prob * float(w)).otherwise(p)
        p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
        return (x > MASK) & (draw.uniform(seed, *key, i, F.lit("mask")) < p)

    return F.transform(ids, one)


def target_count(valid: Column, fraction: float) -> Column:
    """How many tokens span masking covers: half-even rounded, from 1 to all; none for no fraction."""
    if fraction <= 0:
        return F.lit(0)
    return F.when(valid > 0, F.least(F.greatest(F.bround(valid * F.lit(fraction)).cast("int"), F.lit(1)), valid)).otherwise(0)


class _Free:
    """Positions that can still be drawn; taking one out costs the same at any length."""

    def __init__(self, positions: list[int], weight) -> None:
        self.at, self.place, self.weight = positions, {p: i for i, p in enumerate(positions)}, weight

    def take(self, position: int) -> None:
        i, last = self.place.pop(position), self.at.pop()
        if last != position:
            self.at[i], self.place[last] = last, i

    def draw(self, u) -> int:
        """By weight; where all weights are 0, or there are none, each alike."""
        total = sum(map(self.weight, self.at)) if self.weight else 0
        if not total:
            return self.at[int(u() * len(self.at))]
        upto, aim = 0.0, u() * total
        for p in self.at:
            upto += self.weight(p)
            if aim < upto:
                return p
        return max(self.at, key=self.weight)


def span_mask_one(ids: list[int], attention: list[int], fraction: float, span: int, u, weights: dict[int, float] | None = None) -> list[bool]:
    """G4 for one row: spans from drawn starts until exactly the target is masked; ``u`` draws from [0, 1).

    A span covers ``span`` tokens that were free, walking past masked ones up to the next token that can't be masked.
    ``weights``: by token id, how likely a span starts there (1 if absent).
    """
    valid = [a == 1 and x > MASK for x, a in zip(ids, attention)]
    free = _Free([i for i, good in enumerate(valid) if good], (lambda p: max(0.0, weights.get(ids[p], 1.0))) if weights else None)
    n, left = len(free.at), min(len(free.at), max(1, round(len(free.at) * fraction))) if fraction > 0 else 0
    out = [False] * len(ids)
    for _ in range(max(4 * n, 8 * left, 16)):
        if not left:
            break
        at, room = free.draw(u), min(span, left)
        while room and at < len(ids) and valid[at]:
            if not out[at]:
                out[at] = True
                free.take(at)
                room, left = room - 1, left - 1
            at += 1
    for _ in range(left):  # the starts that weights allow were not enough
        at = free.at[int(u() * len(free.at))]
        out[at] = True
        free.take(at)
    return out


def span_mask(df: DataFrame, ids: str, attention: str, key: str, fraction: float, span: int, seed: int, weights: dict[int, float] | None = None) -> DataFrame:
    """``df`` with ``mask``, exactly the target count in each row."""
    import random

    @F.pandas_udf("array<boolean>")
    def run(a: pd.Series, b: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([span_mask_one(list(x), list(y), fraction, span, random.Random(f"{seed}:{z}").random, weights) for x, y, z in zip(a, b, k)])

    return df.withColumn("mask", run(ids, attention, F.col(key).cast("string")))


def replaced(ids: Column, mask: Column, vocab_size: int, seed: int, *key: Column, first: int = 5) -> Column:
    """Of masked tokens 80 % become MASK, 10 % a drawn non-special id, 10 % stay."""

    def one(m: Column, x: Column, i: Column) -> Column:
        u = draw.uniform(seed, *key, i, F.lit("how"))
        other = draw.integer(seed, F.lit(vocab_size - first), *key, i, F.lit("repl")) + first
        return F.when(~F.get(m, i), x).when(u < 0.8, MASK).when(u < 0.9, other).otherwise(x)

    return bind(mask, lambda m: F.transform(ids, lambda x, i: one(m, x, i)))


def labels(ids: Column, mask: Column) -> Column:
    """The id where masked, else the ignored label."""
    return F.zip_with(ids, mask, lambda x, m: F.when(m, x).otherwise(IGNORE))


def mask_kmers(kmers: Column, mask: Column, k: int) -> Column:
    """A k-mer is blanked if any of the k tokens from its place on is masked."""
    look = lambda m, i: F.exists(F.slice(m, i + 1, k), lambda x: x)
    return bind(mask, lambda m: F.transform(kmers, lambda x, i: F.when(look(m, i), 0).otherwise(x)))


def boundary_labels(mask: Column, attention: Column) -> Column:
    """1 where the mask differs from a neighbour, 0 elsewhere, -1 on padding."""

    def of(m: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            differs = (F.coalesce(F.get(m, i - 1), x) != x) | (F.coalesce(F.get(m, i + 1), x) != x)
            return F.when(F.get(attention, i) == 0, -1).when(differs, 1).otherwise(0)

        return F.transform(m, one)

    return bind(mask, of)
