"""Schedules as expressions over a step column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _check(warmup: int, total: int, cooldown: int, floor: float) -> None:
    if warmup < 0 or cooldown < 0 or total <= 0 or warmup + cooldown > total or not 0 <= floor <= 1:
        raise ValueError("steps must not be negative, warm-up and cool-down must fit, the floor lies in [0, 1]")


def cosine(step: Column, warmup: int, total: int, cooldown: int = 0, floor: float = 0.1, cycles: float = 0.5) -> Column:
    """Linear warm-up, cosine decay to ``floor``, linear cool-down from where the cosine stands."""
    _check(warmup, total, cooldown, floor)

    def ratio(s: Column) -> Column:
        done = _clamp((s - warmup) / float(max(1, total - warmup)))
        return floor + (1.0 - floor) * 0.5 * (1.0 + F.cos(F.pi() * (2.0 * cycles) * done))

    out = F.greatest(F.lit(floor), ratio(step))
    if cooldown:
        start = ratio(F.lit(total - cooldown))
        out = F.when(step >= total - cooldown, start + (floor - start) * _clamp((step - (total - cooldown)) / float(cooldown))).otherwise(out)
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(out)


def linear(step: Column, warmup: int, total: int) -> Column:
    """Linear warm-up, then linear decay to 0."""
    down = F.greatest(F.lit(0.0), (F.lit(total) - step) / float(max(1, total - warmup)))
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(down)


def constant(step: Column, warmup: int) -> Column:
    """Linear warm-up, then 1."""
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(1.0)


def mask_fraction(step: Column, total: int, warm_share: float = 0.4, start: float = 0.15, end: float = 0.30) -> Column:
    """Masking curriculum: a cosine ramp over the first share of the steps."""
    warm = int(total * warm_share)
    ramp = start + (end - start) * 0.5 * (1.0 - F.cos(F.pi() * step / float(max(1, warm))))
    return F.when(step >= warm, F.lit(end)).otherwise(ramp)


def ramp(step: Column, warmup: int, top: float) -> Column:
    """A weight that grows linearly to ``top`` over the warm-up (consistency weight, expert drop)."""
    return top * F.least(F.lit(1.0), step / float(warmup)) if warmup > 0 else F.lit(top)
