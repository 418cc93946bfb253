"""Reproducible draws: the same key gives the same number on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *keys: Column) -> Column:
    """A number in [0, 1) drawn for (seed, keys); keys must be unique to the draw."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)


def integer(seed: int | str, n: Column, *keys: Column) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(uniform(seed, *keys) * n).cast("int")
