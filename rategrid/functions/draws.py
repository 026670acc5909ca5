"""Reproducible pseudo-random draws computed from keys, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 52
# "xxhash64" is the fast choice; "md5" gives the same values in other SQL engines
ENGINES = ("xxhash64", "md5")


def draw_bits(tag: str, *keys: Column, engine: str = "xxhash64") -> Column:
    """A bigint in [0, 2**52) determined by ``tag`` and the keys."""
    if engine == "xxhash64":
        return F.pmod(F.xxhash64(F.lit(tag), *keys), F.lit(1 << BITS))
    if engine == "md5":
        text = F.concat_ws("|", F.lit(tag), *[k.cast("string") for k in keys])
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")
    raise ValueError(f"unknown engine {engine!r}; known: {ENGINES}")


def uniform(tag: str, *keys: Column, engine: str = "xxhash64") -> Column:
    """A double in [0, 1)."""
    return draw_bits(tag, *keys, engine=engine) / F.lit(float(1 << BITS))


def below(limit: Column, tag: str, *keys: Column, engine: str = "xxhash64") -> Column:
    """An integer in [0, limit)."""
    return F.pmod(draw_bits(tag, *keys, engine=engine), limit.cast("bigint")).cast("int")
