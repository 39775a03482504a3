"""Deterministic draws from a key, equal in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(salt: str, key: Column | str) -> Column:
    """A non-negative integer below 2**32 that depends only on (salt, key)."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def one_of(salt: str, key: Column | str, *values: str) -> Column:
    """One of the values, drawn evenly."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (draw(salt, key) % len(values)).cast("int") + 1)
