"""Deterministic, partition-independent randomness.

Every random choice is a pure function of ``(key, purpose)`` where the purpose string
carries the seed and cycle. The digest is md5, read as the first 8 hex digits: the same
integer is reproducible in any SQL engine, it does not depend on partitioning, and a
retried task draws the same values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def purpose(name: str, seed: int = 42, cycle: int = 0) -> str:
    return f"{name}.{seed}.{cycle}"


def hash32(key: Column, purpose_text: str) -> Column:
    """Unsigned 32-bit integer (as bigint) drawn from ``md5(key || ':' || purpose)``."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(":" + purpose_text)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def pick(key: Column, purpose_text: str, n: Column | int) -> Column:
    """Uniform integer in ``[0, n)``; NULL when ``n`` is 0."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    return F.when(n_col > 0, F.pmod(hash32(key, purpose_text), n_col.cast("bigint")))


def unit(key: Column, purpose_text: str) -> Column:
    """Uniform double in ``[0, 1)``."""
    return hash32(key, purpose_text).cast("double") / F.lit(TWO_POW_32)


def row_key(*cols: str | Column) -> Column:
    """Key string ``a:b:c`` from identifying columns."""
    parts = [c if isinstance(c, Column) else F.col(c) for c in cols]
    return F.concat_ws(":", *[p.cast("string") for p in parts])
