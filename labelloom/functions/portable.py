"""Seeded pseudo-random columns that any engine with md5 can repeat.

``rand()`` depends on partitioning, so a retried task may draw other numbers.
These depend only on the seed and the key columns.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEX_WORD = 8
WORD_RANGE = float(16**HEX_WORD)


def digest(seed: object, *keys: Column | str) -> Column:
    """md5 of ``seed:key1:key2…`` as 32 hex digits."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def uniform(seed: object, *keys: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of the digest."""
    word = F.conv(F.substring(digest(seed, *keys), 1, HEX_WORD), 16, 10)
    return word.cast("double") / F.lit(WORD_RANGE)
