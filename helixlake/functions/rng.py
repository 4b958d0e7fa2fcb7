"""Counter-based randomness: every draw is a slice of md5 of its seed and counters, so results
don't depend on partitioning, order or retries, and another engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 2**32


def digest(seed: object, *counters: Column | str) -> Column:
    """md5 of seed|counter|..., 32 hex digits: four draws."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in counters]))


def draw(digested: Column, k: int = 0) -> Column:
    """The k-th draw (0..3) of a digest: an integer in 0..2**32-1."""
    return F.conv(F.substring(digested, 8 * k + 1, 8), 16, 10).cast("long")


def uniform(digested: Column, k: int = 0) -> Column:
    """The k-th draw as a double in [0, 1)."""
    return draw(digested, k) / float(SPAN)
