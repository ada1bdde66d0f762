"""Retry delays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repeatable_unit(*parts: Column) -> Column:
    """A number in [-1, 1] drawn from a hash of the row's identity.

    The same row always gets the same draw, so a recomputed task agrees with
    the first run.
    """
    return F.pmod(F.xxhash64(*parts), F.lit(2_000_001)) / F.lit(1_000_000.0) - F.lit(1.0)


def backoff_seconds(
    attempt: Column,
    base: Column | float = 1.0,
    cap: Column | float = 60.0,
    jitter: Column | float = 0.2,
    unit: Column | float = 0.0,
) -> Column:
    """min(cap, base * 2^(attempt - 1)), moved by jitter * unit, never negative."""
    base, cap, jitter, unit = (
        v if isinstance(v, Column) else F.lit(float(v)) for v in (base, cap, jitter, unit)
    )
    # 2^1023 is the largest power a double holds; the cap decides long before.
    exponent = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(1023))
    delay = F.least(cap, base * F.pow(F.lit(2.0), exponent))
    return F.greatest(F.lit(0.0), delay + delay * jitter * unit)
