"""Randomness that depends on the row alone.

Every draw is an MD5 of (seed, stream, row key), so it is the same on any number
of partitions, after a retry, and in any engine that has MD5. ``rand(seed)`` is
tied to the partition a row happens to sit in and would change when a lost
executor's work is redone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIGITS = 15  # 60 bits: fits a signed long
UNIFORM_DIGITS = 13  # 52 bits: every value is an exact double


def _digest(key: Column, seed: int | str, stream: str | int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|{stream}|"), key.cast("string")).cast("binary"))


def hash_long(key: Column, seed: int | str, stream: str | int) -> Column:
    """A 60-bit hash of the row key as a non-negative long."""
    return F.conv(F.substring(_digest(key, seed, stream), 1, HASH_DIGITS), 16, 10).cast("long")


def uniform(key: Column, seed: int | str, stream: str | int) -> Column:
    """A draw from the open interval (0, 1)."""
    draw = F.conv(F.substring(_digest(key, seed, stream), 1, UNIFORM_DIGITS), 16, 10).cast("double")
    return (draw + F.lit(0.5)) / F.lit(float(16**UNIFORM_DIGITS))


def normal(key: Column, seed: int | str, stream: str | int) -> Column:
    """A standard normal draw (Box-Muller over two uniform draws)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(key, seed, f"{stream}/r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(key, seed, f"{stream}/a"))
