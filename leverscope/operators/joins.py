"""Joins against a table with one row per key, safe when one key is very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup side is broadcast only when counted to be at most this long.
BROADCAST_ROWS = 100_000
HOT_ROWS = 100_000
SALTS = 32


def small_enough(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether the table has at most ``most`` rows; reads no further than that."""
    return df.limit(most + 1).count() <= most


def lookup_join(
    many: DataFrame,
    one: DataFrame,
    key: str,
    how: str = "left",
    hot_rows: int | None = None,
    salts: int = SALTS,
    broadcast_rows: int | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Join ``many`` to ``one`` (unique on ``key``).

    A counted-small ``one`` is broadcast; a caller that has counted already says so
    with ``small``. Otherwise keys with more than
    ``hot_rows`` (``HOT_ROWS``) rows in ``many`` are salted: their row in ``one`` is copied once
    per salt and their rows in ``many`` spread over the copies. There are at most
    rows / ``hot_rows`` such keys.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    broadcast_rows = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    if small_enough(one, broadcast_rows) if small is None else small:
        return many.join(F.broadcast(one), key, how)
    hot = (
        many.groupBy(key)
        .agg(F.count(F.lit(1)).alias("key_rows"))
        .where(F.col("key_rows") > hot_rows)
        .select(key, F.lit(True).alias("hot_key"))
    )
    # With that many frequent keys none is a large part of the whole.
    if hot.isEmpty() or not small_enough(hot, broadcast_rows):
        return many.join(one, key, how)
    hot = F.broadcast(hot)
    spread = F.pmod(F.xxhash64(*[c for c in many.columns if _hashable(many, c)]), F.lit(salts))
    left = many.join(hot, key, "left").withColumn(
        "salt", F.when(F.col("hot_key"), spread).otherwise(F.lit(0)).cast("int")
    )
    copies = F.when(F.col("hot_key"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = one.join(hot, key, "left").withColumn("salt", F.explode(copies)).drop("hot_key")
    return left.drop("hot_key").join(right, [key, "salt"], how).drop("salt")


def _hashable(df: DataFrame, column: str) -> bool:
    return "map<" not in df.schema[column].dataType.simpleString()
