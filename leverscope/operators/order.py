"""Exact ordering work that never sorts a whole table in one place.

* ``order_statistics`` / ``exact_quantiles``: k-th smallest values by narrowing a
  range. Each round is one map-side aggregate; no row is shuffled.
* ``order_buckets`` + ``running_before``: prefix sums in value order, in parallel
  over value ranges.
* ``hash_buckets`` + ``bucket_starts``: the same for a random order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leverscope.functions.hashing import HASH_DIGITS, hash_long
from leverscope.functions.scalars import quoted

# A narrowed range holding at most this many values is finished by sorting it.
FINISH_BELOW = 50_000
# Size of a quantile sketch, and the share of the rows by which it may misplace a rank.
SKETCH_SIZE, SKETCH_ERROR = 4096, 0.0015
EDGE_SKETCH_SIZE = 16_384
# Sketches are merged in so many groups of tasks first, then these few: no task meets one
# sketch of every other task.
SKETCH_GROUPS = 256
SEARCHES_PER_PASS = 24
# A task holds one sketch per column of a pass.
COLUMNS_PER_PASS = 50
# Largest part of a range that lies between the outer two of three sketched pivots:
# their distance and the sketch's own error at both.
PIVOT_GAP = 4 * SKETCH_ERROR
MOST_BUCKETS = 4096


@dataclass
class _Search:
    """The ``rank``-th smallest value lies in [low, high]."""

    name: str
    rank: int
    low: Any
    high: Any
    below: int  # values < low
    upto: int  # values <= high

    @property
    def inside(self) -> int:
        return self.upto - self.below

    @property
    def done(self) -> bool:
        return self.low == self.high


def _chunks(items: list, size: int):
    for start in range(0, len(items), size):
        yield items[start : start + size]


def _in_range(value: Column, search: _Search) -> Column:
    return F.when(value.between(F.lit(search.low), F.lit(search.high)), value)


def _finish(df: DataFrame, searches: list[_Search]) -> None:
    row = df.agg(
        *[
            F.element_at(
                F.array_sort(F.collect_list(_in_range(F.col(s.name), s))), s.rank - s.below
            ).alias(f"v{i}")
            for i, s in enumerate(searches)
        ]
    ).first()
    for i, s in enumerate(searches):
        s.low = s.high = row[i]


def _sketched_quantiles(
    df: DataFrame,
    values: list[tuple[Column, str, list[float]]],
    size: int = SKETCH_SIZE,
    extra: list[tuple[Column, Callable[[str], Column]]] = (),
) -> list:
    """Approximate quantiles of several (value, type name, probabilities) in one pass, None without a value.

    Sketches are merged by groups of tasks, then across the groups. ``extra`` are aggregates of the same
    pass: how a group makes one and how groups are joined. Their values follow the quantiles.
    """
    kinds = ["bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "double" for _, kind, _ in values]
    sketch = {"bigint": F.kll_sketch_agg_bigint, "double": F.kll_sketch_agg_double}
    merge = {"bigint": F.kll_merge_agg_bigint, "double": F.kll_merge_agg_double}
    read = {"bigint": F.kll_sketch_get_quantile_bigint, "double": F.kll_sketch_get_quantile_double}
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("sketch_group")
    parts = [
        part
        for i, ((value, _, _), kind) in enumerate(zip(values, kinds))
        for part in (F.count(value).alias(f"n{i}"), sketch[kind](value.cast(kind), F.lit(size)).alias(f"s{i}"))
    ]
    parts += [own.alias(f"x{i}") for i, (own, _) in enumerate(extra)]
    joined = [
        part
        for i, kind in enumerate(kinds)
        for part in (F.sum(f"n{i}").alias(f"n{i}"), merge[kind](F.when(F.col(f"n{i}") > 0, F.col(f"s{i}")), F.lit(size)).alias(f"s{i}"))
    ]
    joined += [join(f"x{i}").alias(f"x{i}") for i, (_, join) in enumerate(extra)]
    merged = df.groupBy(group).agg(*parts).agg(*joined)
    found = [
        F.when(F.col(f"n{i}") > 0, read[kind](f"s{i}", F.array(*[F.lit(float(p)) for p in wanted]))).alias(f"q{i}")
        for i, (kind, (_, _, wanted)) in enumerate(zip(kinds, values))
    ]
    return list(merged.select(*found, *[f"x{i}" for i in range(len(extra))]).first())


def _sketch(df: DataFrame, searches: list[_Search]) -> list[list]:
    """Pivots near each wanted rank, from one sketch pass over the open ranges."""
    kinds, wanted = dict(df.dtypes), []
    for s in searches:
        place = (s.rank - s.below) / s.inside
        near = [min(max(place + d, 0.0), 1.0) for d in (-SKETCH_ERROR, 0.0, SKETCH_ERROR)]
        wanted.append((_in_range(F.col(s.name), s), kinds[s.name], near))
    return _sketched_quantiles(df, wanted)


def _narrow(
    df: DataFrame, searches: list[_Search], pivots: list[list], sketched: bool
) -> None:
    """Count exactly around the pivots and shrink each range accordingly.

    Pivots only guide: they are clamped to the range, so each round drops at least
    the pivot value itself and the search always ends. Between sketched pivots of a
    range that is not too long the values are fetched along: a value not itself a
    pivot repeats less often than the pivots are apart, so they are few.
    """
    pivots = [
        sorted({min(max(v, s.low), s.high) for v in values}) for s, values in zip(searches, pivots)
    ]
    parts = []
    for s, values in zip(searches, pivots):
        value = F.col(s.name)
        for v in values:
            parts += [
                F.count_if(value < F.lit(v)),
                F.count_if(value <= F.lit(v)),
                F.max(F.when(value < F.lit(v), value)),
                F.min(F.when(value > F.lit(v), value)),
            ]
        fetch = sketched and s.inside * PIVOT_GAP <= FINISH_BELOW
        inner = (value > F.lit(values[0])) & (value < F.lit(values[-1])) & ~value.isin(*values)
        parts.append(F.collect_list(F.when(inner, value)) if fetch else F.array())
    row = df.agg(*[c.alias(f"n{i}") for i, c in enumerate(parts)]).first()
    at = 0
    for s, values in zip(searches, pivots):
        fetched = sorted(row[at + 4 * len(values)])
        below_pivot, pivot = None, None
        for v in values:
            less, upto, before, after = row[at : at + 4]
            at += 4
            if s.done:
                continue
            if less < s.rank <= upto:
                s.low = s.high = v
            elif s.rank <= less:
                if fetched and below_pivot is not None:
                    gap = [x for x in fetched if pivot < x < v]
                    s.low = s.high = gap[s.rank - below_pivot - 1]
                elif before < s.high:
                    s.high, s.upto = before, less
            else:
                below_pivot, pivot = upto, v
                if after > s.low:
                    s.low, s.below = after, upto
        at += 1


def order_statistics(
    df: DataFrame,
    wanted: dict[str, list[int]],
    ends: dict[str, tuple[int, Any, Any]] | None = None,
    guesses: dict[str, dict[int, list]] | None = None,
    sketched: bool = False,
) -> dict[str, dict[int, Any]]:
    """Exact k-th smallest non-null values: ``{column: [1-based ranks]}``.

    Driver state is a few numbers per wanted rank, whatever the table's size. A
    caller that knows (count, least, most) of a column, or values near a rank, saves
    the passes that would find them; ``sketched`` says those values are a sketch's.
    """
    columns = [c for c, ranks in wanted.items() if ranks]
    found: dict[str, dict[int, Any]] = {c: {} for c in wanted}
    if not columns:
        return found
    narrow = df.select(*columns)
    if ends is None:
        ends = column_ends(narrow, columns)
    searches = []
    for c in columns:
        count, low, high = ends[c]
        for rank in sorted(set(wanted[c])):
            if not 1 <= rank <= count:
                raise ValueError(f"rank {rank} outside 1..{count} for {c}")
            searches.append(_Search(c, rank, low, high, 0, count))
    guesses = guesses or {}
    while open_searches := [s for s in searches if not s.done]:
        for chunk in _chunks(open_searches, SEARCHES_PER_PASS):
            small = [s for s in chunk if s.inside <= FINISH_BELOW]
            large = [s for s in chunk if s.inside > FINISH_BELOW]
            if small:
                _finish(narrow, small)
            if large:
                known = [guesses.get(s.name, {}).pop(s.rank, None) for s in large]
                if None in known:
                    known, sketched = _sketch(narrow, large), True
                _narrow(narrow, large, known, sketched)
    for s in searches:
        found[s.name][s.rank] = s.low
    return found


def column_ends(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, Any, Any]]:
    row = df.agg(
        *[
            part.alias(f"e{i}")
            for i, part in enumerate([f(c) for c in columns for f in (F.count, F.min, F.max)])
        ]
    ).first()
    return {c: tuple(row[3 * i : 3 * i + 3]) for i, c in enumerate(columns)}


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float]
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbours (``percentile_cont``)."""
    if not columns:
        return {}
    if len(columns) > COLUMNS_PER_PASS:
        found = {}
        for chunk in _chunks(columns, COLUMNS_PER_PASS):
            found |= exact_quantiles(df, chunk, probabilities)
        return found
    plain = [f"q{i}" for i in range(len(columns))]
    df = df.select(*[quoted(c).alias(p) for c, p in zip(columns, plain)])
    found = _plain_quantiles(df, plain, probabilities)
    return dict(zip(columns, found.values()))


def _plain_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict:
    near = [min(max(p + d, 0.0), 1.0) for p in probabilities for d in (-SKETCH_ERROR, 0.0, SKETCH_ERROR)]
    kinds = dict(df.dtypes)
    extra = [pair for c in columns for pair in ((F.count(c), F.sum), (F.min(c), F.min), (F.max(c), F.max))]
    row = _sketched_quantiles(df, [(F.col(c), kinds[c], near) for c in columns], extra=extra)
    sketches, row = row[: len(columns)], row[len(columns) :]
    ends, places, guesses = {}, {}, {}
    for i, c in enumerate(columns):
        count, low, high = row[3 * i : 3 * i + 3]
        ends[c] = (count, low, high)
        places[c], guesses[c] = [], {}
        if count:
            for j, p in enumerate(probabilities):
                spot = (count - 1) * p
                first, last = math.floor(spot) + 1, math.ceil(spot) + 1
                places[c].append((first, last, spot - math.floor(spot)))
                for rank in (first, last):
                    guesses[c][rank] = list(sketches[i][3 * j : 3 * j + 3])
    wanted = {c: [r for first, last, _ in spots for r in (first, last)] for c, spots in places.items()}
    values = order_statistics(df, wanted, ends, guesses, sketched=True)
    return {
        c: [
            float(values[c][first])
            + part * (float(values[c][last]) - float(values[c][first]))
            for first, last, part in places[c]
        ]
        or [None] * len(probabilities)
        for c in columns
    }


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}


def order_buckets(
    df: DataFrame, column: str, bucket: str, rows_per_bucket: int = 500_000, least: int = 8
) -> DataFrame:
    """Add an order-preserving bucket number to each row.

    Bucket edges come from a quantile sketch, so a bucket holds about
    ``rows_per_bucket`` rows (more only when one value repeats more often).
    """
    total = df.count()
    parts = min(max(math.ceil(total / rows_per_bucket), least), MOST_BUCKETS)
    wanted = [i / parts for i in range(1, parts)]
    edges = _sketched_quantiles(df, [(F.col(column).cast("double"), "double", wanted)], EDGE_SKETCH_SIZE)[0] or []
    inner = sorted(set(edges)) or [0.0]
    number = f"{bucket}_number"
    splitter = Bucketizer(
        splits=[-math.inf, *inner, math.inf], inputCol=number, outputCol=bucket
    )
    return (
        splitter.transform(df.withColumn(number, F.col(column).cast("double")))
        .withColumn(bucket, F.col(bucket).cast("int"))
        .drop(number)
    )


def running_before(
    df: DataFrame,
    bucket: str,
    order: list[Column],
    sums: dict[str, Column],
    group: tuple[str, ...] = (),
) -> DataFrame:
    """For each row, the sums over the rows before it (within its group).

    Buckets are totalled first; their running totals are a table of at most one
    row per group and bucket. Rows are then sorted only within their bucket, so a
    group of any size is spread over its buckets.
    """
    totals = df.groupBy(*group, bucket).agg(
        *[F.sum(c).alias(f"{name}_bucket") for name, c in sums.items()]
    )
    across = (Window.partitionBy(*group) if group else Window).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = totals.select(
        *[F.col(g).alias(f"{g}_start") for g in group],
        F.col(bucket).alias(f"{bucket}_start"),
        *[
            F.coalesce(F.sum(f"{name}_bucket").over(across), F.lit(0)).alias(f"{name}_start")
            for name in sums
        ],
    )
    if not group:
        starts = F.broadcast(starts)  # at most MOST_BUCKETS rows
    within = (
        Window.partitionBy(*group, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = df.withColumns(
        {f"{name}_local": F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sums.items()}
    )
    same = F.col(bucket) == F.col(f"{bucket}_start")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_start"))
    joined = local.join(starts, same)
    return joined.withColumns(
        {f"{name}_before": F.col(f"{name}_start") + F.col(f"{name}_local") for name in sums}
    ).drop(
        f"{bucket}_start",
        *[f"{g}_start" for g in group],
        *[f"{name}_{part}" for name in sums for part in ("start", "local")],
    )


def rank_in_group(
    df: DataFrame,
    group: tuple[str, ...],
    value: str,
    tie: str,
    name: str,
    rows_per_bucket: int = 500_000,
    least: int = 8,
) -> DataFrame:
    """``row_number`` per group in (value, tie) order, without a task per group.

    A group is spread over value ranges. ``value`` should tell most rows of a group
    apart (a time stamp); rows sharing one value stay in one range.
    """
    cut = order_buckets(df, value, "order_bucket", rows_per_bucket, least)
    ranked = running_before(
        cut, "order_bucket", [F.col(value), F.col(tie)], {name: F.lit(1)}, group
    )
    return ranked.withColumn(name, (F.col(f"{name}_before") + 1).cast("int")).drop(
        f"{name}_before", "order_bucket"
    )


def bucket_digits(rows: int) -> int:
    return min(max(math.ceil(math.log(max(rows, 1) / 1e6, 16)), 2), 4)


def hash_buckets(df: DataFrame, key: str, seed: int | str, digits: int | None = None) -> DataFrame:
    """Add ``hash_order`` (random, from the key) and ``hash_bucket`` (its leading digits).

    Buckets follow hash order. ``digits`` hexadecimal digits give 16**digits of
    them; by default 256, or enough for about a million rows each, 65,536 at most.
    """
    digits = bucket_digits(df.count()) if digits is None else digits
    hashed = df.withColumn("hash_order", hash_long(F.col(key), seed, "order"))
    return hashed.withColumn(
        "hash_bucket", F.shiftright("hash_order", 4 * (HASH_DIGITS - digits)).cast("int")
    )


def bucket_starts(hashed: DataFrame) -> DataFrame:
    """One row per hash bucket: its size, the rows before it, the rows in all."""
    counts = hashed.groupBy("hash_bucket").agg(F.count(F.lit(1)).alias("bucket_rows"))
    before = Window.orderBy("hash_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("hash_bucket").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return counts.select(
        F.col("hash_bucket"),
        F.col("bucket_rows"),
        F.coalesce(F.sum("bucket_rows").over(before), F.lit(0)).alias("bucket_start"),
        F.sum("bucket_rows").over(everything).alias("all_rows"),
    )


def hash_rank(df: DataFrame, key: str, seed: int | str, digits: int | None = None) -> DataFrame:
    """Add ``hash_rank`` 1..n: the row's place in a random order of all rows."""
    hashed = hash_buckets(df, key, seed, digits)
    place = F.row_number().over(
        Window.partitionBy("hash_bucket").orderBy("hash_order", key)
    )
    return (
        hashed.withColumn("bucket_place", place)
        .join(F.broadcast(bucket_starts(hashed)), "hash_bucket")
        .withColumn("hash_rank", F.col("bucket_start") + F.col("bucket_place"))
        .drop("bucket_start", "bucket_place", "bucket_rows", "all_rows", "hash_bucket", "hash_order")
    )
