"""Profiles kept as states that merge: per batch and column one small row.

A state holds counts, extremes and two sketches (distinct values, quantiles of numbers). States of
batches add up to the state of the whole, so a table that grows is profiled by its new part alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leverscope.functions.scalars import nan_to_null, parse_boolean, parse_number, quoted
from leverscope.operators.profile import _kind, _present

DISTINCT_BITS = 12  # log2 of the registers of a distinct sketch: 1.6 % standard error, 4 KB
QUANTILE_K = 400  # of a quantile sketch: rank error below 0.5 %, some 8 KB

FIELDS = (
    "batch string, position int, name string, kind string, row_count long, filled long, numbers long, booleans long, "
    "least double, greatest double, distinct_sketch binary, quantile_sketch binary"
)


def profile_states(df: DataFrame, batch: Column, columns: list[str] | None = None) -> DataFrame:
    """One row per batch and column, by one pass with map-side partial states.

    ``batch`` names the batch of a row (a literal, a column, the file's name); ``columns`` are those
    to profile, all unless given. No row is shuffled:
    each task sends one state per batch it saw.
    """
    measures = [F.count(F.lit(1)).alias("row_count")]
    fields = [df.schema[c] for c in columns or df.columns]
    for i, field in enumerate(fields):
        value, kind = quoted(field.name), _kind(field.dataType)
        nothing = F.lit(0).cast("long")
        if kind == "text":
            present, number, booleans = value, nan_to_null(parse_number(value)), F.count(parse_boolean(value))
        elif kind == "number":
            present, booleans = _present(df, field.name), nothing
            number = nan_to_null(value.cast("double"))
        else:
            present, number, booleans = value, F.lit(None).cast("double"), nothing
        measures.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(field.name).alias("name"), F.lit(kind).alias("kind"),
                F.count(present).alias("filled"), F.count(number).alias("numbers"), booleans.alias("booleans"),
                F.min(number).alias("least"), F.max(number).alias("greatest"),
                F.hll_sketch_agg(present.cast("string"), DISTINCT_BITS).alias("distinct_sketch"),
                F.kll_sketch_agg_double(number, QUANTILE_K).alias("quantile_sketch"),
            ).alias(f"m{i}")
        )
    per_batch = df.groupBy(batch.cast("string").alias("batch")).agg(*measures)
    each = F.explode(F.array(*[F.col(f"m{i}") for i in range(len(fields))])).alias("m")
    return per_batch.select("batch", "row_count", each).select(
        *[f"m.{c}" if c not in ("batch", "row_count") else c for c in (f.split()[0] for f in FIELDS.split(", "))]
    )


def merge_states(states: DataFrame, row_count: int) -> DataFrame:
    """One row per column of all batches, in the form ``infer_types`` reads, with sketch estimates.

    ``row_count`` is ``total_rows(states)``: a batch without a column counts as missing there. A
    column of different kinds is text. ``distinct_values`` and the quartiles are estimates.
    """
    one_kind = F.min("kind") == F.max("kind")
    merged = states.groupBy("name").agg(
        F.min("position").alias("position"),
        F.when(one_kind, F.min("kind")).otherwise("text").alias("kind"),
        *[F.sum(c).alias(c) for c in ("filled", "numbers", "booleans")],
        F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch", QUANTILE_K).alias("quantile_sketch"),
    )
    quartiles = F.when(
        F.col("numbers") > 0,
        F.kll_sketch_get_quantile_double("quantile_sketch", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))),
    )
    return merged.select(
        F.lit(row_count).cast("long").alias("rows"), "position", "name", "kind", "filled", "numbers", "booleans", "least", "greatest",
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_values"), quartiles.alias("quartiles"),
    )


def total_rows(states: DataFrame) -> int:
    """Rows of all batches: one number from one small row per batch and column."""
    batches = states.groupBy("batch").agg(F.max("row_count").alias("n"))
    return batches.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
