"""Plain sentences as string columns: a code, a summary, and the numbers as a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leverscope.functions.scalars import fixed, signed

# Below this a baseline is no basis for a percentage, and the rank of
# an input that has none.
LEAST_BASELINE = 1e-9
NO_RANK = 10_000


def _args(**values: Column) -> Column:
    """A text map; a NULL number stays a NULL value."""
    return F.create_map(
        *[part for k, v in values.items() for part in (F.lit(k), v.cast("string"))]
    )


def _insight(code: Column, summary: Column, args: Column) -> list[Column]:
    return [code.alias("code"), summary.alias("summary"), args.alias("args")]


def importance_insights(ranked: DataFrame, target: str) -> DataFrame:
    """One sentence per ranked input (needs feature, importance, share, rank, direction)."""
    name, rank = F.col("feature"), F.col("rank")
    share = fixed(F.col("share") * 100, 1)
    code = F.when(rank == 1, "topFactor").when(rank <= 3, "highFactor").otherwise("otherFactor")
    text = (
        F.when(rank == 1, F.concat(name, F.lit(f" explains {target} most: "), share, F.lit("% of the explained part.")))
        .when(rank <= 3, F.concat(name, F.lit(" is number "), rank, F.lit(f" for {target} with "), share, F.lit("%.")))
        .otherwise(F.concat(name, F.lit(" accounts for "), share, F.lit(f"% of what explains {target}.")))
    )
    push = (
        F.when(F.col("direction") == "up", F.concat(F.lit(" Raising "), name, F.lit(f" goes with a higher {target}.")))
        .when(F.col("direction") == "down", F.concat(F.lit(" Raising "), name, F.lit(f" goes with a lower {target}.")))
        .otherwise("")
    )
    args = _args(
        name=name,
        rank=rank,
        share=share,
        target=F.lit(target),
        importance=fixed(F.col("importance"), 4),
    )
    return ranked.select("*", *_insight(code, F.concat(text, push), args))


def dependence_insight(
    described: DataFrame,
    target: str,
    class_label: str | None = None,
) -> DataFrame:
    """One sentence per curve (needs feature, feature_type, direction, steepest_from/to).

    Levels have no order, so the curve of a categorical input has no slope, direction or
    steepest part, whatever was measured over its level numbers.
    """
    name = F.col("feature")
    numeric = F.col("feature_type") == "numeric"
    ordered = [c for c in ("slope", "direction", "steepest_from", "steepest_to") if c in described.columns]
    described = described.withColumns({c: F.when(numeric, F.col(c)) for c in ordered})
    start, end = fixed(F.col("steepest_from"), 3), fixed(F.col("steepest_to"), 3)
    if class_label is None:
        code = F.when(numeric, "dependenceNumeric").otherwise("dependenceCategorical")
        place = F.when(
            start.isNotNull() & end.isNotNull(),
            F.concat(F.lit(" The steepest part is from "), start, F.lit(" to "), end, F.lit(".")),
        ).otherwise("")
        push = (
            F.when(F.col("direction") == "up", F.lit(" The curve rises."))
            .when(F.col("direction") == "down", F.lit(" The curve falls."))
            .otherwise("")
        )
        text = F.when(
            numeric,
            F.concat(F.lit(f"Average predicted {target} as "), name, F.lit(" alone varies."), place, push),
        ).otherwise(F.concat(F.lit(f"Average predicted {target} for each value of "), name, F.lit(".")))
    else:
        code = F.when(numeric, "dependenceClassProbability").otherwise("dependenceCategorical")
        text = F.concat(F.lit(f"Average chance of {class_label} as "), name, F.lit(" alone varies."))
    args = _args(
        feature=name,
        target=F.lit(target),
        direction=F.coalesce("direction", F.lit("flat")),
        steepestFrom=start,
        steepestTo=end,
        classLabel=F.lit(class_label),
    )
    return described.select("*", *_insight(code, text, args))


def rank_map(ranked: DataFrame) -> Column:
    """The stored ranks as a map literal (one entry per input)."""
    rows = ranked.select("feature", "rank").collect()
    if not rows:
        return F.create_map().cast("map<string,int>")
    return F.create_map(*[F.lit(v) for r in rows for v in (r["feature"], r["rank"])])


def contribution_ranks() -> Column:
    """Ranks by size of contribution, for when no importance table is at hand."""
    return F.map_from_entries(
        F.transform("contributions", lambda c: F.struct(c["feature"], c["rank"]))
    )


def _primary(ranks: Column, order: list[str]) -> tuple[Column, Column]:
    """The best-ranked edited input and its rank; NULL when no edit has a rank."""
    edited = F.transform(
        F.filter(F.array(*[F.lit(c) for c in order]), lambda c: F.map_contains_key("applied", c)),
        lambda c: F.struct(
            F.coalesce(F.try_element_at(ranks, c), F.lit(NO_RANK)).alias("rank"), c.alias("feature")
        ),
    )
    ranked = F.filter(edited, lambda e: e["rank"] < NO_RANK)
    best = F.array_min(F.transform(ranked, lambda e: e["rank"]))
    first = F.try_element_at(F.filter(ranked, lambda e: e["rank"] == best), F.lit(1))
    return first["feature"], best


def _edit_bits(results: DataFrame, names: list[str]) -> Column:
    """'a from 1.000 to 2; b from x to y', in input order."""
    kinds = {f.name: f.dataType.simpleString() for f in results.schema["original"].dataType}

    def before(name: str) -> Column:
        value = F.col("original")[name]
        return fixed(value, 3) if kinds[name] == "double" else value

    bits = [
        F.when(
            F.map_contains_key("applied", c),
            F.concat(
                F.lit(f"{c} from "),
                F.coalesce(before(c), F.lit("nothing")),
                F.lit(" to "),
                F.coalesce(F.element_at("applied", c), F.lit("nothing")),
            ),
        )
        for c in names
    ]
    return F.concat_ws("; ", *bits)


def whatif_narrative(results: DataFrame, target: str, names: list[str], ranks: Column) -> DataFrame:
    """Adds delta_pct, code, summary, args to a regression ``whatif`` result."""
    base, new = F.col("baseline"), F.col("prediction")
    delta = new - base
    percent = F.when(
        F.abs(base) > LEAST_BASELINE, F.round(F.try_divide(delta * 100, F.abs(base)), 1)
    )
    count = F.size("applied")
    primary, rank = _primary(ranks, names)
    move = F.coalesce(F.concat(signed(percent, 1), F.lit("%")), signed(delta, 3))
    changed = F.concat(
        F.lit("With "), _edit_bits(results, names), F.lit(f", predicted {target} goes from "),
        fixed(base, 3), F.lit(" to "), fixed(new, 3), F.lit(" ("), move, F.lit(")."),
        F.coalesce(F.concat(F.lit(" "), primary, F.lit(" ranks "), rank, F.lit(" among the drivers.")), F.lit("")),
    )
    same = F.concat(F.lit(f"Nothing is changed; predicted {target} stays "), fixed(new, 3), F.lit("."))
    args = _args(
        target=F.lit(target),
        baseline=fixed(base, 4),
        prediction=fixed(new, 4),
        delta=fixed(delta, 4),
        deltaPct=fixed(percent, 1),
        edits=_edit_bits(results, names),
        primaryFeature=F.coalesce(primary, F.lit("")),
        primaryRank=rank,
        editCount=count,
    )
    code = F.when(count == 0, "whatIfNoEdits").otherwise("whatIfChanged")
    return results.select(
        "*",
        percent.alias("delta_pct"),
        primary.alias("primary_feature"),
        rank.alias("primary_rank"),
        *_insight(code, F.when(count == 0, same).otherwise(changed), args),
    )


def whatif_class_narrative(
    results: DataFrame, target: str, names: list[str], numeric: list[str], ranks: Column
) -> DataFrame:
    """Adds code, summary, args to a classification ``whatif`` result."""
    percent = fixed(F.col("prediction") * 100, 1)
    count = F.size("applied")
    primary, _ = _primary(ranks, names)
    hint = F.lit("changed")
    for c in numeric:
        before, after = F.col("original")[c], F.col("edited")[c]
        hint = (
            F.when((primary == c) & (after > before), "higher")
            .when((primary == c) & (after < before), "lower")
            .otherwise(hint)
        )
    hint = F.when(primary.isNotNull(), hint).otherwise("")
    label = F.col("predicted_class")
    why = F.coalesce(F.concat(F.lit(", above all because "), primary, F.lit(" is "), hint), F.lit(""))
    changed = F.concat(F.lit("The edited row looks like "), label, F.lit(" ("), percent, F.lit("%)"), why, F.lit("."))
    same = F.concat(F.lit("Nothing is changed; the row looks like "), label, F.lit(" ("), percent, F.lit("%)."))
    args = _args(
        target=F.lit(target),
        label=label,
        probability=percent,
        feature=F.coalesce(primary, F.lit("")),
        hint=hint,
        hintKey=hint,
        editCount=count,
    )
    code = F.when(count == 0, "whatIfClassNoEdits").otherwise("whatIfClass")
    return results.select(
        "*",
        primary.alias("primary_feature"),
        hint.alias("hint"),
        *_insight(code, F.when(count == 0, same).otherwise(changed), args),
    )


def class_insights(metrics: DataFrame, push: DataFrame, target: str) -> DataFrame:
    """One card per class from ``class_metrics`` and ``class_push`` (a row per class each)."""
    joined = metrics.join(
        F.broadcast(push.select("class_index", "feature", "direction")), "class_index", "left"
    )
    label, feature = F.col("label"), F.col("feature")
    direction = F.coalesce("direction", F.lit("flat"))
    part, hit, found = (fixed(F.col(c), 1) for c in ("support_pct", "precision_pct", "recall_pct"))
    text = F.concat(
        label, F.lit(": "), F.col("support"), F.lit(" rows ("), part, F.lit("%), precision "),
        hit, F.lit("%, recall "), found, F.lit("%."),
    )
    push_text = (
        F.when(feature.isNull() | (feature == ""), "")
        .when(direction == "up", F.concat(F.lit(" Raising "), feature, F.lit(" makes it likelier.")))
        .when(direction == "down", F.concat(F.lit(" Raising "), feature, F.lit(" makes it less likely.")))
        .otherwise(F.concat(F.lit(" "), feature, F.lit(" matters most over all classes.")))
    )
    args = _args(
        label=label,
        target=F.lit(target),
        support=F.col("support"),
        supportPct=part,
        precision=hit,
        recall=found,
        feature=F.coalesce(feature, F.lit("")),
        direction=direction,
    )
    return joined.select(
        "class_index", "label", "support", "support_pct", "precision_pct", "recall_pct",
        "feature", direction.alias("direction"),
        *_insight(F.lit("classCard"), F.concat(text, push_text), args),
    )
