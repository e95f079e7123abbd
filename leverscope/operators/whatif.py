"""What-if scenarios in batch, and the scored rows they start from."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leverscope.functions.scalars import finite_or_null, parse_number
from leverscope.operators.evaluate import class_table
from leverscope.operators.joins import lookup_join, small_enough
from leverscope.operators.prepare import Features, Fill
from leverscope.functions.scalars import quoted
from leverscope.operators.scorers import Scorer, response

# Fixed value: rows shown to a reader; the table itself is never cut.
SHOWN_ROWS = 500


def _edited(features: Features, name: str, edits: Column, original: Column) -> Column:
    """The edit when one is given (even an empty one), else the original value."""
    given = F.element_at(edits, name)
    if name in features.numeric:
        given = parse_number(given)
    return F.when(F.map_contains_key(edits, name), given).otherwise(original)


def scenario_rows(
    scenarios: DataFrame, rows: DataFrame, features: Features, key: str = "row_key"
) -> DataFrame:
    """Scenario (scenario_id, key, edits[, row]) with its original and edited inputs.

    A scenario starts from the table row it names, or from ``row`` (a text map) when
    that is given. Edits of unknown inputs are ignored. ``status`` is ``rowNotFound``
    when neither exists. Many scenarios may name one row: the join spreads it.
    """
    base = rows.select(key, F.struct(*[quoted(c) for c in features.names]).alias("base"))
    # Only the named rows take part. When they are few the table is filtered where it
    # is read and neither side is shuffled.
    named = scenarios.select(key).where(F.col(key).isNotNull()).distinct()
    few = small_enough(named)
    base = base.join(F.broadcast(named) if few else named, key, "left_semi")
    joined = lookup_join(scenarios, base, key, small=few)
    names = [F.lit(c) for c in features.names]
    edits = F.map_filter(
        F.coalesce("edits", F.create_map().cast("map<string,string>")),
        lambda k, _: k.isin(*names),
    )
    if "row" in scenarios.columns:
        given = F.struct(
            *[
                (
                    parse_number(F.element_at("row", c))
                    if c in features.numeric
                    else F.element_at("row", c)
                ).alias(c)
                for c in features.names
            ]
        )
        joined = joined.withColumn("base", F.when(F.col("row").isNotNull(), given).otherwise(F.col("base")))
    ready = joined.withColumn("applied", edits)
    return ready.select(
        "scenario_id",
        key,
        "applied",
        F.col("base").alias("original"),
        F.struct(
            *[
                _edited(features, c, F.col("applied"), F.col("base")[c]).alias(c)
                for c in features.names
            ]
        ).alias("edited"),
        F.when(F.col("base").isNull(), "rowNotFound").otherwise("ok").alias("status"),
    )


# Names of the scenario's own cells and of its answers while inputs stand beside them.
HELD, ANSWER = "whatif_row", "whatif_answer_"


def _with_answers(rows: DataFrame, features: Features, scorer: Scorer, fill: Fill | None) -> DataFrame:
    """(HELD, one answer column per variant): 0 original, 1 edited, 1 + j input j reset.

    The variants of a scenario are scored one after another where its row lies: nothing is
    expanded, grouped or joined back.
    """
    names = features.names
    before, after = F.col(HELD)["original"], F.col(HELD)["edited"]
    outcome = "prediction" if scorer.classes is None else "probability"
    out = rows.select(F.struct("*").alias(HELD))
    answers: list[str] = []
    for variant in range(2 if fill is None else len(names) + 2):
        inputs = []
        for j, c in enumerate(names, 2):
            value = (before if variant == 0 else after)[c]
            if variant == j:
                numeric = c in features.numeric
                value = F.lit(fill.numeric[c] if numeric else fill.categorical[c]).cast("double" if numeric else "string")
            inputs.append(value.alias(c))
        scored = scorer.score(out.select(HELD, *answers, *inputs))
        kept = [F.col(outcome).alias(f"{ANSWER}{variant}")]
        if scorer.classes is not None and variant < 2:
            kept.append(F.col("prediction").alias(f"{ANSWER}class_{variant}"))
        out = scored.select(HELD, *answers, *kept)
        answers = out.columns[1:]
    return out


def whatif(
    rows: DataFrame, features: Features, scorer: Scorer, fill: Fill | None = None
) -> DataFrame:
    """Per scenario of ``scenario_rows``: baseline, prediction and what moved it.

    Regression: ``baseline``, ``prediction``, ``delta``. Classification: the chance of
    the class predicted before and after, the two classes, ``baseline_focus`` (the
    chance, before, of the class predicted after) and all ``probabilities``. With
    ``fill``: ``contributions`` = prediction minus the prediction with one input put
    back to its standard value, largest first. All of them are NULL where no row was found.
    """
    names = features.names
    answered = _with_answers(rows, features, scorer, fill)
    classify = scorer.classes is not None
    alternatives = range(2, len(names) + 2) if fill is not None else ()
    if classify:
        labels = F.array(*[F.lit(c) for c in scorer.classes])
        first, then = (F.col(f"{ANSWER}class_{i}").cast("int") + 1 for i in range(2))
        prediction = F.element_at(f"{ANSWER}1", then)
        main = {
            "baseline": F.element_at(f"{ANSWER}0", first),
            "prediction": prediction,
            "baseline_focus": F.element_at(f"{ANSWER}0", then),
            "baseline_class": F.element_at(labels, first),
            "predicted_class": F.element_at(labels, then),
            "probabilities": F.arrays_zip(
                labels.alias("label"), F.col(f"{ANSWER}1").alias("probability")
            ),
        }
        alt = {j: F.element_at(f"{ANSWER}{j}", then) for j in alternatives}
    else:
        prediction = F.col(f"{ANSWER}1")
        main = {
            "baseline": F.col(f"{ANSWER}0"),
            "prediction": prediction,
            "delta": prediction - F.col(f"{ANSWER}0"),
        }
        alt = {j: F.col(f"{ANSWER}{j}") for j in alternatives}
    if fill is not None:
        steps = F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.lit(j - 1).alias("feature_pos"),
                    (prediction - alt[j]).alias("delta"),
                )
                for j, c in enumerate(names, 2)
            ]
        )
        main["contributions"] = F.sort_array(
            F.transform(
                steps,
                lambda s: F.struct(
                    F.abs(s["delta"]).alias("size"),
                    (-s["feature_pos"]).alias("back"),
                    s["feature"].alias("feature"),
                    s["delta"].alias("delta"),
                ),
            ),
            asc=False,
        )
    found = F.col(HELD)["status"] == "ok"
    results = answered.select(HELD, *[F.when(found, v).alias(k) for k, v in main.items()])
    if fill is not None:
        results = results.withColumn(
            "contributions",
            F.transform(
                "contributions",
                lambda s, i: F.struct(
                    s["feature"].alias("feature"),
                    s["delta"].alias("delta"),
                    (i + 1).alias("rank"),
                ),
            ),
        )
    return results.select(f"{HELD}.*", *results.columns[1:])


def mean_prediction(scored: DataFrame, scorer: Scorer) -> DataFrame:
    """One row; for classes (class_index, label, mean_prediction), one row per class."""
    if scorer.classes is None:
        return scored.agg(F.avg("prediction").alias("mean_prediction"))
    # One vector aggregate for all classes.
    chances = array_to_vector(F.col("probability"))
    means = scored.agg(vector_to_array(Summarizer.mean(chances)).alias("means"))
    each = means.select(F.posexplode("means").alias("class_index", "mean_prediction"))
    return each.join(class_table(scored, scorer.classes), "class_index").select("class_index", "label", "mean_prediction")


def scored_rows(
    scored: DataFrame,
    features: Features,
    scorer: Scorer,
    keep: tuple[str, ...] = (),
    actual: str = "actual",
) -> DataFrame:
    """actual, predicted, residual and the inputs of every row (non-finite cells NULL).

    For classes ``actual`` is the label, ``predicted`` the chance of the last class,
    and there is no residual.
    """
    predicted = response(scorer)
    if scorer.classes is None:
        truth, residual = quoted(actual), predicted - quoted(actual)
    else:
        labels = F.array(*[F.lit(c) for c in scorer.classes])
        truth = F.element_at(labels, quoted(actual).cast("int") + 1)
        residual = F.lit(None).cast("double")
    cells = [
        (finite_or_null(quoted(c)) if c in features.numeric else quoted(c)).alias(c)
        for c in features.names
    ]
    return scored.select(
        *keep,
        truth.alias("actual"),
        predicted.alias("predicted"),
        residual.alias("residual"),
        *cells,
    )


def shown_rows(rows: DataFrame, order: list[str], limit: int = SHOWN_ROWS) -> DataFrame:
    """The part of ``scored_rows`` a reader sees first."""
    return rows.orderBy(*order).limit(limit)
