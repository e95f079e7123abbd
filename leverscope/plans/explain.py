"""What a user asks of a fitted model: drivers, curves, what-if answers, scored rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverscope.errors import AnalysisError
from leverscope.operators import dependence as curves
from leverscope.operators import narrate
from leverscope.operators import whatif as scenarios_
from leverscope.operators.importance import class_push
from leverscope.operators.scorers import pick_class, response
from leverscope.plans.train import FittedModel, model_metrics


def _held(df: DataFrame) -> DataFrame:
    """A result of a few rows per input or class, computed once and kept."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@dataclass(frozen=True)
class Drivers:
    ranked: DataFrame  # importance, share, direction, rank, code, summary per input
    classes: DataFrame | None  # one card per class


def drivers(model: FittedModel, top: int | None = None, ranked: DataFrame | None = None) -> Drivers:
    """The ranked inputs in numbers and sentences; ``ranked`` reuses a stored table."""
    found = _held(model.importance(top) if ranked is None else ranked)
    told = narrate.importance_insights(found, model.spec.target)
    if model.spec.classes is None:
        return Drivers(told, None)
    leader = found.orderBy("rank").first()["feature"]
    spark, labels = found.sparkSession, model.spec.classes
    if leader in model.spec.numeric:
        push = class_push(model.scored(), leader, labels)
    else:
        push = spark.createDataFrame(
            [(i, c, leader, "flat") for i, c in enumerate(labels)],
            "class_index int, label string, feature string, direction string",
        )
    stored = model.spec.metrics.get("classMetrics")
    if stored is None:  # fitted without metrics
        stored = model_metrics(model.scored(), model.spec.task, labels)["classMetrics"]
    metrics = spark.createDataFrame(
        [
            (i, m["label"], m["support"], m["supportPct"], m["precision"], m["recall"])
            for i, m in enumerate(stored)
        ],
        "class_index int, label string, support long, support_pct double, precision_pct double,"
        " recall_pct double",
    )
    return Drivers(told, _held(narrate.class_insights(metrics, push, model.spec.target)))


@dataclass(frozen=True)
class Dependence:
    curve: DataFrame  # feature, grid_id, x, x_label, y
    points: DataFrame  # observed x, y, x_label, color per row
    insight: DataFrame  # direction, steepest part, code, summary


def dependence(
    model: FittedModel, feature: str, color_by: str | None = None, class_name: str | None = None
) -> Dependence:
    """Curve, observed points and description of one input (for one class)."""
    features, scorer = model.spec.features, model.scorer
    index = pick_class(scorer, class_name)
    answer = response(scorer, index)
    grid = curves.build_grid(model.frame, features, [feature])
    curve = _held(curves.partial_dependence(model.frame, features, scorer, grid, class_index=index))
    levels = [p.x_label for p in grid] if feature in features.categorical else None
    points = curves.dependence_points(
        model.scored(), feature, features, answer, levels, color_by, keep=(model.spec.key,)
    )
    kind = "numeric" if feature in features.numeric else "categorical"
    described = curves.describe_curves(curve).withColumn("feature_type", F.lit(kind))
    label = None if index is None else scorer.classes[index]
    return Dependence(curve, points, narrate.dependence_insight(described, model.spec.target, label))


def whatif(model: FittedModel, scenarios: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Answers to a table of scenarios (see ``operators.whatif.scenario_rows``).

    With a ranked importance table the sentence names the best-ranked edit by it,
    else by the size of its contribution.
    """
    spec, scorer = model.spec, model.scorer
    edits = dict(scenarios.dtypes).get("edits")
    if edits != "map<string,string>":
        raise AnalysisError("invalidEdits", "edits must be a text map of input to value.")
    if not scenarios.groupBy("scenario_id").count().where("count > 1").isEmpty():
        raise AnalysisError("duplicateScenarios", "Every scenario needs a scenario_id of its own.")
    features = spec.features
    rows = scenarios_.scenario_rows(scenarios, model.frame, features, spec.key)
    # Standard values are those of all usable rows, not only the training ones.
    found = scenarios_.whatif(rows, features, scorer, model.standard)
    means = model.means
    ranks = narrate.contribution_ranks() if ranked is None else narrate.rank_map(ranked)
    names = list(features.names)
    if spec.classes is None:
        found = found.withColumn("mean_prediction", F.lit(means[0]["mean_prediction"]))
        return narrate.whatif_narrative(found, spec.target, names, ranks)
    by_class = F.create_map(*[F.lit(v) for m in means for v in (m["label"], m["mean_prediction"])])
    found = found.withColumn("mean_prediction", F.element_at(by_class, F.col("predicted_class")))
    return narrate.whatif_class_narrative(found, spec.target, names, list(features.numeric), ranks)


def rows(model: FittedModel) -> DataFrame:
    """Every usable row with actual, predicted and residual."""
    return scenarios_.scored_rows(
        model.scored(), model.spec.features, model.scorer, keep=(model.spec.key,)
    )
