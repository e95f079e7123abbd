"""One way to score a frame, whatever made the model.

A scorer adds ``prediction`` (a number, or a class index) and, for classes,
``probability`` (array in class order). Every explanation goes through it.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property
from typing import Protocol

from pyspark import Broadcast
from pyspark.ml import PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leverscope.errors import AnalysisError
from leverscope.functions.scalars import quoted
from leverscope.operators.boosting import TreesModel, scored_rows
from leverscope.operators.ensemble import TreeScorer, read_trees

# Columns the library itself adds to a model frame; inputs must not use these names.
RESERVED = ("prediction", "probability", "actual", "split", "split_hash", "own_loss", "inputs")


class Scorer(Protocol):
    classes: list[str] | None

    def score(self, df: DataFrame) -> DataFrame: ...


def check_reserved(names: Iterable[str]) -> None:
    taken = [c for c in names if c.lower() in RESERVED]
    if taken:
        raise AnalysisError("reservedColumn", f"Rename input column(s) {', '.join(taken)}.")


def response(scorer: Scorer, class_index: int | None = None) -> Column:
    """The explained number: the prediction, or the probability of one class.

    The default class is the last one; an index out of range is clamped.
    """
    if scorer.classes is None:
        return F.col("prediction")
    last = len(scorer.classes) - 1
    wanted = last if class_index is None else min(max(class_index, 0), last)
    return F.element_at("probability", wanted + 1)


def pick_class(scorer: Scorer, name: str | None) -> int | None:
    """A class by label, else by number, else the last one; None for regression."""
    if scorer.classes is None:
        return None
    if name in scorer.classes:
        return scorer.classes.index(name)
    if name and name.strip().lstrip("+-").isdigit() and 0 <= int(name) < len(scorer.classes):
        return int(name)
    return len(scorer.classes) - 1


def batch_score(
    df: DataFrame, scorer: Scorer, class_index: int | None = None, name: str = "score"
) -> DataFrame:
    return scorer.score(df).withColumn(name, response(scorer, class_index))


class ExprScorer:
    """A closed-form model given as SQL expressions over the input columns."""

    def __init__(
        self,
        prediction: str | None = None,
        probabilities: list[str] | None = None,
        classes: list[str] | None = None,
    ):
        assert (prediction is None) == (probabilities is not None)
        self.classes = classes
        self._prediction = prediction
        self._probabilities = probabilities

    def score(self, df: DataFrame) -> DataFrame:
        if self._prediction is not None:
            return df.withColumn("prediction", F.expr(self._prediction).cast("double"))
        chances = F.array(*[F.expr(p).cast("double") for p in self._probabilities])
        return with_best_class(df.withColumn("probability", chances))


def with_best_class(df: DataFrame) -> DataFrame:
    best = F.array_position("probability", F.array_max("probability")) - 1
    return df.withColumn("prediction", best.cast("double"))


class PipelineScorer:
    """A fitted Spark ML pipeline: preparation stages and one learner."""

    def __init__(self, pipeline: PipelineModel, classes: list[str] | None):
        self.classes = classes
        self.pipeline = pipeline

    @cached_property
    def trees(self) -> TreeScorer | None:
        """The same model as a node table, for answers to many variants of a row; read once per model object."""
        found = read_trees(self.pipeline, self.classes)
        return None if found is None else TreeScorer(self.pipeline, found)

    @cached_property
    def _held(self) -> Broadcast:
        return SparkSession.active().sparkContext.broadcast(self.trees.trees)

    def score(self, df: DataFrame) -> DataFrame:
        *preparation, learner = self.pipeline.stages
        if isinstance(learner, TreesModel) and self.trees is not None:
            return scored_rows(self.trees.prepared(df, "inputs"), df.columns, F.col("inputs"), self._held, self.trees.trees.kind).select(
                *[quoted(c) for c in df.columns], "prediction", *(["probability"] if self.classes is not None else []))
        ready = df
        for stage in preparation:
            ready = stage.transform(ready)
        if isinstance(learner, OneVsRestModel):
            scored = _one_vs_rest(ready, learner)
        elif isinstance(learner, TreesModel):
            scored = learner.transform(ready.select(*[quoted(c) for c in df.columns], "inputs"))
        else:
            scored = learner.transform(ready)
            if self.classes is not None:
                scored = scored.withColumn("probability", vector_to_array("probability"))
        keep = [*df.columns, "prediction"] + (["probability"] if self.classes is not None else [])
        return scored.select(*[quoted(c) for c in keep])


def _one_vs_rest(ready: DataFrame, learner: OneVsRestModel) -> DataFrame:
    """Each member's chance of its own class, scaled to sum to one."""
    scored = ready
    members = []
    for i, member in enumerate(learner.models):
        member = member.copy()
        chance = f"member_{i}"
        member.setPredictionCol("").setRawPredictionCol(f"raw_{i}").setProbabilityCol(chance)
        scored = member.transform(scored)
        members.append(vector_to_array(chance)[1])
    scored = scored.withColumn("member_chances", F.array(*members))
    total = F.aggregate("member_chances", F.lit(0.0), lambda acc, x: acc + x)
    share = F.transform(
        "member_chances",
        lambda x: F.coalesce(F.try_divide(x, F.col("member_total")), F.lit(1.0 / len(members))),
    )
    return with_best_class(
        scored.withColumn("member_total", total).withColumn("probability", share)
    )
