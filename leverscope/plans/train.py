"""Fit a model end to end: table in, model with metrics and explanations out."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leverscope.errors import AnalysisError
from leverscope.operators import evaluate
from leverscope.operators.importance import explain_importance
from leverscope.operators.learners import ALGORITHMS, LearnerSettings, fit_pipeline
from leverscope.operators.prepare import (
    LEAST_ROWS,
    Features,
    Fill,
    Task,
    choose_features,
    class_labels,
    encode_labels,
    fill_values,
    holdout_split,
    label_text,
    resolve_task,
    usable_rows,
    with_split_hash,
)
from leverscope.functions.scalars import quoted
from leverscope.operators.scorers import PipelineScorer, check_reserved
from leverscope.operators.whatif import mean_prediction

# Learners seed their draws per partition, so the partitions of the training rows must follow from
# the rows alone: their number from the row count, their contents and order from the key.
ROWS_PER_TASK = 20_000
MOST_TASKS = 8192


@dataclass(frozen=True)
class ModelSpec:
    """What a saved model must say about itself besides its stages."""

    target: str
    key: str
    algorithm: str
    task_kind: str
    classes: list[str] | None
    numeric: list[str]
    categorical: list[str]
    numeric_fill: dict[str, float | None]
    categorical_fill: dict[str, str | None]
    metrics: dict = field(default_factory=dict)

    @property
    def features(self) -> Features:
        return Features(tuple(self.numeric), tuple(self.categorical))

    @property
    def fill(self) -> Fill:
        return Fill(self.numeric_fill, self.categorical_fill)

    @property
    def task(self) -> Task:
        return Task(self.task_kind)


@dataclass(frozen=True)
class FittedModel:
    """A fitted model with its model frame (key, inputs, ``actual``, ``split``)."""

    spec: ModelSpec
    scorer: PipelineScorer
    frame: DataFrame | None = None

    def scored(self) -> DataFrame:
        return self.scorer.score(self.frame)

    def importance(self, top: int | None = None, repeats: int | None = None) -> DataFrame:
        return explain_importance(
            self.frame, self.spec.features, self.scorer, self.spec.key, repeats=repeats, top=top
        )

    @cached_property
    def standard(self) -> Fill:
        """Standard values over all usable rows; computed once per model object."""
        return fill_values(self.frame, self.spec.features)

    @cached_property
    def means(self) -> list:
        """Mean answers (a row, or a row per class) over all usable rows; one scoring pass per model object."""
        return mean_prediction(self.scored(), self.scorer).collect()

    def release(self) -> None:
        self.frame.unpersist()


def model_frame(
    df: DataFrame, target: str, task: str = "auto", key: str = "row_key", seed: int = 42
) -> tuple[DataFrame, Features, Task, list[str] | None, int]:
    """Choose inputs, drop unusable rows, encode the target; the frame comes persisted."""
    features = choose_features(df, target, skip=(key,))
    check_reserved((key, *features.names))
    present = df.where(quoted(target).isNotNull())
    if present.limit(LEAST_ROWS).count() < LEAST_ROWS:
        raise AnalysisError("tooFewRows", f"At least {LEAST_ROWS} rows with a target are needed.")
    kind = resolve_task(present, target, task)
    usable = usable_rows(df, target, kind)
    classes = None
    inputs = [quoted(c) for c in features.names]
    if kind.is_classification:
        classes = class_labels(usable, target)
        labelled = usable.select(quoted(key), *inputs, label_text(usable, target).alias("class_label"))
        frame = encode_labels(labelled, "class_label", classes, "actual").select(quoted(key), *inputs, "actual")
    else:
        frame = usable.select(quoted(key), *inputs, quoted(target).try_cast("double").alias("actual"))
    frame = with_split_hash(frame, key, seed)
    # Kept because everything from here on reads it: the split, the fill values, the
    # learner's set-up, the metrics and the explanations.
    frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
    rows = frame.count()
    if rows < LEAST_ROWS:
        frame.unpersist()
        raise AnalysisError("tooFewRows", f"Only {rows} rows have a numeric target.")
    return frame, features, kind, classes, rows


def fit_model(
    df: DataFrame,
    target: str,
    algorithm: str = "gbr",
    task: str = "auto",
    key: str = "row_key",
    settings: LearnerSettings = LearnerSettings(),
    seed: int = 42,
    with_metrics: bool = True,
) -> FittedModel:
    """Profile-typed table (see ``load_table``) with a unique ``key`` -> fitted model."""
    if algorithm not in ALGORITHMS:
        raise AnalysisError("invalidAlgorithm", f"Use one of {', '.join(ALGORITHMS)}.")
    frame, features, kind, classes, rows = model_frame(df, target, task, key, seed)
    stratify = "actual" if kind.is_classification else None
    frame = holdout_split(frame, key, seed, stratify=stratify)
    train = frame.where(F.col("split") != "test")
    fill = fill_values(train, features)
    tasks = min(MOST_TASKS, -(-rows // ROWS_PER_TASK))
    pipeline = fit_pipeline(train, features, fill, algorithm, kind, settings.for_rows(rows), len(classes) if classes else None,
                            lambda df: df.repartition(tasks, quoted(key)).sortWithinPartitions(quoted(key)))
    scorer = PipelineScorer(pipeline, classes)
    metrics = {
        "algorithm": ALGORITHMS[algorithm],
        "targetColumn": target,
        "taskKind": kind.kind,
        "nRows": rows,
        "nFeatures": len(features.names),
    }
    if with_metrics:
        metrics |= model_metrics(scorer.score(frame.drop(key)), kind, classes)
    spec = ModelSpec(
        target,
        key,
        ALGORITHMS[algorithm],
        kind.kind,
        classes,
        list(features.numeric),
        list(features.categorical),
        fill.numeric,
        fill.categorical,
        metrics,
    )
    return FittedModel(spec, scorer, frame)


def model_metrics(scored: DataFrame, task: Task, classes: list[str] | None) -> dict:
    """Test metrics, the training figure beside them, and per-class detail."""
    outcome = ["split", "actual", "prediction"] + (["probability"] if classes else [])
    scored = scored.select(*outcome).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _metrics(evaluate.both_splits(scored), task, classes)
    finally:
        scored.unpersist()


def _metrics(sides: DataFrame, task: Task, classes: list[str] | None) -> dict:
    none = dict.fromkeys(
        ("rSquared", "rmse", "mae", "accuracy", "auc", "f1", "trainRSquared", "trainAccuracy")
    )
    if not task.is_classification:
        found = {r["split"]: r for r in evaluate.regression_metrics(sides, ("split",)).collect()}
        test, train = found["test"], found["train"]
        return none | {
            "task": "regression",
            "rSquared": test["r_squared"],
            "rmse": test["rmse"],
            "mae": test["mae"],
            "trainRSquared": train["r_squared"],
        }
    hits = {r["split"]: r["accuracy"] for r in evaluate.accuracy(sides, ("split",)).collect()}
    test = sides.where(F.col("split") == "test")
    seen = evaluate.confusion_cells(test).persist(StorageLevel.MEMORY_AND_DISK)
    cells = sorted(seen.collect())  # what occurs, not k * k cells
    counts = evaluate.class_totals(seen, classes)
    details = evaluate.class_metrics(counts).orderBy("class_index").collect()
    auc = None
    if task.kind == "binary":
        auc = evaluate.roc_auc(test, F.element_at("probability", 2)).first()["auc"]
    f1 = evaluate.f1_scores(counts).first()["f1"]
    seen.unpersist()
    return none | {
        "task": "classification",
        "accuracy": hits["test"],
        "trainAccuracy": hits["train"],
        "auc": auc,
        "f1": f1,
        "classes": classes,
        "confusion": {"labels": classes, "cells": [[c["actual_index"], c["predicted_index"], c["rows"]] for c in cells]},
        "classMetrics": [
            {
                "label": r["label"],
                "support": r["support"],
                "supportPct": round(r["support_pct"], 1),
                "precision": round(r["precision_pct"], 1),
                "recall": round(r["recall_pct"], 1),
            }
            for r in details
        ],
    }


def save_model(model: FittedModel, path: str) -> None:
    """Stages in Spark ML's own format, the description as one JSON line, the model frame as Parquet."""
    spark = SparkSession.active()
    model.scorer.pipeline.write().overwrite().save(f"{path}/stages")
    line = json.dumps(asdict(model.spec), ensure_ascii=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/spec"
    )
    if model.frame is not None:
        model.frame.write.mode("overwrite").parquet(f"{path}/frame")


def load_model(spark: SparkSession, path: str, frame: DataFrame | None = None) -> FittedModel:
    """A saved model; its own frame comes back with it, so that everything can be explained again."""
    try:
        spec = ModelSpec(**json.loads(spark.read.text(f"{path}/spec").first()["value"]))
        pipeline = PipelineModel.load(f"{path}/stages")
    except Exception as problem:  # whatever the storage or the format raises
        raise AnalysisError("badArtifact", f"No readable model at {path}.") from problem
    if frame is None:
        try:
            frame = spark.read.parquet(f"{path}/frame")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
    return FittedModel(spec, PipelineScorer(pipeline, spec.classes), frame)
