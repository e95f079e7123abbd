"""Spark ML pipelines: imputation, one-hot encoding and a tree learner."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverscope.errors import AnalysisError
from leverscope.functions.scalars import quoted
from leverscope.operators.boosting import LEAST_SHARE, SoftmaxBoosting, SoftmaxTreesModel, TreesModel
from leverscope.operators.cells import boost_classes, boost_number, boost_two, cell_grid, cell_sums, forest, largest
from leverscope.operators.prepare import Features, Fill, Task
from leverscope.session import checkpoint_dir

# The algorithm names a caller passes and the names reported back.
ALGORITHMS = {"gbr": "gradient_boosting", "rf": "random_forest"}
# Fixed value: a table under this many rows gets the small learner.
SMALL_ROWS = 40
PARTS_PER_TASK = 16  # partitions of the learner's order whose draws one task sums


@dataclass(frozen=True)
class LearnerSettings:
    """Tree counts and depths.

    ``forest_depth`` is bounded because Spark's trees are (30 at most). Without
    ``bootstrap`` every tree of a forest sees each row once. ``joint_classes``: boosting of three
    or more classes is one soft-max model; else one model per class with chances scaled to one.
    """

    trees: int = 80
    boosting_depth: int = 3
    boosting_step: float = 0.1
    forest_depth: int = 10
    least_leaf: int = 2
    bins: int = 32
    seed: int = 42
    parallel_classes: int = 4
    bootstrap: bool = True
    joint_classes: bool = True

    def for_rows(self, rows: int) -> LearnerSettings:
        if rows >= SMALL_ROWS:
            return self
        return replace(self, trees=min(self.trees, 40), boosting_depth=2, least_leaf=1)


def _sql_text(value: float | str) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"double('{value!r}')"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def preparation_stages(features: Features, fill: Fill) -> list:
    """Missing cells take the training values, levels become 0/1 columns.

    Unknown and missing levels have all zeros; no level is dropped (the encoder
    drops only the slot the indexer keeps for unknown ones).
    """
    columns = []
    for i, c in enumerate(features.numeric):
        value = fill.numeric[c] if fill.numeric[c] is not None else 0.0
        columns.append(f"coalesce({_name(c)}, {_sql_text(value)}) AS number_{i}")
    for i, c in enumerate(features.categorical):
        value = fill.categorical[c]
        filled = _name(c) if value is None else f"coalesce({_name(c)}, {_sql_text(value)})"
        columns.append(f"{filled} AS level_{i}")
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")]
    inputs = [f"number_{i}" for i in range(len(features.numeric))]
    if features.categorical:
        count = range(len(features.categorical))
        stages.append(
            StringIndexer(
                inputCols=[f"level_{i}" for i in count],
                outputCols=[f"level_index_{i}" for i in count],
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            )
        )
        stages.append(
            OneHotEncoder(
                inputCols=[f"level_index_{i}" for i in count],
                outputCols=[f"level_flags_{i}" for i in count],
                dropLast=True,
                handleInvalid="error",
            )
        )
        inputs += [f"level_flags_{i}" for i in count]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="inputs", handleInvalid="keep"))
    return stages


def learner(algorithm: str, task: Task, settings: LearnerSettings, classes: int | None = None) -> Estimator:
    if algorithm not in ALGORITHMS:
        raise AnalysisError("invalidAlgorithm", f"Use one of {', '.join(ALGORITHMS)}.")
    common = {
        "featuresCol": "inputs",
        "labelCol": "actual",
        "seed": settings.seed,
        "maxBins": settings.bins,
    }
    if algorithm == "rf":
        forest = {
            "numTrees": settings.trees,
            "maxDepth": settings.forest_depth,
            "minInstancesPerNode": settings.least_leaf,
            "bootstrap": settings.bootstrap,
        }
        if task.is_classification:
            return RandomForestClassifier(featureSubsetStrategy="sqrt", **forest, **common)
        return RandomForestRegressor(featureSubsetStrategy="all", **forest, **common)
    boosting = {
        "maxIter": settings.trees,
        "maxDepth": settings.boosting_depth,
        "stepSize": settings.boosting_step,
    }
    if task.kind == "regression":
        return GBTRegressor(**boosting, **common)
    if task.kind == "binary":
        return GBTClassifier(**boosting, **common)
    if settings.joint_classes and classes:
        return SoftmaxBoosting(classes=classes, rounds=settings.trees, depth=settings.boosting_depth, step=settings.boosting_step,
                               bins=settings.bins, seed=settings.seed, parallel=settings.parallel_classes)
    return OneVsRest(
        classifier=GBTClassifier(**boosting, **common),
        featuresCol="inputs",
        labelCol="actual",
        parallelism=settings.parallel_classes,
    )


def fit_on_cells(
    rows: DataFrame,
    laid: DataFrame,
    levels: tuple[int, ...],
    algorithm: str,
    task: Task,
    settings: LearnerSettings,
    classes: int | None,
) -> TreesModel | None:
    """The learner's trees, grown from the cells of its bins; None where these are too many or the learner has no such form.

    ``rows`` in any order have ``prepared`` inputs, ``laid`` has them in the learner's order.
    """
    if task.is_classification and (not classes or (algorithm == "gbr" and task.kind != "binary" and not settings.joint_classes)):
        return None
    most = None if task.is_classification else largest(rows)
    if not task.is_classification and most is None:
        return None
    kinds = classes if task.is_classification else None
    grid = cell_grid(laid, rows, levels, settings.bins, settings.seed, kinds)
    if grid is None:
        return None
    if algorithm == "rf":
        slots = sum(max(n, 1) for n in levels)
        some = math.ceil(math.sqrt(slots)) if task.is_classification else None
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, laid.rdd.getNumPartitions() // PARTS_PER_TASK)
        return TreesModel(forest(laid, grid, kinds, settings.trees, settings.forest_depth, settings.least_leaf, settings.bootstrap, settings.seed, some, most, tasks))
    cells = cell_sums(rows, grid, kinds, most)
    if task.kind == "regression":
        return TreesModel(boost_number(cells, settings.trees, settings.boosting_depth, settings.boosting_step))
    if task.kind == "binary":
        return TreesModel(boost_two(cells, settings.trees, settings.boosting_depth, settings.boosting_step))
    return SoftmaxTreesModel(boost_classes(cells, settings.trees, settings.boosting_depth, settings.boosting_step, LEAST_SHARE))


def fit_pipeline(
    train: DataFrame,
    features: Features,
    fill: Fill,
    algorithm: str,
    task: Task,
    settings: LearnerSettings,
    classes: int | None = None,
    layout: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> PipelineModel:
    """Fit on ``train`` (the features and ``actual``); ``layout`` deals its rows to partitions in the learner's order.

    Trees are grown from cells of equal bins where these can be held at once, else by Spark's learner over rows.
    With a checkpoint folder, its boosting cuts the lineage every ten rounds, so a lost
    executor costs a few rounds at most.
    """
    checkpoint_dir(train.sparkSession, required=False)
    own = learner(algorithm, task, settings, classes)
    used = [*[quoted(c) for c in features.names], "actual"]
    preparation = Pipeline(stages=preparation_stages(features, fill)).fit(train.select(*used))
    indexer = next((s for s in preparation.stages if isinstance(s, StringIndexerModel)), None)
    levels = (*[0] * len(features.numeric), *([len(labels) for labels in indexer.labelsArray] if indexer else []))
    columns = [f"number_{i}" for i in range(len(features.numeric))] + [f"level_index_{i}" for i in range(len(features.categorical))]
    prepared = F.array(*[F.col(c).cast("double") for c in columns]).alias("prepared")
    laid = preparation.transform(layout(train).select(*used))
    rows = preparation.transform(train.select(*used)).select(prepared, "actual")
    grown = fit_on_cells(rows, laid.select(prepared, "actual"), levels, algorithm, task, settings, classes)
    return PipelineModel([*preparation.stages, own.fit(laid) if grown is None else grown])
