"""Boosting of several classes at once: a tree per class and round against soft-max residuals.

Trees are grown by Spark ML; what is added here is what its learner lacks, the margins of all
classes kept together and leaves that take a Newton step on the joint loss.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel, inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from leverscope.functions.scalars import quoted
from leverscope.operators.ensemble import Trees, matrix
from leverscope.session import checkpoint_dir

CUT_LINEAGE = 10  # rounds between two checkpoints of the margins
LEAST_SHARE = 2.0**-23  # of a class in the starting margins: one without training rows keeps a finite one


@dataclass
class _Nodes:
    """Nodes of the trees so far, tree by tree; a leaf is its own child."""

    roots: list[int] = field(default_factory=list)
    out: list[int] = field(default_factory=list)
    slot: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def grow(self, node, place: int) -> None:
        """Append a fitted tree (its root as Spark holds it) for class ``place``; leaves get no value yet."""
        self.roots.append(len(self.slot))
        self.out.append(place)
        self._append(node)

    def _append(self, node) -> int:
        at = len(self.slot)
        leaf = node.subtreeDepth() == 0
        for column, value in ((self.slot, 0), (self.cut, 0.0), (self.low, at), (self.high, at), (self.value, 0.0)):
            column.append(value)
        if not leaf:
            self.slot[at], self.cut[at] = node.split().featureIndex(), node.split().threshold()
            self.low[at] = self._append(node.leftChild())
            self.high[at] = self._append(node.rightChild())
        return at

    def extend(self, more: _Nodes) -> None:
        base = len(self.slot)
        for name in ("roots", "out", "slot", "cut", "low", "high", "value"):
            moved = base if name in ("roots", "low", "high") else 0
            getattr(self, name).extend(v + moved for v in getattr(more, name))

    def trees(self, start: np.ndarray, depth: int) -> Trees:
        return Trees("softmax", np.array(self.roots, np.int64), np.array(self.slot, np.int32), np.array(self.cut, float),
                     np.array(self.low, np.int64), np.array(self.high, np.int64), np.array(self.value, float),
                     np.array(self.out, np.int64), len(start), depth, (), np.array([], np.int64), (), start)


def _per_class(spark: SparkSession, trees: Trees, chances: bool):
    """(inputs, margins before) -> margins with these trees added, or the chances they give; arrays in class order."""
    held = spark.sparkContext.broadcast(trees)

    @F.arrow_udf("array<double>")
    def answer(inputs: pa.Array, before: pa.Array) -> pa.Array:
        own, n = held.value, len(inputs)
        found = np.zeros((0, own.outputs))
        if n:
            found = matrix(before, own.outputs) + own.raw(_slots(inputs))
            found = own.answers(found)[1] if chances else found
        return _lists(found)

    return answer


def _lists(found: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(found.ravel()))


def _slots(inputs: pa.Array) -> np.ndarray:
    flat = inputs.flatten()
    return np.ascontiguousarray(matrix(inputs, len(flat) // len(inputs)).T)


def _leaf_sums(rows: DataFrame, trees: Trees) -> DataFrame:
    """(node, slope, bend): residuals and their curvature summed over the rows of each leaf, in the tasks first."""
    held = rows.sparkSession.sparkContext.broadcast(trees)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        slope, bend = np.zeros(len(own.slot)), np.zeros(len(own.slot))
        for batch in batches:
            if not batch.num_rows:
                continue
            chances = matrix(batch.column("chances"), own.outputs)
            slots = _slots(batch.column("inputs"))
            actual = batch.column("actual").to_numpy(zero_copy_only=False)
            for root, place in zip(own.roots, own.out):
                node = own.leaves(slots, root)
                chance = chances[:, place]
                slope += np.bincount(node, (actual == place) - chance, len(slope))
                bend += np.bincount(node, chance * (1 - chance), len(bend))
        reached = np.flatnonzero(bend)
        yield pa.RecordBatch.from_arrays([pa.array(reached), pa.array(slope[reached]), pa.array(bend[reached])], names=["node", "slope", "bend"])

    parts = rows.select("inputs", "actual", "chances").mapInArrow(task, "node long, slope double, bend double")
    return parts.groupBy("node").agg(F.sum("slope").alias("slope"), F.sum("bend").alias("bend"))


class SoftmaxBoosting(Estimator):
    """Rows (``inputs`` vector, ``actual`` class index) to one ensemble for all classes.

    A round fits a regression tree per class to indicator minus chance, from the margins of the
    round before; leaf values are (k-1)/k * sum(residual) / sum(chance * (1 - chance)), scaled by
    ``step``. Margins start at the logarithms of the class shares. They are written beside the rows
    every ten rounds; a round adds the trees since then, so its plan is a scan and one step whatever
    the round, and a lost executor costs ten rounds of trees at most (without a checkpoint folder
    all trees are added each round). A class without training rows gets trees of one leaf and a chance
    near nothing.
    """

    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "trees per class", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "of a tree", TypeConverters.toInt)
    step = Param(Params._dummy(), "step", "share of a leaf's value that is taken", TypeConverters.toFloat)
    bins = Param(Params._dummy(), "bins", "cuts tried per input, plus one", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of the sample that places the bins", TypeConverters.toInt)
    parallel = Param(Params._dummy(), "parallel", "trees of a round fitted at a time", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, classes=None, rounds=None, depth=None, step=None, bins=None, seed=None, parallel=None):
        super().__init__()
        self._setDefault(classes=2, rounds=80, depth=3, step=0.1, bins=32, seed=42, parallel=4)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> SoftmaxTreesModel:
        spark, k = df.sparkSession, self.getOrDefault("classes")
        step, depth = self.getOrDefault("step"), self.getOrDefault("depth")
        folder = checkpoint_dir(spark, required=False)
        rows = df.select(vector_to_array("inputs").alias("inputs"), F.col("actual").cast("int").alias("actual"))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        seen = {r["actual"]: r["n"] for r in rows.groupBy("actual").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per class
        total = max(sum(seen.values()), 1)
        start = np.log([max(seen.get(c, 0) / total, LEAST_SHARE) for c in range(k)])
        # The starting margins are the model's own; what is written with the rows is what trees add to them.
        state = rows.withColumn("margins", F.array_repeat(F.lit(0.0), k))
        every, since = _Nodes(), _Nodes()
        learner = DecisionTreeRegressor(featuresCol="vector", labelCol="residual", maxDepth=depth, maxBins=self.getOrDefault("bins"),
                                        seed=self.getOrDefault("seed"))
        with ThreadPool(min(k, self.getOrDefault("parallel"))) as pool:
            for number in range(self.getOrDefault("rounds")):
                answer = _per_class(spark, since.trees(start, depth), chances=True)
                current = state.withColumn("chances", answer("inputs", "margins")).persist(StorageLevel.MEMORY_AND_DISK)

                def grown(place: int, current=current):
                    residual = F.when(F.col("actual") == place, 1.0).otherwise(0.0) - F.get("chances", F.lit(place))
                    return learner.fit(current.select(array_to_vector("inputs").alias("vector"), residual.alias("residual")))

                new = _Nodes()
                for place, tree in enumerate(pool.map(inheritable_thread_target(spark)(grown), range(k))):
                    new.grow(tree._call_java("rootNode"), place)
                for r in _leaf_sums(current, new.trees(start, depth)).collect():  # a row per leaf of the round
                    if r["bend"] > 0:
                        new.value[r["node"]] = step * (k - 1) / k * r["slope"] / r["bend"]
                every.extend(new)
                since.extend(new)
                if folder is not None and number % CUT_LINEAGE == CUT_LINEAGE - 1:
                    moved = _per_class(spark, since.trees(start, depth), chances=False)
                    state = state.withColumn("margins", moved("inputs", "margins")).checkpoint()
                    since = _Nodes()
                current.unpersist()
        rows.unpersist()
        return SoftmaxTreesModel(every.trees(start, depth))


def scored_rows(df: DataFrame, keep: list[str], inputs: Column, held: Broadcast, kind: str) -> DataFrame:
    """The columns to keep and the answers of a broadcast ensemble; ``inputs`` is an array, of prepared inputs if the ensemble knows their levels, else of slots."""
    # Whole rows go through the step as one cell, so their names and types do not matter to it.
    row = F.struct(*[quoted(c) for c in keep]).alias("row")
    packed = df.select(row, inputs.alias("inputs"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        kept = own.kept
        for batch in batches:
            if not batch.num_rows:
                continue
            if kept is not None:
                code = kept.grid.codes(matrix(batch.column("inputs"), len(own.levels)))
                kept.learn(code)
                prediction, chances = kept.prediction[code], None if kept.chances is None else kept.chances[code]
            else:
                lines = _slots(batch.column("inputs"))
                prediction, chances = own.answers(own.raw(own.slots(lines.T) if own.levels else lines))
            answers = [batch.column("row"), pa.array(prediction), *([] if chances is None else [_lists(chances)])]
            yield pa.RecordBatch.from_arrays(answers, names=["row", "prediction", "probability"][: len(answers)])

    fields = [StructField("prediction", DoubleType()), *([] if kind == "number" else [StructField("probability", ArrayType(DoubleType()))])]
    scored = packed.mapInArrow(task, StructType([packed.schema["row"], *fields]))
    return scored.select("row.*", *[f.name for f in reversed(fields)])


class TreesModel(Model, MLWritable, MLReadable):
    """Adds ``prediction`` (a number, or the likeliest class, the first of equals) and for classes ``probability`` (array in class order)."""

    def __init__(self, trees: Trees | None = None):
        super().__init__()
        self.trees = trees
        self._held = None

    def _transform(self, df: DataFrame) -> DataFrame:
        if self._held is None:
            self._held = df.sparkSession.sparkContext.broadcast(self.trees)
        keep = [c for c in df.columns if c.lower() not in ("probability", "prediction")]
        return scored_rows(df, keep, vector_to_array("inputs"), self._held, self.trees.kind)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class SoftmaxTreesModel(TreesModel):
    """The ensemble of ``SoftmaxBoosting``."""


class _Writer(MLWriter):
    """Metadata with the kind and the starting margins, and the nodes as a Parquet table."""

    def __init__(self, model: TreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, t = self.sparkSession, self.model.trees
        start = None if t.start is None else t.start.tolist()
        extra = {"kind": t.kind, "outputs": t.outputs, "start": start, "depth": t.depth, "nodes": len(t.slot)}
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata=extra)
        ends = np.append(t.roots[1:], len(t.slot))
        tree = np.repeat(np.arange(len(t.roots)), ends - t.roots)
        of = np.zeros(len(t.roots), np.int64) if t.out is None else t.out
        nodes = pa.table({"node": np.arange(len(t.slot)), "tree": tree, "class": of[tree], "slot": t.slot, "cut": t.cut,
                          "low": t.low, "high": t.high, "value": pa.array(t.value) if t.out is not None else _lists(t.value)})
        spark.createDataFrame(nodes).write.parquet(f"{path}/data")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TreesModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        nodes = spark.read.parquet(f"{path}/data").toPandas().sort_values("node")  # the model itself, which the driver holds anyway
        if len(nodes) != metadata["nodes"]:
            raise ValueError(f"{len(nodes)} of {metadata['nodes']} nodes at {path}")
        roots = nodes.drop_duplicates("tree")
        kind, start = metadata["kind"], metadata["start"]
        value = np.stack(nodes["value"].tolist()) if kind == "shares" else nodes["value"].to_numpy(float)
        model = self.cls(Trees(
            kind, roots["node"].to_numpy(np.int64), nodes["slot"].to_numpy(np.int32), nodes["cut"].to_numpy(float), nodes["low"].to_numpy(np.int64),
            nodes["high"].to_numpy(np.int64), value, None if kind == "shares" else roots["class"].to_numpy(np.int64), metadata["outputs"], metadata["depth"],
            (), np.array([], np.int64), (), None if start is None else np.array(start, float)))
        DefaultParamsReader.getAndSetParams(model, metadata)
        model._resetUid(metadata["uid"])
        return model
