"""Fitted trees as a table of nodes: a changed input re-evaluates only the trees that split on it.

The sum over all trees is kept per row; a variant adds what the trees of its input give for the
new value and takes away what they gave for the old one. Rows arrive as prepared numbers (gaps
filled, levels as indices), so a variant is one number in place of another.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, OneVsRestModel, RandomForestClassificationModel
from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from leverscope.functions.scalars import quoted
from leverscope.session import checkpoint_dir

SLICE_CELLS = 1 << 21  # rows x variants x trees that one step of the evaluation holds
LEAST_SLICE = 16
GRID_ANSWERS = 1 << 22  # cells x outputs whose answers are kept
ANSWERS_AT_ONCE = 4096
MOST_BYTES = 512 << 20  # of node arrays; larger ensembles are scored by their own library


@dataclass(frozen=True)
class Grid:
    """Bins of prepared inputs, and one number for a row's bins. A number lies in the first bin whose cut it does
    not pass; a level is a bin of its own, an unknown one the last."""

    levels: tuple[int, ...]  # per input; 0 for a number
    cuts: tuple[np.ndarray, ...]

    @cached_property
    def sizes(self) -> list[int]:
        return [(levels or len(cuts)) + 1 for levels, cuts in zip(self.levels, self.cuts)]

    @cached_property
    def strides(self) -> list[int]:
        return [math.prod(self.sizes[i + 1 :]) for i in range(len(self.sizes))]

    @property
    def size(self) -> int:
        return math.prod(self.sizes)

    def bins(self, place: int, values: np.ndarray) -> np.ndarray:
        if levels := self.levels[place]:
            known = (values >= 0) & (values < levels)
            return np.where(known, values, levels).astype(np.int64)
        return np.searchsorted(self.cuts[place], values, side="left")

    def codes(self, rows: np.ndarray) -> np.ndarray:
        found = np.zeros(len(rows), np.int64)
        for i, stride in enumerate(self.strides):
            found += self.bins(i, rows[:, i]) * stride
        return found

    def digit(self, codes: np.ndarray, place: int) -> np.ndarray:
        return codes // self.strides[place] % self.sizes[place]

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """A row of inputs that lies in each cell."""
        lines = []
        for i, levels in enumerate(self.levels):
            digit = self.digit(codes, i)
            lines.append(digit.astype(np.float64) if levels else np.append(self.cuts[i], np.inf)[digit])
        return np.stack(lines, axis=1)


class Answers:
    """What an ensemble says of each cell of its own cuts, found when a cell is first asked for."""

    def __init__(self, trees: Trees, grid: Grid):
        self.trees, self.grid = trees, grid
        self.known = np.zeros(grid.size, bool)
        self.prediction = np.zeros(grid.size)
        self.chances = None if trees.kind == "number" else np.zeros((grid.size, max(trees.outputs, 2)))

    def learn(self, codes: np.ndarray) -> None:
        new = np.unique(codes[~self.known[codes]])
        for at in range(0, len(new), ANSWERS_AT_ONCE):
            some = new[at : at + ANSWERS_AT_ONCE]
            prediction, chances = self.trees.answers(self.trees.raw(self.trees.slots(self.grid.rows(some))))
            self.prediction[some] = prediction
            if chances is not None:
                self.chances[some] = chances
        self.known[new] = True


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees in a row; a leaf is its own child. ``value`` carries the tree's weight.

    ``out`` is the column of the raw sum that a tree adds to, or None if its leaves have one value per class.
    """

    kind: str  # number, two, shares, one_vs_rest, softmax
    roots: np.ndarray
    slot: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    out: np.ndarray | None
    outputs: int
    depth: int
    levels: tuple[int, ...]  # flags per input; 0 for a number
    slot_input: np.ndarray
    uses: tuple[np.ndarray, ...]  # per input the trees that split on it
    start: np.ndarray | None = None  # of soft-max margins, per class

    @cached_property
    def kept(self) -> Answers | None:
        """Answers by cell, where the cells of the cuts made are few; held by each process for itself."""
        if not self.levels:
            return None
        inner = self.low != np.arange(len(self.low))
        cuts = tuple(np.unique(self.cut[inner & (self.slot_input[self.slot] == i)]) if not levels else np.array([]) for i, levels in enumerate(self.levels))
        grid = Grid(self.levels, cuts)
        if any(np.isnan(c).any() for c in cuts) or grid.size * max(self.outputs, 2) > GRID_ANSWERS:
            return None
        return Answers(self, grid)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "kept"}

    def slots(self, rows: np.ndarray) -> np.ndarray:
        """One line per slot from rows of prepared inputs."""
        lines = []
        for i, levels in enumerate(self.levels):
            if levels:
                lines += [(rows[:, i] == level).astype(np.float64) for level in range(levels)]
            else:
                lines.append(rows[:, i])
        return np.stack(lines)

    def raw(self, slots: np.ndarray, trees: np.ndarray | None = None) -> np.ndarray:
        """Sum of leaf values of these trees (all if None), a column per output."""
        n = slots.shape[1]
        trees = np.arange(len(self.roots)) if trees is None else trees
        total = np.zeros((n, self.outputs))
        step = max(1, SLICE_CELLS // max(n, 1))
        for at in range(0, len(trees), step):
            some = trees[at : at + step]
            node = np.repeat(self.roots[some][:, None], n, axis=1)
            column = np.arange(n)
            for _ in range(self.depth):
                x = slots[self.slot[node], column]
                node = np.where(x <= self.cut[node], self.low[node], self.high[node])
            if self.out is None:
                for line in node:
                    total += self.value[line]
            else:
                found = self.value[node]
                for o in np.unique(self.out[some]):
                    total[:, o] += found[self.out[some] == o].sum(axis=0)
        return total

    def leaves(self, slots: np.ndarray, root: int) -> np.ndarray:
        """The leaf of one tree that each row reaches."""
        node, column = np.full(slots.shape[1], root), np.arange(slots.shape[1])
        for _ in range(self.depth):
            node = np.where(slots[self.slot[node], column] <= self.cut[node], self.low[node], self.high[node])
        return node

    def answers(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(prediction, chances) from raw sums, as the fitted model's own library gives them."""
        if self.kind == "number":
            return raw[..., 0], None
        if self.kind == "two":
            one = 1 / (1 + np.exp(-2 * raw[..., 0]))
            chances = np.stack([1 - one, one], axis=-1)
            return (raw[..., 0] > 0).astype(np.float64), chances
        if self.kind == "softmax":
            margins = raw + self.start
            powers = np.exp(margins - margins.max(axis=-1, keepdims=True))
            chances = powers / powers.sum(axis=-1, keepdims=True)
            return chances.argmax(axis=-1).astype(np.float64), chances
        if self.kind == "one_vs_rest":
            raw = 1 / (1 + np.exp(-2 * raw))
        total = raw.sum(axis=-1, keepdims=True)
        chances = np.where(total > 0, raw / np.where(total > 0, total, 1), 1 / self.outputs)
        return chances.argmax(axis=-1).astype(np.float64), chances

    def variants(self, slots: np.ndarray, raw: np.ndarray, place: int, values: np.ndarray) -> np.ndarray:
        """Raw sums (variant, row, output) with input ``place`` set to ``values`` (variant, row)."""
        trees = self.uses[place]
        if not len(trees):
            return np.broadcast_to(raw, (len(values), *raw.shape))
        kept = raw - self.raw(slots, trees)
        first = int(np.argmax(self.slot_input == place))
        wide = max(self.levels[place], 1)
        changed = slots.copy()
        out = np.empty((len(values), *raw.shape))
        for v, line in enumerate(values):
            if self.levels[place]:
                changed[first : first + wide] = line[None, :] == np.arange(wide)[:, None]
            else:
                changed[first] = line
            out[v] = kept + self.raw(changed, trees)
        return out


def _read(spark: SparkSession, model, folder: str) -> tuple[list, np.ndarray, bool]:
    """(nodes per tree, weights, whether leaves hold class counts) of a saved ensemble."""
    path = f"{folder}/{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    flat = nodes.select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.leftChild", "nodeData.rightChild",
                        "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold", "nodeData.split.numCategories")
    rows = sorted(flat.collect(), key=lambda r: (r["treeID"], r["id"]))  # the model itself, which the driver holds anyway
    weights = np.array(model.treeWeights)
    trees: list[list] = [[] for _ in weights]
    for r in rows:
        trees[r["treeID"]].append(r)
    return trees, weights, isinstance(model, RandomForestClassificationModel)


def _placed(trees: Trees, levels: tuple[int, ...], slot_input: np.ndarray) -> Trees | None:
    """Trees that come as a node table, with the inputs of the pipeline they belong to."""
    if len(trees.slot) * 32 + trees.value.nbytes > MOST_BYTES:
        return None
    tree = np.repeat(np.arange(len(trees.roots)), np.diff(np.append(trees.roots, len(trees.slot))))
    inner = trees.low != np.arange(len(trees.low))
    input_of = slot_input[trees.slot]
    uses = tuple(np.unique(tree[inner & (input_of == i)]) for i in range(len(levels)))
    return replace(trees, levels=levels, slot_input=slot_input, uses=uses)


def read_trees(pipeline: PipelineModel, classes: list[str] | None) -> Trees | None:
    """The node table of a fitted pipeline; None if its stages or splits are of another kind, or it is too large to send about."""
    *preparation, learner = pipeline.stages
    if not isinstance(preparation[-1], VectorAssembler):
        return None
    kind = {GBTRegressionModel: "number", RandomForestRegressionModel: "number", GBTClassificationModel: "two",
            RandomForestClassificationModel: "shares", OneVsRestModel: "one_vs_rest"}.get(type(learner))
    indexer = next((s for s in preparation if isinstance(s, StringIndexerModel)), None)
    flags = [len(labels) for labels in indexer.labelsArray] if indexer else []
    numbers = len(preparation[-1].getInputCols()) - len(flags)
    levels = (*[0] * numbers, *flags)
    slot_input = np.repeat(np.arange(len(levels)), [max(n, 1) if i >= numbers else 1 for i, n in enumerate(levels)])
    if kind is None:
        own = getattr(learner, "trees", None)
        return _placed(own, levels, slot_input) if isinstance(own, Trees) else None
    spark = SparkSession.active()
    folder = checkpoint_dir(spark, required=False)
    if folder is None:
        return None
    folder = f"{folder.rstrip('/')}/trees"
    members = learner.models if kind == "one_vs_rest" else [learner]
    if not all(isinstance(m, GBTClassificationModel) for m in members) and kind == "one_vs_rest":
        return None
    outputs = len(classes) if kind in ("shares", "one_vs_rest") else 1
    slot, cut, low, high, value, roots, out, used, depth = [], [], [], [], [], [], [], [], 1
    for place, member in enumerate(members):
        trees, weights, counts = _read(spark, member, folder)
        if kind == "number" and isinstance(member, RandomForestRegressionModel):
            weights = np.full(len(trees), 1 / len(trees))
        for nodes, weight in zip(trees, weights):
            base, at = len(slot), {r["id"]: i for i, r in enumerate(nodes)}
            roots.append(base)
            out.append(place)
            used.append({int(slot_input[r["featureIndex"]]) for r in nodes if r["leftChild"] >= 0})
            level = {nodes[0]["id"]: 0}
            for r in nodes:
                leaf = r["leftChild"] < 0
                here = base + at[r["id"]]
                left, right = (here, here) if leaf else (base + at[r["leftChild"]], base + at[r["rightChild"]])
                limit = 0.0
                if not leaf:
                    level[r["leftChild"]] = level[r["rightChild"]] = level[r["id"]] + 1
                    depth = max(depth, level[r["id"]] + 1)
                    named = list(r["leftCategoriesOrThreshold"])
                    if r["numCategories"] == -1:
                        limit = named[0]
                    elif r["numCategories"] == 2 and len(named) == 1:  # a flag
                        limit = 0.5
                        if named[0] == 1.0:
                            left, right = right, left
                    else:
                        return None
                slot.append(0 if leaf else r["featureIndex"])
                cut.append(limit)
                low.append(left)
                high.append(right)
                if counts:
                    stats = np.array(r["impurityStats"])
                    value.append(stats / stats.sum() if stats.sum() else stats)
                else:
                    value.append(weight * r["prediction"])
            if len(slot) * (32 + 8 * (outputs if counts else 1)) > MOST_BYTES:
                return None
    uses = tuple(np.array([t for t, u in enumerate(used) if i in u], np.int64) for i in range(len(levels)))
    return Trees(kind, np.array(roots, np.int64), np.array(slot, np.int32), np.array(cut), np.array(low, np.int64), np.array(high, np.int64), np.array(value),
                 None if kind == "shares" else np.array(out), outputs, depth, levels, slot_input, uses)


class TreeScorer:
    """The incremental side of a fitted pipeline of trees; inputs are numbered as in the model."""

    def __init__(self, pipeline: PipelineModel, trees: Trees):
        self.pipeline, self.trees = pipeline, trees

    def prepared(self, df: DataFrame, name: str) -> DataFrame:
        """Add the inputs as one array: numbers with gaps filled, levels as indices."""
        ready = df
        for stage in self.pipeline.stages[:-1]:
            if not isinstance(stage, (OneHotEncoderModel, VectorAssembler)):
                ready = stage.transform(ready)
        levels = self.trees.levels
        numbers = sum(n == 0 for n in levels)
        columns = [f"number_{i}" for i in range(numbers)] + [f"level_index_{i}" for i in range(len(levels) - numbers)]
        return ready.select(*[quoted(c) for c in df.columns], F.array(*[F.col(c).cast("double") for c in columns]).alias(name))

    def index(self, place: int, label: str) -> float:
        """The prepared value of a level; one the model has not seen gets a place behind the known ones."""
        indexer = next(s for s in self.pipeline.stages if isinstance(s, StringIndexerModel))
        labels = list(indexer.labelsArray[place - sum(n == 0 for n in self.trees.levels)])
        return float(labels.index(label) if label in labels else len(labels))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrays of equal length as the lines of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _slices(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    size = max(LEAST_SLICE, SLICE_CELLS // max(cells, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def added_losses(pairs: DataFrame, trees: Trees) -> DataFrame:
    """(feature_pos, repeat, added): loss added by permuting each input, summed per task.

    ``pairs``: inputs, actual, donors (arrays of inputs) and the repeats these are for.
    """
    held = pairs.sparkSession.sparkContext.broadcast(trees)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        width, sums = len(own.levels), {}

        def loss(raw: np.ndarray, actual: np.ndarray) -> np.ndarray:
            prediction, _ = own.answers(raw)
            return (prediction - actual) ** 2 if own.kind == "number" else (prediction != actual).astype(np.float64)

        for batch in _slices(batches, len(own.roots) // 4 + 32 * own.outputs):
            rows, actual = matrix(batch.column("inputs"), width), batch.column("actual").to_numpy(zero_copy_only=False)
            sizes = np.diff(batch.column("repeats").offsets.to_numpy())
            repeats = batch.column("repeats").flatten().to_numpy()
            donors = matrix(batch.column("donors").flatten(), width)
            # Donor lists have one length or are single: lines of one length go together.
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            for size in np.unique(sizes[sizes > 0]):
                some = np.flatnonzero(sizes == size)
                mine, truth = rows[some], actual[some]
                slots = own.slots(mine)
                raw = own.raw(slots)
                before = loss(raw, truth)
                places = starts[some][None, :] + np.arange(size)[:, None]
                for j in range(width):
                    after = loss(own.variants(slots, raw, j, donors[places, j]), truth)
                    # A row without a target is a donor, but adds no loss.
                    for line, r in zip(np.where(np.isnan(truth), 0.0, after - before), repeats[places]):
                        for repeat in np.unique(r):
                            key = (j + 1, int(repeat))
                            sums[key] = sums.get(key, 0.0) + float(line[r == repeat].sum())
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(sums.values()), pa.float64())],
                                         names=["feature_pos", "repeat", "added"])

    return pairs.select("inputs", "actual", "donors", "repeats").mapInArrow(task, "feature_pos int, repeat int, added double")


def cell_codes(rows: DataFrame, trees: Trees, key: str) -> DataFrame:
    """(key, code, actual) of rows (key, inputs, actual): the cell among the ensemble's cuts in place of the inputs."""
    held = rows.sparkSession.sparkContext.broadcast(trees)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = held.value.kept.grid
        for batch in batches:
            if batch.num_rows:
                code = pa.array(grid.codes(matrix(batch.column(1), len(grid.levels))))
                yield pa.RecordBatch.from_arrays([batch.column(0), code, batch.column(2)], names=[key, "code", "actual"])

    rows = rows.select(key, "inputs", "actual")
    schema = StructType([rows.schema[0], StructField("code", LongType()), rows.schema[2]])
    return rows.mapInArrow(task, schema)


EDGES = "bucket int, place long, rows long, code long, actual double"


def added_cell_losses(ordered: DataFrame, trees: Trees, repeats: int) -> tuple[dict[tuple[int, int], float], int]:
    """(loss added by permuting each input, by (input, repeat); rows in all).

    ``ordered``: hash_bucket, code, actual, a bucket's rows in one partition and in their order. In repeat r the donor
    is the row r places further on. Within a bucket tasks sum the losses as rows pass by; the rows at its two ends, at
    most twice ``repeats`` of up to 65,536 buckets, meet their neighbours on the driver.
    """
    held = ordered.sparkSession.sparkContext.broadcast(trees)

    def added(own: Trees, code: np.ndarray, actual: np.ndarray, mine: np.ndarray, donor: np.ndarray) -> list[float]:
        """Per input the loss added to rows ``mine`` by the inputs of rows ``donor``."""
        kept = own.kept
        kept.learn(code)

        def loss(cell: np.ndarray) -> np.ndarray:
            prediction, truth = kept.prediction[cell], actual[mine]
            return (prediction - truth) ** 2 if kept.chances is None else (prediction != truth).astype(np.float64)

        before, out = loss(code[mine]), []
        for j, stride in enumerate(kept.grid.strides):
            digit = kept.grid.digit(code, j)
            changed = code[mine] + (digit[donor] - digit[mine]) * stride
            kept.learn(changed)
            # A row without a target is a donor, but adds no loss.
            out.append(float(np.where(np.isnan(actual[mine]), 0.0, loss(changed) - before).sum()))
        return out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, edges = held.value, {}, []
        bucket, place, code, actual = None, 0, np.zeros(0, np.int64), np.zeros(0)

        def close() -> None:
            if bucket is not None:
                edges.append((np.full(len(code), bucket), np.arange(place - len(code), place), np.full(len(code), place), code, actual))

        for batch in batches:
            buckets = batch.column("hash_bucket").to_numpy()
            starts = np.r_[np.flatnonzero(np.diff(buckets, prepend=-1 if len(buckets) else 0)), len(buckets)]
            codes, truths = batch.column("code").to_numpy(), batch.column("actual").to_numpy(zero_copy_only=False)
            for a, b in zip(starts, starts[1:]):
                if buckets[a] != bucket:
                    close()
                    bucket, place, code, actual = int(buckets[a]), 0, codes[:0], truths[:0]
                if place < repeats:  # the first rows, as donors of the bucket before
                    n = min(repeats - place, b - a)
                    edges.append((np.full(n, bucket), np.arange(place, place + n), np.zeros(n, np.int64), codes[a : a + n], truths[a : a + n]))
                before, code, actual = len(code), np.concatenate([code, codes[a:b]]), np.concatenate([actual, truths[a:b]])
                for r in range(1, repeats + 1):
                    donor = np.arange(max(before, r), len(code))
                    if len(donor):
                        for j, x in enumerate(added(own, code, actual, donor - r, donor)):
                            sums[j + 1, r] = sums.get((j + 1, r), 0.0) + x
                place, code, actual = place + int(b - a), code[-repeats:], actual[-repeats:]
        close()
        # One schema for both: a sum has bucket -1, its input as place and its repeat as rows.
        if sums:
            keys = np.array(list(sums))
            edges.append((np.full(len(keys), -1), keys[:, 0], keys[:, 1], np.zeros(len(keys), np.int64), np.array(list(sums.values()))))
        for e in edges:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(e, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                                             names=["bucket", "place", "rows", "code", "actual"])

    found = ordered.select("hash_bucket", "code", "actual").mapInArrow(task, EDGES).toArrow()
    bucket, place, rows, code, actual = (found[c].to_numpy() for c in ("bucket", "place", "rows", "code", "actual"))
    total: dict[tuple[int, int], list[float]] = {(j + 1, r): [] for j in range(len(trees.levels)) for r in range(1, repeats + 1)}
    for i in np.flatnonzero(bucket < 0):
        total[int(place[i]), int(rows[i])].append(float(actual[i]))
    tail = np.flatnonzero((bucket >= 0) & (rows > 0))
    names, first = np.unique(bucket[tail], return_index=True)
    sizes = rows[tail][first]
    start = np.cumsum(sizes) - sizes
    everything = int(sizes.sum())
    edge = np.flatnonzero(bucket >= 0)
    of = np.searchsorted(names, bucket[edge])
    at, ends = place[edge] + start[of], (start + sizes)[of]
    code, actual, last = code[edge], actual[edge], np.flatnonzero(rows[edge] > 0)
    known, some = np.unique(at, return_index=True)  # a row may be among the first and the last
    for r in range(1, repeats + 1):
        out = last[at[last] + r >= ends[last]]
        donor = some[np.searchsorted(known, (at[out] + r) % max(everything, 1))]
        for j, x in enumerate(added(trees, code, actual, out, donor) if len(out) else []):
            total[j + 1, r].append(x)
    return {k: math.fsum(v) for k, v in total.items()}, everything


def point_means(rows: DataFrame, trees: Trees, grid: list[tuple[int, float]]) -> DataFrame:
    """(point, rows, total): sums of the answers (one, or one per class) with an input set to each point's value.

    ``grid`` names (input, prepared value) per point; every class comes from the one pass.
    """
    held = rows.sparkSession.sparkContext.broadcast(trees)
    asked: dict[int, list[int]] = {}
    for p, (place, _) in enumerate(grid):
        asked.setdefault(place, []).append(p)
    values = np.array([v for _, v in grid])

    def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = held.value.kept
        grid, count = kept.grid, np.zeros(kept.grid.size, np.int64)
        for batch in batches:
            if batch.num_rows:
                code, n = np.unique(grid.codes(matrix(batch.column("inputs"), len(grid.levels))), return_counts=True)
                count[code] += n
        code = np.flatnonzero(count)
        if len(code):
            totals = []
            for place, value in grid_points:
                changed = code + (grid.bins(place, np.array([value])) - grid.digit(code, place)) * grid.strides[place]
                kept.learn(changed)
                found = kept.prediction[changed, None] if kept.chances is None else kept.chances[changed]
                totals.append(count[code] @ found)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(totals)), pa.int32()), pa.array([int(count.sum())] * len(totals), pa.int64()), pa.array(np.array(totals).tolist(), pa.list_(pa.float64()))],
                                             names=["point", "rows", "total"])

    grid_points = list(grid)
    if trees.kept is not None:
        return rows.select("inputs").mapInArrow(by_cell, "point int, rows long, total array<double>")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count, sums = held.value, 0, None
        for batch in _slices(batches, len(own.roots) // 4 + 32 * own.outputs):
            lines = matrix(batch.column("inputs"), len(own.levels))
            slots = own.slots(lines)
            raw = own.raw(slots)
            count += len(lines)
            for place, points in asked.items():
                changed = own.variants(slots, raw, place, np.repeat(values[points][:, None], len(lines), axis=1))
                prediction, chances = own.answers(changed)
                found = prediction[..., None] if chances is None else chances
                sums = np.zeros((len(grid), found.shape[-1])) if sums is None else sums
                sums[points] += found.sum(axis=1)
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array([count] * len(grid), pa.int64()), pa.array(sums.tolist(), pa.list_(pa.float64()))],
                                             names=["point", "rows", "total"])

    return rows.select("inputs").mapInArrow(task, "point int, rows long, total array<double>")
