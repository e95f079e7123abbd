"""Trees grown from cells: training rows that fall into the same bin of every input are one weighted point.

A tree learner sees an input only through its bins, so counts and target sums per cell decide every
cut and every leaf. Rows are read a fixed number of times, whatever the number of rounds; what is
repeated each round is over cells. Bins are placed by Spark's own learner, over the same sample.
Sums are whole numbers of a fixed unit, so a fit does not depend on the order of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverscope.operators.ensemble import Grid, Trees, matrix

MOST_CELLS = 1 << 20  # larger tables of cells are left to the learners that read rows
MOST_CLASS_CELLS = 1 << 23  # cells x classes
MOST_CLASSES = 100
CODES = 1 << 62
SPLIT_ROWS = 10_000
EPSILON = 2.0**-52
LEAST_TARGET = 1e-200  # sizes outside this and its inverse are left to the learners that read rows
UNIT_BITS = 30  # of each of the two whole numbers that stand for a target
POISSON_TOP = 18  # P(Poisson(1) > 18) < 2**-53


def split_points(laid: DataFrame, total: int, numbers: int, bins: int, seed: int) -> list[np.ndarray] | None:
    """Per number the cuts Spark's learners try on these rows (``prepared``, ``actual``): they sort a sample of ten
    thousand rows, drawn partition by partition. None if a number in it is none."""
    spark = laid.sparkSession
    jdf = laid.select(F.slice("prepared", 1, numbers).alias("prepared"))._jdf
    wanted = max(bins * bins, SPLIT_ROWS)
    share = wanted / total if wanted < total else 1.0
    taken = jdf.rdd()
    if share < 1:
        taken = taken.sample(False, share, spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt())
    sample = DataFrame(jdf.sparkSession().createDataFrame(taken, jdf.schema()), spark).toArrow()  # SPLIT_ROWS rows
    values = matrix(sample["prepared"].combine_chunks(), numbers) if numbers else np.zeros((0, 0))
    if np.isnan(values).any():
        return None
    return [_cuts(line, share * total, min(bins, total) - 1) for line in values.T]


def _cuts(values: np.ndarray, rows: float, most: int) -> np.ndarray:
    """Midpoints between neighbours nearest to equal shares of the rows expected; what is missing from these counts as zeros."""
    found, counts = np.unique(values[values != 0], return_counts=True)
    missing = rows - counts.sum()
    if not len(found):
        return np.array([])
    if missing > EPSILON * counts.sum() * 100:
        at = np.searchsorted(found, 0.0)
        found, counts = np.insert(found, at, 0.0), np.insert(counts.astype(float), at, missing)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) <= most:
        return middles
    step, cuts, so_far = rows / (most + 1), [], counts[0]
    target = step
    for middle, count in zip(middles, counts[1:]):
        before, so_far = so_far, so_far + count
        if abs(before - target) < abs(so_far - target):
            cuts.append(middle)
            target += step
    return np.array(cuts)


@dataclass(frozen=True)
class Unit:
    """Targets as two whole numbers: multiples of ``2**high`` and of ``2**low``, exact to 2**-60 of the largest."""

    high: int
    low: int

    @classmethod
    def of(cls, most: float) -> Unit:
        top = math.frexp(most)[1] if most else 0
        return cls(top - UNIT_BITS, top - 2 * UNIT_BITS)

    def split(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = np.rint(np.ldexp(y, -self.high))
        return high.astype(np.int64), np.rint(np.ldexp(y - np.ldexp(high, self.high), -self.low)).astype(np.int64)

    def joined(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return np.ldexp(high.astype(float), self.high) + np.ldexp(low.astype(float), self.low)


def _coded(rows: DataFrame, grid: Grid, numbered: bool = False) -> DataFrame:
    """(code, actual) of rows (``prepared``, ``actual``); ``numbered`` adds the row's place in its partition and that one's number."""
    held = rows.sparkSession.sparkContext.broadcast(grid)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = held.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            if batch.num_rows:
                code = pa.array(own.codes(matrix(batch.column("prepared"), len(own.levels))))
                place = pa.array(np.arange(at, at + batch.num_rows))
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([code, batch.column("actual"), *([place] if numbered else [])], names=["code", "actual", "place"][: 2 + numbered])

    return rows.select("prepared", "actual").mapInArrow(task, "code long, actual double" + (", place long" if numbered else ""))


def _few(rows: DataFrame, grid: Grid, classes: int) -> bool:
    """Whether the cells that occur can be held at once; a grid that is small needs no counting."""
    cells = grid.size
    if cells > MOST_CELLS:
        cells = _coded(rows, grid).agg(F.approx_count_distinct("code", 0.02)).first()[0] * 1.1
    return cells <= MOST_CELLS and cells * classes <= MOST_CLASS_CELLS


@dataclass(frozen=True)
class Cells:
    """Cells by code, rows per cell, and target sums: a column, or rows per class."""

    grid: Grid
    n: np.ndarray
    s: np.ndarray
    bins: list[np.ndarray]  # per slot


def _slot_bins(grid: Grid, code: np.ndarray) -> list[np.ndarray]:
    lines = []
    for i, levels in enumerate(grid.levels):
        digit = grid.digit(code, i)
        lines += [(digit == level).astype(np.int64) for level in range(levels)] if levels else [digit]
    return lines


def _slot_cuts(grid: Grid) -> list[np.ndarray]:
    cuts = []
    for levels, own in zip(grid.levels, grid.cuts):
        cuts += [np.array([0.5])] * levels if levels else [own]
    return cuts


def cell_sums(rows: DataFrame, grid: Grid, classes: int | None, most: float | None) -> Cells:
    """The cells of rows (``prepared``, ``actual``), summed in the tasks first."""
    if classes:
        coded = _coded(rows, grid).groupBy("code", F.col("actual").cast("int").alias("place")).agg(F.count(F.lit(1)).alias("n"))
        found = coded.toArrow()
        code, of = np.unique(found["code"].to_numpy(), return_inverse=True)
        s = np.zeros((len(code), classes))
        s[of, found["place"].to_numpy()] = found["n"].to_numpy()
        return Cells(grid, s.sum(axis=1), s, _slot_bins(grid, code))
    unit = Unit.of(most)
    high = F.rint(F.col("actual") * 2.0**-unit.high)
    low = F.rint((F.col("actual") - high * 2.0**unit.high) * 2.0**-unit.low)
    found = _coded(rows, grid).groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.sum(high.cast("long")).alias("high"), F.sum(low.cast("long")).alias("low")
    ).toArrow().sort_by("code")
    s = unit.joined(found["high"].to_numpy(), found["low"].to_numpy())
    return Cells(grid, found["n"].to_numpy().astype(float), s[:, None], _slot_bins(grid, found["code"].to_numpy()))


@dataclass
class Grown:
    """A tree in order of its levels; a leaf is its own child. ``at`` is the leaf each cell reaches."""

    slot: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray
    s: np.ndarray
    at: np.ndarray


def grow(bins: list[np.ndarray], cuts: list[np.ndarray], n: np.ndarray, s: np.ndarray, depth: int, least: int = 1,
         some: int | None = None, rng: np.random.Generator | None = None) -> Grown:
    """A tree level by level: the cut of largest gain, the first of equals, wherever one gains anything.

    The gain of squared error (``s`` a sum per cell) and of Gini impurity (a count per class) is one
    formula. ``some``: inputs tried per node, drawn anew for each.
    """
    k, at = s.shape[1], np.zeros(len(n), np.int64)
    slot, cut, low, high = [0], [0.0], [0], [0]
    sums_n, sums_s = [float(n.sum())], [s.sum(axis=0)]
    open_ = np.zeros(1, np.int64)
    rows = np.arange(len(n))
    for _ in range(depth):
        place = np.full(len(slot), -1)
        place[open_] = np.arange(len(open_))
        rows = rows[place[at[rows]] >= 0]
        here = place[at[rows]]
        count, sums = n[rows], [s[rows, c] for c in range(k)]
        best, best_slot, best_cut = np.zeros(len(open_)), np.full(len(open_), -1), np.zeros(len(open_), np.int64)
        left_n, left_s = np.zeros(len(open_)), np.zeros((len(open_), k))
        tried = None
        if some is not None and some < len(bins):
            tried = np.zeros((len(open_), len(bins)), bool)
            np.put_along_axis(tried, rng.random((len(open_), len(bins))).argsort(axis=1)[:, :some], True, axis=1)
        for j, own in enumerate(cuts):
            width = len(own) + 1
            if width < 2 or (tried is not None and not tried[:, j].any()):
                continue
            key = here * width + bins[j][rows]
            wide = len(open_) * width
            hn = np.bincount(key, count, wide).reshape(-1, width).cumsum(axis=1)
            hs = np.stack([np.bincount(key, x, wide).reshape(-1, width).cumsum(axis=1) for x in sums])
            ln, ls = hn[:, :-1], hs[:, :, :-1]
            rn, rs = hn[:, -1:] - ln, hs[:, :, -1:] - ls
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (ls * ls).sum(axis=0) / ln + (rs * rs).sum(axis=0) / rn - (hs[:, :, -1:] ** 2).sum(axis=0) / hn[:, -1:]
            gain[(ln < least) | (rn < least)] = -np.inf
            if tried is not None:
                gain[~tried[:, j]] = -np.inf
            c = gain.argmax(axis=1)
            g = gain[np.arange(len(open_)), c]
            better = np.flatnonzero(g > best)
            best[better], best_slot[better], best_cut[better] = g[better], j, c[better]
            left_n[better], left_s[better] = ln[better, c[better]], ls[:, better, c[better]].T
        split = np.flatnonzero(best_slot >= 0)
        if not len(split):
            break
        child = len(slot) + 2 * np.arange(len(split))
        first = np.full(len(open_), -1)
        first[split] = child
        for i, a in zip(split, child):
            node, j = open_[i], best_slot[i]
            slot[node], cut[node], low[node], high[node] = j, cuts[j][best_cut[i]], a, a + 1
            slot += [0, 0]
            cut += [0.0, 0.0]
            low += [a, a + 1]
            high += [a, a + 1]
            sums_s += [left_s[i], sums_s[node] - left_s[i]]
            sums_n += [left_n[i], sums_n[node] - left_n[i]]
        moved = first[here] >= 0
        rows, here = rows[moved], here[moved]
        digit = np.empty(len(rows), np.int64)
        slot_of = best_slot[here]
        for j in np.unique(slot_of):
            own = np.flatnonzero(slot_of == j)
            digit[own] = bins[j][rows[own]]
        at[rows] = first[here] + (digit > best_cut[here])
        open_ = np.concatenate([child, child + 1])
        open_.sort()
    return Grown(np.array(slot, np.int32), np.array(cut, float), np.array(low, np.int64), np.array(high, np.int64), np.array(sums_n), np.array(sums_s), at)


def pruned(tree: Grown) -> Grown:
    """Leaves of one parent that name the same class are one leaf, as in Spark's own trees; nodes cut off stay unreached."""
    own, named = np.arange(len(tree.low)), tree.s.argmax(axis=1)
    for node in range(len(own) - 1, -1, -1):
        a, b = tree.low[node], tree.high[node]
        if a != node and tree.low[a] == a and tree.low[b] == b and named[a] == named[b]:
            tree.low[node] = tree.high[node] = node
    return tree


def _joined(kind: str, grown: list[Grown], value: list[np.ndarray], out: list[int] | None, outputs: int, depth: int, start: np.ndarray | None = None) -> Trees:
    base = np.cumsum([0, *[len(g.slot) for g in grown]])[:-1]
    return Trees(kind, base.astype(np.int64), np.concatenate([g.slot for g in grown]), np.concatenate([g.cut for g in grown]),
                 np.concatenate([g.low + b for g, b in zip(grown, base)]), np.concatenate([g.high + b for g, b in zip(grown, base)]),
                 np.concatenate(value), None if out is None else np.array(out, np.int64), outputs, max(depth, 1), (), np.array([], np.int64), (), start)


def boost_number(cells: Cells, rounds: int, depth: int, step: float) -> Trees:
    """Boosting of squared error as Spark has it: the first tree counts whole, later ones fit twice the residual."""
    cuts, margin = _slot_cuts(cells.grid), np.zeros(len(cells.n))
    grown, value = [], []
    for number in range(rounds):
        s = cells.s[:, 0] if number == 0 else 2 * (cells.s[:, 0] - cells.n * margin)
        tree = grow(cells.bins, cuts, cells.n, s[:, None], depth)
        grown.append(tree)
        value.append((step if number else 1.0) * tree.s[:, 0] / tree.n)
        margin += value[-1][tree.at]
    return _joined("number", grown, value, [0] * rounds, 1, depth)


def boost_two(cells: Cells, rounds: int, depth: int, step: float) -> Trees:
    """Boosting of two classes as Spark has it: labels -1 and 1, log loss, leaves the mean gradient."""
    cuts, margin = _slot_cuts(cells.grid), np.zeros(len(cells.n))
    first, second = cells.s[:, 0], cells.s[:, 1]
    grown, value = [], []
    for number in range(rounds):
        s = second - first if number == 0 else 4 * (second / (1 + np.exp(2 * margin)) - first / (1 + np.exp(-2 * margin)))
        tree = grow(cells.bins, cuts, cells.n, s[:, None], depth)
        grown.append(tree)
        value.append((step if number else 1.0) * tree.s[:, 0] / tree.n)
        margin += value[-1][tree.at]
    return _joined("two", grown, value, [0] * rounds, 1, depth)


def boost_classes(cells: Cells, rounds: int, depth: int, step: float, least_share: float) -> Trees:
    """The rounds of ``SoftmaxBoosting`` over cells: a tree per class against soft-max residuals, Newton leaves."""
    cuts, k = _slot_cuts(cells.grid), cells.s.shape[1]
    start = np.log(np.maximum(cells.s.sum(axis=0) / max(cells.n.sum(), 1), least_share))
    margins = np.tile(start, (len(cells.n), 1))
    grown, value, out = [], [], []
    for _ in range(rounds):
        powers = np.exp(margins - margins.max(axis=1, keepdims=True))
        chances = powers / powers.sum(axis=1, keepdims=True)
        for c in range(k):
            slope = cells.s[:, c] - cells.n * chances[:, c]
            tree = grow(cells.bins, cuts, cells.n, slope[:, None], depth)
            bend = np.bincount(tree.at, cells.n * chances[:, c] * (1 - chances[:, c]), len(tree.slot))
            leaf = np.bincount(tree.at, slope, len(tree.slot))
            with np.errstate(divide="ignore", invalid="ignore"):
                grown.append(tree)
                value.append(np.where(bend > 0, step * (k - 1) / k * leaf / bend, 0.0))
            out.append(c)
            margins[:, c] += value[-1][tree.at]
    return _joined("softmax", grown, value, out, k, depth, start)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(place: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """How often each tree takes each row (row, tree): Poisson(1), settled by the row's place and the seed alone."""
    ends = np.array([sum(1 / math.factorial(i) for i in range(k + 1)) / math.e for k in range(POISSON_TOP)])
    ends = (ends[ends < 1] * 2.0**53).astype(np.uint64)
    begin = np.arange(1 << 16, dtype=np.uint64) << np.uint64(37)
    low = np.searchsorted(ends, begin, side="right").astype(np.uint8)
    unsure = np.searchsorted(ends, begin + np.uint64((1 << 37) - 1), side="right") != low
    own = _mixed(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mixed(np.array([seed], np.int64).view(np.uint64)))
    bits = _mixed(own[:, None] + (np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]) >> np.uint64(11)
    lead = (bits >> np.uint64(37)).astype(np.int64)
    out = low[lead]
    open_ = unsure[lead]
    out[open_] = np.searchsorted(ends, bits[open_], side="right")
    return out


def _weights(coded: DataFrame, trees: int, seed: int, bootstrap: bool, unit: Unit | None, classes: int) -> DataFrame:
    """(tree, code, place, n, s): per tree and cell (and class) how many draws, and the sum of their targets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        sums = [np.zeros((1024, trees), np.int64) for _ in range(3 if unit else 1)]
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column("code").to_numpy()
            y = batch.column("actual").to_numpy()
            key = code if unit else code * classes + y.astype(np.int64)
            order = np.argsort(key, kind="stable")
            names, starts = np.unique(key[order], return_index=True)
            taken = (draws(batch.column("place").to_numpy()[order], trees, seed) if bootstrap else np.ones((len(key), trees), np.uint8)).astype(np.int64)
            at = np.array([known.setdefault(c, len(known)) for c in names.tolist()])
            while len(known) > len(sums[0]):
                sums = [np.concatenate([x, np.zeros_like(x)]) for x in sums]
            sums[0][at] += np.add.reduceat(taken, starts, axis=0)
            if unit:
                for x, part in zip(sums[1:], unit.split(y[order])):
                    x[at] += np.add.reduceat(taken * part[:, None], starts, axis=0)
        names = np.array(list(known), np.int64)
        for t in range(trees):
            n = sums[0][: len(names), t]
            some = np.flatnonzero(n)
            if len(some):
                s = unit.joined(*[x[: len(names), t][some] for x in sums[1:]]) if unit else n[some].astype(float)
                code, place = (names[some], np.zeros(len(some), np.int32)) if unit else (names[some] // classes, (names[some] % classes).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), t, np.int32)), pa.array(code), pa.array(place), pa.array(n[some]), pa.array(s)],
                                                 names=["tree", "code", "place", "n", "s"])

    return coded.mapInArrow(task, "tree int, code long, place int, n long, s double")


def forest(laid: DataFrame, grid: Grid, classes: int | None, trees: int, depth: int, least: int, bootstrap: bool, seed: int,
           some: int | None, most: float | None, tasks: int) -> Trees:
    """Random forest: rows are drawn one by one for every tree and summed by cell, then each tree is grown by one task.

    ``laid``: rows whose order in their partitions follows from the rows alone, since a row's draws follow from its place.
    """
    unit = None if classes else Unit.of(most)
    coded = _coded(laid, grid, numbered=True).repartition(tasks, "code")
    drawn = _weights(coded, trees, seed, bootstrap, unit, classes or 1)
    held = laid.sparkSession.sparkContext.broadcast(grid)

    def one(group: pa.Table) -> pa.Table:
        own, tree = held.value, group["tree"][0].as_py()
        group = group.sort_by([("code", "ascending"), ("place", "ascending")])
        code, of = np.unique(group["code"].to_numpy(), return_inverse=True)
        s = np.zeros((len(code), classes or 1))
        s[of, group["place"].to_numpy()] = group["s"].to_numpy()
        n = np.bincount(of, group["n"].to_numpy(), len(code))
        found = grow(_slot_bins(own, code), _slot_cuts(own), n, s, depth, least, some, np.random.default_rng([seed & (2**63 - 1), tree]))
        if classes:
            found = pruned(found)
            value = found.s / found.n[:, None]
        else:
            value = found.s / found.n[:, None] / trees
        rows = np.arange(len(found.slot))
        return pa.table({"tree": pa.array(np.full(len(rows), tree, np.int32)), "node": pa.array(rows), "slot": pa.array(found.slot), "cut": pa.array(found.cut),
                         "low": pa.array(found.low), "high": pa.array(found.high), "value": pa.array(list(value), pa.list_(pa.float64()))})

    nodes = drawn.repartition(trees, "tree").groupBy("tree").applyInArrow(
        one, "tree int, node long, slot int, cut double, low long, high long, value array<double>"
    ).toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])  # the model itself
    tree, column = nodes["tree"].to_numpy(), {c: nodes[c].to_numpy() for c in ("slot", "cut", "low", "high")}
    value = matrix(nodes["value"].combine_chunks(), classes or 1)
    grown, values = [], []
    for t in range(trees):
        own = tree == t
        if own.any():
            grown.append(Grown(*[column[c][own] for c in ("slot", "cut", "low", "high")], None, None, None))
            values.append(value[own])
        else:  # no row was drawn for it: a leaf that adds nothing
            grown.append(Grown(np.zeros(1, np.int32), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64), None, None, None))
            values.append(np.zeros((1, classes or 1)))
    values = values if classes else [v[:, 0] for v in values]
    return _joined("shares" if classes else "number", grown, values, None if classes else [0] * trees, classes or 1, depth)


def largest(rows: DataFrame) -> float | None:
    """The largest size of a target; None if sums of such targets have no unit."""
    most = rows.agg(F.max(F.abs("actual"))).first()[0]
    return most if most is not None and (most == 0 or LEAST_TARGET < most < 1 / LEAST_TARGET) else None


def cell_grid(laid: DataFrame, rows: DataFrame, levels: tuple[int, ...], bins: int, seed: int, classes: int | None) -> Grid | None:
    """The bins of the inputs; None where cells or classes are too many to be held at once."""
    if (classes or 1) > MOST_CLASSES:
        return None
    cuts = split_points(laid, rows.count(), sum(n == 0 for n in levels), bins, seed)
    if cuts is None:
        return None
    grid = Grid(levels, (*cuts, *[np.array([])] * (len(levels) - len(cuts))))
    return grid if grid.size * (classes or 1) < CODES and _few(rows, grid, classes or 1) else None
