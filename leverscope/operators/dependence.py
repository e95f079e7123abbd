"""Partial dependence: the average response when one input is set to each grid value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leverscope.errors import AnalysisError
from leverscope.operators.ensemble import TreeScorer, point_means
from leverscope.operators.evaluate import class_table
from leverscope.operators.order import exact_quantiles
from leverscope.operators.prepare import MOST_LEVELS, Features
from leverscope.functions.scalars import quoted
from leverscope.operators.scorers import Scorer, response

# Grid points on a small and on an ordinary table, where small ends,
# and the quantiles between which an equally spaced grid is laid.
SMALL_ROWS = 80
SMALL_GRID = 16
GRID = 24
GRID_ENDS = (0.05, 0.95)
# Slope taken as flat, and the step in x too small to divide by.
FLAT_SLOPE = 1e-6
LEAST_STEP = 1e-9

GRID_SCHEMA = "feature string, grid_id int, x double, x_label string"


@dataclass(frozen=True)
class GridPoint:
    feature: str
    grid_id: int
    x: float
    x_label: str | None


def _few_values(df: DataFrame, columns: list[str], mark: int) -> dict[str, list]:
    """The sorted distinct values of the columns whose distinct sketch is under ``mark``."""
    if not columns:
        return {}
    sketches = df.agg(
        *[F.approx_count_distinct(quoted(c)).alias(f"a{i}") for i, c in enumerate(columns)]
    ).first()
    low = [c for c, n in zip(columns, sketches) if n <= mark]
    if not low:
        return {}
    sets = df.agg(
        *[F.array_sort(F.collect_set(quoted(c))).alias(f"a{i}") for i, c in enumerate(low)]
    ).first()
    return dict(zip(low, sets))


def build_grid(
    df: DataFrame, features: Features, wanted: list[str] | None = None, resolution: int | None = None
) -> list[GridPoint]:
    """Grid points per feature.

    Numeric: the distinct values when fewer than the resolution, else equally spaced
    between two exact quantiles. Categorical: every level, sorted; missing values
    are no level. At most ``resolution`` or ``MOST_LEVELS`` points per feature.
    """
    wanted = list(features.names) if wanted is None else wanted
    for c in wanted:
        if c not in features.names:
            raise AnalysisError("unknownFeature", f"'{c}' is not an input of the model.")
    if resolution is None:
        resolution = SMALL_GRID if df.limit(SMALL_ROWS).count() < SMALL_ROWS else GRID
    # The sketch never reads more than 53 for 50 values (see ``prepare``).
    values = _few_values(df, wanted, 2 * MOST_LEVELS)
    spread = [
        c
        for c in wanted
        if c in features.numeric and (c not in values or len(values[c]) >= resolution)
    ]
    ends = exact_quantiles(df, spread, list(GRID_ENDS))
    points = []
    for c in wanted:
        if c in spread:
            low, high = ends[c]
            step = (high - low) / (resolution - 1)
            points += [GridPoint(c, i, low + step * i, None) for i in range(resolution)]
        elif c in features.numeric:
            points += [GridPoint(c, i, float(v), None) for i, v in enumerate(values[c])]
        else:
            if len(values.get(c) or [None] * (MOST_LEVELS + 1)) > MOST_LEVELS:
                raise AnalysisError("unboundedLevels", f"'{c}' has more than {MOST_LEVELS} levels.")
            points += [GridPoint(c, i, float(i), str(v)) for i, v in enumerate(values[c])]
        if not any(p.feature == c for p in points):
            raise AnalysisError("dependenceFailed", f"'{c}' has no value to draw a curve over.")
    return points


def _spread(df: DataFrame, features: Features, grid: list[GridPoint]) -> DataFrame:
    """Rows expanded in place over the point numbers (no join), one input replaced.

    The points of a feature are numbered in a run, so a variant is one array lookup.
    """
    point = F.col("point")
    replaced = {}
    for c in features.names:
        places = [i for i, p in enumerate(grid) if p.feature == c]
        if places:
            values = [grid[i].x if c in features.numeric else grid[i].x_label for i in places]
            first, last = places[0], places[-1]
            assert last - first + 1 == len(places), "the points of a feature stand together"
            looked_up = F.get(F.array(*[F.lit(v) for v in values]), point - first)
            replaced[c] = F.when(point.between(first, last), looked_up).otherwise(quoted(c))
    spread = df.select(
        *[quoted(c) for c in features.names],
        F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("point"),
    )
    return spread.select("point", *[replaced.get(c, quoted(c)).alias(c) for c in features.names])


def _described(means: DataFrame, grid: list[GridPoint], columns: list[str]) -> DataFrame:
    """Point numbers replaced by what they stand for; one row per grid point (and class) from here on."""
    points = F.array(
        *[
            F.struct(
                F.lit(p.feature).alias("feature"),
                F.lit(p.grid_id).alias("grid_id"),
                F.lit(p.x).alias("x"),
                F.lit(p.x_label).cast("string").alias("x_label"),
            )
            for p in grid
        ]
    )
    return means.select(F.get(points, F.col("point")).alias("p"), *columns).select("p.*", *columns)


def _tree_means(df: DataFrame, features: Features, scorer: TreeScorer, grid: list[GridPoint]) -> DataFrame:
    """(point, means): mean answer, or one per class, by re-evaluating the trees of the input alone."""
    names = features.names
    asked = []
    for p in grid:
        place = names.index(p.feature)
        asked.append((place, p.x if p.feature in features.numeric else scorer.index(place, p.x_label)))
    ready = scorer.prepared(df.select(*[quoted(c) for c in names]), "inputs")
    sums = point_means(ready, scorer.trees, asked)
    each = sums.select("point", "rows", F.posexplode("total").alias("class_index", "total"))
    means = each.groupBy("point", "class_index").agg((F.sum("total") / F.sum("rows")).alias("y"))
    return means.groupBy("point").agg(F.transform(F.array_sort(F.collect_list(F.struct("class_index", "y"))), lambda m: m["y"]).alias("means"))


def partial_dependence(
    df: DataFrame,
    features: Features,
    scorer: Scorer,
    grid: list[GridPoint],
    answer: Column | None = None,
    class_index: int | None = None,
) -> DataFrame:
    """(feature, grid_id, x, x_label, y) for all features of the grid in one job.

    Rows are expanded in place, scored once, and reduced to one row per point and task before the
    shuffle. An ensemble of trees re-evaluates only the trees that split on the input set. For classes
    the curve is that of ``class_index`` (the last by default), unless an ``answer`` is given.
    """
    trees = getattr(scorer, "trees", None)
    if answer is None and trees is not None:
        place = 0 if scorer.classes is None else (len(scorer.classes) - 1 if class_index is None else class_index)
        means = _tree_means(df, features, trees, grid).select("point", F.get("means", F.lit(place)).alias("y"))
        return _described(means, grid, ["y"])
    answer = response(scorer, class_index) if answer is None else answer
    means = scorer.score(_spread(df, features, grid)).groupBy("point").agg(F.avg(answer).alias("y"))
    return _described(means, grid, ["y"])


def class_curves(df: DataFrame, features: Features, scorer: Scorer, grid: list[GridPoint]) -> DataFrame:
    """(feature, grid_id, x, x_label, class_index, label, y): the curves of every class from one scoring."""
    trees = getattr(scorer, "trees", None)
    if trees is not None:
        means = _tree_means(df, features, trees, grid)
    else:
        scored = scorer.score(_spread(df, features, grid)).select("point", array_to_vector("probability").alias("chances"))
        means = scored.groupBy("point").agg(vector_to_array(Summarizer.mean(F.col("chances"))).alias("means"))
    each = means.select("point", F.posexplode("means").alias("class_index", "y")).join(class_table(df, scorer.classes), "class_index")
    return _described(each, grid, ["class_index", "label", "y"])


def dependence_points(
    scored: DataFrame,
    feature: str,
    features: Features,
    answer: Column,
    levels: list[str] | None = None,
    color_by: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Observed (x, y, x_label, color) per row; rows without the input are left out.

    ``levels`` are the curve's labels in order; a label not among them sits at 0.
    """
    value = quoted(feature)
    if feature in features.numeric:
        x, label = value.cast("double"), F.lit(None).cast("string")
    else:
        places = F.create_map(
            *[F.lit(v) for i, level in enumerate(levels or [""]) for v in (level, float(i))]
        )
        x, label = F.coalesce(F.element_at(places, value), F.lit(0.0)), value
    color = F.lit(None).cast("string")
    if color_by in features.names:
        color = quoted(color_by).cast("string")
    return scored.where(value.isNotNull()).select(
        *keep,
        F.lit(feature).alias("feature"),
        x.alias("x"),
        label.alias("x_label"),
        answer.alias("y"),
        color.alias("color"),
    )


def describe_curves(curves: DataFrame) -> DataFrame:
    """(feature, slope, direction, steepest_from, steepest_to) per curve.

    The slope joins the curve's two ends. The steepest interval is the first with
    the largest slope, the whole range when no interval has a width. Both are NULL
    under two points. One pass, so a curve is computed once.
    """
    along = Window.partitionBy("feature").orderBy("grid_id")
    width = F.col("x") - F.col("x_before")
    steps = curves.select(
        "feature",
        "grid_id",
        "x",
        "y",
        F.lag("x").over(along).alias("x_before"),
        (F.col("y") - F.lag("y").over(along)).alias("rise"),
    ).withColumn(
        "steepness",
        F.when(F.abs(width) >= LEAST_STEP, F.abs(F.try_divide(F.col("rise"), width))),
    )
    order = F.when(
        F.col("steepness").isNotNull(), F.struct(F.col("steepness"), -F.col("grid_id"))
    )
    found = steps.groupBy("feature").agg(
        F.count(F.lit(1)).alias("points"),
        F.max_by(F.struct("x_before", "x"), order).alias("interval"),
        *[
            f(F.col(c), F.col("grid_id")).alias(f"{c}_{name}")
            for c in ("x", "y")
            for f, name in ((F.min_by, "first"), (F.max_by, "last"))
        ],
    )
    enough = F.col("points") >= 2
    slope = F.try_divide(
        F.col("y_last") - F.col("y_first"), F.col("x_last") - F.col("x_first") + F.lit(1e-9)
    )
    return found.select(
        "feature",
        F.when(enough, slope).alias("slope"),
        F.when(enough, F.coalesce("interval.x_before", "x_first")).alias("steepest_from"),
        F.when(enough, F.coalesce("interval.x", "x_last")).alias("steepest_to"),
    ).withColumn(
        "direction",
        F.when(F.col("slope") > FLAT_SLOPE, "up")
        .when(F.col("slope") < -FLAT_SLOPE, "down")
        .when(F.col("slope").isNotNull(), "flat"),
    )


def curve_direction(curves: DataFrame) -> DataFrame:
    return describe_curves(curves).select("feature", "slope", "direction")


def steepest_range(curves: DataFrame) -> DataFrame:
    return describe_curves(curves).select("feature", "steepest_from", "steepest_to")
