"""Model quality on a scored table.

Input columns: ``actual`` (a number, or a class index) and what a scorer adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leverscope.operators.joins import BROADCAST_ROWS
from leverscope.operators.order import order_buckets, running_before

CELLS_PER_TASK = 100_000


def _r_squared(error: Column, spread: Column) -> Column:
    """1 - error / spread; without spread 1 for a perfect fit, else 0."""
    flat = F.when(error == 0, 1.0).otherwise(0.0)
    return F.when(spread > 0, 1 - F.try_divide(error, spread)).otherwise(flat)


def both_splits(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows marked ``both`` count as train and as test."""
    sides = F.when(F.col(split) == "both", F.array(F.lit("train"), F.lit("test"))).otherwise(
        F.array(split)
    )
    return df.withColumn(split, F.explode(sides))


def regression_metrics(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """rows, r_squared, rmse, mae in one aggregate; rows without a target are left out."""
    error = F.col("prediction") - F.col("actual")
    sums = scored.where(F.col("actual").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(error * error).alias("error"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop("actual").alias("variance"),
    )
    rows = F.col("rows")
    return sums.select(
        *by,
        "rows",
        F.when(rows > 1, _r_squared(F.col("error"), F.col("variance") * rows)).alias("r_squared"),
        F.sqrt(F.try_divide("error", rows)).alias("rmse"),
        "mae",
    )


def accuracy(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    hit = (F.col("prediction") == F.col("actual")).cast("double")
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(hit).alias("accuracy")
    )


def roc_auc(
    scored: DataFrame, score: Column, rows_per_bucket: int = 500_000, least: int = 8
) -> DataFrame:
    """Exact, tie-aware area under the ROC curve; NULL when a class is absent.

    Equal scores are added up first. The distinct scores are then cut into value
    ranges whose running totals come from their sums, so no task sees them all.
    """
    pairs = scored.select(score.cast("double").alias("score"), F.col("actual"))
    cut = order_buckets(pairs, "score", "score_bucket", rows_per_bucket, least)
    scores = cut.groupBy("score_bucket", "score").agg(
        F.count_if(F.col("actual") == 1).alias("positives"),
        F.count_if(F.col("actual") == 0).alias("negatives"),
    )
    below = running_before(
        scores, "score_bucket", [F.col("score")], {"negatives_sum": F.col("negatives")}
    )
    won = F.col("positives") * (
        F.col("negatives_sum_before").cast("double") + F.col("negatives") / 2.0
    )
    sums = below.agg(
        F.sum(won).alias("won"),
        F.sum("positives").alias("positives"),
        F.sum("negatives").alias("negatives"),
    )
    pairs_total = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return sums.select("positives", "negatives", F.try_divide("won", pairs_total).alias("auc"))


def class_table(df: DataFrame, classes: list[str]) -> DataFrame:
    """(class_index, label), to be joined; a list of labels is no part of a plan."""
    table = df.sparkSession.createDataFrame(list(enumerate(classes)), "class_index int, label string")
    return F.broadcast(table) if len(classes) <= BROADCAST_ROWS else table


def confusion_cells(scored: DataFrame) -> DataFrame:
    """The cells that occur: (actual_index, predicted_index, rows)."""
    indices = {"actual_index": F.col("actual").cast("int"), "predicted_index": F.col("prediction").cast("int")}
    known = scored.select(*[v.alias(k) for k, v in indices.items()]).where("actual_index IS NOT NULL AND predicted_index IS NOT NULL")
    return known.groupBy("actual_index", "predicted_index").agg(F.count(F.lit(1)).alias("rows"))


def confusion_matrix(scored: DataFrame, classes: list[str]) -> DataFrame:
    """Long form (actual_index, predicted_index, labels, rows); empty cells kept, spread over tasks."""
    k = len(classes)
    counted = confusion_cells(scored).withColumnRenamed("rows", "found")
    cells = (
        scored.sparkSession.range(k * k, numPartitions=-(-k * k // CELLS_PER_TASK))
        .select(
            (F.col("id") / k).cast("int").alias("actual_index"),
            (F.col("id") % k).cast("int").alias("predicted_index"),
        )
    )
    labels = class_table(scored, classes)
    actual = labels.select(F.col("class_index").alias("actual_index"), F.col("label").alias("actual_label"))
    predicted = labels.select(F.col("class_index").alias("predicted_index"), F.col("label").alias("predicted_label"))
    return (
        cells.join(counted, ["actual_index", "predicted_index"], "left")
        .join(actual, "actual_index")
        .join(predicted, "predicted_index")
        .select(
            "actual_index",
            "predicted_index",
            "actual_label",
            "predicted_label",
            F.coalesce("found", F.lit(0)).alias("rows"),
        )
    )


def confusion_rows(matrix: DataFrame) -> DataFrame:
    """Export form: one row per actual class, counts as an array in class order."""
    cell = F.struct("predicted_index", "rows")
    return matrix.groupBy("actual_index", "actual_label").agg(
        F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["rows"]).alias("counts")
    )


def class_counts(matrix: DataFrame) -> DataFrame:
    """Per class: support, predicted and hit counts, from the k * k matrix."""
    each = _each_side(matrix, F.col("actual_label"), F.col("predicted_label"))
    return each.groupBy("class_index", "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])


def class_totals(cells: DataFrame, classes: list[str]) -> DataFrame:
    """``class_counts`` from the cells that occur: work follows them, not the square of the classes."""
    zero = F.lit(0).cast("long")
    named = class_table(cells, classes).select("class_index", "label", *[zero.alias(c) for c in ("support", "predicted", "hits")])
    unnamed = F.lit(None).cast("string")
    each = _each_side(cells, unnamed, unnamed).unionByName(named)
    return each.groupBy("class_index").agg(F.max("label").alias("label"), *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])


def _each_side(cells: DataFrame, actual_label: Column, predicted_label: Column) -> DataFrame:
    """Each cell as a row of its actual and one of its predicted class."""
    hit = F.col("actual_index") == F.col("predicted_index")
    zero = F.lit(0).cast("long")
    as_actual = F.struct(
        F.col("actual_index").alias("class_index"),
        actual_label.alias("label"),
        F.col("rows").alias("support"),
        zero.alias("predicted"),
        F.when(hit, F.col("rows")).otherwise(zero).alias("hits"),
    )
    as_predicted = F.struct(
        F.col("predicted_index").alias("class_index"),
        predicted_label.alias("label"),
        zero.alias("support"),
        F.col("rows").alias("predicted"),
        zero.alias("hits"),
    )
    return cells.select(F.inline(F.array(as_actual, as_predicted)))


def _or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def class_metrics(counts: DataFrame) -> DataFrame:
    """Support, its share, precision and recall per class, in percent (unrounded)."""
    total = F.greatest(F.sum("support").over(Window.partitionBy()), F.lit(1))
    return counts.select(
        "class_index",
        "label",
        "support",
        (_or_zero(F.col("support"), total) * 100).alias("support_pct"),
        (_or_zero(F.col("hits"), F.col("predicted")) * 100).alias("precision_pct"),
        (_or_zero(F.col("hits"), F.col("support")) * 100).alias("recall_pct"),
    )


def f1_scores(counts: DataFrame) -> DataFrame:
    """of class index 1 when two classes are present, else the mean over the classes seen.

    Two present classes make it a two-class score, which has no value (NULL) when a third class
    is predicted or class 1 is not among them.
    """
    f1 = _or_zero(2 * F.col("hits"), F.col("support") + F.col("predicted"))
    seen = (F.col("support") > 0) | (F.col("predicted") > 0)
    two_class = (F.col("classes_seen") == 2) & F.col("one_seen")
    return counts.agg(
        F.max(F.when(F.col("class_index") == 1, f1)).alias("f1_positive"),
        F.avg(F.when(seen, f1)).alias("f1_macro"),
        F.count_if(F.col("support") > 0).alias("classes_present"),
        F.count_if(seen).alias("classes_seen"),
        F.bool_or(seen & (F.col("class_index") == 1)).alias("one_seen"),
    ).select(
        F.when(F.col("classes_present") != 2, F.col("f1_macro")).when(two_class, F.col("f1_positive")).alias("f1"),
        "f1_positive",
        "f1_macro",
    )
