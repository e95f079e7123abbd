import random

import pytest
from pyspark.sql import functions as F

from leverscope.operators import evaluate


def scored(spark, rows):
    return spark.createDataFrame(rows, "actual double, prediction double")


def test_regression_metrics(spark):
    row = evaluate.regression_metrics(scored(spark, [(1.0, 2.0), (3.0, 3.0), (5.0, 4.0), (None, 9.0)])).first()
    assert (row["rows"], row["r_squared"], row["mae"]) == (3, 0.75, pytest.approx(2 / 3))
    assert row["rmse"] == pytest.approx((2 / 3) ** 0.5)


@pytest.mark.parametrize(
    "rows, expected", [([(2.0, 2.0), (2.0, 2.0)], 1.0), ([(2.0, 2.0), (2.0, 3.0)], 0.0), ([(1.0, 1.0)], None)]
)
def test_r_squared_without_spread(spark, rows, expected):
    assert evaluate.regression_metrics(scored(spark, rows)).first()["r_squared"] == expected


@pytest.mark.parametrize("digits", [1, 6])
def test_auc_equals_brute_force(spark, digits):
    rng = random.Random(digits)
    rows = [(float(rng.random() < 0.3), round(rng.random(), digits)) for _ in range(400)]
    positives = [s for y, s in rows if y == 1]
    negatives = [s for y, s in rows if y == 0]
    won = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives)
    df = scored(spark, rows).repartition(4)
    found = evaluate.roc_auc(df, F.col("prediction"), rows_per_bucket=30).first()["auc"]
    assert found == pytest.approx(won / (len(positives) * len(negatives)), abs=1e-12)


def test_auc_needs_both_classes(spark):
    assert evaluate.roc_auc(scored(spark, [(1.0, 0.2), (1.0, 0.4)]), F.col("prediction")).first()["auc"] is None


def test_confusion_keeps_empty_cells(spark):
    df = scored(spark, [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0)])
    matrix = evaluate.confusion_matrix(df, ["A", "B", "C"])
    table = {r["actual_label"]: r["counts"] for r in evaluate.confusion_rows(matrix).collect()}
    assert table == {"A": [1, 1, 0], "B": [0, 2, 0], "C": [0, 0, 0]}
    counts = evaluate.class_counts(matrix)
    rows = {r["label"]: r for r in evaluate.class_metrics(counts).collect()}
    assert (rows["B"]["precision_pct"], rows["B"]["recall_pct"]) == (pytest.approx(200 / 3), 100.0)
    assert (rows["C"]["support"], rows["C"]["precision_pct"], rows["C"]["recall_pct"]) == (0, 0.0, 0.0)
    f1 = evaluate.f1_scores(counts).first()
    # Two classes are present, so the score is that of class 1.
    assert f1["f1"] == f1["f1_positive"] == pytest.approx(0.8)
    assert f1["f1_macro"] == pytest.approx((2 / 3 + 0.8) / 2)


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(0.0, 0.0), (2.0, 2.0), (2.0, 0.0)], None),  # two of three classes, not class 1
        ([(0.0, 0.0), (1.0, 1.0), (1.0, 2.0)], None),  # a third class is predicted
        ([(0.0, 0.0), (1.0, 1.0), (1.0, 0.0)], 2 / 3),
        ([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], 1.0),
    ],
)
def test_two_present_classes_are_a_two_class_score(spark, rows, expected):
    counts = evaluate.class_counts(evaluate.confusion_matrix(scored(spark, rows), ["A", "B", "C"]))
    assert evaluate.f1_scores(counts).first()["f1"] == (None if expected is None else pytest.approx(expected))


def test_rows_in_both_splits_count_twice(spark):
    df = scored(spark, [(1.0, 1.0), (2.0, 1.0)]).withColumn("split", F.lit("both"))
    found = {r["split"]: r["accuracy"] for r in evaluate.accuracy(evaluate.both_splits(df), ("split",)).collect()}
    assert found == {"train": 0.5, "test": 0.5}
