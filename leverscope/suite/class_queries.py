"""Classes by the thousand: every order date is a class of its own.

The forest has one tree of one cut, whose answer SQL can state (see ``stump_queries``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leverscope.operators import evaluate, prepare
from leverscope.operators.evaluate import class_table
from leverscope.plans.train import fit_model
from leverscope.suite.frames import derive, rounded, select_sql, wide_table
from leverscope.suite.prepare_queries import SPLIT_ORDER
from leverscope.suite.stump_queries import ONE_CUT

DAYS = {"row_key": "o_orderkey", "month": "cast(month(o_orderdate) AS double)", "shift": "o_custkey % 3", "day": "cast(cast(o_orderdate AS date) AS string)"}
DAYS_SQL = select_sql("orders", DAYS)


def _days(spark, sf_dir):
    return derive(wide_table(spark, sf_dir, "orders"), DAYS)


def _labelled(df, classes, index, name):
    labels = class_table(df, classes).select(F.col("class_index").alias(f"{name}_index"), F.col("label").alias(name))
    return df.withColumn(f"{name}_index", F.col(index).cast("int")).join(labels, f"{name}_index")


def fit_rf_many_classes(spark, sf_dir):
    model = fit_model(_days(spark, sf_dir).select("row_key", "month", "day"), "day", "rf", "multiclass", settings=ONE_CUT, with_metrics=False)
    scored = model.scored().withColumn("chance", F.round(F.array_max("probability"), 8)).drop("probability")
    named = _labelled(_labelled(scored.withColumnRenamed("actual", "truth"), model.spec.classes, "truth", "actual"), model.spec.classes, "prediction", "predicted")
    return named.select("row_key", "split", "actual", "predicted", "chance")


# Where a class has a single row the split is not stratified.
FIT_SQL = f"""
WITH rows AS ({DAYS_SQL}),
classes AS (SELECT t, n, row_number() OVER (ORDER BY t) - 1 AS c, min(n) OVER () AS least, n * ceil(0.25 * sum(n) OVER ()) / sum(n) OVER () AS exact,
              ceil(0.25 * sum(n) OVER ()) AS wanted FROM (SELECT day AS t, count(*) AS n FROM rows GROUP BY 1)),
shares AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY floor(exact) - exact, c) <= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS test_rows FROM classes),
x AS (SELECT row_key, month AS m, day, c, CASE WHEN CASE WHEN least < 2 THEN row_number() OVER (ORDER BY {SPLIT_ORDER}) <= wanted
        ELSE row_number() OVER (PARTITION BY day ORDER BY {SPLIT_ORDER}) <= test_rows END THEN 'test' ELSE 'train' END AS split FROM rows JOIN shares ON t = day),
cells AS (SELECT m, c, count(*) AS n FROM x WHERE split = 'train' GROUP BY ALL),
months AS (SELECT DISTINCT m AS cut FROM cells),
sides AS (SELECT cut, m <= cut AS low, c, sum(n) AS n FROM cells, months GROUP BY ALL),
best AS (SELECT cut FROM (SELECT cut, low, sum(n * n) / sum(n) AS g FROM sides GROUP BY ALL) GROUP BY cut HAVING count(*) = 2 ORDER BY sum(g) DESC, cut LIMIT 1),
leaf AS (SELECT low, arg_max(c, n * 1000000 - c) AS c, max(n) / sum(n) AS chance FROM sides JOIN best USING (cut) GROUP BY low)
SELECT row_key, split, day AS actual, t AS predicted, {rounded('chance', 8)} AS chance
FROM x JOIN leaf ON low = (m <= (SELECT cut FROM best)) JOIN classes ON classes.c = leaf.c"""


def _guessed(spark, sf_dir):
    """Orders with their day's index and a guess: the day itself, or up to two days on."""
    df = _days(spark, sf_dir)
    classes = prepare.class_labels(df, "day")
    encoded = prepare.encode_labels(df, "day", classes, "actual")
    return encoded.withColumn("prediction", F.when(F.col("month") <= 6, F.col("actual")).otherwise((F.col("actual") + F.col("shift")) % len(classes))), classes


GUESSED_SQL = f"""
k AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS c, count(*) OVER () AS k FROM (SELECT DISTINCT day AS t FROM ({DAYS_SQL}))),
g AS (SELECT c AS actual, CASE WHEN month <= 6 THEN c ELSE (c + shift) % k END AS prediction FROM ({DAYS_SQL}) JOIN k ON t = day)"""


def confusion_many(spark, sf_dir):
    scored, classes = _guessed(spark, sf_dir)
    cells = evaluate.confusion_cells(scored)
    return _labelled(_labelled(cells, classes, "actual_index", "actual_label"), classes, "predicted_index", "predicted_label").select(
        "actual_index", "predicted_index", "actual_label", "predicted_label", "rows")


CONFUSION_SQL = f"""
WITH {GUESSED_SQL}
SELECT cast(actual AS int) AS actual_index, cast(prediction AS int) AS predicted_index, a.t AS actual_label, p.t AS predicted_label, count(*) AS rows
FROM g JOIN k a ON a.c = actual JOIN k p ON p.c = prediction GROUP BY ALL"""


def class_metrics_many(spark, sf_dir):
    scored, classes = _guessed(spark, sf_dir)
    found = evaluate.class_metrics(evaluate.class_totals(evaluate.confusion_cells(scored), classes))
    return found.select("class_index", "label", "support", *[F.round(c, 6).alias(c) for c in ("precision_pct", "recall_pct")])


METRICS_SQL = f"""
WITH {GUESSED_SQL},
a AS (SELECT actual AS c, count(*) AS support, count(*) FILTER (actual = prediction) AS hits FROM g GROUP BY 1),
p AS (SELECT prediction AS c, count(*) AS predicted FROM g GROUP BY 1)
SELECT cast(k.c AS int) AS class_index, t AS label, coalesce(support, 0) AS support,
  {rounded("coalesce(100.0 * hits / predicted, 0.0)")} AS precision_pct, {rounded("coalesce(100.0 * hits / support, 0.0)")} AS recall_pct
FROM k LEFT JOIN a USING (c) LEFT JOIN p USING (c)"""


ENTRIES = {
    "fit_rf_many_classes": (fit_rf_many_classes, FIT_SQL),
    "confusion_many": (confusion_many, CONFUSION_SQL),
    "class_metrics_many": (class_metrics_many, METRICS_SQL),
}
