"""Metrics on scored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leverscope.operators import evaluate, prepare, scorers
from leverscope.suite.frames import (
    GRADES,
    SCORED_GRADES_SQL,
    SCORED_LINES_SQL,
    SCORED_VERDICTS_SQL,
    VERDICTS,
    grade_scorer,
    line_scorer,
    lines,
    orders,
    rounded,
    verdict_scorer,
)
from leverscope.suite.prepare_queries import SPLIT_ORDER


def _round_all(df, digits=6):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def scored_lines(spark, sf_dir):
    return line_scorer().score(lines(spark, sf_dir))


def scored_verdicts(spark, sf_dir):
    return verdict_scorer().score(orders(spark, sf_dir, "verdict"))


def scored_grades(spark, sf_dir):
    return grade_scorer().score(orders(spark, sf_dir, "grade"))


def regression_metrics(spark, sf_dir):
    return _round_all(evaluate.regression_metrics(scored_lines(spark, sf_dir)))


def _regression_sql(source: str, by: str = "") -> str:
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return (
        f"SELECT {head}count(*) AS rows,"
        f" {rounded('1 - sum((prediction - actual) * (prediction - actual)) / (count(*) * var_pop(actual))')} AS r_squared,"
        f" {rounded('sqrt(avg((prediction - actual) * (prediction - actual)))')} AS rmse,"
        f" {rounded('avg(abs(prediction - actual))')} AS mae FROM ({source}){tail}"
    )


def metrics_by_split(spark, sf_dir):
    split = prepare.holdout_split(scored_lines(spark, sf_dir), "row_key")
    return _round_all(evaluate.regression_metrics(evaluate.both_splits(split), ("split",)))


SPLIT_LINES_SQL = f"""
SELECT *, CASE WHEN row_number() OVER (ORDER BY {SPLIT_ORDER}) <= ceil(0.25 * count(*) OVER ())
       THEN 'test' ELSE 'train' END AS split FROM ({SCORED_LINES_SQL})"""


def accuracy(spark, sf_dir):
    parts = [
        evaluate.accuracy(df).withColumn("model", F.lit(name))
        for name, df in (
            ("verdict", scored_verdicts(spark, sf_dir)),
            ("grade", scored_grades(spark, sf_dir)),
        )
    ]
    return _round_all(parts[0].unionByName(parts[1]))


ACCURACY_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS model, count(*) AS rows,"
    f" {rounded('avg(CASE WHEN prediction = actual THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM ({source})"
    for name, source in (("verdict", SCORED_VERDICTS_SQL), ("grade", SCORED_GRADES_SQL))
)


def roc_auc(spark, sf_dir):
    """Continuous scores, and the same scores rounded so that many are tied."""
    scored = scored_verdicts(spark, sf_dir)
    chance = F.element_at("probability", 2)
    parts = [
        evaluate.roc_auc(scored, score).withColumn("scores", F.lit(name))
        for name, score in (("continuous", F.round(chance, 12)), ("tied", F.round(chance, 1)))
    ]
    return _round_all(parts[0].unionByName(parts[1]))


def _auc_sql(name: str, digits: int) -> str:
    return f"""
SELECT '{name}' AS scores, positives, negatives,
       {rounded("(rank_sum - positives * (positives + 1) / 2.0) / (cast(positives AS double) * negatives)")} AS auc
FROM (SELECT sum(CASE WHEN actual = 1 THEN mean_rank ELSE 0 END) AS rank_sum,
             count(CASE WHEN actual = 1 THEN 1 END) AS positives,
             count(CASE WHEN actual = 0 THEN 1 END) AS negatives
      FROM (SELECT actual, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS mean_rank
            FROM (SELECT actual, {rounded('p1', digits)} AS s FROM ({SCORED_VERDICTS_SQL}))))"""


AUC_SQL = _auc_sql("continuous", 12) + " UNION ALL " + _auc_sql("tied", 1)


def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(scored_grades(spark, sf_dir), GRADES)


def _labels_sql(classes: list[str]) -> str:
    return ", ".join(f"({i}, '{c}')" for i, c in enumerate(classes))


def _matrix_sql(source: str, classes: list[str]) -> str:
    return f"""
SELECT cast(a.i AS int) AS actual_index, cast(p.i AS int) AS predicted_index, a.c AS actual_label,
       p.c AS predicted_label, count(s.actual) AS rows
FROM (VALUES {_labels_sql(classes)}) a(i, c) CROSS JOIN (VALUES {_labels_sql(classes)}) p(i, c)
LEFT JOIN ({source}) s ON s.actual = a.i AND s.prediction = p.i GROUP BY a.i, a.c, p.i, p.c"""


def class_metrics(spark, sf_dir):
    counts = evaluate.class_counts(evaluate.confusion_matrix(scored_grades(spark, sf_dir), GRADES))
    return _round_all(evaluate.class_metrics(counts))


def class_metrics_sql(source: str, classes: list[str]) -> str:
    return f"""
SELECT cast(l.i AS int) AS class_index, l.c AS label, support,
       {rounded("coalesce(100.0 * support / nullif(total, 0), 0.0)")} AS support_pct,
       {rounded("coalesce(100.0 * hits / nullif(predicted, 0), 0.0)")} AS precision_pct,
       {rounded("coalesce(100.0 * hits / nullif(support, 0), 0.0)")} AS recall_pct
FROM (SELECT l.i, l.c, count(CASE WHEN actual = l.i THEN 1 END) AS support,
             count(CASE WHEN prediction = l.i THEN 1 END) AS predicted,
             count(CASE WHEN actual = l.i AND prediction = l.i THEN 1 END) AS hits, count(*) AS total
      FROM (VALUES {_labels_sql(classes)}) l(i, c) CROSS JOIN ({source}) GROUP BY l.i, l.c) l"""


def f1_scores(spark, sf_dir):
    parts = []
    for name, df, classes in (
        ("verdict", scored_verdicts(spark, sf_dir), VERDICTS),
        ("grade", scored_grades(spark, sf_dir), GRADES),
    ):
        counts = evaluate.class_counts(evaluate.confusion_matrix(df, classes))
        parts.append(evaluate.f1_scores(counts).select(F.lit(name).alias("model"), "f1"))
    return _round_all(parts[0].unionByName(parts[1]))


def _f1_sql(name: str, source: str, classes: list[str], wanted: str) -> str:
    return f"""
SELECT '{name}' AS model, {rounded(wanted)} AS f1
FROM (SELECT l.i, 2.0 * count(CASE WHEN actual = l.i AND prediction = l.i THEN 1 END)
             / (count(CASE WHEN actual = l.i THEN 1 END) + count(CASE WHEN prediction = l.i THEN 1 END)) AS f
      FROM (VALUES {_labels_sql(classes)}) l(i, c) CROSS JOIN ({source}) GROUP BY l.i)"""


F1_SQL = (
    _f1_sql("verdict", SCORED_VERDICTS_SQL, VERDICTS, "max(CASE WHEN i = 1 THEN f END)")
    + " UNION ALL "
    + _f1_sql("grade", SCORED_GRADES_SQL, GRADES, "avg(f)")
)


def batch_score(spark, sf_dir):
    """Class chances by expression: the default (last) class, and a clamped index."""
    frame = orders(spark, sf_dir, "grade")
    last = scorers.batch_score(frame, grade_scorer(), name="last_class")
    return last.select(
        "row_key",
        F.round("last_class", 6).alias("last_class"),
        F.round(scorers.response(grade_scorer(), -3), 6).alias("first_class"),
        F.round(scorers.response(grade_scorer(), 99), 6).alias("clamped"),
        "prediction",
    )


BATCH_SQL = f"""
SELECT row_key, {rounded('p2')} AS last_class, {rounded('p0')} AS first_class,
       {rounded('p2')} AS clamped, prediction FROM ({SCORED_GRADES_SQL})"""

ENTRIES = {
    "regression_metrics": (regression_metrics, _regression_sql(SCORED_LINES_SQL)),
    "metrics_by_split": (metrics_by_split, _regression_sql(SPLIT_LINES_SQL, "split")),
    "accuracy": (accuracy, ACCURACY_SQL),
    "roc_auc": (roc_auc, AUC_SQL),
    "confusion_matrix": (confusion_matrix, _matrix_sql(SCORED_GRADES_SQL, GRADES)),
    "class_metrics": (class_metrics, class_metrics_sql(SCORED_GRADES_SQL, GRADES)),
    "f1_scores": (f1_scores, F1_SQL),
    "batch_score": (batch_score, BATCH_SQL),
}
