"""Learners held against a closed answer: one tree with one cut has its best cut and leaf values in SQL.

The input has fewer values than the learners have bins, so every cut is tried. The first tree of
boosting has weight 1; a two-class chance is 1 / (1 + exp(-2 * leaf)) for leaves of labels -1 and 1,
and the chances of one-vs-rest are scaled to one. The soft-max row runs two rounds with the usual step.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leverscope.operators.learners import LearnerSettings
from leverscope.plans.train import fit_model
from leverscope.suite.frames import GRADES, ORDERS_SQL, VERDICTS, orders, rounded
from leverscope.suite.prepare_queries import SPLIT_ORDER

ONE_CUT = LearnerSettings(trees=1, boosting_depth=1, forest_depth=1, bootstrap=False, joint_classes=False)
TWO_ROUNDS = LearnerSettings(trees=2, boosting_depth=1)
TARGETS = {"outcome": None, "verdict": VERDICTS, "grade": GRADES}


def _fit(spark, sf_dir, target, algorithm, settings=ONE_CUT):
    df = orders(spark, sf_dir).select("row_key", "month", target)
    task = "multiclass" if target == "grade" else "auto"
    model = fit_model(df, target, algorithm, task, settings=settings, with_metrics=False)
    answers = [F.round("prediction", 6).alias("prediction")] if TARGETS[target] is None else [
        F.round(F.element_at("probability", i + 1), 8).alias(f"chance_{c}") for i, c in enumerate(TARGETS[target])
    ]
    return model.scored().select("row_key", "split", "actual", *answers)


def _query(target, algorithm):
    return lambda spark, sf_dir: _fit(spark, sf_dir, target, algorithm)


def _rows_sql(target: str) -> str:
    """row_key, split, m (month, gaps filled with the training median) and y (number or class index)."""
    classes = TARGETS[target]
    if classes is None:
        base = f"""SELECT row_key, month, {target} AS y, CASE WHEN row_number() OVER (ORDER BY {SPLIT_ORDER})
            <= ceil(0.25 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM ({ORDERS_SQL}) WHERE {target} IS NOT NULL"""
    else:
        index = "CASE t " + " ".join(f"WHEN '{c}' THEN {i}.0" for i, c in enumerate(classes)) + " END"
        base = f"""SELECT row_key, month, cast({index} AS double) AS y, CASE WHEN row_number() OVER (PARTITION BY t ORDER BY {SPLIT_ORDER})
              <= test_rows THEN 'test' ELSE 'train' END AS split
            FROM (SELECT row_key, month, {target} AS t FROM ({ORDERS_SQL})) JOIN (
              SELECT t, floor(exact) + CASE WHEN row_number() OVER (ORDER BY floor(exact) - exact, t) <= wanted - sum(floor(exact)) OVER ()
                THEN 1 ELSE 0 END AS test_rows
              FROM (SELECT t, n * ceil(0.25 * sum(n) OVER ()) / sum(n) OVER () AS exact, ceil(0.25 * sum(n) OVER ()) AS wanted
                FROM (SELECT {target} AS t, count(*) AS n FROM ({ORDERS_SQL}) GROUP BY 1))) USING (t)"""
    return f"""base AS ({base}), x AS (SELECT row_key, split, y, coalesce(month, (SELECT median(month) FROM base WHERE split = 'train')) AS m FROM base)"""


def _cut_sql(name: str, signals: list[str]) -> str:
    """(cut, l0, r0, ...): the cut of least squared error over all signals, means of each side."""
    sums = ", ".join(f"sum({s}) AS s{i}" for i, s in enumerate(signals))
    upto = ", ".join(f"sum(s{i}) OVER w AS l{i}, sum(s{i}) OVER () - sum(s{i}) OVER w AS r{i}" for i in range(len(signals)))
    gain = " + ".join(f"l{i} * l{i} / nl + r{i} * r{i} / nr" for i in range(len(signals)))
    means = ", ".join(f"l{i} / nl AS l{i}, r{i} / nr AS r{i}" for i in range(len(signals)))
    return f"""{name} AS (SELECT m AS cut, {means} FROM (
        SELECT m, sum(n) OVER w AS nl, sum(n) OVER () - sum(n) OVER w AS nr, {upto}
        FROM (SELECT m, count(*) AS n, {sums} FROM x WHERE split = 'train' GROUP BY m) WINDOW w AS (ORDER BY m))
      WHERE nr > 0 ORDER BY {gain} DESC, m LIMIT 1)"""


def _leaf(name: str, i: int = 0) -> str:
    return f"(SELECT CASE WHEN x.m <= cut THEN l{i} ELSE r{i} END FROM {name})"


def _sql(target: str, algorithm: str) -> str:
    classes = TARGETS[target] or []
    if not classes:
        cuts, answers = [_cut_sql("c", ["y"])], [f"{rounded(_leaf('c'))} AS prediction"]
    elif algorithm == "rf":  # leaves hold class shares; least Gini impurity is least squared error of the indicators
        cuts = [_cut_sql("c", [f"CASE WHEN y = {i} THEN 1.0 ELSE 0.0 END" for i in range(len(classes))])]
        answers = [f"{rounded(_leaf('c', i), 8)} AS chance_{c}" for i, c in enumerate(classes)]
    else:
        wanted = [1] if len(classes) == 2 else range(len(classes))
        cuts = [_cut_sql(f"c{i}", [f"CASE WHEN y = {i} THEN 1.0 ELSE -1.0 END"]) for i in wanted]
        chance = {i: f"(1 / (1 + exp(-2 * {_leaf(f'c{i}')})))" for i in wanted}
        if len(classes) == 2:
            chance[0] = f"(1 - {chance[1]})"
            total = "1"
        else:
            total = "(" + " + ".join(chance.values()) + ")"
        answers = [f"{rounded(f'{chance[i]} / {total}', 8)} AS chance_{c}" for i, c in enumerate(classes)]
    return f"WITH {', '.join([_rows_sql(target), *cuts])} SELECT row_key, split, y AS actual, {', '.join(answers)} FROM x"


def _softmax_sql(rounds: int = 2, step: float = 0.1) -> str:
    """Joint boosting of the grades: a cut per class and round, leaves by one Newton step, margins from the class shares."""
    k = len(GRADES)
    steps = [_rows_sql("grade").replace("x AS (", "x0 AS (")]
    shares = ", ".join(f"ln(avg(CASE WHEN y = {i} THEN 1.0 ELSE 0.0 END)) AS z{i}" for i in range(k))
    steps.append(f"m0 AS (SELECT x0.*, s.* FROM x0, (SELECT {shares} FROM x0 WHERE split = 'train') s)")
    for r in range(rounds):
        total = " + ".join(f"exp(z{i})" for i in range(k))
        chances = ", ".join(f"exp(z{i}) / ({total}) AS p{i}" for i in range(k))
        steps.append(f"q{r} AS (SELECT *, {chances} FROM m{r})")
        for i in range(k):
            residual = f"(CASE WHEN y = {i} THEN 1.0 ELSE 0.0 END - p{i})"
            steps.append(f"""c{r}_{i} AS (SELECT m AS cut, {(k - 1) / k!r} * gl / hl AS l, {(k - 1) / k!r} * gr / hr AS r FROM (
                SELECT m, sum(n) OVER w AS nl, sum(n) OVER () - sum(n) OVER w AS nr, sum(g) OVER w AS gl, sum(g) OVER () - sum(g) OVER w AS gr,
                  sum(h) OVER w AS hl, sum(h) OVER () - sum(h) OVER w AS hr
                FROM (SELECT m, count(*) AS n, sum({residual}) AS g, sum(p{i} * (1 - p{i})) AS h FROM q{r} WHERE split = 'train' GROUP BY m)
                WINDOW w AS (ORDER BY m)) WHERE nr > 0 ORDER BY gl * gl / nl + gr * gr / nr DESC, m LIMIT 1)""")
        moved = ", ".join(f"z{i} + {step!r} * (SELECT CASE WHEN q{r}.m <= cut THEN l ELSE r END FROM c{r}_{i}) AS z{i}" for i in range(k))
        steps.append(f"m{r + 1} AS (SELECT row_key, split, y, m, {moved} FROM q{r})")
    total = " + ".join(f"exp(z{i})" for i in range(k))
    answers = ", ".join(f"{rounded(f'exp(z{i}) / ({total})', 8)} AS chance_{c}" for i, c in enumerate(GRADES))
    return f"WITH {', '.join(steps)} SELECT row_key, split, y AS actual, {answers} FROM m{rounds}"


def one_cut_softmax_grade(spark, sf_dir):
    return _fit(spark, sf_dir, "grade", "gbr", TWO_ROUNDS)


ENTRIES = {
    f"one_cut_{algorithm}_{target}": (_query(target, algorithm), _sql(target, algorithm))
    for algorithm in ("gbr", "rf")
    for target in TARGETS
} | {"one_cut_softmax_grade": (one_cut_softmax_grade, _softmax_sql())}
