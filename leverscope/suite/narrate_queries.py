"""Sentences, codes and numbers on finished tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leverscope.operators import dependence, evaluate, importance, narrate, whatif
from leverscope.suite.evaluate_queries import class_metrics_sql, scored_grades, scored_lines
from leverscope.suite.explain_queries import (
    CLASS_PUSH_SQL,
    CURVE_DIRECTION_SQL,
    DIRECTION_SQL,
    EDIT_COUNT,
    E_COLUMNS,
    LINE_CURVES_SQL,
    MEAN_DIGITS,
    NUMERIC_CURVES,
    RANKED_SQL,
    SCENARIOS_SQL,
    VERDICT_PAIR_SQL,
    CATEGORICAL_SQL,
    _importance,
    contributions_sql,
    line_curves,
    order_fill,
    scenario_rows,
    verdict_whatif,
)
from leverscope.suite.frames import (
    GRADES,
    LINE_FEATURES,
    ORDER_FEATURES,
    SCORED_GRADES_SQL,
    order_prediction,
    order_scorer,
    rounded,
)


def text(number: str, digits: int, sign: str = "") -> str:
    """SQL for a number as text with fixed decimals."""
    return f"printf('%{sign}.{digits}f', {rounded(number, digits)})"


def _args(df, *names):
    """The argument map as columns, so that it can be compared."""
    return [F.col("args")[n].alias(f"arg_{n}") for n in names]


def importance_insights(spark, sf_dir):
    pushes = importance.directions(scored_lines(spark, sf_dir), LINE_FEATURES, F.col("prediction"))
    ranked = importance.rank_importance(_importance(spark, sf_dir)).join(
        F.broadcast(pushes), "feature", "left"
    )
    told = narrate.importance_insights(ranked, "yield")
    return told.select("feature", "rank", "direction", "code", "summary", *_args(told, "share", "importance"))


_SHARE = text("share * 100", 1)
IMPORTANCE_SQL = f"""
{RANKED_SQL},
pushes AS ({DIRECTION_SQL} UNION ALL {CATEGORICAL_SQL}),
told AS (SELECT r.*, p.direction, {_SHARE} AS pct FROM ranked r LEFT JOIN pushes p ON p.feature = r.feature)
SELECT feature, rank, direction,
       CASE WHEN rank = 1 THEN 'topFactor' WHEN rank <= 3 THEN 'highFactor' ELSE 'otherFactor' END AS code,
       CASE WHEN rank = 1 THEN feature || ' explains yield most: ' || pct || '% of the explained part.'
            WHEN rank <= 3 THEN feature || ' is number ' || rank || ' for yield with ' || pct || '%.'
            ELSE feature || ' accounts for ' || pct || '% of what explains yield.' END
       || CASE direction WHEN 'up' THEN ' Raising ' || feature || ' goes with a higher yield.'
               WHEN 'down' THEN ' Raising ' || feature || ' goes with a lower yield.' ELSE '' END AS summary,
       pct AS arg_share, {text('importance', 4)} AS arg_importance
FROM told"""
# DIRECTION_SQL starts with its own WITH; a nested one has to stand in brackets.
IMPORTANCE_SQL = IMPORTANCE_SQL.replace(
    f"({DIRECTION_SQL} UNION ALL {CATEGORICAL_SQL})",
    f"(SELECT * FROM ({DIRECTION_SQL}) UNION ALL SELECT * FROM ({CATEGORICAL_SQL}))",
)


def dependence_insight(spark, sf_dir):
    """Numeric curves as they are, then as curves of a class, and a categorical one."""
    curves = line_curves(spark, sf_dir, [*NUMERIC_CURVES, "flag"])
    curves = curves.withColumns({"x": F.round("x", 6), "y": F.round("y", MEAN_DIGITS)})
    kind = F.when(F.col("feature") == "flag", "categorical").otherwise("numeric")
    described = dependence.describe_curves(curves).withColumn("feature_type", kind)
    # One short row per curve: kept, because it is told twice.
    described = described.persist()
    parts = [
        narrate.dependence_insight(described, "yield"),
        narrate.dependence_insight(described, "verdict", "NG"),
    ]
    return parts[0].unionByName(parts[1]).select(
        "feature", "code", "summary", *_args(parts[0], "direction", "classLabel")
    )


_STEPS = f"""
SELECT feature, arg_max(x_before, steepness) AS low, arg_max(x, steepness) AS high
FROM (SELECT feature, x, lag(x) OVER w AS x_before, abs((y - lag(y) OVER w) / (x - lag(x) OVER w)) AS steepness
      FROM (SELECT feature, grid_id, {rounded('x')} AS x, {rounded('y', MEAN_DIGITS)} AS y FROM ({LINE_CURVES_SQL}))
      WINDOW w AS (PARTITION BY feature ORDER BY grid_id)) GROUP BY feature"""
DEPENDENCE_SQL = f"""
WITH described AS (
  SELECT d.feature, direction, {text('low', 3)} AS low, {text('high', 3)} AS high
  FROM ({CURVE_DIRECTION_SQL}) d JOIN ({_STEPS}) s ON s.feature = d.feature)
SELECT feature, 'dependenceNumeric' AS code,
       'Average predicted yield as ' || feature || ' alone varies. The steepest part is from ' || low || ' to '
       || high || '.' || CASE direction WHEN 'up' THEN ' The curve rises.' WHEN 'down' THEN ' The curve falls.'
       ELSE '' END AS summary, direction AS arg_direction, NULL AS arg_classLabel FROM described
UNION ALL
SELECT feature, 'dependenceClassProbability', 'Average chance of NG as ' || feature || ' alone varies.',
       direction, 'NG' FROM described
UNION ALL SELECT 'flag', 'dependenceCategorical', 'Average predicted yield for each value of flag.', 'flat', NULL
UNION ALL SELECT 'flag', 'dependenceCategorical', 'Average chance of NG as flag alone varies.', 'flat', 'NG'"""

# Stored ranks as an importance table would hold them; ``site`` has none.
STORED_RANKS = (("total_k", 2), ("month", 3), ("priority", 1))


def stored_ranks(spark):
    return narrate.rank_map(spark.createDataFrame(list(STORED_RANKS), "feature string, rank int"))


def whatif_narrative(spark, sf_dir):
    found = whatif.whatif(scenario_rows(spark, sf_dir), ORDER_FEATURES, order_scorer())
    told = narrate.whatif_narrative(found, "outcome", list(ORDER_FEATURES.names), stored_ranks(spark))
    return told.select(
        "scenario_id", "delta_pct", "code", "summary", "primary_feature", "primary_rank",
        *_args(told, "baseline", "delta", "deltaPct", "edits", "editCount"),
    )


_ORIGINAL = {
    "total_k": f"coalesce({text('total_k', 3)}, 'nothing')",
    "month": f"coalesce({text('month', 3)}, 'nothing')",
    "priority": "coalesce(priority, 'nothing')",
}
# What each kind of event edits, as SCENARIOS gives it.
_BITS = f"""CASE event_type
  WHEN 'click' THEN 'total_k from ' || {_ORIGINAL['total_k']} || ' to ' || cast(value AS string)
  WHEN 'purchase' THEN 'total_k from ' || {_ORIGINAL['total_k']} || ' to ' || cast(value AS string)
       || '; priority from ' || {_ORIGINAL['priority']} || ' to 1-URGENT'
  WHEN 'error' THEN 'month from ' || {_ORIGINAL['month']} || ' to abc'
  WHEN 'signup' THEN 'month from ' || {_ORIGINAL['month']} || ' to ' || cast(cast(e_month AS int) AS string)
  ELSE '' END"""
_PRIMARY = """CASE event_type WHEN 'click' THEN 'total_k' WHEN 'purchase' THEN 'priority' WHEN 'error' THEN 'month'
  WHEN 'signup' THEN 'month' END"""
_RANK = "CASE event_type WHEN 'click' THEN 2 WHEN 'purchase' THEN 1 WHEN 'error' THEN 3 WHEN 'signup' THEN 3 END"
NARRATIVE_SQL = f"""
WITH numbers AS (
  SELECT *, {order_prediction()} AS base, {order_prediction(**E_COLUMNS)} AS new, {_BITS} AS bits,
         {_PRIMARY} AS primary_feature, {_RANK} AS primary_rank FROM ({SCENARIOS_SQL})),
told AS (SELECT *, CASE WHEN abs(base) > 1e-9 THEN {rounded('(new - base) * 100 / abs(base)', 1)} END AS pct FROM numbers)
SELECT scenario_id, pct AS delta_pct,
       CASE WHEN event_type = 'view' THEN 'whatIfNoEdits' ELSE 'whatIfChanged' END AS code,
       CASE WHEN event_type = 'view' THEN 'Nothing is changed; predicted outcome stays ' || {text('new', 3)} || '.'
       ELSE 'With ' || bits || ', predicted outcome goes from ' || {text('base', 3)} || ' to ' || {text('new', 3)}
            || ' (' || coalesce({text('pct', 1, '+')} || '%', {text('new - base', 3, '+')}) || '). '
            || primary_feature || ' ranks ' || primary_rank || ' among the drivers.' END AS summary,
       primary_feature, primary_rank, {text('base', 4)} AS arg_baseline, {text('new - base', 4)} AS arg_delta,
       {text('pct', 1)} AS arg_deltaPct, bits AS arg_edits, cast({EDIT_COUNT} AS string) AS arg_editCount
FROM told"""


def whatif_contribution_ranks(spark, sf_dir):
    """Without an importance table the ranks are those of the contributions."""
    found = whatif.whatif(
        scenario_rows(spark, sf_dir), ORDER_FEATURES, order_scorer(), order_fill(spark, sf_dir)
    )
    told = narrate.whatif_narrative(
        found, "outcome", list(ORDER_FEATURES.names), narrate.contribution_ranks()
    )
    return told.select("scenario_id", "code", "primary_feature", "primary_rank")


CONTRIBUTION_RANKS_SQL = f"""
WITH {contributions_sql()},
edited AS (
  SELECT scenario_id, event_type, unnest(CASE event_type WHEN 'click' THEN ['total_k']
    WHEN 'purchase' THEN ['total_k', 'priority'] WHEN 'error' THEN ['month'] WHEN 'signup' THEN ['month']
    ELSE [NULL] END) AS feature FROM ({SCENARIOS_SQL}))
SELECT e.scenario_id, CASE WHEN any_value(event_type) = 'view' THEN 'whatIfNoEdits' ELSE 'whatIfChanged' END AS code,
       arg_min(e.feature, c.rank) AS primary_feature, min(c.rank) AS primary_rank
FROM edited e LEFT JOIN contributions c ON c.scenario_id = e.scenario_id AND c.feature = e.feature
GROUP BY e.scenario_id"""


def whatif_class_narrative(spark, sf_dir):
    told = narrate.whatif_class_narrative(
        verdict_whatif(spark, sf_dir),
        "verdict",
        list(ORDER_FEATURES.names),
        list(ORDER_FEATURES.numeric),
        stored_ranks(spark),
    )
    return told.select("scenario_id", "code", "summary", "primary_feature", "hint", *_args(told, "probability"))


_HINT = f"""CASE event_type WHEN 'click' THEN CASE WHEN e_total_k > total_k THEN 'higher'
    WHEN e_total_k < total_k THEN 'lower' ELSE 'changed' END
  WHEN 'signup' THEN CASE WHEN e_month > month THEN 'higher' WHEN e_month < month THEN 'lower' ELSE 'changed' END
  WHEN 'view' THEN '' ELSE 'changed' END"""
CLASS_NARRATIVE_SQL = f"""
WITH told AS (SELECT *, {text('prediction * 100', 1)} AS pct, {_PRIMARY} AS primary_feature, {_HINT} AS hint
              FROM ({VERDICT_PAIR_SQL}))
SELECT scenario_id, CASE WHEN event_type = 'view' THEN 'whatIfClassNoEdits' ELSE 'whatIfClass' END AS code,
       CASE WHEN event_type = 'view' THEN 'Nothing is changed; the row looks like ' || predicted_class || ' (' || pct || '%).'
       ELSE 'The edited row looks like ' || predicted_class || ' (' || pct || '%), above all because '
            || primary_feature || ' is ' || hint || '.' END AS summary,
       primary_feature, hint, pct AS arg_probability
FROM told"""


def class_insights(spark, sf_dir):
    scored = scored_grades(spark, sf_dir)
    counts = evaluate.class_counts(evaluate.confusion_matrix(scored, GRADES))
    cards = narrate.class_insights(
        evaluate.class_metrics(counts), importance.class_push(scored, "total_k", GRADES), "grade"
    )
    return cards.select(
        "label", "support", "direction", "code", "summary", *_args(cards, "precision", "recall", "feature")
    )


CLASS_CARDS_SQL = f"""
SELECT m.label, support, direction, 'classCard' AS code,
       m.label || ': ' || support || ' rows (' || {text('support_pct', 1)} || '%), precision '
       || {text('precision_pct', 1)} || '%, recall ' || {text('recall_pct', 1)} || '%.'
       || CASE direction WHEN 'up' THEN ' Raising total_k makes it likelier.'
            WHEN 'down' THEN ' Raising total_k makes it less likely.'
            ELSE ' total_k matters most over all classes.' END AS summary,
       {text('precision_pct', 1)} AS arg_precision, {text('recall_pct', 1)} AS arg_recall, 'total_k' AS arg_feature
FROM ({class_metrics_sql(SCORED_GRADES_SQL, GRADES)}) m JOIN ({CLASS_PUSH_SQL}) p ON p.class_index = m.class_index"""

ENTRIES = {
    "importance_insights": (importance_insights, IMPORTANCE_SQL),
    "dependence_insight": (dependence_insight, DEPENDENCE_SQL),
    "whatif_narrative": (whatif_narrative, NARRATIVE_SQL),
    "whatif_contribution_ranks": (whatif_contribution_ranks, CONTRIBUTION_RANKS_SQL),
    "whatif_class_narrative": (whatif_class_narrative, CLASS_NARRATIVE_SQL),
    "class_insights": (class_insights, CLASS_CARDS_SQL),
}
