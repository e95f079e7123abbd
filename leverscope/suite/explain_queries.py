"""Importance, direction, dependence and what-if with closed-form scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from leverscope.operators import dependence, importance, prepare, scorers, whatif
from leverscope.suite.evaluate_queries import scored_grades, scored_lines, scored_verdicts
from leverscope.suite.frames import (
    GRADES,
    LINE_FEATURES,
    LINES_SQL,
    ORDER_FEATURES,
    ORDERS_SQL,
    SCORED_GRADES_SQL,
    SCORED_LINES_SQL,
    derive,
    grade_chances,
    grade_scorer,
    line_prediction,
    line_scorer,
    lines,
    order_frame_sql,
    order_prediction,
    order_scorer,
    orders,
    rounded,
    table,
    verdict_chances,
    verdict_scorer,
)

# --- permutation importance -----------------------------------------------------

REPEATS = 8


def _importance(spark, sf_dir):
    return importance.permutation_importance(
        lines(spark, sf_dir), LINE_FEATURES, line_scorer(), repeats=REPEATS
    )


def permutation_importance(spark, sf_dir):
    return _importance(spark, sf_dir).select(
        "feature_pos", "feature", F.round("importance", 6).alias("importance")
    )


_PLACE = "row_number() OVER (ORDER BY substr(md5('42|order|' || row_key), 1, 15), row_key)"


def _losses_sql() -> str:
    """Importance of each feature, stated with one plain global row number.

    Squared errors are subtracted row by row: the difference of two large parallel
    sums would not be the same from run to run.
    """
    columns = ", ".join(f"b.{c} AS d_{c}" for c in LINE_FEATURES.names)
    drops = " UNION ALL ".join(
        f"SELECT {i} AS feature_pos, '{c}' AS feature,"
        f" avg({_square({c: 'd_' + c})} - {_square({})}) AS added FROM pairs"
        for i, c in enumerate(LINE_FEATURES.names, 1)
    )
    return f"""
placed AS (SELECT *, {_PLACE} AS place, count(*) OVER () AS n FROM ({LINES_SQL})),
pairs AS (
  SELECT a.*, {columns} FROM placed a CROSS JOIN (SELECT unnest(range(1, {REPEATS + 1})) AS r) s
  JOIN placed b ON b.place = (a.place - 1 + s.r) % a.n + 1),
base AS (SELECT var_pop(actual) AS variance FROM placed),
drops AS ({drops}),
found AS (SELECT cast(feature_pos AS int) AS feature_pos, feature,
                 greatest(added / variance, 0.0) AS importance FROM drops, base)"""


def _square(columns: dict[str, str]) -> str:
    error = f"({line_prediction(**columns)} - actual)"
    return f"{error} * {error}"


PERMUTATION_SQL = f"""
WITH {_losses_sql()}
SELECT feature_pos, feature, {rounded('importance')} AS importance FROM found"""


def permutation_importance_accuracy(spark, sf_dir):
    """Three classes: the mean drop of accuracy."""
    found = importance.permutation_importance(
        orders(spark, sf_dir, "grade"), ORDER_FEATURES, grade_scorer(), repeats=REPEATS
    )
    return found.select("feature_pos", "feature", F.round("importance", 6).alias("importance"))


def _grade_miss(columns: dict[str, str]) -> str:
    chances = grade_chances(**columns)
    best = f"greatest({', '.join(chances)})"
    picked = "CASE " + " ".join(f"WHEN {c} = {best} THEN {i}" for i, c in enumerate(chances)) + " END"
    return f"avg(CASE WHEN {picked} <> actual THEN 1.0 ELSE 0.0 END)"


PERMUTATION_ACCURACY_SQL = f"""
WITH placed AS (SELECT *, {_PLACE} AS place, count(*) OVER () AS n FROM ({order_frame_sql("grade")})),
pairs AS (
  SELECT a.*, {', '.join(f'b.{c} AS d_{c}' for c in ORDER_FEATURES.names)}
  FROM placed a CROSS JOIN (SELECT unnest(range(1, {REPEATS + 1})) AS r) s
  JOIN placed b ON b.place = (a.place - 1 + s.r) % a.n + 1),
base AS (SELECT {_grade_miss({})} AS miss FROM placed),
drops AS ({' UNION ALL '.join(
    f"SELECT {i} AS feature_pos, '{c}' AS feature, {_grade_miss({c: 'd_' + c})} AS miss FROM pairs"
    for i, c in enumerate(ORDER_FEATURES.names, 1))})
SELECT cast(feature_pos AS int) AS feature_pos, feature,
       {rounded('greatest(d.miss - b.miss, 0.0)')} AS importance FROM drops d, base b"""


def importance_topn(spark, sf_dir):
    ranked = importance.rank_importance(_importance(spark, sf_dir), top=3)
    return ranked.select(
        "feature",
        "rank",
        F.round("importance", 6).alias("importance"),
        F.round("share", 6).alias("share"),
    )


RANKED_SQL = f"""
WITH {_losses_sql()},
ranked AS (SELECT *, importance / sum(importance) OVER () AS share,
                  cast(row_number() OVER (ORDER BY importance DESC, feature_pos) AS int) AS rank FROM found)"""
TOPN_SQL = f"""{RANKED_SQL}
SELECT feature, rank, {rounded('importance')} AS importance, {rounded('share')} AS share
FROM ranked WHERE rank <= 3"""

# --- direction ------------------------------------------------------------------


def _direction_columns(df):
    return df.select("feature", F.round("correlation", 6).alias("correlation"), "direction")


def direction_numeric(spark, sf_dir):
    """The model's inputs, a constant and an almost empty column."""
    scored = scored_lines(spark, sf_dir).withColumns(
        {"constant": F.lit(2.0), "empty": F.when(F.col("row_key") == "", 1.0)}
    )
    names = [*LINE_FEATURES.numeric, "constant", "empty"]
    return _direction_columns(importance.numeric_direction(scored, names, F.col("prediction")))


def _direction_case(correlation: str) -> str:
    return (
        f"CASE WHEN {correlation} > 0.08 THEN 'up' WHEN {correlation} < -0.08 THEN 'down'"
        f" WHEN {correlation} IS NOT NULL THEN 'flat' END"
    )


def _correlation_parts(names, source: str, answer: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN count({c}) >= 5 AND min({c}) < max({c})"
        f" THEN corr({c}, {answer}) END AS c FROM ({source})"
        for c in names
    )


DIRECTION_SQL = f"""
WITH found AS ({_correlation_parts(
    [*LINE_FEATURES.numeric, 'constant', 'empty'],
    f"SELECT *, cast(2 AS double) AS constant, cast(NULL AS double) AS empty FROM ({SCORED_LINES_SQL})",
    'prediction')})
SELECT feature, {rounded('c')} AS correlation, {_direction_case('c')} AS direction FROM found"""


def direction_categorical(spark, sf_dir):
    scored = scored_lines(spark, sf_dir).withColumn("one_level", F.lit("x"))
    names = [*LINE_FEATURES.categorical, "one_level"]
    return _direction_columns(importance.categorical_direction(scored, names, F.col("prediction")))


CATEGORICAL_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {rounded('s')} AS correlation,"
    f" CASE WHEN abs(s) < 1e-6 THEN 'flat' WHEN s > 0 THEN 'up' END AS direction FROM"
    f" (SELECT CASE WHEN count(*) >= 2 THEN max(m) - min(m) END AS s FROM"
    f" (SELECT avg(prediction) AS m FROM (SELECT *, 'x' AS one_level FROM ({SCORED_LINES_SQL}))"
    f" WHERE {c} IS NOT NULL GROUP BY {c}))"
    for c in (*LINE_FEATURES.categorical, "one_level")
)


def class_push(spark, sf_dir):
    found = importance.class_push(scored_grades(spark, sf_dir), "total_k", GRADES)
    return found.withColumn("correlation", F.round("correlation", 6))


CLASS_PUSH_SQL = " UNION ALL ".join(
    f"SELECT cast({i} AS int) AS class_index, '{label}' AS label, 'total_k' AS feature,"
    f" {_direction_case(f'corr(total_k, p{i})')} AS direction, {rounded(f'corr(total_k, p{i})')} AS correlation"
    f" FROM ({SCORED_GRADES_SQL})"
    for i, label in enumerate(GRADES)
)

# --- partial dependence ---------------------------------------------------------


# Averages of short decimals over 6 * 10**k rows can end exactly in a 5 after six
# digits, where the last bit of a sum decides the rounding; after eight they cannot.
MEAN_DIGITS = 8


def _rounded_curve(df):
    return df.select(
        "feature", "grid_id", F.round("x", 6).alias("x"), "x_label", F.round("y", MEAN_DIGITS).alias("y")
    )


def line_curves(spark, sf_dir, wanted):
    df = lines(spark, sf_dir)
    grid = dependence.build_grid(df, LINE_FEATURES, wanted)
    return dependence.partial_dependence(df, LINE_FEATURES, line_scorer(), grid)


NUMERIC_CURVES = ["quantity", "price_k", "discount", "tax"]


def pdp_numeric(spark, sf_dir):
    return _rounded_curve(line_curves(spark, sf_dir, NUMERIC_CURVES))


def _grid_sql(column: str, source: str) -> str:
    """Distinct values when under 24, else 24 equal steps between two quantiles."""
    return f"""
(SELECT grid_id, x FROM (
   SELECT cast(row_number() OVER (ORDER BY {column}) - 1 AS int) AS grid_id, {column} AS x, count(*) OVER () AS n
   FROM (SELECT DISTINCT {column} FROM ({source}) WHERE {column} IS NOT NULL)) WHERE n < 24
 UNION ALL
 SELECT cast(i AS int), low + (high - low) / 23 * i
 FROM (SELECT quantile_cont({column}, 0.05) AS low, quantile_cont({column}, 0.95) AS high,
              count(DISTINCT {column}) AS n FROM ({source})), (SELECT unnest(range(24)) AS i) WHERE n >= 24)"""


def curve_sql(column: str, source: str, answer: str) -> str:
    return (
        f"SELECT '{column}' AS feature, grid_id, x, cast(NULL AS string) AS x_label, avg({answer}) AS y"
        f" FROM ({source}) CROSS JOIN {_grid_sql(column, source)} g GROUP BY grid_id, x"
    )


LINE_CURVES_SQL = " UNION ALL ".join(
    curve_sql(c, LINES_SQL, line_prediction(**{c: "g.x"})) for c in NUMERIC_CURVES
)
CURVE_COLUMNS = f"feature, grid_id, {rounded('x')} AS x, x_label, {rounded('y', MEAN_DIGITS)} AS y"


def pdp_categorical(spark, sf_dir):
    return _rounded_curve(line_curves(spark, sf_dir, ["flag", "status"]))


LEVEL_CURVES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, grid_id, cast(grid_id AS double) AS x, g.v AS x_label,"
    f" avg({line_prediction(**{c: 'g.v'})}) AS y FROM ({LINES_SQL}) CROSS JOIN"
    f" (SELECT v, cast(row_number() OVER (ORDER BY v) - 1 AS int) AS grid_id FROM"
    f" (SELECT DISTINCT {c} AS v FROM ({LINES_SQL}) WHERE {c} IS NOT NULL)) g GROUP BY grid_id, g.v"
    for c in LINE_FEATURES.categorical
)


def pdp_class(spark, sf_dir):
    """One curve per class: by label, by number, and by an unknown name (last class)."""
    df = orders(spark, sf_dir, "grade")
    scorer = grade_scorer()
    grid = dependence.build_grid(df, ORDER_FEATURES, ["month", "total_k"])
    wanted = [scorers.pick_class(scorer, asked) for asked in ("A", "1", "no such class")]
    curves = dependence.class_curves(df, ORDER_FEATURES, scorer, grid).where(F.col("class_index").isin(wanted))
    return curves.select(
        "feature", "grid_id", F.round("x", 6).alias("x"), F.round("y", MEAN_DIGITS).alias("y"), F.col("label").alias("class_label")
    )


PDP_CLASS_SQL = " UNION ALL ".join(
    f"SELECT feature, grid_id, {rounded('x')} AS x, {rounded('y', MEAN_DIGITS)} AS y, '{label}' AS class_label FROM ("
    + curve_sql(c, ORDERS_SQL, grade_chances(**{c: "g.x"})[i])
    + ")"
    for c in ("month", "total_k")
    for i, label in enumerate(GRADES)
)


def dependence_points(spark, sf_dir):
    scored = scored_lines(spark, sf_dir)
    answer = F.col("prediction")
    # The curve's levels lack 'R': such rows sit at 0.
    by_flag = dependence.dependence_points(
        scored, "flag", LINE_FEATURES, answer, ["A", "N"], "status", keep=("row_key",)
    )
    by_quantity = dependence.dependence_points(
        scored, "quantity", LINE_FEATURES, answer, color_by="flag", keep=("row_key",)
    )
    return by_flag.unionByName(by_quantity).withColumn("y", F.round("y", 6))


POINTS_SQL = f"""
SELECT row_key, 'flag' AS feature, CASE flag WHEN 'N' THEN cast(1 AS double) ELSE cast(0 AS double) END AS x,
       flag AS x_label, {rounded('prediction')} AS y, status AS color
FROM ({SCORED_LINES_SQL}) WHERE flag IS NOT NULL
UNION ALL
SELECT row_key, 'quantity', quantity, NULL, {rounded('prediction')}, flag
FROM ({SCORED_LINES_SQL}) WHERE quantity IS NOT NULL"""


def curve_direction(spark, sf_dir):
    found = dependence.curve_direction(line_curves(spark, sf_dir, NUMERIC_CURVES))
    return found.select("feature", F.round("slope", 6).alias("slope"), "direction")


SLOPE_SQL = f"""
SELECT feature, (last_y - first_y) / (last_x - first_x + 1e-9) AS slope FROM
 (SELECT feature, arg_min(x, grid_id) AS first_x, arg_max(x, grid_id) AS last_x,
         arg_min(y, grid_id) AS first_y, arg_max(y, grid_id) AS last_y FROM ({LINE_CURVES_SQL}) GROUP BY feature)"""
CURVE_DIRECTION_SQL = f"""
SELECT feature, {rounded('slope')} AS slope,
       CASE WHEN slope > 1e-6 THEN 'up' WHEN slope < -1e-6 THEN 'down' ELSE 'flat' END AS direction
FROM ({SLOPE_SQL})"""


def observed_curves(spark, sf_dir):
    """Curves with a clear steepest part: mean order total by month and by site."""
    df = orders(spark, sf_dir)
    parts = [
        df.groupBy(F.col(c).alias("x")).agg(F.avg("outcome").alias("y")).select(
            F.lit(c).alias("feature"), F.col("x").cast("int").alias("grid_id"), "x", "y"
        )
        for c in ("month", "site")
    ]
    return parts[0].unionByName(parts[1])


OBSERVED_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, cast({c} AS int) AS grid_id, {c} AS x, avg(outcome) AS y"
    f" FROM ({ORDERS_SQL}) GROUP BY {c}"
    for c in ("month", "site")
)


def steepest_range(spark, sf_dir):
    return dependence.steepest_range(observed_curves(spark, sf_dir))


STEEPEST_SQL = f"""
SELECT feature, arg_max(x_before, steepness) AS steepest_from, arg_max(x, steepness) AS steepest_to
FROM (SELECT feature, x, lag(x) OVER w AS x_before, abs((y - lag(y) OVER w) / (x - lag(x) OVER w)) AS steepness
      FROM ({OBSERVED_SQL}) WINDOW w AS (PARTITION BY feature ORDER BY grid_id)) GROUP BY feature"""

# --- what-if --------------------------------------------------------------------

EVENT_K = "cast(regexp_extract(props, '([0-9]+)', 1) AS int)"
# A third of the scenarios start from one and the same order.
SCENARIO_KEY = "CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id END"


def scenarios(spark, sf_dir):
    edits = f"""CASE event_type
        WHEN 'click' THEN map('total_k', cast(value AS string))
        WHEN 'purchase' THEN map('total_k', cast(value AS string), 'priority', '1-URGENT')
        WHEN 'error' THEN map('no_such_input', '1', 'month', 'abc')
        WHEN 'signup' THEN map('month', cast({EVENT_K} % 12 + 1 AS string))
        ELSE cast(map() AS map<string,string>) END"""
    return derive(
        table(spark, sf_dir, "events"),
        {"scenario_id": "event_id", "row_key": SCENARIO_KEY, "edits": edits},
    )


def scenario_rows(spark, sf_dir):
    return whatif.scenario_rows(scenarios(spark, sf_dir), orders(spark, sf_dir), ORDER_FEATURES)


EDITED = {
    "total_k": "CASE WHEN event_type IN ('click', 'purchase') THEN value ELSE total_k END",
    "month": (
        f"CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN cast({EVENT_K} % 12 + 1 AS double)"
        " ELSE month END"
    ),
    "site": "site",
    "priority": "CASE WHEN event_type = 'purchase' THEN '1-URGENT' ELSE priority END",
}
SCENARIOS_SQL = f"""
SELECT e.event_id AS scenario_id, e.event_type, e.value, e.props, o.row_key, total_k, month, site, priority,
       {', '.join(f'{e} AS e_{c}' for c, e in EDITED.items())}
FROM events e JOIN ({ORDERS_SQL}) o ON o.row_key = {SCENARIO_KEY}"""
E_COLUMNS = {c: f"e_{c}" for c in ORDER_FEATURES.names}


def whatif_batch(spark, sf_dir):
    found = whatif.whatif(scenario_rows(spark, sf_dir), ORDER_FEATURES, order_scorer())
    return found.select(
        "scenario_id",
        "row_key",
        F.size("applied").cast("long").alias("edit_count"),
        *[F.round(c, 6).alias(c) for c in ("baseline", "prediction", "delta")],
        "status",
    )


EDIT_COUNT = "cast(CASE event_type WHEN 'purchase' THEN 2 WHEN 'view' THEN 0 ELSE 1 END AS bigint)"
WHATIF_SQL = f"""
SELECT scenario_id, row_key, {EDIT_COUNT} AS edit_count, {rounded(order_prediction())} AS baseline,
       {rounded(order_prediction(**E_COLUMNS))} AS prediction,
       {rounded(f'{order_prediction(**E_COLUMNS)} - ({order_prediction()})')} AS delta, 'ok' AS status
FROM ({SCENARIOS_SQL})"""


def order_fill(spark, sf_dir):
    return prepare.fill_values(orders(spark, sf_dir), ORDER_FEATURES)


def whatif_contributions(spark, sf_dir):
    found = whatif.whatif(
        scenario_rows(spark, sf_dir), ORDER_FEATURES, order_scorer(), order_fill(spark, sf_dir)
    )
    return found.select("scenario_id", F.inline("contributions")).select(
        "scenario_id", "feature", F.round("delta", 6).alias("delta"), "rank"
    )


STANDARD_SQL = f"""
SELECT median(total_k) AS m_total_k, median(month) AS m_month, median(site) AS m_site,
       (SELECT priority FROM ({ORDERS_SQL}) WHERE priority IS NOT NULL GROUP BY priority
        ORDER BY count(*) DESC, priority LIMIT 1) AS m_priority FROM ({ORDERS_SQL})"""


def contributions_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT scenario_id, '{c}' AS feature, {i} AS pos, {order_prediction(**E_COLUMNS)}"
        f" - ({order_prediction(**(E_COLUMNS | {c: 'm_' + c}))}) AS delta FROM both_sides"
        for i, c in enumerate(ORDER_FEATURES.names)
    )
    return f"""
both_sides AS (SELECT * FROM ({SCENARIOS_SQL}), ({STANDARD_SQL})),
contributions AS (SELECT scenario_id, feature, delta, cast(row_number() OVER (
    PARTITION BY scenario_id ORDER BY abs(delta) DESC, pos) AS int) AS rank FROM ({parts}))"""


CONTRIBUTIONS_SQL = f"""
WITH {contributions_sql()}
SELECT scenario_id, feature, {rounded('delta')} AS delta, rank FROM contributions"""


def verdict_whatif(spark, sf_dir, fill=None):
    rows = scenario_rows(spark, sf_dir)
    return whatif.whatif(rows, ORDER_FEATURES, verdict_scorer(), fill)


def whatif_classes(spark, sf_dir):
    return verdict_whatif(spark, sf_dir).select(
        "scenario_id",
        "baseline_class",
        "predicted_class",
        *[F.round(c, 6).alias(c) for c in ("baseline", "prediction", "baseline_focus")],
        F.round(F.col("probabilities")[0]["probability"], 6).alias("chance_ng"),
        F.col("probabilities")[1]["label"].alias("second_label"),
    )


def _verdict_pair_sql() -> str:
    before, after = verdict_chances(), verdict_chances(**E_COLUMNS)
    return f"""
SELECT *, CASE WHEN b0 >= b1 THEN 'NG' ELSE 'OK' END AS baseline_class,
       CASE WHEN a0 >= a1 THEN 'NG' ELSE 'OK' END AS predicted_class, greatest(b0, b1) AS baseline,
       greatest(a0, a1) AS prediction, CASE WHEN a0 >= a1 THEN b0 ELSE b1 END AS baseline_focus
FROM (SELECT *, {before[0]} AS b0, {before[1]} AS b1, {after[0]} AS a0, {after[1]} AS a1 FROM ({SCENARIOS_SQL}))"""


VERDICT_PAIR_SQL = _verdict_pair_sql()
WHATIF_CLASSES_SQL = f"""
SELECT scenario_id, baseline_class, predicted_class, {rounded('baseline')} AS baseline,
       {rounded('prediction')} AS prediction, {rounded('baseline_focus')} AS baseline_focus,
       {rounded('a0')} AS chance_ng, 'OK' AS second_label FROM ({VERDICT_PAIR_SQL})"""


def mean_prediction(spark, sf_dir):
    one = whatif.mean_prediction(scored_lines(spark, sf_dir), line_scorer()).select(
        F.lit("line").alias("label"), "mean_prediction"
    )
    classes = whatif.mean_prediction(scored_grades(spark, sf_dir), grade_scorer())
    both = one.unionByName(classes.select("label", "mean_prediction"))
    return both.withColumn("mean_prediction", F.round("mean_prediction", MEAN_DIGITS))


MEAN_SQL = f"SELECT 'line' AS label, {rounded('avg(prediction)', MEAN_DIGITS)} AS mean_prediction FROM ({SCORED_LINES_SQL})" + "".join(
    f" UNION ALL SELECT '{label}', {rounded(f'avg(p{i})', MEAN_DIGITS)} FROM ({SCORED_GRADES_SQL})"
    for i, label in enumerate(GRADES)
)


def scored_rows(spark, sf_dir):
    scored = scored_lines(spark, sf_dir).withColumn(
        # A non-finite cell must come out empty.
        "tax", F.when(F.col("quantity") == 13, float("inf")).otherwise(F.col("tax"))
    )
    rows = whatif.scored_rows(scored, LINE_FEATURES, line_scorer(), keep=("row_key",))
    return rows.withColumns(
        {c: F.round(c, 6) for c in ("actual", "predicted", "residual", "price_k")}
    )


SCORED_ROWS_SQL = f"""
SELECT row_key, {rounded('actual')} AS actual, {rounded('prediction')} AS predicted,
       {rounded('prediction - actual')} AS residual, quantity, {rounded('price_k')} AS price_k, discount,
       CASE WHEN quantity = 13 THEN NULL ELSE tax END AS tax, flag, status FROM ({SCORED_LINES_SQL})"""


def scored_rows_classes(spark, sf_dir):
    """Labels and the chance of the last class."""
    rows = whatif.scored_rows(
        scored_verdicts(spark, sf_dir), ORDER_FEATURES, verdict_scorer(), keep=("row_key",)
    )
    return rows.select("row_key", "actual", F.round("predicted", 6).alias("predicted"), "month", "priority")


SCORED_CLASS_SQL = f"""
SELECT row_key, verdict AS actual, {rounded(verdict_chances()[1])} AS predicted, month, priority
FROM ({ORDERS_SQL})"""


def scored_rows_shown(spark, sf_dir):
    """The first 500 rows by key, as a page shows them."""
    return whatif.shown_rows(scored_rows_classes(spark, sf_dir), ["row_key"])


SHOWN_SQL = f"{SCORED_CLASS_SQL} ORDER BY row_key LIMIT 500"

ENTRIES = {
    "permutation_importance": (permutation_importance, PERMUTATION_SQL),
    "permutation_importance_accuracy": (permutation_importance_accuracy, PERMUTATION_ACCURACY_SQL),
    "importance_topn": (importance_topn, TOPN_SQL),
    "direction_numeric": (direction_numeric, DIRECTION_SQL),
    "direction_categorical": (direction_categorical, CATEGORICAL_SQL),
    "class_push": (class_push, CLASS_PUSH_SQL),
    "pdp_numeric": (pdp_numeric, f"SELECT {CURVE_COLUMNS} FROM ({LINE_CURVES_SQL})"),
    "pdp_categorical": (pdp_categorical, f"SELECT {CURVE_COLUMNS} FROM ({LEVEL_CURVES_SQL})"),
    "pdp_class": (pdp_class, PDP_CLASS_SQL),
    "dependence_points": (dependence_points, POINTS_SQL),
    "curve_direction": (curve_direction, CURVE_DIRECTION_SQL),
    "steepest_range": (steepest_range, STEEPEST_SQL),
    "whatif_batch": (whatif_batch, WHATIF_SQL),
    "whatif_contributions": (whatif_contributions, CONTRIBUTIONS_SQL),
    "whatif_classes": (whatif_classes, WHATIF_CLASSES_SQL),
    "mean_prediction": (mean_prediction, MEAN_SQL),
    "scored_rows": (scored_rows, SCORED_ROWS_SQL),
    "scored_rows_classes": (scored_rows_classes, SCORED_CLASS_SQL),
    "scored_rows_shown": (scored_rows_shown, SHOWN_SQL),
}
