"""Tree learners end to end. Their numbers have no SQL form: rows hold what SQL can state of them, tests check more."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leverscope.operators import dependence, whatif
from leverscope.operators.evaluate import class_table
from leverscope.operators.importance import explain_importance
from leverscope.operators.narrate import importance_insights
from leverscope.operators.profile import load_table
from leverscope.operators.scorers import pick_class
from leverscope.plans import explain
from leverscope.plans.train import fit_model, load_model, save_model
from leverscope.suite.explain_queries import SCENARIOS_SQL, curve_sql, scenarios
from leverscope.suite.frames import (
    GRADES,
    ORDER_FEATURES,
    ORDERS_SQL,
    derive,
    orders,
    rounded,
    table,
    wide_table,
)
from leverscope.suite.prepare_queries import SPLIT_ORDER
from leverscope.suite.profile_queries import scratch


def order_table(spark, sf_dir, target):
    return orders(spark, sf_dir).select("row_key", *ORDER_FEATURES.names, target)


def fit(spark, sf_dir, target, algorithm="gbr", task="auto", with_metrics=False):
    return fit_model(order_table(spark, sf_dir, target), target, algorithm, task, with_metrics=with_metrics)


def _regression(model, widened=0.0):
    """Rows with what SQL can state of a prediction: it lies within the training targets' range, widened by a share of it."""
    low, high = model.frame.where("split <> 'test'").agg(F.min("actual"), F.max("actual")).first()
    slack = widened * (high - low) + 1e-9
    return model.scored().select("row_key", "split", "actual", F.col("prediction").between(low - slack, high + slack).alias("in_range"))


def _classification(model):
    """Rows with what SQL can state of chances: they add up to one, and the class given has the largest."""
    labels = class_table(model.frame, model.spec.classes)
    total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
    largest = F.get("probability", F.col("prediction").cast("int")) == F.array_max("probability")
    scored = model.scored().withColumn("class_index", F.col("actual").cast("int")).join(labels, "class_index")
    return scored.select("row_key", "split", F.col("label").alias("actual"), (F.abs(total - 1) < 1e-9).alias("adds_up"), largest.alias("takes_largest"))


def stratified_sql(rows: str) -> str:
    """(row_key, split, t) of rows (row_key, t): per class the share of test rows, largest remainders first."""
    return f"""
SELECT row_key, t, CASE WHEN row_number() OVER (PARTITION BY t ORDER BY {SPLIT_ORDER}) <= test_rows THEN 'test' ELSE 'train' END AS split
FROM ({rows}) JOIN (
  SELECT t, floor(exact) + CASE WHEN row_number() OVER (ORDER BY floor(exact) - exact, t) <= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS test_rows
  FROM (SELECT t, n * ceil(0.25 * sum(n) OVER ()) / sum(n) OVER () AS exact, ceil(0.25 * sum(n) OVER ()) AS wanted
    FROM (SELECT t, count(*) AS n FROM ({rows}) GROUP BY 1))) USING (t)"""


REGRESSION_SQL = f"""
SELECT row_key, CASE WHEN row_number() OVER (ORDER BY {SPLIT_ORDER}) <= ceil(0.25 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split,
  outcome AS actual, true AS in_range FROM ({ORDERS_SQL})"""


def _classes_sql(rows: str) -> str:
    return f"SELECT row_key, split, t AS actual, true AS adds_up, true AS takes_largest FROM ({stratified_sql(rows)})"


VERDICT_SQL, GRADE_SQL = (_classes_sql(f"SELECT row_key, {t} AS t FROM ({ORDERS_SQL})") for t in ("verdict", "grade"))


def fit_gbt_regression(spark, sf_dir):
    return _regression(fit(spark, sf_dir, "outcome"), widened=0.5)


def fit_gbt_binary(spark, sf_dir):
    return _classification(fit(spark, sf_dir, "verdict"))


def fit_gbt_multiclass(spark, sf_dir):
    return _classification(fit(spark, sf_dir, "grade", task="multiclass"))


def fit_rf_regression(spark, sf_dir):
    return _regression(fit(spark, sf_dir, "outcome", "rf"))


def fit_rf_classification(spark, sf_dir):
    return _classification(fit(spark, sf_dir, "grade", "rf", "multiclass"))


def labelled_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return table(spark, sf_dir, "labels").join(documents, "doc_id").selectExpr(
        "doc_id AS row_key", "n_chars", "lang", "source", "cast(toxic AS double) AS toxic",
        "CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS grade",
    )


def fit_rf_documents(spark, sf_dir):
    """A two-class target the data brings along: document quality."""
    df = labelled_documents(spark, sf_dir)
    return _classification(fit_model(df, "grade", "rf", with_metrics=False))


DOCUMENTS_SQL = _classes_sql("SELECT doc_id AS row_key, CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS t FROM labels JOIN documents USING (doc_id)")

# What bounds each metric; counts are stated as they are.
BOUNDS = {"rSquared": (None, 1), "trainRSquared": (None, 1), "rmse": (0, None), "mae": (0, None), "accuracy": (0, 1), "trainAccuracy": (0, 1), "auc": (0, 1), "f1": (0, 1)}
KNOWN = {"outcome": ("rSquared", "rmse", "mae", "trainRSquared"), "verdict": ("accuracy", "trainAccuracy", "auc", "f1"), "grade": ("accuracy", "trainAccuracy", "f1")}


def model_metrics(spark, sf_dir):
    """The metrics of one fit per task kind, long form: counts as they are, others by their bounds."""
    out = []
    for target, task in (("outcome", "auto"), ("verdict", "auto"), ("grade", "multiclass")):
        metrics = fit(spark, sf_dir, target, "rf", task, with_metrics=True).spec.metrics
        for name, value in metrics.items():
            if isinstance(value, (int, float)):
                low, high = BOUNDS.get(name, (None, None))
                inside = (low is None or value >= low) and (high is None or value <= high)
                out.append((target, name, None if name in BOUNDS else float(value), inside))
        out.append((target, "mae <= rmse", None, (metrics["mae"] or 0) <= (metrics["rmse"] or 0)))
    return spark.createDataFrame(out, "target string, metric string, value double, in_bounds boolean")


METRICS_SQL = " UNION ALL ".join(
    f"SELECT '{target}' AS target, unnest(['nRows', 'nFeatures', 'mae <= rmse', {', '.join(repr(n) for n in names)}]) AS metric,"
    f" unnest([cast(count(*) AS double), 4.0, NULL, {', '.join('NULL' for _ in names)}]) AS value, true AS in_bounds FROM ({ORDERS_SQL})"
    for target, names in KNOWN.items()
)


def model_quality(spark, sf_dir):
    """What can be said exactly about a fit: its rows, classes, test rows, and that it
    beats the constant answer (the mean, or the most frequent class) on them."""
    out = []
    for target, task in (("outcome", "auto"), ("verdict", "auto"), ("grade", "multiclass")):
        model = fit(spark, sf_dir, target, "rf", task, with_metrics=True)
        metrics, classes = model.spec.metrics, model.spec.classes or []
        if classes:
            support = [m["support"] for m in metrics["classMetrics"]]
            tested, better = sum(support), metrics["accuracy"] > max(support) / sum(support)
        else:
            tested = model.frame.where("split = 'test'").count()
            better = metrics["rSquared"] > 0
        out.append(
            (target, model.spec.task_kind, metrics["nRows"], metrics["nFeatures"], tested, ",".join(classes), better)
        )
    return spark.createDataFrame(
        out,
        "target string, task_kind string, rows long, features int, test_rows long, classes string,"
        " beats_constant boolean",
    )


QUALITY_SQL = " UNION ALL ".join(
    f"SELECT '{target}' AS target, '{kind}' AS task_kind, count(*) AS rows, cast(4 AS int) AS features,"
    f" cast(ceil(0.25 * count(*)) AS bigint) AS test_rows, {classes} AS classes, true AS beats_constant"
    f" FROM ({ORDERS_SQL})"
    for target, kind, classes in (
        ("outcome", "regression", "''"),
        ("verdict", "binary", "string_agg(DISTINCT verdict, ',' ORDER BY verdict)"),
        ("grade", "multiclass", "string_agg(DISTINCT grade, ',' ORDER BY grade)"),
    )
)


def model_roundtrip(spark, sf_dir):
    """A boosted model before saving and after loading: scores per row, then drivers, a curve and what-if answers."""
    path = scratch(spark, "model")
    model = fit(spark, sf_dir, "verdict")
    save_model(model, path)
    loaded = load_model(spark, path)
    before = model.scored().select("row_key", F.col("probability").alias("before"))
    after = loaded.scored().select("row_key", F.col("probability").alias("after"))
    same = before.join(after, "row_key").select(
        F.lit("score").alias("part"), "row_key", (F.col("before") == F.col("after")).alias("same_after_loading")
    )

    def told(m):
        curve = explain.dependence(m, "month", class_name="NG").curve
        asked = scenarios(spark, sf_dir).where("scenario_id < 50")
        return (
            [(r["feature"], r["rank"], round(r["importance"], 9)) for r in m.importance(repeats=2).orderBy("rank").collect()],
            [(r["grid_id"], r["x"], round(r["y"], 9)) for r in curve.orderBy("grid_id").collect()],
            [(r["scenario_id"], r["predicted_class"], r["summary"]) for r in explain.whatif(m, asked).orderBy("scenario_id").collect()],
        )

    parts = [(name, None, a == b) for name, a, b in zip(("drivers", "curve", "whatif"), told(model), told(loaded))]
    return same.unionByName(spark.createDataFrame(parts, "part string, row_key long, same_after_loading boolean"))


ROUNDTRIP_SQL = """
SELECT 'score' AS part, o_orderkey AS row_key, true AS same_after_loading FROM orders
UNION ALL SELECT unnest(['drivers', 'curve', 'whatif']), NULL, true"""


def permutation_importance_gbt(spark, sf_dir):
    """Per input what SQL can state: importance is not negative, shares add up, ranks are places, the idle input is last but one at best."""
    found = fit(spark, sf_dir, "outcome").importance()
    all_ = Window.partitionBy()
    return found.select(
        "feature_pos", "feature", (F.col("importance") >= 0).alias("not_negative"),
        (F.abs(F.sum("share").over(all_) - 1) < 1e-9).alias("shares_add_up"),
        (F.array_sort(F.collect_list("rank").over(all_)) == F.array(*[F.lit(i) for i in range(1, len(ORDER_FEATURES.names) + 1)])).alias("ranks_are_places"),
        (F.col("rank") == F.lit(1)).alias("leads"),
    )


IMPORTANCE_SQL = " UNION ALL ".join(
    f"SELECT cast({i} AS int) AS feature_pos, '{c}' AS feature, true AS not_negative, true AS shares_add_up, true AS ranks_are_places, {str(c == 'total_k').lower()} AS leads"
    for i, c in enumerate(ORDER_FEATURES.names, 1)
)


def pdp_gbt(spark, sf_dir):
    """The grid as it is, the curve by its bounds."""
    model = fit(spark, sf_dir, "verdict")
    grid = dependence.build_grid(model.frame, model.spec.features)
    curve = dependence.partial_dependence(
        model.frame, model.spec.features, model.scorer, grid, class_index=pick_class(model.scorer, "NG")
    )
    return curve.select("feature", "grid_id", F.round("x", 6).alias("x"), "x_label", F.col("y").between(0, 1).alias("is_chance"))


PDP_SQL = " UNION ALL ".join(
    f"SELECT feature, grid_id, {rounded('x')} AS x, x_label, true AS is_chance FROM ({curve_sql(c, ORDERS_SQL, '0')})" for c in ORDER_FEATURES.numeric
) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, cast(row_number() OVER (ORDER BY v) - 1 AS int) AS grid_id, cast(row_number() OVER (ORDER BY v) - 1 AS double) AS x, v AS x_label,"
    f" true AS is_chance FROM (SELECT DISTINCT {c} AS v FROM ({ORDERS_SQL}) WHERE {c} IS NOT NULL)" for c in ORDER_FEATURES.categorical
)


def whatif_probabilities(spark, sf_dir):
    model = fit(spark, sf_dir, "grade", task="multiclass")
    rows = whatif.scenario_rows(scenarios(spark, sf_dir), model.frame, model.spec.features)
    found = whatif.whatif(rows, model.spec.features, model.scorer)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p["probability"])
    return found.where(F.col("probabilities").isNotNull()).select(
        "scenario_id", (F.abs(total - 1) < 1e-9).alias("adds_up"), F.inline("probabilities"), F.col("prediction").alias("largest")
    ).select("scenario_id", "label", "adds_up", F.col("probability").between(0, F.col("largest")).alias("is_chance"))


PROBABILITIES_SQL = f"""
SELECT scenario_id, unnest([{', '.join(repr(g) for g in GRADES)}]) AS label, true AS adds_up, true AS is_chance FROM ({SCENARIOS_SQL})"""


def flagship(spark, sf_dir):
    """Raw lines to ranked, explained drivers: profile, prepare, fit, permute, tell."""
    raw = derive(
        wide_table(spark, sf_dir, "lineitem"),
        {
            "row_key": "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
            " cast(round(l_extendedprice * 100) AS bigint))",
            "quantity": "CASE WHEN l_partkey % 10 = 0 THEN 'n.a.' ELSE cast(l_quantity AS string) END",
            "discount": "l_discount",
            "tax": "l_tax",
            "flag": "l_returnflag",
            "status": "l_linestatus",
            "revenue": "l_quantity * 2 * (1 - l_discount) * (1 + l_tax)"
            " + CASE l_returnflag WHEN 'R' THEN 3.0 ELSE 0.0 END",
        },
    )
    typed, _ = load_table(raw)
    model = fit_model(typed, "revenue", with_metrics=False)
    ranked = explain_importance(model.frame, model.spec.features, model.scorer)
    return importance_insights(ranked, "revenue")


ENTRIES = {
    "fit_gbt_regression": (fit_gbt_regression, REGRESSION_SQL),
    "fit_gbt_binary": (fit_gbt_binary, VERDICT_SQL),
    "fit_gbt_multiclass": (fit_gbt_multiclass, GRADE_SQL),
    "fit_rf_regression": (fit_rf_regression, REGRESSION_SQL),
    "fit_rf_classification": (fit_rf_classification, GRADE_SQL),
    "fit_rf_documents": (fit_rf_documents, DOCUMENTS_SQL),
    "model_metrics": (model_metrics, METRICS_SQL),
    "model_quality": (model_quality, QUALITY_SQL),
    "model_roundtrip": (model_roundtrip, ROUNDTRIP_SQL),
    "permutation_importance_gbt": (permutation_importance_gbt, IMPORTANCE_SQL),
    "pdp_gbt": (pdp_gbt, PDP_SQL),
    "whatif_probabilities": (whatif_probabilities, PROBABILITIES_SQL),
    "flagship": (flagship, None),
}
