import pytest
from pyspark.sql import functions as F

from leverscope.errors import AnalysisError
from leverscope.operators import dependence, whatif
from leverscope.operators.learners import LearnerSettings
from leverscope.operators.narrate import class_insights
from leverscope.operators.profile import load_table
from leverscope.operators.scorers import pick_class, response
from leverscope.plans.train import fit_model, load_model, save_model
from leverscope.sources.synthetic import generate_process_okng, generate_process_quality

# Enough trees for the invariants; the library's default is tried once below.
FEW = LearnerSettings(trees=12)


def raises(code, call):
    with pytest.raises(AnalysisError) as caught:
        call()
    assert caught.value.code == code


def keyed(spark, rows, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row_key long, {schema}")
    return df.coalesce(1)


def binary(spark):
    """A speed that settles the verdict, and a load that says nothing."""
    speeds = [31, 34, 38, 40, 33, 36, 71, 75, 79, 82, 73, 77]
    rows = [(float(v), 5.0 + i % 2, "bad" if v > 60 else "good") for i, v in enumerate(speeds)]
    return keyed(spark, rows, "speed double, load double, verdict string")


def multiclass(spark):
    """Three bands of speed; the load is the same in all rows."""
    speeds = [11, 12, 14, 15, 46, 47, 48, 49, 91, 93, 95, 98]
    rows = [(float(v), 7.0, "slow" if v < 30 else "fast" if v > 60 else "mid") for v in speeds]
    return keyed(spark, rows, "speed double, load double, band string")


@pytest.fixture(scope="module")
def binary_model(spark):
    return fit_model(binary(spark), "verdict", settings=FEW)


@pytest.fixture(scope="module")
def grade_model(spark):
    return fit_model(multiclass(spark), "band", task="multiclass", settings=FEW)


def test_two_values_are_classes(binary_model):
    metrics = binary_model.spec.metrics
    assert binary_model.spec.task_kind == "binary" and binary_model.spec.classes == ["bad", "good"]
    assert metrics["accuracy"] == metrics["f1"] == metrics["auc"] == 1.0
    assert metrics["confusion"] == {"labels": ["bad", "good"], "cells": [[0, 0, 6], [1, 1, 6]]}
    assert metrics["rSquared"] is None and metrics["nFeatures"] == 2


def test_multiclass(grade_model):
    metrics = grade_model.spec.metrics
    assert metrics["taskKind"] == "multiclass" and metrics["auc"] is None and metrics["accuracy"] == 1.0
    assert sorted(metrics["confusion"]["cells"]) == [[0, 0, 4], [1, 1, 4], [2, 2, 4]]
    rows = grade_model.scored().collect()
    assert all(sum(r["probability"]) == pytest.approx(1.0) for r in rows)
    assert grade_model.spec.numeric == ["speed", "load"]  # a constant number stays


def test_wrong_requests(spark):
    raises("invalidMulticlassTarget", lambda: fit_model(binary(spark), "verdict", task="multiclass"))
    raises("invalidBinaryTarget", lambda: fit_model(multiclass(spark), "band", task="binary"))
    raises("invalidAlgorithm", lambda: fit_model(binary(spark), "verdict", "forest"))
    raises("tooFewRows", lambda: fit_model(binary(spark).limit(7), "verdict"))
    # Text with three values is taken for a regression target and has no numbers.
    raises("tooFewRows", lambda: fit_model(multiclass(spark), "band"))


def test_class_curves_follow_the_class_asked_for(binary_model):
    features, scorer = binary_model.spec.features, binary_model.scorer
    grid = dependence.build_grid(binary_model.frame, features, ["speed"])
    ends = {}
    for name in ("bad", "good"):
        answer = response(scorer, pick_class(scorer, name))
        curve = dependence.partial_dependence(binary_model.frame, features, scorer, grid, answer)
        ys = [r["y"] for r in curve.orderBy("grid_id").collect()]
        ends[name] = ys[-1] - ys[0]
    assert ends["bad"] > 0.5 and ends["good"] == pytest.approx(-ends["bad"])


def test_whatif_has_class_and_probabilities(spark, binary_model):
    asked = spark.createDataFrame([(1, 0, {"speed": "80"})], "scenario_id long, row_key long, edits map<string,string>")
    rows = whatif.scenario_rows(asked, binary_model.frame, binary_model.spec.features)
    row = whatif.whatif(rows, binary_model.spec.features, binary_model.scorer, binary_model.spec.fill).first()
    assert (row["baseline_class"], row["predicted_class"]) == ("good", "bad")
    assert [p["label"] for p in row["probabilities"]] == ["bad", "good"]
    assert row["contributions"][0]["feature"] == "speed"


def test_forest_on_a_tiny_table(spark):
    rows = [(10.0 * i, float(i * 7 % 4), 100.0 - 6.0 * i) for i in range(11)]
    model = fit_model(keyed(spark, rows, "main double, side double, out double"), "out", "rf", settings=FEW)
    metrics = model.spec.metrics
    # Under 24 rows nothing is held out: both figures are over the same rows.
    assert metrics["rSquared"] == metrics["trainRSquared"] > 0.8
    assert model.importance().orderBy("rank").first()["feature"] == "main"


def test_id_like_text_is_skipped_and_missing_levels_are_fine(spark):
    rows = [(float(i), f"serial {i:04d}", [None, "north", "south", "east"][i % 4], 90.0 - i) for i in range(44)]
    model = fit_model(keyed(spark, rows, "hours double, serial string, site string, left_over double"), "left_over", "rf", settings=FEW)
    assert model.spec.features.names == ("hours", "site")
    unseen = spark.createDataFrame([(5.0, "west"), (None, None)], "hours double, site string")
    assert model.scorer.score(unseen).where("prediction IS NOT NULL").count() == 2


def test_falling_target_has_a_falling_curve(spark):
    rows = [(float(i), float(i % 2), 50.0 - 3.0 * i) for i in range(18)]
    model = fit_model(keyed(spark, rows, "depth double, side double, out double"), "out", settings=FEW)
    grid = dependence.build_grid(model.frame, model.spec.features, ["depth"])
    curve = dependence.partial_dependence(model.frame, model.spec.features, model.scorer, grid)
    row = dependence.describe_curves(curve).first()
    assert row["direction"] == "down" and row["slope"] < -0.5


def test_more_of_the_driving_input_predicts_more(spark):
    rows = [(float(i * i), float(i % 3), 4.0 * i) for i in range(22)]
    model = fit_model(keyed(spark, rows, "area double, side double, out double"), "out", settings=FEW)
    asked = spark.createDataFrame(
        [(1, 2, {"area": "9"}), (2, 2, {"area": "400"}), (3, 2, {})], "scenario_id long, row_key long, edits map<string,string>"
    )
    rows = whatif.scenario_rows(asked, model.frame, model.spec.features)
    found = {r["scenario_id"]: r for r in whatif.whatif(rows, model.spec.features, model.scorer).collect()}
    assert found[2]["prediction"] > found[1]["prediction"]
    assert found[3]["delta"] == 0.0


@pytest.mark.parametrize("algorithm", ["gbr", "rf"])
def test_fits_do_not_depend_on_the_layout_of_the_rows(spark, algorithm):
    df = spark.range(3000).select(
        F.col("id").alias("row_key"), (F.col("id") * 7919 % 1009).cast("double").alias("a"), (F.col("id") * 104729 % 613).cast("double").alias("b"),
        (F.col("id") * 7919 % 1009 + F.col("id") * 31 % 97).cast("double").alias("out"),
    )
    fits = [fit_model(df.repartition(n), "out", algorithm, settings=LearnerSettings(trees=4), with_metrics=False) for n in (1, 7)]
    mine, other = ({r["row_key"]: round(r["prediction"], 6) for r in m.scored().collect()} for m in fits)
    assert mine == other


def test_boolean_targets_keep_their_words(spark):
    raw = spark.createDataFrame([(i, str(i * 3 % 29), str(i * 3 % 29 > 14)) for i in range(40)], "row_key long, a string, flag string")
    typed, _ = load_table(raw, key="row_key")
    assert dict(typed.dtypes)["row_key"] == "bigint"
    assert fit_model(typed, "flag", "rf", settings=FEW, with_metrics=False).spec.classes == ["False", "True"]


def test_restored_models_explain_the_same(spark, tmp_path):
    from leverscope.plans import explain

    df = spark.range(48).select(F.col("id").alias("row_key"), F.col("id").cast("double").alias("a"), (F.col("id") * 5 % 7).cast("double").alias("b"),
                                F.when(F.col("id") > 20, "up").otherwise("down").alias("side"))
    model = fit_model(df, "side", settings=LearnerSettings(trees=4), with_metrics=False)
    save_model(model, str(tmp_path / "m"))
    loaded = load_model(spark, str(tmp_path / "m"))
    for told in (lambda m: explain.drivers(m).ranked, lambda m: explain.drivers(m).classes, lambda m: explain.dependence(m, "a").curve, explain.rows):
        # Sums of doubles may be added up in another order.
        mine, other = (sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in told(m).collect()) for m in (model, loaded))
        assert mine == other
    twice = spark.createDataFrame([(1, 2, {"a": "9"}), (1, 3, {})], "scenario_id long, row_key long, edits map<string,string>")
    raises("duplicateScenarios", lambda: explain.whatif(loaded, twice))
    assert explain.whatif(loaded, twice.limit(1)).count() == 1


def test_generated_process_is_driven_by_temperature(spark):
    """The library's default size, on the published schema."""
    typed, _ = load_table(generate_process_quality(spark, 160, 7).coalesce(1))
    model = fit_model(typed, "TargetConductivity")
    assert model.spec.metrics["rSquared"] > 0.5 and model.spec.metrics["rmse"] >= 0
    ranked = model.importance().orderBy("rank").collect()
    assert ranked[0]["feature"] == "Temperature" and ranked[0]["share"] >= 0.25
    assert ranked[1]["share"] >= 0.05
    assert all(r["importance"] >= 0 for r in ranked)


def test_generated_verdicts_are_driven_by_temperature(spark):
    from leverscope.operators import evaluate, importance

    typed, _ = load_table(generate_process_okng(spark, 160, 7).coalesce(1))
    model = fit_model(typed, "QualityResult", task="binary", settings=FEW)
    assert model.importance().orderBy("rank").first()["feature"] == "Temperature"
    scored = model.scored()
    counts = evaluate.class_counts(evaluate.confusion_matrix(scored, model.spec.classes))
    push = importance.class_push(scored, "Temperature", model.spec.classes)
    cards = class_insights(evaluate.class_metrics(counts), push, "QualityResult").collect()
    assert {r["label"]: r["direction"] for r in cards} == {"NG": "up", "OK": "down"}


@pytest.mark.parametrize("name", ["binary_model", "grade_model"])
def test_saved_models_score_the_same(spark, tmp_path, request, name):
    model = request.getfixturevalue(name)
    path = str(tmp_path / "model")
    save_model(model, path)
    loaded = load_model(spark, path, model.frame)
    assert loaded.spec == model.spec
    mine = {r["row_key"]: r["probability"] for r in model.scored().collect()}
    assert mine == {r["row_key"]: r["probability"] for r in loaded.scored().collect()}


def test_unreadable_model(spark, tmp_path):
    raises("badArtifact", lambda: load_model(spark, str(tmp_path / "none")))


def test_numeric_two_value_target(spark):
    rows = [(float(i), float(i >= 15)) for i in range(30)]
    model = fit_model(keyed(spark, rows, "x double, y double"), "y", "rf", settings=FEW)
    assert model.spec.classes == ["0", "1"]
    split = {r["split"]: r["n"] for r in model.frame.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert split == {"test": 8, "train": 22}


def test_names_with_dots_and_signs(spark):
    rows = [(float(i), ["x y", "z'", None][i % 3], 2.0 * i) for i in range(30)]
    df = keyed(spark, rows, "`Temp. (°C)` double, `Line's no.` string, `y.1` double")
    model = fit_model(df, "y.1", settings=LearnerSettings(trees=4))
    assert model.spec.features.names == ("Temp. (°C)", "Line's no.")
    assert model.importance(repeats=2).orderBy("rank").first()["feature"] == "Temp. (°C)"
    grid = dependence.build_grid(model.frame, model.spec.features)
    curves = dependence.partial_dependence(model.frame, model.spec.features, model.scorer, grid)
    assert curves.where("x_label = 'x y'").count() == 1
    asked = spark.createDataFrame([(1, 2, {"Temp. (°C)": "29"})], "scenario_id long, row_key long, edits map<string,string>")
    rows = whatif.scenario_rows(asked, model.frame, model.spec.features)
    found = whatif.whatif(rows, model.spec.features, model.scorer, model.spec.fill).first()
    assert found["delta"] > 0 and len(found["contributions"]) == 2
