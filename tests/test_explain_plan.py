import pytest
from pyspark.sql import functions as F

from leverscope.errors import AnalysisError
from leverscope.operators.learners import LearnerSettings
from leverscope.plans import explain
from leverscope.plans.train import fit_model


@pytest.fixture(scope="module")
def models(spark):
    df = spark.range(60).select(
        F.col("id").alias("row_key"),
        F.col("id").cast("double").alias("heat"),
        F.element_at(F.array(F.lit("L1"), F.lit("L2")), (F.col("id") % 2 + 1).cast("int")).alias("line"),
        (F.col("id") * 2.0).alias("y"),
        F.when(F.col("id") >= 30, "NG").otherwise("OK").alias("verdict"),
    )
    settings = LearnerSettings(trees=5)
    return {
        "y": fit_model(df.drop("verdict").coalesce(1), "y", "rf", settings=settings),
        "verdict": fit_model(df.drop("y").coalesce(1), "verdict", "rf", settings=settings),
    }


def scenarios(spark):
    return spark.createDataFrame(
        [(1, 3, {"heat": "55"}), (2, 3, {}), (3, 999, {})], "scenario_id long, row_key long, edits map<string,string>"
    )


def test_drivers(models):
    found = explain.drivers(models["y"])
    assert found.classes is None and found.ranked.orderBy("rank").first()["feature"] == "heat"
    cards = {r["label"]: r for r in explain.drivers(models["verdict"]).classes.collect()}
    assert cards["NG"]["direction"] == "up" and cards["OK"]["direction"] == "down"
    assert sum(r["support"] for r in cards.values()) == 15
    assert explain.drivers(models["y"], top=1).ranked.count() == 1


def test_dependence(models):
    found = explain.dependence(models["y"], "heat", "line")
    row = found.insight.first()
    assert (row["code"], row["direction"]) == ("dependenceNumeric", "up")
    assert found.points.count() == 60 and {r["color"] for r in found.points.collect()} == {"L1", "L2"}
    by_class = explain.dependence(models["verdict"], "heat", class_name="NG").insight.first()
    assert by_class["code"] == "dependenceClassProbability" and by_class["args"]["classLabel"] == "NG"
    levels = explain.dependence(models["y"], "line")
    assert [r["x_label"] for r in levels.curve.orderBy("grid_id").collect()] == ["L1", "L2"]
    told = levels.insight.first()
    assert (told["code"], told["direction"], told["slope"], told["steepest_from"]) == ("dependenceCategorical", None, None, None)
    assert told["args"]["direction"] == "flat"
    with pytest.raises(AnalysisError, match="unknownFeature"):
        explain.dependence(models["y"], "LotNo")


def test_whatif(spark, models):
    found = {r["scenario_id"]: r for r in explain.whatif(models["y"], scenarios(spark)).collect()}
    assert found[1]["delta"] > 0 and found[1]["primary_feature"] == "heat"
    assert found[2]["delta"] == 0 and found[2]["code"] == "whatIfNoEdits"
    assert found[3]["status"] == "rowNotFound"
    assert found[1]["mean_prediction"] == pytest.approx(59, abs=6)
    told = {r["scenario_id"]: r for r in explain.whatif(models["verdict"], scenarios(spark)).collect()}
    assert (told[1]["baseline_class"], told[1]["predicted_class"], told[1]["hint"]) == ("OK", "NG", "higher")
    with pytest.raises(AnalysisError, match="invalidEdits"):
        explain.whatif(models["y"], scenarios(spark).withColumn("edits", F.lit("heat=3")))


def test_rows(models):
    rows = explain.rows(models["y"]).collect()
    assert len(rows) == 60
    assert all(r["residual"] == pytest.approx(r["predicted"] - r["actual"]) for r in rows)
    assert {r["actual"] for r in explain.rows(models["verdict"]).collect()} == {"OK", "NG"}
