"""Answers from the node table against those of the fitted pipeline itself."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from leverscope.operators import dependence, importance, whatif
from leverscope.operators.learners import LearnerSettings
from leverscope.plans.train import fit_model

SETTINGS = LearnerSettings(trees=6, boosting_depth=3, forest_depth=6)


class Plain:
    """The same pipeline without its node table."""

    def __init__(self, scorer):
        self.classes, self.score = scorer.classes, scorer.score


@pytest.fixture(scope="module")
def table(spark):
    base = spark.range(600).select(
        F.col("id").alias("row_key"),
        F.when(F.col("id") % 11 > 0, (F.col("id") * 37 % 101) / 7).alias("a"),
        (F.col("id") * 53 % 89).cast("double").alias("b"),
        F.lit(1.0).alias("idle"),
        F.when(F.col("id") % 13 > 0, F.concat(F.lit("l"), (F.col("id") % 4).cast("string"))).alias("c"),
    )
    value = F.coalesce("a", F.lit(3.0)) * 2 - F.col("b") / 10 + F.when(F.col("c") == "l1", 5.0).otherwise(0.0) + F.col("row_key") % 3
    return base.withColumn("y", value).withColumn("two", F.when(value > 10, "hi").otherwise("lo")).withColumn(
        "three", F.when(value > 20, "x").when(value > 5, "y").otherwise("z")).cache()


@pytest.fixture(scope="module", params=[("y", "gbr", "auto"), ("y", "rf", "auto"), ("two", "gbr", "auto"), ("three", "gbr", "multiclass"), ("three", "gbr apart", "multiclass"), ("three", "rf", "multiclass")],
                ids=lambda p: "-".join(p[:2]))
def model(request, table):
    target, algorithm, task = request.param
    settings = replace(SETTINGS, joint_classes=not algorithm.endswith("apart"))
    return fit_model(table.select("row_key", "a", "b", "idle", "c", target), target, algorithm.split()[0], task, settings=settings, with_metrics=False)


def test_raw_sums_give_the_pipelines_answers(model):
    trees = model.scorer.trees
    scored = trees.prepared(model.scored(), "inputs").collect()
    rows = np.array([r["inputs"] for r in scored])
    prediction, chances = trees.trees.answers(trees.trees.raw(trees.trees.slots(rows)))
    assert np.allclose(prediction, [r["prediction"] for r in scored], atol=1e-9)
    if chances is not None:
        assert np.allclose(chances, [r["probability"] for r in scored], atol=1e-9)


@pytest.mark.parametrize("digits", [None, 1])
def test_importance_is_that_of_rescoring_every_variant(model, digits):
    spec = model.spec
    fast = importance.permutation_importance(model.frame, spec.features, model.scorer, repeats=3, digits=digits).collect()
    slow = importance.permutation_importance(model.frame, spec.features, Plain(model.scorer), repeats=3, digits=digits).collect()
    assert {r["feature"]: pytest.approx(r["importance"], abs=1e-9) for r in slow} == {r["feature"]: r["importance"] for r in fast}
    assert {r["feature"]: r["importance"] for r in fast}["idle"] == 0


def test_curves_are_those_of_rescoring_every_variant(model):
    spec = model.spec
    grid = dependence.build_grid(model.frame, spec.features)
    key = ["feature", "grid_id"]
    fast = dependence.partial_dependence(model.frame, spec.features, model.scorer, grid).orderBy(*key).collect()
    slow = dependence.partial_dependence(model.frame, spec.features, Plain(model.scorer), grid).orderBy(*key).collect()
    assert [tuple(r)[:4] for r in fast] == [tuple(r)[:4] for r in slow]
    assert np.allclose([r["y"] for r in fast], [r["y"] for r in slow], atol=1e-9)
    if spec.classes is not None:
        key.append("class_index")
        both = [dependence.class_curves(model.frame, spec.features, s, grid).orderBy(*key).collect() for s in (model.scorer, Plain(model.scorer))]
        assert [tuple(r)[:6] for r in both[0]] == [tuple(r)[:6] for r in both[1]]
        assert np.allclose([r["y"] for r in both[0]], [r["y"] for r in both[1]], atol=1e-9)
        one = dependence.partial_dependence(model.frame, spec.features, model.scorer, grid, class_index=0).orderBy("feature", "grid_id").collect()
        assert [r["y"] for r in one] == [r["y"] for r in both[0] if r["class_index"] == 0]


def test_importance_joins_only_rows_at_bucket_ends_and_broadcasts_no_rows(model):
    plan = importance.donor_lists(model.frame.select("row_key", "a", "actual"), "row_key", ["a", "actual"], 8, digits=2)
    pairs = plan.select(F.explode(F.arrays_zip("donors", "repeats"))).count()
    assert pairs == 8 * 600
    assert {len(r["donors"]) for r in plan.select("donors").collect()} <= {1, 8}


def test_whatif_moves_nothing_after_the_join_of_scenarios(model, spark):
    spec = model.spec
    scenarios = spark.createDataFrame([(i, i * 7 % 650, {"a": "4", "c": "l2"}) for i in range(90)], "scenario_id long, row_key long, edits map<string,string>")
    rows = whatif.scenario_rows(scenarios, model.frame, spec.features)
    before = rows._jdf.queryExecution().executedPlan().toString().count("Exchange")
    found = whatif.whatif(rows, spec.features, model.scorer, model.standard)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == before
    got = {r["scenario_id"]: r for r in found.collect()}
    assert len(got) == 90
    frame = {r["row_key"]: r for r in model.frame.collect()}
    plain = [(i, *[frame[r["row_key"]][c] if which == 0 else {"a": 4.0, "c": "l2"}.get(c, frame[r["row_key"]][c]) for c in spec.features.names])
             for i, r in got.items() if r["status"] == "ok" for which in (0, 1)]
    answers = model.scorer.score(spark.createDataFrame([(n, *p) for n, p in enumerate(plain)], "n int, id long, a double, b double, idle double, c string")).orderBy("n").collect()
    for before_row, after_row in zip(answers[::2], answers[1::2]):
        r = got[before_row["id"]]
        if spec.classes is None:
            assert (r["baseline"], r["prediction"]) == (before_row["prediction"], after_row["prediction"])
        else:
            assert r["prediction"] == after_row["probability"][int(after_row["prediction"])]
            assert r["predicted_class"] == spec.classes[int(after_row["prediction"])]
    missing = [r for r in got.values() if r["status"] == "rowNotFound"]
    assert missing and all(r["prediction"] is None and r["contributions"] is None for r in missing)
