import math

import pytest
from pyspark.sql import functions as F

from leverscope.errors import AnalysisError
from leverscope.operators import dependence, importance, narrate, prepare, scorers, whatif
from leverscope.operators.prepare import Features
from leverscope.operators.scorers import ExprScorer

FEATURES = Features(("a", "b", "unused"), ("c",))
SCORER = ExprScorer("3.0 * a - b + CASE c WHEN 'x' THEN 1.0 ELSE 0.0 END")
CLASSES = ExprScorer(probabilities=["1 / (1 + exp(-a))", "1 - 1 / (1 + exp(-a))"], classes=["no", "yes"])


def frame(spark, n=300):
    return spark.range(n).select(
        F.col("id").alias("row_key"),
        ((F.col("id") * 7) % 11 - 5).cast("double").alias("a"),
        ((F.col("id") * 5) % 13).cast("double").alias("b"),
        ((F.col("id") * 3) % 17).cast("double").alias("unused"),
        F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 3 + 1).cast("int")).alias("c"),
    ).withColumn("actual", F.expr("3.0 * a - b + CASE c WHEN 'x' THEN 1.0 ELSE 0.0 END + (row_key % 5) * 0.1"))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("digits, n", [(1, 300), (2, 300), (3, 300), (1, 5), (2, 1)])
def test_each_repeat_is_a_permutation(spark, digits, n):
    pairs = importance.with_donors(frame(spark, n), "row_key", ["a", "b"], 8, 42, digits)
    found = pairs.select("repeat", "own.a", "own.b", "donor.a", "donor.b").toDF("r", "a", "b", "x", "y").collect()
    own = sorted((r["a"], r["b"]) for r in found if r["r"] == 1)
    for repeat in range(1, 9):
        assert sorted((r["x"], r["y"]) for r in found if r["r"] == repeat) == own


def test_importance_does_not_depend_on_layout(spark):
    df = frame(spark)
    base = rows_of(importance.permutation_importance(df, FEATURES, SCORER, digits=2))
    for other, digits in ((df.repartition(7), 2), (df.coalesce(1), 1), (df.repartition(3), 3)):
        found = rows_of(importance.permutation_importance(other, FEATURES, SCORER, digits=digits))
        for mine, theirs in zip(base, found):
            assert mine[:2] == theirs[:2] and mine[2] == pytest.approx(theirs[2], abs=1e-12)


def test_unused_input_has_no_importance_and_shares_sum_to_one(spark):
    ranked = importance.rank_importance(importance.permutation_importance(frame(spark), FEATURES, SCORER)).collect()
    by_name = {r["feature"]: r for r in ranked}
    assert by_name["unused"]["importance"] == 0.0
    assert by_name["a"]["rank"] == 1
    assert sum(r["share"] for r in ranked) == pytest.approx(1.0)
    assert sorted(r["rank"] for r in ranked) == [1, 2, 3, 4]


def test_importance_is_what_permuting_does(spark):
    """Against a plain computation on the driver, from the same donors."""
    df = frame(spark, 60)
    names = [*FEATURES.names, "actual"]
    pairs = importance.with_donors(df, "row_key", names, 4, 42, 1).collect()
    score = lambda r: 3.0 * r["a"] - r["b"] + (1.0 if r["c"] == "x" else 0.0)
    actual = [r["own"]["actual"] for r in pairs if r["repeat"] == 1]
    mean = sum(actual) / len(actual)
    spread = sum((y - mean) ** 2 for y in actual)
    base = sum((score(r["own"]) - r["own"]["actual"]) ** 2 for r in pairs if r["repeat"] == 1)
    expected = {}
    for name in FEATURES.names:
        drops = []
        for repeat in range(1, 5):
            loss = sum(
                (score(r["own"].asDict() | {name: r["donor"][name]}) - r["own"]["actual"]) ** 2
                for r in pairs
                if r["repeat"] == repeat
            )
            drops.append((loss - base) / spread)
        expected[name] = max(0.0, sum(drops) / 4)
    found = importance.permutation_importance(df, FEATURES, SCORER, repeats=4, digits=1)
    for r in found.collect():
        assert r["importance"] == pytest.approx(expected[r["feature"]], abs=1e-10)


def test_all_zero_importances_have_shares(spark):
    flat = ExprScorer("1.0")
    ranked = importance.rank_importance(importance.permutation_importance(frame(spark), FEATURES, flat))
    assert [(r["share"], r["feature"]) for r in ranked.orderBy("rank").collect()] == [
        (0.0, "a"), (0.0, "b"), (0.0, "unused"), (0.0, "c"),
    ]


def test_top_cuts_after_the_shares(spark):
    found = importance.permutation_importance(frame(spark), FEATURES, SCORER)
    whole = importance.rank_importance(found).orderBy("rank").collect()
    top = importance.rank_importance(found, 2).orderBy("rank").collect()
    assert [r["share"] for r in top] == [r["share"] for r in whole[:2]]
    assert importance.rank_importance(found, 0).count() == 1


def test_directions(spark):
    scored = SCORER.score(frame(spark)).withColumns({"flat": F.lit(1.0), "few": F.when(F.col("row_key") < 4, F.col("a"))})
    found = {r["feature"]: r for r in importance.numeric_direction(scored, ["a", "b", "flat", "few"], F.col("prediction")).collect()}
    assert found["a"]["direction"] == "up" and found["b"]["direction"] == "down"
    assert found["flat"]["correlation"] is None and found["flat"]["direction"] is None
    assert found["few"]["direction"] is None  # four pairs are not enough
    levels = importance.categorical_direction(scored.withColumn("one", F.lit("q")), ["c", "one"], F.col("prediction"))
    found = {r["feature"]: r["direction"] for r in levels.collect()}
    assert found == {"c": "up", "one": None}


def test_linear_model_has_linear_curves(spark):
    df = frame(spark)
    grid = dependence.build_grid(df, FEATURES)
    curves = dependence.partial_dependence(df, FEATURES, SCORER, grid)
    points = {}
    for r in curves.orderBy("feature", "grid_id").collect():
        points.setdefault(r["feature"], []).append((r["x"], r["y"], r["x_label"]))
    slopes = {f: {round((q[1] - p[1]) / (q[0] - p[0]), 9) for p, q in zip(v, v[1:])} for f, v in points.items()}
    assert slopes["a"] == {3.0} and slopes["b"] == {-1.0} and slopes["unused"] == {0.0}
    assert [p[2] for p in points["c"]] == ["x", "y", "z"]
    assert points["c"][0][1] - points["c"][1][1] == pytest.approx(1.0)
    described = {r["feature"]: r for r in dependence.describe_curves(curves).collect()}
    assert (described["a"]["direction"], described["b"]["direction"], described["unused"]["direction"]) == ("up", "down", "flat")
    assert (described["c"]["steepest_from"], described["c"]["steepest_to"]) == (0.0, 1.0)


def test_grid_rules(spark):
    wide = spark.range(1000).select(F.col("id").cast("double").alias("v"), F.lit("x").alias("c"))
    features = Features(("v",), ("c",))
    grid = [p.x for p in dependence.build_grid(wide, features, ["v"])]
    assert len(grid) == 24 and grid[0] == pytest.approx(49.95) and grid[-1] == pytest.approx(949.05)
    assert len(dependence.build_grid(wide.limit(79), features, ["v"])) == 16
    few = wide.withColumn("v", F.col("v") % 5)
    assert [p.x for p in dependence.build_grid(few, features, ["v"])] == [0.0, 1.0, 2.0, 3.0, 4.0]
    with pytest.raises(AnalysisError, match="unknownFeature"):
        dependence.build_grid(wide, features, ["other"])
    many = wide.withColumn("c", F.col("v").cast("string"))
    with pytest.raises(AnalysisError, match="unboundedLevels"):
        dependence.build_grid(many, features, ["c"])


def test_flat_and_single_point_curves(spark):
    df = spark.createDataFrame(
        [("one", 0, 1.0, 5.0), ("still", 0, 2.0, 1.0), ("still", 1, 2.0, 9.0)], "feature string, grid_id int, x double, y double"
    )
    found = {r["feature"]: r for r in dependence.describe_curves(df).collect()}
    assert found["one"]["slope"] is None and found["one"]["steepest_from"] is None
    assert (found["still"]["steepest_from"], found["still"]["steepest_to"]) == (2.0, 2.0)


def test_class_choice():
    assert scorers.pick_class(CLASSES, "no") == 0
    assert scorers.pick_class(CLASSES, "0") == 0
    assert scorers.pick_class(CLASSES, "7") == 1
    assert scorers.pick_class(CLASSES, None) == 1
    assert scorers.pick_class(SCORER, "no") is None


def scenarios(spark, rows):
    return spark.createDataFrame(rows, "scenario_id long, row_key long, edits map<string,string>")


def test_whatif(spark):
    df = frame(spark)
    asked = scenarios(spark, [(1, 5, {}), (2, 5, {"a": "100", "nope": "1"}), (3, 10**6, {"a": "1"}), (4, 6, {"c": "x"})])
    rows = whatif.scenario_rows(asked, df, FEATURES)
    fill = prepare.fill_values(df, FEATURES)
    found = {r["scenario_id"]: r for r in whatif.whatif(rows, FEATURES, SCORER, fill).collect()}
    assert found[1]["baseline"] == found[1]["prediction"] and found[1]["delta"] == 0.0
    assert found[2]["delta"] == pytest.approx(3.0 * (100.0 - found[2]["original"]["a"]))
    assert dict(found[2]["applied"]) == {"a": "100"}
    assert found[2]["contributions"][0]["feature"] == "a" and found[2]["contributions"][0]["rank"] == 1
    assert found[2]["contributions"][0]["delta"] == pytest.approx(300.0 - 3.0 * fill.numeric["a"])
    assert found[3]["status"] == "rowNotFound" and found[3]["prediction"] is None
    texts = narrate.whatif_narrative(
        whatif.whatif(rows, FEATURES, SCORER, fill), "target", list(FEATURES.names), narrate.contribution_ranks()
    )
    told = {r["scenario_id"]: r for r in texts.collect()}
    assert told[1]["code"] == "whatIfNoEdits" and told[2]["code"] == "whatIfChanged"
    assert told[2]["primary_feature"] == "a" and "a from" in told[2]["summary"]


def test_whatif_on_a_supplied_row(spark):
    asked = spark.createDataFrame(
        [(1, None, {"b": "2"}, {"a": "1", "b": "0", "c": "x"}), (2, 3, {"a": None}, None)],
        "scenario_id long, row_key long, edits map<string,string>, row map<string,string>",
    )
    rows = whatif.scenario_rows(asked, frame(spark), FEATURES)
    found = {r["scenario_id"]: r for r in whatif.whatif(rows, FEATURES, SCORER).collect()}
    assert (found[1]["baseline"], found[1]["prediction"]) == (4.0, 2.0)
    assert found[2]["edited"]["a"] is None  # an empty edit clears the cell


def test_hot_row_in_many_scenarios(spark, monkeypatch):
    from leverscope.operators import joins

    df = frame(spark)
    asked = spark.range(600).select(
        F.col("id").alias("scenario_id"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 300).alias("row_key"),
        F.create_map(F.lit("a"), F.col("id").cast("string")).alias("edits"),
    )
    plain = whatif.whatif(whatif.scenario_rows(asked, df, FEATURES), FEATURES, SCORER)
    expected = rows_of(plain.select("scenario_id", "baseline", "prediction"))
    monkeypatch.setattr(whatif, "small_enough", lambda *a: False)
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    spread = whatif.whatif(whatif.scenario_rows(asked, df, FEATURES), FEATURES, SCORER)
    assert rows_of(spread.select("scenario_id", "baseline", "prediction")) == expected


def test_whatif_classes(spark):
    asked = scenarios(spark, [(1, 5, {"a": "9"}), (2, 5, {"a": "-9"}), (3, 5, {})])
    rows = whatif.scenario_rows(asked, frame(spark), FEATURES)
    results = whatif.whatif(rows, FEATURES, CLASSES)
    found = {r["scenario_id"]: r for r in results.collect()}
    assert found[1]["predicted_class"] == "no" and found[2]["predicted_class"] == "yes"
    for r in found.values():
        assert sum(p["probability"] for p in r["probabilities"]) == pytest.approx(1.0)
        chance = 1 / (1 + math.exp(-r["original"]["a"]))
        focus = chance if r["predicted_class"] == "no" else 1 - chance
        assert r["baseline_focus"] == pytest.approx(focus)
    ranks = F.create_map(F.lit("a"), F.lit(1))
    told = narrate.whatif_class_narrative(results, "t", list(FEATURES.names), list(FEATURES.numeric), ranks)
    assert {r["scenario_id"]: r["hint"] for r in told.collect()} == {1: "higher", 2: "lower", 3: ""}


def test_texts_exist_for_every_rank(spark):
    ranked = importance.rank_importance(importance.permutation_importance(frame(spark), FEATURES, SCORER))
    ranked = ranked.withColumn("direction", F.lit("up"))
    told = narrate.importance_insights(ranked, "y").orderBy("rank").collect()
    assert [r["code"] for r in told] == ["topFactor", "highFactor", "highFactor", "otherFactor"]
    assert all(r["summary"] and r["feature"] in r["summary"] for r in told)
    assert told[0]["args"]["target"] == "y"


def test_reserved_names_are_refused():
    with pytest.raises(AnalysisError, match="reservedColumn"):
        scorers.check_reserved(["a", "Prediction"])
