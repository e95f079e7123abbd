"""Trees grown from cells of equal bins, against Spark's own learners and against counting by hand."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from leverscope.operators import cells, ensemble, learners, order
from leverscope.operators.boosting import TreesModel
from leverscope.plans.train import fit_model

FEW = learners.LearnerSettings(trees=3)


@pytest.fixture(scope="module")
def table(spark):
    """Enough rows for the learners to place their bins over a sample."""
    base = spark.range(15_000).select(
        F.col("id").alias("row_key"),
        F.when(F.col("id") % 11 > 0, (F.col("id") * 7919 % 10_007) / 7).alias("a"),
        (F.col("id") * 53 % 12).cast("double").alias("b"),
        F.when(F.col("id") % 13 > 0, F.concat(F.lit("l"), (F.col("id") * 31 % 97 % 4).cast("string"))).alias("c"),
    )
    value = F.coalesce("a", F.lit(400.0)) / 100 - F.col("b") + F.when(F.col("c") == "l1", 5.0).otherwise(0.0) + F.col("row_key") * 17 % 101 / 25
    return base.withColumn("y", value).withColumn("two", F.when(value > 6, "hi").otherwise("lo")).withColumn(
        "three", F.when(value > 9, "x").when(value > 3, "y").otherwise("z")).cache()


def fitted(table, target, algorithm="gbr", task="auto", settings=FEW):
    return fit_model(table.select("row_key", "a", "b", "c", target), target, algorithm, task, settings=settings, with_metrics=False)


def answers(model):
    column = "probability" if model.spec.classes else "prediction"
    return np.array([r[column] for r in model.scored().orderBy("row_key").collect()])


KINDS = [("three", "gbr", "multiclass"), ("y", "rf", "auto")]


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize(("target", "algorithm", "task"), KINDS)
def test_rows_are_read_as_often_whatever_the_rounds_and_levels(spark, table, target, algorithm, task):
    name = f"cells {target} {algorithm}"
    small, large = (jobs(spark, f"{name} {n}", lambda s=s: fitted(table, target, algorithm, task, s)) for n, s in enumerate((
        learners.LearnerSettings(trees=2, boosting_depth=1, forest_depth=2), learners.LearnerSettings(trees=6, boosting_depth=3, forest_depth=6))))
    assert large <= small + 2  # not jobs per round or level; one more or less is Spark's own choice


@pytest.mark.parametrize(("target", "task"), [("y", "auto"), ("two", "auto"), ("three", "multiclass")])
def test_boosted_trees_are_those_of_sparks_learner(table, target, task, monkeypatch):
    mine = fitted(table, target, task=task)
    assert isinstance(mine.scorer.pipeline.stages[-1], TreesModel)
    monkeypatch.setattr(learners, "fit_on_cells", lambda *a: None)
    assert np.allclose(answers(mine), answers(fitted(table, target, task=task)), atol=1e-9)


def test_a_tree_of_all_rows_cuts_where_sparks_tree_cuts(table, monkeypatch):
    """Without draws a forest of one tree that tries every input has one answer."""
    settings = replace(FEW, trees=1, bootstrap=False, forest_depth=4)
    mine = fitted(table, "y", "rf", settings=settings)
    monkeypatch.setattr(learners, "fit_on_cells", lambda *a: None)
    assert np.allclose(answers(mine), answers(fitted(table, "y", "rf", settings=settings)), atol=1e-9)


def test_draws_follow_the_poisson_law_and_the_place_alone():
    place = np.arange(40_000)
    found = cells.draws(place, 5, 42)
    assert np.array_equal(found[123:456], cells.draws(place[123:456], 5, 42)) and not np.array_equal(found, cells.draws(place, 5, 43))
    shares = np.bincount(found.ravel(), minlength=4)[:4] / found.size
    assert np.allclose(shares, np.exp(-1) / np.array([1, 1, 2, 6]), atol=0.006)
    assert abs(np.corrcoef(found.T.astype(float))[0, 1:]).max() < 0.02


@pytest.mark.parametrize(("target", "task"), [("y", "auto")])
def test_forests_are_equal_to_the_last_bit_however_the_rows_arrive(table, target, task):
    settings = replace(FEW, forest_depth=5)
    one, other = (fitted(table.repartition(n), target, "rf", task, settings) for n in (2, 7))
    assert np.array_equal(answers(one), answers(other))


def test_sums_do_not_depend_on_the_order(spark):
    unit = cells.Unit.of(1e9)
    y = np.array([1e9, 0.1, -1e9, 0.2, 3e-7, 12345.678])
    for order in (np.arange(6), np.array([5, 3, 1, 0, 2, 4])):
        high, low = unit.split(y[order])
        assert unit.joined(high.sum(), low.sum()) == pytest.approx(12345.9780003, abs=1e-9)


def test_too_many_cells_are_left_to_sparks_learner(table, monkeypatch):
    monkeypatch.setattr(cells, "MOST_CELLS", 100)
    assert not isinstance(fitted(table, "two").scorer.pipeline.stages[-1], TreesModel)


def test_importance_moves_a_row_as_its_cell_and_meets_the_next_bucket(table):
    """Rows are shuffled with a number in place of their inputs, and no row holds its donors."""
    model = fitted(table, "y")
    trees = model.scorer.trees
    ready = trees.prepared(model.frame, "inputs").select("row_key", "inputs", "actual")
    coded = ensemble.cell_codes(ready, trees.trees, "row_key")
    assert [t for _, t in coded.dtypes] == ["bigint", "bigint", "double"]
    ordered = order.hash_buckets(coded, "row_key", 42, 2).repartition("hash_bucket").sortWithinPartitions("hash_bucket", "hash_order", "row_key")
    sums, rows = ensemble.added_cell_losses(ordered, trees.trees, 3)
    assert rows == 15_000
    line = ready.join(order.hash_buckets(ready, "row_key", 42, 2).select("row_key", "hash_order"), "row_key").orderBy("hash_order", "row_key").collect()
    x, y = np.array([r["inputs"] for r in line]), np.array([r["actual"] for r in line])
    answer = lambda rows: trees.trees.answers(trees.trees.raw(trees.trees.slots(rows)))[0]
    before = (answer(x) - y) ** 2
    for r in (1, 3):
        for j in range(3):
            changed = x.copy()
            changed[:, j] = np.roll(x[:, j], -r)
            assert sums[j + 1, r] == pytest.approx(((answer(changed) - y) ** 2 - before).sum(), rel=1e-9, abs=1e-6)
