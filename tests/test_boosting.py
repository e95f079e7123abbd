"""Joint boosting of several classes against a plain version of the same rounds, and its round trip."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from leverscope.operators.boosting import SoftmaxBoosting, SoftmaxTreesModel


def table(spark, rows, classes):
    x, flag = F.col("id") * 37 % 11, F.col("id") % 2
    return spark.range(rows).select(
        array_to_vector(F.array(x.cast("double"), flag.cast("double"))).alias("inputs"),
        ((x + flag + F.col("id") % 5 / 3) * classes / 14).cast("int").cast("double").alias("actual"),
    )


def plain(inputs, actual, k, rounds, step):
    """Trees of one cut, every cut of every input tried."""
    shares = np.array([max((actual == c).mean(), 2.0**-23) for c in range(k)])
    margins = np.tile(np.log(shares), (len(actual), 1))
    for _ in range(rounds):
        powers = np.exp(margins - margins.max(axis=1, keepdims=True))
        chances = powers / powers.sum(axis=1, keepdims=True)
        for c in range(k):
            residual, bend = (actual == c) - chances[:, c], chances[:, c] * (1 - chances[:, c])
            options = []
            for j in range(inputs.shape[1]):
                for cut in np.unique(inputs[:, j])[:-1]:
                    low = inputs[:, j] <= cut
                    gain = residual[low].sum() ** 2 / low.sum() + residual[~low].sum() ** 2 / (~low).sum()
                    options.append((-round(gain, 9), j, cut))
            _, j, cut = min(options)
            low = inputs[:, j] <= cut
            for side in (low, ~low):
                margins[side, c] += step * (k - 1) / k * residual[side].sum() / bend[side].sum()
    powers = np.exp(margins - margins.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def scored(model, df):
    found = model.transform(df).select("inputs", "actual", "probability", "prediction").collect()
    return found, np.array([r["probability"] for r in found])


def test_rounds_are_those_of_the_plain_version(spark):
    df = table(spark, 400, 3)
    model = SoftmaxBoosting(classes=3, rounds=12, depth=1, step=0.3).fit(df)  # more rounds than lie between two checkpoints
    found, chances = scored(model, df)
    inputs, actual = np.array([r["inputs"].toArray() for r in found]), np.array([r["actual"] for r in found])
    assert np.allclose(chances, plain(inputs, actual, 3, 12, 0.3), atol=1e-9)
    assert [r["prediction"] for r in found] == list(chances.argmax(axis=1))


def test_a_class_without_rows_and_no_rows_to_score(spark):
    df = table(spark, 200, 3)
    model = SoftmaxBoosting(classes=5, rounds=2, depth=2).fit(df)
    _, chances = scored(model, df)
    assert chances.shape == (200, 5) and np.allclose(chances.sum(axis=1), 1) and chances[:, 4].max() < 1e-5
    assert scored(model, df.limit(0))[0] == []


def test_saved_in_a_pipeline_it_answers_the_same(spark, tmp_path):
    df = table(spark, 300, 4)
    model = SoftmaxBoosting(classes=4, rounds=3, depth=3).fit(df)
    PipelineModel([model]).save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert isinstance(again.stages[0], SoftmaxTreesModel) and again.stages[0].uid == model.uid
    assert scored(again, df)[0] == scored(model, df)[0]


def test_a_round_reads_rows_and_trees_but_no_round_before_it(spark):
    df = table(spark, 300, 3)
    one, many = (SoftmaxBoosting(classes=3, rounds=n, depth=1).fit(df) for n in (1, 3))
    assert len(many.trees.roots) == 3 * len(one.trees.roots) == 9
    first = len(one.trees.slot)
    assert np.array_equal(one.trees.value, many.trees.value[:first])


def test_more_partitions_give_the_same_chances(spark):
    df = table(spark, 300, 3).cache()
    _, a = scored(SoftmaxBoosting(classes=3, rounds=3, depth=2).fit(df.coalesce(1)), df)
    _, b = scored(SoftmaxBoosting(classes=3, rounds=3, depth=2).fit(df.repartition(5)), df)
    assert np.allclose(a, b, atol=1e-9)


def test_scoring_is_an_arrow_map_that_keeps_every_column(spark):
    df = table(spark, 60, 3)
    model = SoftmaxBoosting(classes=3, rounds=1, depth=1).fit(df)
    odd = df.select("*", F.create_map(F.lit("k"), "actual").alias("Line's no."), F.lit(None).alias("none"), F.struct(F.lit(1).alias("q")).alias("s`t"))
    out = model.transform(odd)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == [*odd.columns, "probability", "prediction"] and [f.dataType for f in out.schema][:5] == [f.dataType for f in odd.schema]
    assert [tuple(r)[:5] for r in out.collect()] == [tuple(r) for r in odd.collect()]
    again = model.transform(out)  # earlier answers are replaced
    assert sorted(again.columns) == sorted(out.columns) and again.count() == 60
