import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leverscope.operators import order
from leverscope.operators.joins import lookup_join

VALUES = {
    "spread": [random.Random(1).gauss(0, 5) for _ in range(5000)],
    "ties": [float(random.Random(i).randint(0, 6)) for i in range(5000)],
    "one_hot_value": [7.0] * 3000 + [float(i) for i in range(2000)],
    "constant": [3.0] * 5000,
    "two": [1.0] * 2500 + [2.0] * 2500,
    "single": [4.0],
}


def frame(spark, values, parts=5):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(parts)


@pytest.mark.parametrize("finish", [50, 50_000])
@pytest.mark.parametrize("name", VALUES)
def test_order_statistics_are_exact(spark, monkeypatch, name, finish):
    monkeypatch.setattr(order, "FINISH_BELOW", finish)
    values = sorted(VALUES[name])
    ranks = sorted({1, len(values), (len(values) + 1) // 2, max(1, len(values) // 4)})
    found = order.order_statistics(frame(spark, values), {"v": ranks})["v"]
    assert found == {r: values[r - 1] for r in ranks}


@pytest.mark.parametrize("finish", [50, 50_000])
@pytest.mark.parametrize("name", VALUES)
def test_quantiles_interpolate(spark, monkeypatch, name, finish):
    monkeypatch.setattr(order, "FINISH_BELOW", finish)
    probabilities = [0.0, 0.05, 0.5, 0.95, 1.0]
    found = order.exact_quantiles(frame(spark, VALUES[name]), ["v"], probabilities)["v"]
    assert found == pytest.approx(list(np.quantile(VALUES[name], probabilities)), rel=1e-12)


def test_bad_guesses_do_not_harm(spark, monkeypatch):
    monkeypatch.setattr(order, "FINISH_BELOW", 10)
    values = sorted(VALUES["spread"])
    found = order.order_statistics(
        frame(spark, values), {"v": [4000]}, guesses={"v": {4000: [-100.0, values[10], 1e9]}}
    )
    assert found["v"][4000] == values[3999]


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "a double, b double")
    assert order.exact_medians(df, ["a", "b"]) == {"a": None, "b": 2.0}


def test_many_columns_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr(order, "COLUMNS_PER_PASS", 2)
    df = spark.range(9).select(*[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(5)])
    assert order.exact_medians(df, df.columns) == {f"c{i}": 4.0 * i for i in range(5)}


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_hash_rank_is_one_order_whatever_the_layout(spark, digits):
    df = spark.range(500).toDF("k")
    base = {r["k"]: r["hash_rank"] for r in order.hash_rank(df, "k", 42, 2).collect()}
    other = {
        r["k"]: r["hash_rank"] for r in order.hash_rank(df.repartition(7), "k", 42, digits).collect()
    }
    assert sorted(base.values()) == list(range(1, 501))
    assert base == other
    assert base != {r["k"]: r["hash_rank"] for r in order.hash_rank(df, "k", 43, 2).collect()}


def test_rank_in_group_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", float(rng.randint(0, 50)), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(6)
    ranked = order.rank_in_group(df, ("g",), "v", "i", "place", rows_per_bucket=20)
    found = {(r["g"], r["i"]): r["place"] for r in ranked.collect()}
    expected = {}
    for g in {r[0] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1):
            expected[(g, r[2])] = place
    assert found == expected


def test_running_before_over_all_rows(spark):
    df = spark.createDataFrame([(float(i % 10), i) for i in range(100)], "v double, i long")
    cut = order.order_buckets(df, "v", "b", rows_per_bucket=10)
    out = order.running_before(cut, "b", [F.col("v"), F.col("i")], {"n": F.lit(1)}).collect()
    assert sorted(r["n_before"] for r in out) == list(range(100))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_lookup_equals_plain_join(spark, how):
    many = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k")
    )
    one = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("value"))
    plain = many.join(one, "k", how)
    # Few enough hot keys, but a lookup side counted as too long to broadcast.
    salted = lookup_join(many, one, "k", how, hot_rows=100, salts=4, broadcast_rows=30)
    key = lambda df: sorted((r["id"], r["k"], -1 if r["value"] is None else r["value"]) for r in df.collect())
    assert key(salted) == key(plain)
    assert "salt" in salted._jdf.queryExecution().optimizedPlan().toString()


def test_ceil_of_share():
    from leverscope.operators.prepare import holdout_allocation

    for rows in ([2, 2, 20], [100, 1000, 7], [24], [3, 3, 3, 3, 3, 3, 3, 3]):
        taken = holdout_allocation(rows)
        assert sum(taken) == math.ceil(0.25 * sum(rows))
        assert all(0 <= t <= n for t, n in zip(taken, rows))
