import math

import pytest
from pyspark.sql import functions as F

from leverscope.errors import AnalysisError
from leverscope.operators import prepare


def raises(code, call):
    with pytest.raises(AnalysisError) as caught:
        call()
    assert caught.value.code == code


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"t {kind}")


@pytest.mark.parametrize(
    "values, distinct, auto",
    [
        ([None, None], 0, "regression"),
        (["a", "a", None], 1, "regression"),
        (["a", "b", "a"], 2, "binary"),
        (["a", "b", "c"], 3, "regression"),
        (["a", "b", "c", "d"], 3, "regression"),
    ],
)
def test_cardinality(spark, values, distinct, auto):
    row = prepare.target_cardinality(column(spark, values), ["t"]).first()
    assert (row["distinct_values"], row["auto_task"]) == (distinct, auto)


def test_task_rules(spark):
    two, three = column(spark, ["OK", "NG", None]), column(spark, ["A", "B", "C"])
    assert prepare.resolve_task(two, "t").kind == "binary"
    assert prepare.resolve_task(three, "t", " AUTO ").kind == "regression"
    assert prepare.resolve_task(three, "t", "multiclass").kind == "multiclass"
    assert prepare.resolve_task(two, "t", "regression").kind == "regression"
    raises("invalidMulticlassTarget", lambda: prepare.resolve_task(two, "t", "multiclass"))
    raises("invalidBinaryTarget", lambda: prepare.resolve_task(three, "t", "binary"))
    raises("invalidTask", lambda: prepare.resolve_task(two, "t", "ranking"))


def test_id_like_needs_twenty_rows_for_the_half_rule(spark):
    df = spark.range(40).select(
        F.concat(F.lit("LOT-"), "id").alias("lot"),
        F.when(F.col("id") % 3 != 2, F.concat(F.lit("L"), F.col("id") % 3)).alias("line"),
        (F.col("id") % 21).cast("string").alias("over_half"),
        (F.col("id") % 20).cast("string").alias("half"),
    )
    found = {r["column_name"]: r["id_like"] for r in prepare.level_counts(df, df.columns).collect()}
    assert found == {"lot": True, "line": False, "over_half": True, "half": False}
    few = spark.range(12).select(F.col("id").cast("string").alias("lot"))
    assert not prepare.level_counts(few, ["lot"]).first()["id_like"]


def test_features_keep_constant_numbers(spark):
    df = spark.range(30).select("id", F.lit(2.0).alias("flat"), F.lit("x").alias("one"), "id").toDF(
        "row_key", "flat", "one", "y"
    )
    assert prepare.choose_features(df, "y", ("row_key",)).names == ("flat",)
    raises("noFeatures", lambda: prepare.choose_features(df.select("y", "one"), "y"))


def test_class_labels(spark):
    assert prepare.class_labels(column(spark, [1.0, 0.0, None], "double"), "t") == ["0", "1"]
    assert prepare.class_labels(column(spark, [0.5, 2.0], "double"), "t") == ["0.5", "2"]
    many = spark.range(2400).select(F.format_string("%04d", F.col("id") % 1200).alias("t"))
    classes = prepare.class_labels(many, "t")
    assert len(classes) == 1200
    found = prepare.encode_labels(many, "t", classes, "i").where("cast(t AS double) = i").count()
    assert found == 2400
    words = spark.createDataFrame([(True,), (False,), (None,)], "t boolean")
    assert prepare.class_labels(words, "t") == ["False", "True"]


def test_split_takes_two_passes_for_any_number_of_classes(spark):
    df = spark.range(9000).select(F.col("id").alias("k"), (F.col("id") % 1500).cast("string").alias("g"), (F.col("id") % 3).alias("h"))
    found = prepare.holdout_split(df, "k", stratify="g")
    rows = {r["split"]: r["n"] for r in found.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert rows == {"test": 2250, "train": 6750}
    per_class = found.where("split = 'test'").groupBy("g").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(per_class) == (1, 2)
    scans = [prepare.holdout_split(df, "k", stratify=c)._jdf.queryExecution().optimizedPlan().toString().count("Range (") for c in ("g", "h")]
    assert scans[0] == scans[1] <= 3


def split_of(df, **options):
    return {r["k"]: r["split"] for r in prepare.holdout_split(df, "k", **options).collect()}


@pytest.mark.parametrize("n", [24, 25, 26, 27, 1000])
def test_holdout_takes_a_quarter(spark, n):
    found = split_of(spark.range(n).toDF("k"))
    assert sum(s == "test" for s in found.values()) == math.ceil(0.25 * n)
    assert found == split_of(spark.range(n).toDF("k").repartition(5))


def test_small_tables_are_not_split(spark):
    assert set(split_of(spark.range(23).toDF("k")).values()) == {"both"}


def test_narrowed_split_equals_sorted_split(spark, monkeypatch):
    from leverscope.operators import order

    plain = split_of(spark.range(2000).toDF("k"))
    monkeypatch.setattr(order, "FINISH_BELOW", 5)
    assert split_of(spark.range(2000).toDF("k")) == plain


def test_stratified_split(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 300, "a").when(F.col("id") < 310, "b").otherwise("c").alias("g"))
    found = split_of(df, stratify="g")
    per = {g: sum(found[k] == "test" for k in r) for g, r in {"a": range(300), "b": range(300, 310), "c": range(310, 1000)}.items()}
    assert sum(per.values()) == 250 and per["a"] == 75 and per["b"] in (2, 3)


def test_a_class_with_one_row_ends_stratification(spark):
    df = spark.range(40).select(F.col("id").alias("k"), F.when(F.col("id") == 0, "x").otherwise("y").alias("g"))
    assert split_of(df, stratify="g") == split_of(df)


def test_rows_with_one_hash_are_told_apart_by_key(spark):
    # All rows share the hash: exactly the smallest keys must become test rows.
    df = spark.range(40).select(F.col("id").alias("k"), F.lit(5).cast("long").alias(prepare.SPLIT_HASH))
    found = split_of(df)
    assert sorted(k for k, s in found.items() if s == "test") == list(range(10))


def test_fill_values(spark):
    rows = [(1.0, "b"), (2.0, "a"), (3.0, "b"), (10.0, "a"), (None, None)]
    df = spark.createDataFrame(rows, "x double, c string")
    fill = prepare.fill_values(df, prepare.Features(("x",), ("c",)))
    assert fill == prepare.Fill({"x": 2.5}, {"c": "a"})  # tie: the smaller level
