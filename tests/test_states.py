import json

import pytest
from pyspark.sql import functions as F

from leverscope.errors import AnalysisError
from leverscope.operators.profile import column_counts, dataset_overview, infer_types, load_table
from leverscope.operators.states import merge_states, profile_states, total_rows
from leverscope.plans.ledger import Ledger
from leverscope.sources.catalog import append_dataset, dataset_profile, read_dataset, register_dataset


def rows_of(df):
    return sorted(map(str, df.collect()))


def raw(spark, low, high):
    return spark.range(low, high).select(
        F.col("id").cast("string").alias("n"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("v"), F.col("id") % 37)).alias("level"),
        F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("id") * 0.5).alias("x"),
        F.when(F.col("id") % 2 == 0, "True").otherwise("False").alias("flag"),
        F.lit(None).cast("string").alias("none"),
    )


def test_merged_states_equal_one_pass_over_all(spark):
    whole = raw(spark, 0, 3000)
    parts = [profile_states(raw(spark, a, b), F.lit(f"b{a}")) for a, b in ((0, 10), (10, 1700), (1700, 3000))]
    states = parts[0].unionByName(parts[1]).unionByName(parts[2])
    merged = merge_states(states, total_rows(states))
    assert rows_of(infer_types(merged)) == rows_of(infer_types(column_counts(whole)))
    by_name = {r["name"]: r for r in merged.collect()}
    assert (by_name["x"]["least"], by_name["x"]["greatest"]) == (0.5, 1499.5)
    assert by_name["level"]["distinct_values"] == 37 and by_name["none"]["distinct_values"] == 0
    assert abs(by_name["n"]["distinct_values"] - 3000) < 200
    assert all(abs(q - e) < 30 for q, e in zip(by_name["n"]["quartiles"], (750, 1500, 2250)))
    assert by_name["none"]["quartiles"] is None and by_name["level"]["least"] is None


def test_states_by_a_column_and_columns_that_some_batches_lack(spark):
    one = profile_states(raw(spark, 0, 100), F.when(F.col("n") < 40, "early"))
    assert {(r["batch"], r["row_count"]) for r in one.collect()} == {("early", 40), (None, 60)}
    few = profile_states(spark.range(10).select((F.col("id") * 1.0).alias("n")), F.lit("numbers"))
    both = one.unionByName(few)
    found = {r["name"]: r for r in infer_types(merge_states(both, total_rows(both))).collect()}
    assert found["n"]["type"] == "numeric" and found["n"]["row_count"] == 110 and found["n"]["missing_count"] == 0
    assert found["flag"]["missing_count"] == 10


def test_an_append_reads_its_part_only_and_equals_a_full_profile(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    table, columns = load_table(raw(spark, 1000, 2000))
    id_ = register_dataset(ledger, "grows", table, columns, "csv")
    before = ledger.dataset(id_).first()
    append_dataset(ledger, id_, raw(spark, 0, 500), "second")
    append_dataset(ledger, id_, raw(spark, 0, 500), "second")  # a retry
    append_dataset(ledger, id_, raw(spark, 2000, 2010).drop("x"), "third")
    append_dataset(ledger, id_, raw(spark, 0, 0), "empty")
    after = ledger.dataset(id_).first()
    whole = read_dataset(ledger, id_)
    assert whole.count() == after["row_count"] == 1510 and before["row_count"] == 1000
    full = dataset_overview(infer_types(column_counts(whole))).first()
    assert json.loads(after["overview_json"]) == full.asDict()
    missing = {r["name"]: r["missing_count"] for r in infer_types(column_counts(whole)).collect()}
    assert {c["name"]: c["missing_count"] for c in json.loads(after["columns_json"])} == missing
    assert [r["n"] for r in json.loads(after["preview_json"])] == [float(i) for i in range(12)]
    read = dataset_profile(ledger, id_).inputFiles()
    assert read and all("/ledger/profiles/" in f for f in read)
    with pytest.raises(AnalysisError, match="invalidColumns"):
        append_dataset(ledger, id_, raw(spark, 0, 1).withColumn("more", F.lit(1)), "fourth")
