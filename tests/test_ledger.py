import pytest
from pyspark.sql import functions as F

from leverscope.errors import AnalysisError
from leverscope.operators.profile import load_table
from leverscope.plans.ledger import Ledger, fold_trainings
from leverscope.sources.catalog import register_dataset
from leverscope.sources.synthetic import generate_process_quality


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "ledger"))


def train(ledger, version, dataset="d", minute=0, **values):
    ledger.remember_training(
        version_id=version, dataset_id=dataset, algorithm="gradient_boosting", trained_by="u1",
        trained_at=__import__("datetime").datetime(2024, 1, 1, 0, minute), **values,
    )


def decide(ledger, version, action, minute):
    ledger.decide(
        version, action, "qa", f"e{minute:02d}", note=f"at {minute}",
        decided_at=__import__("datetime").datetime(2024, 1, 2, 0, minute),
    )


def statuses(ledger, dataset="d"):
    return {r["version_id"]: r["status"] for r in ledger.versions(dataset).collect()}


def test_lifecycle(ledger):
    for i, v in enumerate(("v1", "v2", "v3")):
        train(ledger, v, minute=i)
    train(ledger, "other", dataset="e")
    assert statuses(ledger) == {"v1": "Draft", "v2": "Draft", "v3": "Draft"}
    decide(ledger, "v1", "approve", 1)
    decide(ledger, "v2", "approve", 2)
    decide(ledger, "other", "approve", 3)
    assert statuses(ledger) == {"v1": "Retired", "v2": "Approved", "v3": "Draft"}
    decide(ledger, "v2", "reject", 4)
    decide(ledger, "v1", "approve", 5)
    assert statuses(ledger) == {"v1": "Approved", "v2": "Rejected", "v3": "Draft"}
    assert statuses(ledger, "e") == {"other": "Approved"}
    with pytest.raises(AnalysisError, match="modelNotFound"):
        decide(ledger, "none", "approve", 6)


def test_numbers_names_and_headline(ledger, spark):
    train(ledger, "v1", metrics_json='{"accuracy": 0.9, "rSquared": null}')
    train(ledger, "v2", minute=5, metrics_json='{"accuracy": null, "rSquared": 0.7}')
    train(ledger, "v1", minute=9, metrics_json='{"accuracy": 0.95}')  # stored again: same version
    ledger.append("users", spark.createDataFrame([("u2", "Somebody")], "user_id string, username string"))
    rows = ledger.versions("d").collect()
    assert [(r["version_id"], r["version_number"], r["headline"]) for r in rows] == [("v2", 2, 0.7), ("v1", 1, 0.95)]
    assert {r["trained_by"] for r in rows} == {"u1"}  # no account: the id stays
    ledger.append("users", spark.createDataFrame([("u1", "Trainer")], "user_id string, username string"))
    assert {r["trained_by"] for r in ledger.versions("d").collect()} == {"Trainer"}


def test_preferred_version(ledger):
    from leverscope.plans.ledger import preferred_version

    for i, v in enumerate(("v1", "v2", "v3")):
        train(ledger, v, minute=i)
    pick = lambda: preferred_version(ledger.versions("d")).first()
    assert (pick()["version_id"], pick()["unapproved"]) == ("v3", True)
    decide(ledger, "v1", "approve", 1)
    assert (pick()["version_id"], pick()["unapproved"]) == ("v1", False)
    for minute, v in enumerate(("v1", "v2", "v3"), 2):
        decide(ledger, v, "reject", minute)
    assert pick()["version_id"] == "v3"


def test_catalog(ledger, spark):
    table, columns = load_table(generate_process_quality(spark, 40).drop("row_key"))
    first = register_dataset(ledger, "one", table, columns, "csv")
    register_dataset(ledger, "two", table.limit(20), columns, "csv", dataset_id="fixed")
    register_dataset(ledger, "two again", table, columns, "json", dataset_id="fixed")
    rows = ledger.datasets().collect()
    assert [r["name"] for r in rows] == ["two again", "one"]
    row = ledger.dataset("fixed").first()
    assert row["row_count"] == 40 and row["payload_kind"] == "json"
    assert row["preview_json"].count("Temperature") == 12
    assert spark.read.parquet(row["payload_path"]).count() == 40
    assert ledger.dataset(first).count() == 1
    with pytest.raises(AnalysisError, match="datasetNotFound"):
        ledger.dataset("none")


def test_audit_keeps_all_and_shows_two_hundred(ledger, spark):
    from leverscope.plans.ledger import audit_latest

    events = spark.range(250).select(
        F.col("id").cast("string").alias("event_id"), F.timestamp_seconds("id").alias("at"), F.lit("Train").alias("action")
    )
    ledger.append("audit", events)
    ledger.audit(event_id="last", action="Approve", entity_type="ModelVersion", entity_id="v1")
    shown = audit_latest(ledger.table("audit")).collect()
    assert len(shown) == 200 and shown[0]["event_id"] == "last" and shown[1]["event_id"] == "249"
    assert ledger.table("audit").count() == 251


def test_importance_is_computed_once(ledger, spark):
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame(
            [(i, f"f{i}", 1.0 / i, 0.1, "up", None, i) for i in (1, 2, 3)],
            "feature_pos int, feature string, importance double, share double, direction string,"
            " correlation double, rank int",
        )

    assert ledger.importance("m", compute).count() == 3
    assert [r["feature"] for r in ledger.importance("m", compute, top=2).orderBy("rank").collect()] == ["f1", "f2"]
    assert ledger.importance("m", compute, top=0).count() == 1
    late = ledger.importance("m", compute).selectExpr("*", "'zz' AS batch")  # another process that found nothing stored either
    ledger.append("importance", late)
    assert ledger.importance("m", compute).count() == 3
    assert len(calls) == 1


def test_whatif_notes(ledger, spark):
    results = spark.sql("SELECT 7 AS scenario_id, map('a', '1') AS applied, 2.5 AS prediction")
    ledger.remember_whatif("m", results)
    note = ledger.table("notes").first()
    assert note["note_id"] == "7" and note["request_json"] == '{"applied":{"a":"1"}}'
    assert note["response_json"] == '{"prediction":2.5}'


def test_trainings_of_one_time_fold_to_the_same_row_in_any_order(spark):
    rows = [("v1", 5, "gbr", ["a"]), ("v1", 5, "rf", ["b"]), ("v1", 3, "zz", ["c"])]
    found = set()
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        table = spark.createDataFrame(order, "version_id string, trained_at long, algorithm string, names array<string>").coalesce(1)
        row = fold_trainings(table).first()
        found.add((row["trained_at"], row["algorithm"], tuple(row["names"])))
    assert found == {(3, "rf", ("b",))}
