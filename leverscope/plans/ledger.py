"""Model governance as append-only tables folded to their current state.

Nothing is updated in place: registrations, trainings, decisions, notes and audit
events are appended, and the state is an aggregate over them. Aggregates are
partial (one row per key and task is shuffled), so a dataset with most of the
versions needs no task of its own.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leverscope.errors import AnalysisError
from leverscope.operators.joins import lookup_join
from leverscope.operators.order import rank_in_group
from leverscope.operators.states import FIELDS as PROFILE_FIELDS

# Version states, the decisions that lead to them, rows in a listing.
DRAFT, APPROVED, REJECTED, RETIRED = "Draft", "Approved", "Rejected", "Retired"
APPROVE, REJECT = "approve", "reject"
AUDIT_ROWS = 200

SCHEMAS = {
    "datasets": "dataset_id string, name string, created_at timestamp, row_count long, "
    "columns_json string, preview_json string, overview_json string, payload_kind string, "
    "payload_path string",
    "trainings": "version_id string, dataset_id string, target string, algorithm string, "
    "task string, metrics_json string, feature_names array<string>, model_path string, "
    "trained_by string, trained_at timestamp",
    "decisions": "event_id string, version_id string, dataset_id string, action string, "
    "decided_by string, decided_at timestamp, note string",
    "users": "user_id string, username string",
    "notes": "note_id string, model_id string, created_at timestamp, request_json string, "
    "response_json string",
    "importance": "model_id string, feature_pos int, feature string, importance double, "
    "share double, direction string, correlation double, rank int, batch string",
    "profiles": "dataset_id string, registration string, payload string, " + PROFILE_FIELDS,
    "audit": "event_id string, at timestamp, user_id string, action string, "
    "entity_type string, entity_id string, detail_json string",
}


def latest_per_key(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row per key, by aggregation."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return (
        rows.groupBy(F.col(key).alias("fold_key"))
        .agg(F.max_by(whole, F.struct(at, tie)).alias("row"))
        .select("row.*")
    )


def dataset_list(datasets: DataFrame, order: str = "created_at", key: str = "dataset_id") -> DataFrame:
    return datasets.orderBy(F.desc(order), F.desc(key))


def fold_trainings(trainings: DataFrame) -> DataFrame:
    """One row per version: first training time, everything else from the last one; of equal times the greater row as JSON."""
    whole = F.struct(*[F.col(c) for c in trainings.columns if c not in ("version_id", "trained_at")])
    return trainings.groupBy("version_id").agg(
        F.min("trained_at").alias("trained_at"),
        F.max_by(whole, F.struct("trained_at", F.to_json(whole))).alias("row"),
    ).select("version_id", "trained_at", "row.*")


def version_numbers(versions: DataFrame, rows_per_bucket: int = 500_000) -> DataFrame:
    """Add ``version_number``: 1, 2, ... per dataset in order of training."""
    start = F.lit("1970-01-01").cast(versions.schema["trained_at"].dataType)
    timed = versions.withColumn(
        "trained_micros", F.timestamp_diff("MICROSECOND", start, F.col("trained_at"))
    )
    return rank_in_group(
        timed, ("dataset_id",), "trained_micros", "version_id", "version_number", rows_per_bucket
    ).drop("trained_micros")


def version_status(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Add status, decided_by, decided_at, note.

    The last decision on a version settles it: none is Draft, a rejection Rejected.
    An approval holds unless a later one in the same dataset retired it.
    """
    when = F.struct("decided_at", "event_id")
    approved = F.col("action") == APPROVE
    # A decision is valid for the dataset its version belongs to.
    own = decisions.groupBy("version_id").agg(
        F.max_by(F.struct("action", "decided_by", "decided_at", "note"), when).alias("last")
    )
    newest = (
        decisions.where(approved)
        .groupBy("dataset_id")
        .agg(F.max_by("version_id", when).alias("newest_approval"))
    )
    joined = lookup_join(versions.join(own, "version_id", "left"), newest, "dataset_id")
    status = (
        F.when(F.col("last").isNull(), DRAFT)
        .when(F.col("last.action") == REJECT, REJECTED)
        .when(F.col("newest_approval") == F.col("version_id"), APPROVED)
        .otherwise(RETIRED)
    )
    return joined.select(
        *versions.columns,
        status.alias("status"),
        F.col("last.decided_by").alias("decided_by"),
        F.col("last.decided_at").alias("decided_at"),
        F.col("last.note").alias("note"),
    )


def headline_metric(metrics_json: Column) -> Column:
    """Accuracy when there is one, else R squared."""
    return F.coalesce(
        F.get_json_object(metrics_json, "$.accuracy").try_cast("double"),
        F.get_json_object(metrics_json, "$.rSquared").try_cast("double"),
    )


def version_list(versions: DataFrame, jobs: DataFrame, users: DataFrame) -> DataFrame:
    """Versions with their training job and the trainer's name, newest number first.

    Needs version_id, dataset_id, version_number, status, trained_by; a version
    without a job keeps its bare row, a trainer without an account their id.
    """
    with_job = versions.join(jobs, "version_id", "left")
    named = lookup_join(with_job, users.withColumnRenamed("user_id", "trained_by"), "trained_by")
    return (
        named.withColumn("trained_by", F.coalesce("username", "trained_by"))
        .withColumn("headline", headline_metric(F.col("metrics_json")))
        .drop("username")
        .orderBy("dataset_id", F.desc("version_number"))
    )


def preferred_version(versions: DataFrame) -> DataFrame:
    """Per dataset the newest Approved version, else the newest Draft, else the newest."""
    place = F.when(F.col("status") == APPROVED, 2).when(F.col("status") == DRAFT, 1).otherwise(0)
    return (
        versions.groupBy("dataset_id")
        .agg(
            F.max_by(
                F.struct("version_id", "version_number", "status"),
                F.struct(place, "version_number"),
            ).alias("v")
        )
        .select("dataset_id", "v.*", (F.col("v.status") != APPROVED).alias("unapproved"))
    )


def audit_latest(audit: DataFrame, rows: int = AUDIT_ROWS) -> DataFrame:
    return audit.orderBy(F.desc("at"), F.desc("event_id")).limit(rows)


class Ledger:
    """The tables under one folder of shared storage."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        schema = T.StructType.fromDDL(SCHEMAS[name])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing was appended yet

    def append(self, name: str, rows: DataFrame) -> None:
        wanted = T.StructType.fromDDL(SCHEMAS[name])
        cells = [
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in wanted
        ]
        rows.select(*cells).write.mode("append").parquet(f"{self.root}/{name}")

    def _append_one(self, table: str, /, **values) -> None:
        schema = T.StructType.fromDDL(SCHEMAS[table])
        stamped = {
            f.name: values.get(f.name) for f in schema if not isinstance(f.dataType, T.TimestampType)
        }
        given = T.StructType([f for f in schema if f.name in stamped])
        row = self.spark.createDataFrame([tuple(stamped[f.name] for f in given)], given)
        times = {
            f.name: F.lit(values[f.name]) if values.get(f.name) else F.current_timestamp()
            for f in schema
            if isinstance(f.dataType, T.TimestampType)
        }
        self.append(table, row.withColumns(times).coalesce(1))

    def remember_dataset(self, **values) -> None:
        self._append_one("datasets", **values)

    def remember_training(self, **values) -> None:
        self._append_one("trainings", **values)

    def decide(self, version_id: str, action: str, decided_by: str, event_id: str, **values) -> None:
        found = self.table("trainings").where(F.col("version_id") == version_id).first()
        if found is None:
            raise AnalysisError("modelNotFound", f"There is no version '{version_id}'.")
        self._append_one(
            "decisions",
            event_id=event_id,
            version_id=version_id,
            dataset_id=found["dataset_id"],
            action=action,
            decided_by=decided_by,
            **values,
        )

    def audit(self, **values) -> None:
        self._append_one("audit", **values)

    def remember_whatif(self, model_id: str, results: DataFrame) -> None:
        """Append a what-if run: the edits asked for and the answer, as JSON."""
        answer = [c for c in results.columns if c not in ("scenario_id", "applied")]
        self.append(
            "notes",
            results.select(
                F.col("scenario_id").cast("string").alias("note_id"),
                F.lit(model_id).alias("model_id"),
                F.current_timestamp().alias("created_at"),
                F.to_json(F.struct("applied")).alias("request_json"),
                F.to_json(F.struct(*answer)).alias("response_json"),
            ),
        )

    def importance(self, model_id: str, compute, top: int | None = None) -> DataFrame:
        """The stored importance table, computed and stored on first use.

        ``top`` filters the stored ranks; it never causes a second computation. Processes that
        compute at the same time each store a batch of their own; all read the one that sorts first.
        """
        def stored() -> DataFrame:
            return self.table("importance").where(F.col("model_id") == model_id).withColumn("batch", F.coalesce("batch", F.lit("")))

        def first() -> str | None:
            return stored().agg(F.min("batch")).first()[0]

        if first() is None:
            made = compute().withColumn("model_id", F.lit(model_id)).withColumn("batch", F.lit(uuid.uuid4().hex))
            self.append("importance", made)
        batch = first()
        found = stored().where(F.col("batch") == batch).drop("batch")
        return found if top is None else found.where(F.col("rank") <= max(1, top))

    def datasets(self) -> DataFrame:
        return dataset_list(
            latest_per_key(self.table("datasets"), "dataset_id", "created_at", "name")
        )

    def dataset(self, dataset_id: str) -> DataFrame:
        found = self.datasets().where(F.col("dataset_id") == dataset_id)
        if found.isEmpty():
            raise AnalysisError("datasetNotFound", f"There is no dataset '{dataset_id}'.")
        return found

    def versions(self, dataset_id: str | None = None) -> DataFrame:
        trainings, decisions = self.table("trainings"), self.table("decisions")
        if dataset_id is not None:
            trainings = trainings.where(F.col("dataset_id") == dataset_id)
            decisions = decisions.where(F.col("dataset_id") == dataset_id)
        folded = fold_trainings(trainings)
        numbered = version_numbers(folded.select("version_id", "dataset_id", "trained_by", "trained_at"))
        jobs = folded.select(
            "version_id", "target", "algorithm", "task", "metrics_json", "feature_names", "model_path"
        )
        return version_list(version_status(numbered, decisions), jobs, self.table("users"))
