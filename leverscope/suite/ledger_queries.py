"""Governance tables, with the event log as the record of what happened.

A user stands for a dataset and ``user-digit`` for a model version; signups are
trainings, purchases approvals, errors rejections and views dataset uploads.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leverscope.plans import ledger
from leverscope.suite.frames import derive, rounded, select_sql, table
from leverscope.suite.profile_queries import scratch

K = "cast(regexp_extract(props, '([0-9]+)', 1) AS int)"
VERSION = f"concat(user_id, '-', {K} % 10)"
MOMENT = "%Y-%m-%d %H:%M:%S"

TRAININGS = {
    "version_id": VERSION,
    "dataset_id": "cast(user_id AS string)",
    "trained_at": "ts",
    "trained_by": "concat('u', user_id % 30)",
    "metrics_json": (
        f"CASE WHEN user_id % 2 = 0 THEN concat('{{\"accuracy\": 0.', {K} + 100, '}}')"
        f" ELSE concat('{{\"accuracy\": null, \"rSquared\": 0.', {K} + 100, '}}') END"
    ),
    "event_type": "event_type",
}
DECISIONS = {
    "event_id": "event_id",
    "version_id": VERSION,
    "dataset_id": "cast(user_id AS string)",
    "action": "CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' END",
    "decided_at": "ts",
    "decided_by": "concat('u', event_id % 30)",
    "note": "event_type",
}
UPLOADS = {
    "dataset_id": "cast(user_id AS string)",
    "name": f"concat('upload-', {K})",
    "created_at": "ts",
    "row_count": "event_id",
    "event_type": "event_type",
}


def trainings(spark, sf_dir):
    df = derive(table(spark, sf_dir, "events"), TRAININGS)
    return ledger.fold_trainings(df.where("event_type = 'signup'").drop("event_type"))


def decisions(spark, sf_dir):
    """Only versions that exist can be decided on."""
    df = derive(table(spark, sf_dir, "events"), DECISIONS).where("action IS NOT NULL")
    return df.join(trainings(spark, sf_dir).select("version_id"), "version_id", "left_semi")


def numbered(spark, sf_dir):
    return ledger.version_numbers(
        trainings(spark, sf_dir).select("version_id", "dataset_id", "trained_by", "trained_at")
    )


def version_numbers(spark, sf_dir):
    return numbered(spark, sf_dir).select("dataset_id", "version_id", "version_number")


FOLDED_SQL = f"""
folded AS (
  SELECT version_id, min(trained_at) AS trained_at, any_value(dataset_id) AS dataset_id,
         any_value(trained_by) AS trained_by, arg_max(metrics_json, trained_at) AS metrics_json
  FROM ({select_sql("events", TRAININGS)}) WHERE event_type = 'signup' GROUP BY version_id),
numbered AS (SELECT *, cast(row_number() OVER (PARTITION BY dataset_id ORDER BY trained_at, version_id) AS int)
                       AS version_number FROM folded)"""
NUMBERS_SQL = f"WITH {FOLDED_SQL} SELECT dataset_id, version_id, version_number FROM numbered"


def with_status(spark, sf_dir):
    return ledger.version_status(numbered(spark, sf_dir), decisions(spark, sf_dir))


def version_status(spark, sf_dir):
    return with_status(spark, sf_dir).select(
        "dataset_id",
        "version_id",
        "status",
        "decided_by",
        F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss").alias("decided_at"),
        "note",
    )


# Stated per version: its last decision, and whether a later approval exists
# for another version of the dataset.
STATUS_SQL = f"""
{FOLDED_SQL},
decided AS (SELECT d.* FROM ({select_sql("events", DECISIONS)}) d JOIN folded f ON f.version_id = d.version_id
            WHERE action IS NOT NULL),
last_own AS (SELECT * FROM decided QUALIFY
             row_number() OVER (PARTITION BY version_id ORDER BY decided_at DESC, event_id DESC) = 1),
status_found AS (
  SELECT n.*, l.decided_by, l.decided_at, l.note,
         CASE WHEN l.action IS NULL THEN 'Draft' WHEN l.action = 'reject' THEN 'Rejected'
              WHEN EXISTS (SELECT 1 FROM decided o WHERE o.dataset_id = n.dataset_id AND o.action = 'approve'
                           AND o.version_id <> n.version_id AND o.decided_at > l.decided_at) THEN 'Retired'
              ELSE 'Approved' END AS status
  FROM numbered n LEFT JOIN last_own l ON l.version_id = n.version_id)"""
VERSION_STATUS_SQL = f"""
WITH {STATUS_SQL}
SELECT dataset_id, version_id, status, decided_by, strftime(decided_at, '{MOMENT}') AS decided_at, note
FROM status_found"""


def version_list(spark, sf_dir):
    """Some versions have no job; some trainers have no account."""
    jobs = trainings(spark, sf_dir).where("version_id NOT LIKE '%-3'").select(
        "version_id", "metrics_json"
    )
    users = table(spark, sf_dir, "nation").selectExpr(
        "concat('u', n_nationkey) AS user_id", "n_name AS username"
    )
    found = ledger.version_list(with_status(spark, sf_dir), jobs, users)
    return found.select(
        "dataset_id", "version_id", "version_number", "status", "trained_by",
        F.round("headline", 6).alias("headline"),
    )


VERSION_LIST_SQL = f"""
WITH {STATUS_SQL}
SELECT dataset_id, version_id, version_number, status, coalesce(n_name, trained_by) AS trained_by,
       CASE WHEN version_id NOT LIKE '%-3'
            THEN {rounded("cast(regexp_extract(metrics_json, '(0[.][0-9]+)', 1) AS double)")} END AS headline
FROM status_found LEFT JOIN nation ON concat('u', n_nationkey) = trained_by
ORDER BY dataset_id, version_number DESC"""


def preferred_version(spark, sf_dir):
    return ledger.preferred_version(with_status(spark, sf_dir))


PREFERRED_SQL = f"""
WITH {STATUS_SQL}
SELECT dataset_id, version_id, version_number, status, status <> 'Approved' AS unapproved FROM status_found
QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY
  CASE status WHEN 'Approved' THEN 0 WHEN 'Draft' THEN 1 ELSE 2 END, version_number DESC) = 1"""


def uploads(spark, sf_dir):
    df = derive(table(spark, sf_dir, "events"), UPLOADS)
    return df.where("event_type = 'view'").drop("event_type")


def catalog_upsert(spark, sf_dir):
    return ledger.latest_per_key(uploads(spark, sf_dir), "dataset_id", "created_at", "name").select(
        "dataset_id", "name", "row_count"
    )


UPSERT_SQL = f"""
SELECT dataset_id, name, row_count, created_at FROM ({select_sql("events", UPLOADS)}) WHERE event_type = 'view'
QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, name DESC) = 1"""


def dataset_list(spark, sf_dir):
    latest = ledger.latest_per_key(uploads(spark, sf_dir), "dataset_id", "created_at", "name")
    return ledger.dataset_list(latest).select(
        "dataset_id", "name", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")
    )


DATASET_LIST_SQL = f"""
SELECT dataset_id, name, strftime(created_at, '{MOMENT}') AS created_at FROM ({UPSERT_SQL}) ORDER BY created_at DESC"""

AUDIT = {"event_id": "event_id", "at": "ts", "user_id": "user_id", "action": "event_type"}


def audit_latest(spark, sf_dir):
    audit = derive(table(spark, sf_dir, "events"), AUDIT)
    return ledger.audit_latest(audit).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


AUDIT_SQL = f"""
SELECT event_id, strftime(ts, '{MOMENT}') AS at, user_id, event_type AS action FROM events
ORDER BY ts DESC, event_id DESC LIMIT 200"""

def whatif_notes(spark, sf_dir):
    """Answers kept as notes and read back from their JSON."""
    book = ledger.Ledger(spark, scratch(spark, "notes"))
    answers = table(spark, sf_dir, "events").selectExpr(
        "event_id AS scenario_id", "map('kind', event_type) AS applied", "event_id * 2 AS prediction"
    )
    book.remember_whatif("m1", answers)
    return book.table("notes").select(
        "note_id",
        "model_id",
        F.get_json_object("request_json", "$.applied.kind").alias("kind"),
        F.get_json_object("response_json", "$.prediction").cast("long").alias("prediction"),
    )


NOTES_SQL = "SELECT cast(event_id AS varchar) AS note_id, 'm1' AS model_id, event_type AS kind, event_id * 2 AS prediction FROM events"


def importance_cache(spark, sf_dir):
    """A stored table answers the second request; ``top`` only filters it."""
    book = ledger.Ledger(spark, scratch(spark, "importance"))
    amounts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("event_id").alias("amount"))
    rank = F.row_number().over(Window.orderBy(F.col("amount").desc(), "event_type"))  # a row per event type
    found = amounts.withColumn("rank", rank).selectExpr(
        "rank AS feature_pos", "event_type AS feature", "cast(amount AS double) AS importance", "cast(NULL AS double) AS share",
        "'up' AS direction", "cast(NULL AS double) AS correlation", "rank",
    )
    book.importance("m1", lambda: found)
    return book.importance("m1", lambda: F.raise_error("computed twice"), top=3).select("model_id", "feature", "importance", "rank")


CACHE_SQL = """
SELECT 'm1' AS model_id, event_type AS feature, cast(sum(event_id) AS double) AS importance,
       cast(row_number() OVER (ORDER BY sum(event_id) DESC, event_type) AS int) AS rank
FROM events GROUP BY event_type QUALIFY row_number() OVER (ORDER BY sum(event_id) DESC, event_type) <= 3
"""

ENTRIES = {
    "whatif_notes": (whatif_notes, NOTES_SQL),
    "importance_cache": (importance_cache, CACHE_SQL),
    "catalog_upsert": (catalog_upsert, f"SELECT dataset_id, name, row_count FROM ({UPSERT_SQL})"),
    "version_numbers": (version_numbers, NUMBERS_SQL),
    "version_status": (version_status, VERSION_STATUS_SQL),
    "version_list": (version_list, VERSION_LIST_SQL),
    "preferred_version": (preferred_version, PREFERRED_SQL),
    "dataset_list": (dataset_list, DATASET_LIST_SQL),
    "audit_latest": (audit_latest, AUDIT_SQL),
}
