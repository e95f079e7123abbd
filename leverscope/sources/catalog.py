"""Register a typed table: its data as Parquet, its description in the ledger."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leverscope.errors import AnalysisError
from leverscope.functions.scalars import quoted
from leverscope.operators.profile import (
    ColumnProfile,
    coerce,
    dataset_overview,
    infer_types,
    preview,
)
from leverscope.operators.states import FIELDS as STATE_FIELDS
from leverscope.operators.states import merge_states, profile_states, total_rows
from leverscope.plans.ledger import Ledger


def register_dataset(
    ledger: Ledger,
    name: str,
    table: DataFrame,
    columns: list[ColumnProfile],
    kind: str,
    dataset_id: str | None = None,
    order: list[str] | None = None,
) -> str:
    """Write the table beside the ledger and append its catalog row.

    Registering an id again replaces it in the listing; the earlier data stays where
    a running job may still be reading it.
    """
    dataset_id = dataset_id or uuid.uuid4().hex
    path = _write_part(ledger, dataset_id, None, table, uuid.uuid4().hex)
    stored = ledger.spark.read.parquet(path)
    shown = preview(stored, order or [stored.columns[0]])
    _remember(ledger, dataset_id, name, [asdict(c) for c in columns], shown, kind, path)
    return dataset_id


def append_dataset(
    ledger: Ledger, dataset_id: str, raw: DataFrame, batch: str, order: list[str] | None = None
) -> None:
    """Add rows to a registered table; only they are read and profiled.

    The part takes the table's types (a cell that does not fit becomes NULL), a column it lacks is
    NULL and one the table lacks is refused. A ``batch`` that is there already is left as it is, so
    a retried append adds nothing. A part counts from when its states are written.
    """
    found = ledger.dataset(dataset_id).first()
    first = ledger.spark.read.parquet(found["payload_path"])
    columns = json.loads(found["columns_json"])
    if not _states(ledger, dataset_id, found["payload_path"]).where(F.col("batch") == batch).isEmpty():
        return
    foreign = [c for c in raw.columns if c not in first.columns]
    if foreign:
        raise AnalysisError("invalidColumns", f"The table has no column {', '.join(foreign)}.")
    given = raw.withColumns({c: F.lit(None).cast("string") for c in first.columns if c not in raw.columns})
    typed = {c["name"] for c in columns}
    part = coerce(given, columns, tuple(c for c in first.columns if c not in typed)).select(
        *[quoted(c).cast(first.schema[c].dataType).alias(c) for c in first.columns]
    )
    path = _write_part(ledger, dataset_id, found["payload_path"], part, batch)
    earlier = ledger.spark.createDataFrame([(found["preview_json"],)], "j string").select(
        F.explode(F.from_json("j", T.ArrayType(first.schema))).alias("r")
    ).select("r.*")
    shown = preview(earlier.unionByName(ledger.spark.read.parquet(path)), order or [first.columns[0]])
    _remember(ledger, dataset_id, found["name"], columns, shown, found["payload_kind"], found["payload_path"])


def dataset_profile(ledger: Ledger, dataset_id: str) -> DataFrame:
    """The merged profile of all parts, a row per column; reads states, no data."""
    states = _states(ledger, dataset_id, ledger.dataset(dataset_id).first()["payload_path"])
    return merge_states(states, total_rows(states))


def read_dataset(ledger: Ledger, dataset_id: str) -> DataFrame:
    """All parts of a registered table; folders of appends that never finished are not among them."""
    states = _states(ledger, dataset_id, ledger.dataset(dataset_id).first()["payload_path"])
    return ledger.spark.read.parquet(*sorted(r[0] for r in states.select("payload").distinct().collect()))


def _states(ledger: Ledger, dataset_id: str, registration: str) -> DataFrame:
    """States of the parts in use: of one batch written twice at once, the folder that sorts first."""
    rows = ledger.table("profiles").where((F.col("dataset_id") == dataset_id) & (F.col("registration") == registration))
    used = rows.groupBy("batch").agg(F.min("payload").alias("payload"))
    return rows.join(used, ["batch", "payload"])


def _write_part(ledger: Ledger, dataset_id: str, registration: str | None, table: DataFrame, batch: str) -> str:
    path = f"{ledger.root}/data/{dataset_id}/{uuid.uuid4().hex}"
    table.write.parquet(path)
    states = profile_states(ledger.spark.read.parquet(path), F.lit(batch))
    if states.isEmpty():  # a part without rows has states of zero
        states = ledger.spark.createDataFrame(
            [(batch, i, c, "text", 0, 0, 0, 0, None, None, None, None) for i, c in enumerate(table.columns)], STATE_FIELDS
        )
    ledger.append("profiles", states.withColumns(
        {"dataset_id": F.lit(dataset_id), "registration": F.lit(registration or path), "payload": F.lit(path)}))
    return path


def _remember(
    ledger: Ledger, dataset_id: str, name: str, columns: list[dict], shown: DataFrame, kind: str, registration: str
) -> None:
    """Append the catalog row: counts from the merged states, missing cells of each column brought up to date."""
    states = _states(ledger, dataset_id, registration)
    types = infer_types(merge_states(states, total_rows(states)))
    overview = dataset_overview(types).first()
    missing = {r["name"]: r["missing_count"] for r in types.collect()}
    rows = [r[0] for r in shown.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    ledger.remember_dataset(
        dataset_id=dataset_id,
        name=name,
        row_count=overview["row_count"],
        columns_json=json.dumps([c | {"missing_count": missing.get(c["name"], c["missing_count"])} for c in columns], ensure_ascii=False),
        preview_json="[" + ",".join(rows) + "]",
        overview_json=json.dumps(overview.asDict(), ensure_ascii=False),
        payload_kind=kind,
        payload_path=registration,
    )
