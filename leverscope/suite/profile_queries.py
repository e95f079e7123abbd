"""Sources, schema and profiling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leverscope.errors import AnalysisError
from leverscope.operators import profile
from leverscope.operators.states import merge_states, profile_states, total_rows
from leverscope.plans.ledger import Ledger
from leverscope.session import checkpoint_dir
from leverscope.sources.catalog import append_dataset, dataset_profile, register_dataset
from leverscope.sources.synthetic import (
    CONDUCTIVITY_BASE,
    CONDUCTIVITY_HEAT_ADDITIVE,
    CONDUCTIVITY_LINES,
    CONDUCTIVITY_NOISE,
    CONDUCTIVITY_SLOPES,
    HOLE_COLUMNS,
    LINES as LINE_SHARES,
    REJECT_LINES,
    REJECT_NOISE,
    REJECT_SLOPES,
    SETTINGS,
    conductivity,
    process_okng,
    process_quality,
    reject_score,
)
from leverscope.sources.tables import json_rows, json_variant_rows, load_csv, read_csv_text, write_csv
from leverscope.suite.frames import (
    LINES,
    RAW,
    RAW_SQL,
    derive,
    number_sql,
    raw_lines,
    rounded,
    select_sql,
    table,
    wide_table,
)


def scratch(spark, name: str) -> str:
    """A fresh folder on the storage all executors share."""
    return f"{checkpoint_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"


# --- sources --------------------------------------------------------------------

CSV_COLUMNS = {
    "order_id": "o_orderkey",
    "total": "CASE WHEN o_custkey % 17 <> 0 THEN o_totalprice END",
    "state": "CASE WHEN o_custkey % 13 = 0 THEN 'NA' ELSE o_orderstatus END",
    "note": "concat('a, \"b\" ', o_orderpriority)",
    "urgent": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'True' ELSE 'False' END",
}


def csv_roundtrip(spark, sf_dir):
    path = scratch(spark, "csv")
    write_csv(derive(wide_table(spark, sf_dir, "orders"), CSV_COLUMNS), path)
    loaded, _ = load_csv(spark, path)
    return loaded.select("order_id", "total", "state", "note", "urgent")


CSV_SQL = f"""
SELECT cast(order_id AS double) AS order_id, total, nullif(state, 'NA') AS state, note,
       CASE urgent WHEN 'True' THEN cast(1 AS double) ELSE cast(0 AS double) END AS urgent
FROM ({select_sql("orders", CSV_COLUMNS)})
"""

JSON_K = "regexp_extract(props, '([0-9]+)', 1)"
JSON_ROWS = {
    "event_id": "event_id",
    "body": (
        f"CASE event_id % 3 WHEN 0 THEN concat('{{\"kind\": \"', event_type, '\", \"k\": ', {JSON_K}, '}}')"
        f" WHEN 1 THEN concat('[', {JSON_K}, ', \"', event_type, '\", true]')"
        f" ELSE concat('[', {JSON_K}, ']') END"
    ),
}


def json_table_ingest(spark, sf_dir):
    bodies = derive(table(spark, sf_dir, "events"), JSON_ROWS)
    names = ["k", "kind"]
    loaded, _ = profile.load_table(json_rows(bodies, F.col("body"), names, keep=("event_id",)))
    return loaded.select(F.col("event_id").cast("long").alias("event_id"), *names)


JSON_SQL = f"""
SELECT event_id, cast({JSON_K} AS double) AS k,
       CASE WHEN event_id % 3 <> 2 THEN event_type END AS kind
FROM events
"""


# Keys beyond 2^53; every third cell of ``note`` is an object, every third a text that looks like one.
VARIANT_BODY = (
    "concat('{\"big\": ', 9007199254740993 + event_id, ', \"note\": ', CASE event_id % 3 WHEN 0 THEN concat('{\"t\":\"', event_type, '\"}')"
    " WHEN 1 THEN concat('\"[', event_type, ']\"') ELSE 'null' END, '}')"
)


def json_variant_ingest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(VARIANT_BODY).alias("body"))
    found = json_variant_rows(rows, F.col("body"), ["big", "note"], keep=("event_id",))
    return found.withColumn("nested", F.array_join("nested", ","))


JSON_VARIANT_SQL = """
SELECT event_id, cast(9007199254740993 + event_id AS varchar) AS big,
  CASE event_id % 3 WHEN 0 THEN concat('{"t":"', event_type, '"}') WHEN 1 THEN concat('[', event_type, ']') END AS note,
  CASE event_id % 3 WHEN 0 THEN 'note' ELSE '' END AS nested
FROM events
"""


def _hash_sql(key: str, seed: int, stream: str, digits: int) -> str:
    return f"cast('0x' || substr(md5('{seed}|{stream}|' || {key}), 1, {digits}) AS bigint)"


def _uniform_sql(key: str, seed: int, stream: str) -> str:
    return f"((cast({_hash_sql(key, seed, stream, 13)} AS double) + 0.5) / cast({16**13} AS double))"


def _normal_sql(key: str, seed: int, stream: str) -> str:
    return (
        f"(sqrt(-2.0 * ln({_uniform_sql(key, seed, stream + '/r')}))"
        f" * cos(2.0 * pi() * {_uniform_sql(key, seed, stream + '/a')}))"
    )


def _effects_sql(slopes: dict, lines: dict) -> str:
    means = {n: m for n, m, *_ in SETTINGS}
    total = " + ".join(f"({s} * ({n} - {means[n]}))" for n, s in slopes.items())
    return f"({total})", (
        f"CASE LineId WHEN 'L1' THEN {lines['L1']} WHEN 'L2' THEN {lines['L2']} ELSE {lines['L3']} END"
    )


CONDUCTIVITY_SQL = (
    "({base} + {slopes} + {both} * ((Temperature - 182.0) * (AdditivePct - 2.6)) + {line})".format(
        base=CONDUCTIVITY_BASE,
        both=CONDUCTIVITY_HEAT_ADDITIVE,
        slopes=_effects_sql(CONDUCTIVITY_SLOPES, CONDUCTIVITY_LINES)[0],
        line=_effects_sql(CONDUCTIVITY_SLOPES, CONDUCTIVITY_LINES)[1],
    )
)
REJECT_SQL = "({} + {})".format(*_effects_sql(REJECT_SLOPES, REJECT_LINES))


def _synth_sql(outcome: str, name: str, seed: int = 42) -> str:
    key = "o_orderkey"
    draws = ", ".join(
        f"least(greatest({mean} + {spread} * {_normal_sql(key, seed, n)}, {low}), {high}) AS {n}"
        for n, mean, spread, low, high, _ in SETTINGS
    )
    pick = _uniform_sql(key, seed, "LineId")
    line = f"CASE WHEN {pick} < {LINE_SHARES[0][1]} THEN 'L1' WHEN {pick} < {LINE_SHARES[1][1]} THEN 'L2' ELSE 'L3' END"
    digits = {n: d for n, *_, d in SETTINGS}
    columns = []
    for n in digits:
        value = f"(round({n}, {digits[n]}) + 0.0)"
        if n in HOLE_COLUMNS:
            place = HOLE_COLUMNS.index(n)
            value = f"CASE WHEN NOT (hole_rank <= hole_rows AND hole_hash % 5 = {place}) THEN {value} END"
        columns.append(f"{value} AS {n}")
    return f"""
WITH drawn AS (
  SELECT o_orderkey, {draws}, {line} AS LineId,
         {_normal_sql(key, seed, "noise")} AS noise,
         {_hash_sql(key, seed, "hole", 15)} AS hole_hash,
         row_number() OVER (ORDER BY {_hash_sql(key, seed, "hole", 15)}) AS hole_rank,
         greatest(4, count(*) OVER () // 28) AS hole_rows
  FROM orders)
SELECT o_orderkey, LineId, {', '.join(columns)}, {outcome} AS {name} FROM drawn
"""


def synth_quality(spark, sf_dir):
    return process_quality(wide_table(spark, sf_dir, "orders"), "o_orderkey", 42)


def synth_okng(spark, sf_dir):
    return process_okng(wide_table(spark, sf_dir, "orders"), "o_orderkey", 42)


SETTING_COLUMNS = {
    "row_key": "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
    " cast(round(l_extendedprice * 100) AS bigint))",
    "Temperature": "148.0 + l_quantity * 1.4",
    "Pressure": "1.2 + (l_suppkey % 22) * 0.1",
    "TimeSec": "15.0 + l_tax * 900.0",
    "AdditivePct": "0.5 + l_discount * 43.0",
    "PreheatMin": "6.0 + l_linenumber * 4.0",
    "CoolRate": "0.8 + (l_partkey % 28) * 0.1",
    "Humidity": "22.0 + l_orderkey % 56",
    "LineId": "CASE l_returnflag WHEN 'R' THEN 'L1' WHEN 'A' THEN 'L2' ELSE 'L3' END",
}


def settings(spark, sf_dir):
    df = derive(wide_table(spark, sf_dir, "lineitem"), SETTING_COLUMNS)
    return df.withColumns({n: F.col(n).cast("double") for n, *_ in SETTINGS})


SETTINGS_SQL = (
    "SELECT row_key, LineId, "
    + ", ".join(f"cast({n} AS double) AS {n}" for n, *_ in SETTINGS)
    + f" FROM ({select_sql('lineitem', SETTING_COLUMNS)})"
)


def formula_quality(spark, sf_dir):
    return settings(spark, sf_dir).select(
        "row_key", F.round(conductivity(), 6).alias("conductivity")
    )


def formula_okng(spark, sf_dir):
    score = reject_score()
    return settings(spark, sf_dir).select(
        "row_key",
        F.round(score, 6).alias("reject_score"),
        F.when(F.round(score, 6) > 0, "NG").otherwise("OK").alias("verdict"),
    )


# --- schema and profile ---------------------------------------------------------

ODD_COLUMNS = {
    "a": "cast(l_quantity AS string)",
    "b": "cast(NULL AS string)",
    "c": "cast(NULL AS double)",
    "d": "CASE WHEN l_linenumber = 1 THEN l_returnflag END",
    "e": "cast(NULL AS string)",
}
ODD_NAMES = [" Quantity ", "Unnamed: 1", "EmptyNamed", "Unnamed: 3", "  "]


def drop_empty_columns(spark, sf_dir):
    odd = derive(wide_table(spark, sf_dir, "lineitem"), ODD_COLUMNS).toDF(*ODD_NAMES)
    return profile.column_counts(profile.normalise_columns(odd)).select("position", "name", "filled")


DROP_SQL = f"""
WITH raw AS ({select_sql("lineitem", ODD_COLUMNS)}),
counted AS (
  SELECT 0 AS place, 'Quantity' AS name, count(a) AS filled FROM raw
  UNION ALL SELECT 1, 'Unnamed: 1', count(b) FROM raw
  UNION ALL SELECT 2, 'EmptyNamed', count(c) FROM raw
  UNION ALL SELECT 3, 'Unnamed: 3', count(d) FROM raw
  UNION ALL SELECT 4, '', count(e) FROM raw)
SELECT cast(row_number() OVER (ORDER BY place) - 1 AS int) AS position, name, filled
FROM counted WHERE NOT (filled = 0 AND (name = '' OR name LIKE 'Unnamed:%'))
"""


def _types(spark, sf_dir):
    return profile.infer_types(profile.column_counts(raw_lines(spark, sf_dir)))


def infer_types(spark, sf_dir):
    return _types(spark, sf_dir).select("position", "name", "type", "missing_count")


def _raw_counts_sql() -> str:
    parts = []
    for i, c in enumerate(RAW):
        if c in ("discount", "Conductivity_pct"):
            good = f"count(CASE WHEN NOT isnan({c}) THEN 1 END)"
            numbers, booleans = good, "0"
        else:
            good = f"count({c})"
            numbers = f"count(CASE WHEN {number_sql(c)} THEN 1 END)"
            booleans = f"count(CASE WHEN lower({c}) IN ('true', 'false') THEN 1 END)"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS name, count(*) AS total, {good} AS filled,"
            f" {numbers} AS numbers, {booleans} AS booleans FROM raw"
        )
    return f"""
raw AS ({RAW_SQL}),
counted AS ({' UNION ALL '.join(parts)}),
typed AS (
  SELECT *, filled > 0 AND booleans = filled AS is_boolean,
         filled > 0 AND numbers >= 0.8 * filled AS is_number FROM counted),
columns_found AS (
  SELECT position, name,
         CASE WHEN is_boolean OR is_number THEN 'numeric' ELSE 'categorical' END AS type,
         total - CASE WHEN is_number AND NOT is_boolean THEN numbers ELSE filled END AS missing_count,
         total
  FROM typed)"""


TYPES_SQL = f"WITH {_raw_counts_sql()} SELECT position, name, type, missing_count FROM columns_found"


def coerce_numeric(spark, sf_dir):
    raw = raw_lines(spark, sf_dir)
    types = profile.collect_types(profile.infer_types(profile.column_counts(raw)))
    return profile.coerce(raw, types)


COERCE_SQL = f"""
SELECT CASE WHEN {number_sql('qty_text')} THEN cast(qty_text AS double) END AS qty_text,
       price_text, hex_text,
       CASE active WHEN 'True' THEN cast(1 AS double) WHEN 'False' THEN cast(0 AS double) END AS active,
       flag, CASE WHEN NOT isnan(discount) THEN discount END AS discount, Conductivity_pct
FROM ({RAW_SQL})
"""


def missing_counts(spark, sf_dir):
    return profile.missing_counts(_types(spark, sf_dir))


MISSING_SQL = f"WITH {_raw_counts_sql()} SELECT position, name, missing_count FROM columns_found"


def dataset_overview(spark, sf_dir):
    found = profile.dataset_overview(_types(spark, sf_dir), "Conductivity_pct")
    return found.unionByName(profile.dataset_overview(_types(spark, sf_dir)))


OVERVIEW_SQL = f"""
WITH {_raw_counts_sql()},
summed AS (
  SELECT max(total) AS row_count, count(*) AS column_count,
         count(CASE WHEN type = 'numeric' THEN 1 END) AS numeric_count,
         count(CASE WHEN type = 'categorical' THEN 1 END) AS categorical_count,
         cast(sum(missing_count) AS bigint) AS missing_count,
         string_agg(CASE WHEN missing_count > 0 THEN name END, ', ' ORDER BY position) AS missing_columns
  FROM columns_found)
SELECT *, 'Conductivity_pct' AS target, 'datasetOverviewWithTarget' AS code,
       'The table holds ' || row_count || ' records in ' || column_count
       || ' columns; ''Conductivity_pct'' is the outcome to explain. Cells are missing in '
       || missing_columns || '.' AS summary FROM summed
UNION ALL
SELECT *, NULL AS target, 'datasetOverview' AS code,
       'The table holds ' || row_count || ' records in ' || column_count || ' columns: '
       || numeric_count || ' numeric and ' || categorical_count
       || ' categorical. Cells are missing in ' || missing_columns || '.' AS summary FROM summed
"""


def profile_merged(spark, sf_dir):
    """Types from states of seven batches: each is kept as a small row per column, then merged."""
    lines = derive(wide_table(spark, sf_dir, "lineitem"), {**RAW, "batch": "l_orderkey % 7"})
    path = scratch(spark, "states")
    profile_states(lines, F.col("batch"), list(RAW)).write.parquet(path)
    states = spark.read.parquet(path)
    merged = merge_states(states, total_rows(states))
    extremes = merged.select("name", "least", "greatest")
    return profile.infer_types(merged).join(extremes, "name").select(
        "position", "name", "type", "missing_count", "row_count", "least", "greatest"
    )


def _extreme_sql(column: str) -> str:
    if column == "active":
        return "NULL"
    if column in ("discount", "Conductivity_pct"):
        return f"CASE WHEN NOT isnan({column}) THEN {column} END"
    return f"CASE WHEN {number_sql(column)} THEN cast({column} AS double) END"


MERGED_SQL = f"""
WITH {_raw_counts_sql()},
extremes AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS name, min(cast({_extreme_sql(c)} AS double)) AS least, max(cast({_extreme_sql(c)} AS double)) AS greatest FROM raw"
    for c in RAW)})
SELECT position, name, type, missing_count, total AS row_count, least, greatest FROM columns_found JOIN extremes USING (name)
"""


def dataset_append(spark, sf_dir):
    """A table registered with its first third of rows, two thirds appended; the profile is merged from states."""
    lines = derive(wide_table(spark, sf_dir, "lineitem"), {**LINES, "third": "l_orderkey % 3"})
    ledger = Ledger(spark, scratch(spark, "append"))
    first, *later = [lines.where(F.col("third") == i).drop("third") for i in range(3)]
    typed, columns = profile.load_table(first, key="row_key")
    register_dataset(ledger, "lines", typed, columns, "parquet", dataset_id="lines")
    for i, part in enumerate(later):
        append_dataset(ledger, "lines", part, f"third {i + 1}")
    found = dataset_profile(ledger, "lines")
    types = profile.infer_types(found).select("name", "type", "missing_count", "row_count")
    return types.join(found.select("name", "least", "greatest"), "name")


def _append_sql(column: str) -> str:
    numeric = column not in ("row_key", "flag", "status")
    ends = f"min(cast({column} AS double)), max(cast({column} AS double))" if numeric else "cast(NULL AS double), cast(NULL AS double)"
    return (
        f"SELECT '{column}', '{'numeric' if numeric else 'categorical'}', count(*) - count({column}), count(*), {ends} FROM lines"
    )


APPEND_SQL = f"""
WITH lines AS ({select_sql("lineitem", LINES)})
SELECT * FROM ({' UNION ALL '.join(_append_sql(c) for c in LINES)}) AS found(name, type, missing_count, row_count, least, greatest)
"""


def preview(spark, sf_dir):
    cells = ["event_id", "user_id", "event_type", "value"]
    return profile.preview(table(spark, sf_dir, "events").select(*cells), ["event_id"])


PREVIEW_SQL = "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 12"


def guess_target(spark, sf_dir):
    """One table that hints at its target, two that do not, one with the fixed name."""
    named = {
        "raw_lines": raw_lines(spark, sf_dir),
        "orders": table(spark, sf_dir, "orders"),
        "customer": table(spark, sf_dir, "customer"),
        "labels": table(spark, sf_dir, "labels").selectExpr(
            "doc_id", "quality AS line_yield", "cast(toxic AS string) AS QualityResult"
        ),
    }
    found = [
        profile.guess_target(profile.infer_types(profile.column_counts(df))).select(
            F.lit(name).alias("source"), "target"
        )
        for name, df in named.items()
    ]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _last_numeric_sql(name: str) -> str:
    return f"""
SELECT '{name}' AS source, (SELECT column_name FROM
  (SELECT column_name, column_type, row_number() OVER () AS place FROM (DESCRIBE SELECT * FROM {name}))
  WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') ORDER BY place DESC LIMIT 1) AS target"""


GUESS_SQL = f"""
WITH {_raw_counts_sql()}
SELECT 'raw_lines' AS source, (SELECT name FROM columns_found WHERE type = 'numeric'
  AND regexp_matches(lower(name), 'conductivity|quality|lpc|yield') ORDER BY position LIMIT 1) AS target
UNION ALL {_last_numeric_sql("orders")}
UNION ALL {_last_numeric_sql("customer")}
UNION ALL SELECT 'labels', CASE WHEN count(toxic) >= 0 THEN 'QualityResult' END FROM labels
"""

CHECKED_TARGETS = ("l_quantity", "nothing", "gaps", "absent")


def validate_target(spark, sf_dir):
    """What the target check says of a column with values, one without, one of NaN and one that is not there."""
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "l_quantity", "CASE WHEN l_quantity < 0 THEN 'x' END AS nothing", "CASE WHEN l_tax >= 0 THEN double('NaN') END AS gaps"
    )
    out = []
    for target in CHECKED_TARGETS:
        try:
            profile.validate_target(df, target)
            out.append((target, "ok"))
        except AnalysisError as problem:
            out.append((target, problem.code))
    return spark.createDataFrame(out, "target string, code string")


VALIDATE_SQL = """
SELECT 'l_quantity' AS target, CASE WHEN count(l_quantity) > 0 THEN 'ok' ELSE 'emptyTarget' END AS code FROM lineitem
UNION ALL SELECT 'nothing', CASE WHEN count(CASE WHEN l_quantity < 0 THEN 'x' END) > 0 THEN 'ok' ELSE 'emptyTarget' END FROM lineitem
UNION ALL SELECT 'gaps', CASE WHEN count(CASE WHEN l_tax < 0 THEN 1 END) > 0 THEN 'ok' ELSE 'emptyTarget' END FROM lineitem
UNION ALL SELECT 'absent', 'missingTarget'
"""

STANDARD_COLUMNS = {
    "doc": "doc_id",
    "note": (
        "CASE doc_id % 4 WHEN 0 THEN concat('say \"', text, '\", twice \"\"') WHEN 1 THEN concat('C:\\\\dir\\\\', text, ',')"
        " WHEN 2 THEN text ELSE concat(lang, chr(10), '\"', chr(10), text, chr(10)) END"
    ),
}


def csv_standard(spark, sf_dir):
    """Texts with doubled quotes, commas, backslashes and line breaks, written and read back, keys as they were."""
    path = scratch(spark, "csv-standard")
    rows = table(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {c}" for c, e in STANDARD_COLUMNS.items()])
    write_csv(rows, path)
    return read_csv_text(spark, path).select(F.col("doc").cast("long").alias("doc"), "note")


SPLIT_BYTES = 256 << 10  # so that the small test tables, too, are read by several tasks


def csv_split(spark, sf_dir):
    """The same texts, a file read by a task per split although records cross splits."""
    path = scratch(spark, "csv-split")
    rows = table(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {c}" for c, e in STANDARD_COLUMNS.items()])
    write_csv(rows, path)
    return read_csv_text(spark, path, split=True, split_bytes=SPLIT_BYTES).select(F.col("doc").cast("long").alias("doc"), "note")


CSV_STANDARD_SQL = f"SELECT doc_id AS doc, {STANDARD_COLUMNS['note']} AS note FROM documents".replace("\\\\", "\\")

ENTRIES = {
    "validate_target": (validate_target, VALIDATE_SQL),
    "csv_standard": (csv_standard, CSV_STANDARD_SQL),
    "csv_split": (csv_split, CSV_STANDARD_SQL),
    "csv_roundtrip": (csv_roundtrip, CSV_SQL),
    "json_table_ingest": (json_table_ingest, JSON_SQL),
    "json_variant_ingest": (json_variant_ingest, JSON_VARIANT_SQL),
    "synth_quality": (
        synth_quality,
        _synth_sql(f"(round({CONDUCTIVITY_SQL} + {CONDUCTIVITY_NOISE} * noise, 3) + 0.0)", "TargetConductivity"),
    ),
    "synth_okng": (
        synth_okng,
        _synth_sql(f"CASE WHEN {REJECT_SQL} + {REJECT_NOISE} * noise > 0 THEN 'NG' ELSE 'OK' END", "QualityResult"),
    ),
    "formula_quality": (
        formula_quality,
        f"SELECT row_key, {rounded(CONDUCTIVITY_SQL)} AS conductivity FROM ({SETTINGS_SQL})",
    ),
    "formula_okng": (
        formula_okng,
        f"SELECT row_key, {rounded(REJECT_SQL)} AS reject_score,"
        f" CASE WHEN round({REJECT_SQL}, 6) > 0 THEN 'NG' ELSE 'OK' END AS verdict FROM ({SETTINGS_SQL})",
    ),
    "drop_empty_columns": (drop_empty_columns, DROP_SQL),
    "infer_types": (infer_types, TYPES_SQL),
    "coerce_numeric": (coerce_numeric, COERCE_SQL),
    "missing_counts": (missing_counts, MISSING_SQL),
    "dataset_overview": (dataset_overview, OVERVIEW_SQL),
    "profile_merged": (profile_merged, MERGED_SQL),
    "dataset_append": (dataset_append, APPEND_SQL),
    "preview": (preview, PREVIEW_SQL),
    "guess_target": (guess_target, GUESS_SQL),
}
