"""CSV and JSON tables in, typed tables out."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leverscope.errors import AnalysisError
from leverscope.functions.scalars import NA_TOKENS
from leverscope.functions.scalars import quoted
from leverscope.operators.profile import ColumnProfile, load_table
from leverscope.sources.records import quoted_records

_OVERFLOW = "overflow_cell"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core: re-partition a table that has fewer parts than there are cores.

    A file with a single row group is one task however large the cluster. A table
    with enough parts is left alone, so nothing large is ever shuffled here. Meant
    for tables as read, whose number of parts is known without running anything.
    ``keys`` should tell rows apart (a hash of them places a row, which needs no sort).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


# Quotes inside a quoted cell are doubled and a backslash is text, as in RFC 4180.
CSV_FORMAT = {"quote": '"', "escape": '"'}


def _header(spark: SparkSession, path: str | list[str], multi_line: bool) -> list[str]:
    try:
        head = spark.read.options(**CSV_FORMAT).csv(path, header=False, multiLine=multi_line).limit(1).collect()
    except AnalysisException as problem:
        raise AnalysisError("sampleMissing", f"Nothing to read at {path}.") from problem
    if not head:
        raise AnalysisError("emptyDataset", "The file is empty.")
    return [f"Unnamed: {i}" if cell is None or cell == "" else cell for i, cell in enumerate(head[0])]


def _by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The files below ``path``, those with the same header line together; a scan of the text if there are several.

    The header is the first line that is not empty. A file that begins with empty lines stands
    alone, so that its header is checked as the reader finds it.
    """
    text = spark.read.text(path)
    files = text.inputFiles()
    if len(files) < 2:
        return [files]
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), F.col("_metadata.file_block_start").alias("start"))
    full = F.when(F.col("value") != "", F.col("place"))
    first = lines.where("start = 0").groupBy("file").agg(F.min_by(F.rtrim("value"), full).alias("line"), (F.min(full) > F.min("place")).alias("late"))
    alike = first.where("line is not null").groupBy("line", F.when(F.col("late"), F.col("file"))).agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    return sorted(r["files"] for r in alike) or [files]


def read_csv_text(
    spark: SparkSession, path: str, multi_line: bool = True, split: bool = False, split_bytes: int | None = None
) -> DataFrame:
    """A headed CSV as text columns; a missing-cell word becomes NULL.

    Names are kept as written (the reader would rename repeated and blank ones), a
    blank one becomes ``Unnamed: <position>``. The schema is given, so nothing is
    inferred. A row wider than the header fails the read with ``invalidCsv``. Files of a
    folder are read by name: another order of columns is followed, other names fail
    with ``invalidCsv``. Cells may hold line breaks, so a file is one task; give
    ``multi_line=False`` for large files without such cells, which are then split, or
    ``split=True`` for large files with them (see ``sources.records``; ``split_bytes`` is the
    size of a split, by default the session's).
    """
    if split and split_bytes is not None:
        spark = spark.newSession()
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    names = _header(spark, path, multi_line)
    out = None
    for files in _by_header(spark, path):
        own = _header(spark, files, multi_line)
        if sorted(own) != sorted(names):
            raise AnalysisError("invalidCsv", f"Files differ in their columns: {', '.join(names)} and {', '.join(own)}.")
        part = _read_split(spark, files, own) if split else _read_alike(spark, files, own, multi_line)
        if own != names:
            part = part.select(*[quoted(n) for n in names])
        out = part if out is None else out.union(part)
    return out


def _text_schema(names: list[str]) -> T.StructType:
    fields = [f"c{i}" for i in range(len(names))] + [_OVERFLOW]
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


def _read_alike(spark: SparkSession, files: list[str], names: list[str], multi_line: bool) -> DataFrame:
    raw = spark.read.schema(_text_schema(names)).options(**CSV_FORMAT).csv(
        files, header=True, enforceSchema=True, mode="PERMISSIVE", multiLine=multi_line
    )
    return _cells(raw, names)


def _read_split(spark: SparkSession, files: list[str], names: list[str]) -> DataFrame:
    options = {**CSV_FORMAT, "multiLine": "true", "mode": "PERMISSIVE"}
    cells = F.from_csv("record", _text_schema(names).simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    return _cells(quoted_records(spark, files).select(cells.alias("r")).select("r.*"), names)


def _cells(raw: DataFrame, names: list[str]) -> DataFrame:
    # Checked where the first cell is read, in the same pass as everything else.
    width_ok = F.when(
        F.col(_OVERFLOW).isNotNull(),
        F.raise_error(F.lit("invalidCsv: a row has more cells than the header")),
    )
    fields = raw.columns[:-1]
    cells = [F.when(~F.col(c).isin(*NA_TOKENS), F.col(c)) for c in fields]
    cells[0] = F.coalesce(width_ok.cast("string"), cells[0])
    return raw.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).toDF(*names)


def load_csv(
    spark: SparkSession, path: str, multi_line: bool = True, key: str | None = None, split: bool = False
) -> tuple[DataFrame, list[ColumnProfile]]:
    """Read, type and coerce a CSV file or folder; ``key`` is passed through as text."""
    try:
        return load_table(read_csv_text(spark, path, multi_line, split), key)
    except AnalysisError:
        raise
    except Exception as problem:
        if "invalidCsv" in str(problem):
            raise AnalysisError("invalidCsv", "A row has more cells than the header.") from problem
        raise


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """One headed CSV file per partition; missing cells are empty, quotes are doubled, blanks around a text stay."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(**CSV_FORMAT, **kept).option("header", True).csv(path)


def column_names(columns: Iterable) -> list[str]:
    names = [str((c.get("name") if isinstance(c, dict) else c) or "").strip() for c in columns]
    if not names:
        raise AnalysisError("invalidColumns", "At least one column is needed.")
    if "" in names:
        raise AnalysisError("invalidColumns", "A column has no name.")
    return names


def json_rows(df: DataFrame, row: Column, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON rows (objects, or arrays in column order) to text columns.

    Objects are read by name and arrays by place; short arrays end in NULL and what
    is too much is ignored. A row that is neither fails with ``invalidRows``.
    """
    objects = F.from_json(row, "map<string,string>")
    arrays = F.from_json(row, "array<string>")
    opening = F.substring(F.ltrim(row), 1, 1)
    parsed = df.select(
        *keep,
        F.when(opening == "{", objects).alias("by_name"),
        F.when(opening == "[", arrays).alias("by_place"),
    )
    bad = F.when(
        F.col("by_name").isNull() & F.col("by_place").isNull(),
        F.raise_error(F.lit("invalidRows: a row is neither an object nor an array")),
    )
    cells = [
        F.coalesce(
            F.try_element_at(F.col("by_name"), F.lit(n)), F.get(F.col("by_place"), F.lit(i))
        )
        for i, n in enumerate(names)
    ]
    cells[0] = F.coalesce(bad.cast("string"), cells[0])
    return parsed.select(*keep, *[c.alias(n) for c, n in zip(cells, names)])


def json_variant_rows(df: DataFrame, row: Column, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """As ``json_rows``, parsed once to VARIANT: a nested cell is told apart from a text that looks like one.

    ``nested`` names, in column order, the columns whose cell is an object or an array; such a
    cell is its JSON text. Whole numbers keep all their digits, decimals up to 38 of them.
    """
    value = F.try_parse_json(row)
    parsed = df.select(
        *keep,
        F.try_variant_get(value, "$", "map<string,variant>").alias("by_name"),
        F.try_variant_get(value, "$", "array<variant>").alias("by_place"),
    )
    bad = F.when(
        F.col("by_name").isNull() & F.col("by_place").isNull(),
        F.raise_error(F.lit("invalidRows: a row is neither an object nor an array")),
    )
    cells = [
        F.coalesce(F.try_element_at("by_name", F.lit(n)), F.get("by_place", F.lit(i))).alias(f"c{i}")
        for i, n in enumerate(names)
    ]
    found = parsed.select(*keep, bad.cast("string").alias("bad"), *cells)
    texts = [F.try_variant_get(f"c{i}", "$", "string") for i in range(len(names))]
    texts[0] = F.coalesce("bad", texts[0])
    nested = [F.when(F.schema_of_variant(f"c{i}").rlike("^(OBJECT|ARRAY)<"), F.lit(n)) for i, n in enumerate(names)]
    return found.select(*keep, *[t.alias(n) for t, n in zip(texts, names)], F.array_compact(F.array(*nested)).alias("nested"))


def load_json_table(
    spark: SparkSession, columns: Iterable, rows: Iterable | DataFrame
) -> tuple[DataFrame, list[ColumnProfile]]:
    """A JSON table: column names, and rows as Python values or as a one-column
    DataFrame of JSON texts."""
    names = column_names(columns)
    if not isinstance(rows, DataFrame):
        rows = list(rows)
        if not all(isinstance(r, (dict, list, tuple)) for r in rows):
            raise AnalysisError("invalidRows", "A row is an object or an array.")
        if not rows:
            raise AnalysisError("emptyDataset", "The table has no rows.")
        rows = spark.createDataFrame([(json.dumps(r),) for r in rows], "row string")
    try:
        return load_table(json_rows(rows, quoted(rows.columns[0]), names))
    except AnalysisError:
        raise
    except Exception as problem:
        if "invalidRows" in str(problem):
            raise AnalysisError("invalidRows", "A row is an object or an array.") from problem
        raise
