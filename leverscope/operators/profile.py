"""Column cleaning, typing and the dataset overview.

Everything about the columns of a table comes from one aggregate over it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leverscope.errors import AnalysisError
from leverscope.functions.scalars import nan_to_null, parse_boolean, parse_number, quoted

NUMERIC = "numeric"
CATEGORICAL = "categorical"

# Fixed value: a text column is numeric when at least this share of it parses.
NUMERIC_SHARE = 0.8
# Fixed value: rows shown in a preview.
PREVIEW_ROWS = 12
# How a reader names a column without a header.
UNNAMED_PREFIX = "Unnamed:"

# Target names taken first, then words that hint at a target.
TARGET_NAMES = ("QualityResult", "TargetConductivity")
TARGET_HINTS = ("導電", "conductivity", "quality", "lpc", "yield", "良率")


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    type: str
    missing_count: int
    encoding: str = ""  # number, boolean or none: how its text becomes a value


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return "number"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "label"
    return "nested"


def is_unnamed(name: str) -> bool:
    return name == "" or name.startswith(UNNAMED_PREFIX)


def normalise_columns(df: DataFrame) -> DataFrame:
    """Trim names; drop unnamed columns without a value; reject bad names.

    Only the unnamed columns are read, and only when there are any.
    """
    names = [c.strip() for c in df.columns]
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    unnamed = [i for i, n in enumerate(names) if is_unnamed(n)]
    empty: set[int] = set()
    if unnamed:
        filled = plain.agg(*[F.count(_present(plain, f"c{i}")).alias(f"c{i}") for i in unnamed])
        empty = {i for i, n in zip(unnamed, filled.first()) if n == 0}
    kept = [i for i in range(len(names)) if i not in empty]
    if not kept:
        raise AnalysisError("emptyDataset", "The table has no usable column.")
    kept_names = [names[i] for i in kept]
    if "" in kept_names:
        raise AnalysisError("invalidColumns", "A column that holds values has no name.")
    folded = [n.lower() for n in kept_names]
    repeated = sorted({n for n in kept_names if folded.count(n.lower()) > 1})
    if repeated:
        raise AnalysisError("duplicateColumns", f"Names used more than once: {', '.join(repeated)}.")
    nested = [names[i] for i in kept if _kind(plain.schema[f"c{i}"].dataType) == "nested"]
    if nested:
        raise AnalysisError("invalidColumns", f"Not a flat column: {', '.join(nested)}.")
    return plain.select(*[F.col(f"c{i}").alias(names[i]) for i in kept])


def _present(df: DataFrame, name: str) -> Column:
    value = quoted(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return nan_to_null(value)
    return value


def column_counts(df: DataFrame) -> DataFrame:
    """Per column: rows, filled cells, cells that parse as numbers / booleans.

    One pass; the result has one row per column.
    """
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(df.schema.fields):
        value = quoted(field.name)
        kind = _kind(field.dataType)
        if kind == "text":
            parts = (
                F.count(value),
                F.count(parse_number(value)),
                F.count(parse_boolean(value)),
            )
        elif kind == "number":
            filled = F.count(_present(df, field.name))
            parts = (filled, filled, F.lit(0).cast("long"))
        else:
            parts = (F.count(value), F.lit(0).cast("long"), F.lit(0).cast("long"))
        measures.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("name"),
                F.lit(kind).alias("kind"),
                parts[0].alias("filled"),
                parts[1].alias("numbers"),
                parts[2].alias("booleans"),
            ).alias(f"m{i}")
        )
    one_row = df.agg(*measures)
    each = F.explode(F.array(*[F.col(f"m{i}") for i in range(len(df.columns))])).alias("m")
    return one_row.select("rows", each).select("rows", "m.*")


def infer_types(counts: DataFrame) -> DataFrame:
    """(position, name, type, encoding, missing_count) from ``column_counts``.

    ``encoding`` says how text becomes a number: ``number``, ``boolean`` (every
    filled cell is a boolean word) or ``none``. Missing cells are counted as they
    will be after coercion.
    """
    filled, numbers = F.col("filled"), F.col("numbers")
    is_boolean = (F.col("kind") == "text") & (filled > 0) & (F.col("booleans") == filled)
    is_number = (F.col("kind") == "number") | (
        (F.col("kind") == "text")
        & (filled > 0)
        & (F.try_divide(numbers.cast("double"), filled.cast("double")) >= NUMERIC_SHARE)
    )
    encoding = F.when(is_boolean, "boolean").when(is_number, "number").otherwise("none")
    return counts.select(
        "position",
        "name",
        F.when(encoding == "none", CATEGORICAL).otherwise(NUMERIC).alias("type"),
        encoding.alias("encoding"),
        (F.col("rows") - F.when(encoding == "number", numbers).otherwise(filled)).alias(
            "missing_count"
        ),
        F.col("rows").alias("row_count"),
    )


def missing_counts(types: DataFrame) -> DataFrame:
    return types.select("position", "name", "missing_count")


def collect_types(types: DataFrame) -> list:
    """The typed columns on the driver: one small row per column."""
    return types.orderBy("position").collect()


# How a column that was boolean words or a boolean says so: its labels stay True and False.
BOOLEAN_MARK = {"encoding": "boolean"}


def coerced_cell(value: Column, kind: str, type_: str, encoding: str) -> Column:
    """One cell of a typed column; what does not fit its type becomes NULL."""
    if encoding == "boolean" and kind == "text":
        return parse_boolean(value)
    if type_ == NUMERIC:
        return parse_number(value) if kind == "text" else nan_to_null(value.cast("double"))
    return value.cast("string")


def coerce(df: DataFrame, types: list, keep: tuple[str, ...] = ()) -> DataFrame:
    """Numeric columns to double (unparsable becomes NULL), the others to text; ``keep`` as they are."""
    out = [quoted(c) for c in keep]
    for t in types:
        data_type = df.schema[t["name"]].dataType
        value = coerced_cell(quoted(t["name"]), _kind(data_type), t["type"], t["encoding"])
        boolean = t["encoding"] == "boolean" or isinstance(data_type, T.BooleanType)
        out.append(value.alias(t["name"], metadata=BOOLEAN_MARK) if boolean else value.alias(t["name"]))
    return df.select(*out)


def load_table(df: DataFrame, key: str | None = None) -> tuple[DataFrame, list[ColumnProfile]]:
    """Clean, type and coerce a raw table; the column ``key`` comes first and stays as it is, digit for digit."""
    if not df.columns:
        raise AnalysisError("emptyDataset", "The table has no columns.")
    named = normalise_columns(df)
    if key is not None and key not in named.columns:
        raise AnalysisError("invalidColumns", f"There is no key column '{key}'.")
    typed = named.drop(quoted(key)) if key is not None else named
    if not typed.columns:
        raise AnalysisError("emptyDataset", "The table has no column besides its key.")
    types = collect_types(infer_types(column_counts(typed)))
    if types[0]["row_count"] == 0:
        raise AnalysisError("emptyDataset", "The table has no rows.")
    columns = [ColumnProfile(t["name"], t["type"], t["missing_count"], t["encoding"]) for t in types]
    return coerce(named, types, (key,) if key is not None else ()), columns


def dataset_overview(types: DataFrame, target: str | None = None) -> DataFrame:
    """One row of counts, with a code and a sentence, from ``infer_types`` alone."""
    missing = F.col("missing_count") > 0
    named = F.when(missing, F.struct("position", "name"))
    counts = types.agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.count_if(F.col("type") == NUMERIC).alias("numeric_count"),
        F.count_if(F.col("type") == CATEGORICAL).alias("categorical_count"),
        F.sum("missing_count").alias("missing_count"),
        F.concat_ws(
            ", ", F.transform(F.array_sort(F.collect_list(named)), lambda m: m["name"])
        ).alias("missing_columns"),
    )
    if target:
        code = "datasetOverviewWithTarget"
        text = F.concat(
            F.lit("The table holds "), F.col("row_count"), F.lit(" records in "),
            F.col("column_count"),
            F.lit(f" columns; '{target}' is the outcome to explain."),
        )
    else:
        code = "datasetOverview"
        text = F.concat(
            F.lit("The table holds "), F.col("row_count"), F.lit(" records in "),
            F.col("column_count"), F.lit(" columns: "), F.col("numeric_count"),
            F.lit(" numeric and "), F.col("categorical_count"), F.lit(" categorical."),
        )
    gaps = F.when(
        F.col("missing_count") > 0,
        F.concat(F.lit(" Cells are missing in "), F.col("missing_columns"), F.lit(".")),
    ).otherwise(F.lit(""))
    return counts.select(
        "*",
        F.lit(target).cast("string").alias("target"),
        F.lit(code).alias("code"),
        F.concat(text, gaps).alias("summary"),
    )


def preview(df: DataFrame, order: list[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows by key: a top-k, not a sort of the table."""
    return df.orderBy(*order).limit(rows)


def guess_target(types: DataFrame) -> DataFrame:
    """The column most likely meant as the outcome, one row (none if no candidate)."""
    name = F.col("name")
    hint = name.rlike("(?i)" + "|".join(TARGET_HINTS))
    usable = (F.col("type") == NUMERIC) & ~name.startswith("Unnamed")
    tier = (
        F.when(name == TARGET_NAMES[0], 0)
        .when(name == TARGET_NAMES[1], 1)
        .when(usable & hint, 2)
        .when(usable, 3)
    )
    # Without a hint the last numeric column is taken: its negated position is least.
    place = F.when(tier == 3, -F.col("position")).otherwise(F.col("position"))
    return types.agg(
        F.min_by(name, F.when(tier.isNotNull(), F.struct(tier, place))).alias("target")
    )


def validate_target(df: DataFrame, target: str) -> None:
    if not target:
        raise AnalysisError("missingTarget", "A target column is needed.")
    if target not in df.columns:
        raise AnalysisError("missingTarget", f"There is no column '{target}'.")
    if df.select(_present(df, target).alias("t")).where(F.col("t").isNotNull()).isEmpty():
        raise AnalysisError("emptyTarget", f"Column '{target}' holds no value.")


