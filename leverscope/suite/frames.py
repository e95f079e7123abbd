"""The tables the registered queries work on, derived from the given ones.

A column is written once, as an expression both Spark and plain SQL understand, so
a query and the SQL it is checked against start from the same data. Every frame
keeps all rows of its table; ``key % k`` only decides where a cell is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leverscope.operators.prepare import Features
from leverscope.operators.scorers import ExprScorer
from leverscope.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROW_KEYS = {
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey"),
    "orders": ("o_orderkey",),
    "events": ("event_id",),
}


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table much work is done on; the given files have one row group each."""
    return spread(table(spark, sf_dir, name), *ROW_KEYS[name])


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def select_sql(source: str, columns: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source}"


def rounded(expression: str, digits: int = 6) -> str:
    """SQL rounding without a negative zero."""
    return f"(round({expression}, {digits}) + 0.0)"


# --- lineitem as a process table with a numeric outcome -------------------------

LINE_KEY = (
    "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "cast(round(l_extendedprice * 100) AS bigint))"
)
LINES = {
    "row_key": LINE_KEY,
    "quantity": "CASE WHEN l_partkey % 17 <> 0 THEN l_quantity END",
    "price_k": "l_extendedprice / 1000",
    "discount": "l_discount",
    "tax": "CASE WHEN l_suppkey % 23 <> 0 THEN l_tax END",
    "flag": "CASE WHEN l_suppkey % 19 <> 0 THEN l_returnflag END",
    "status": "l_linestatus",
    "actual": (
        "12.0 + 0.16 * l_quantity + 40.0 * l_discount + 0.9 * l_quantity * l_discount"
        " - 25.0 * l_tax + CASE l_returnflag WHEN 'R' THEN 0.8 WHEN 'A' THEN 0.2 ELSE 0.0 END"
        " + ((l_partkey * 7 + l_suppkey * 13) % 101 - 50) / 25.0"
    ),
}
LINE_FEATURES = Features(("quantity", "price_k", "discount", "tax"), ("flag", "status"))
# price_k and status take no part: their importance has to be exactly zero.
LINE_PREDICTION = (
    "12.0 + 0.16 * coalesce({quantity}, 25.0) + 40.0 * {discount}"
    " + 0.9 * coalesce({quantity}, 25.0) * {discount} - 25.0 * coalesce({tax}, 0.04)"
    " + CASE {flag} WHEN 'R' THEN 0.8 WHEN 'A' THEN 0.2 ELSE 0.0 END"
)


def line_prediction(**columns: str) -> str:
    return LINE_PREDICTION.format(**{c: columns.get(c, c) for c in LINE_FEATURES.names})


def line_scorer() -> ExprScorer:
    return ExprScorer(prediction=line_prediction())


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(wide_table(spark, sf_dir, "lineitem"), LINES)


LINES_SQL = select_sql("lineitem", LINES)
SCORED_LINES_SQL = f"SELECT *, {line_prediction()} AS prediction FROM ({LINES_SQL})"


# --- orders with a numeric, a two-class and a three-class outcome ---------------

_LATENT = (
    "0.02 * (o_totalprice / 1000 - 250.0) + 0.3 * (month(o_orderdate) - 6.5)"
    " + CASE o_orderpriority WHEN '1-URGENT' THEN 0.6 WHEN '5-LOW' THEN -0.4 ELSE 0.0 END"
    " + ((o_orderkey * 7 + o_custkey * 13) % 101 - 50) / 50.0"
)
ORDERS = {
    "row_key": "o_orderkey",
    "total_k": "CASE WHEN o_custkey % 17 <> 0 THEN o_totalprice / 1000 END",
    "month": "cast(month(o_orderdate) AS double)",
    "site": "cast(o_custkey % 100 AS double)",
    "priority": "CASE WHEN o_custkey % 13 <> 0 THEN o_orderpriority END",
    "outcome": f"50.0 + 4.0 * ({_LATENT})",
    "verdict": f"CASE WHEN {_LATENT} > 0 THEN 'NG' ELSE 'OK' END",
    "grade": f"CASE WHEN {_LATENT} > 1.5 THEN 'A' WHEN {_LATENT} > -1.5 THEN 'B' ELSE 'C' END",
}
ORDER_FEATURES = Features(("total_k", "month", "site"), ("priority",))
ORDER_LATENT = (
    "(0.02 * (coalesce({total_k}, 250.0) - 250.0) + 0.3 * (coalesce({month}, 6.5) - 6.5)"
    " + CASE {priority} WHEN '1-URGENT' THEN 0.6 WHEN '5-LOW' THEN -0.4 ELSE 0.0 END)"
)
VERDICTS = ["NG", "OK"]
GRADES = ["A", "B", "C"]


def order_latent(**columns: str) -> str:
    return ORDER_LATENT.format(**{c: columns.get(c, c) for c in ORDER_FEATURES.names})


def order_prediction(**columns: str) -> str:
    return f"50.0 + 4.0 * {order_latent(**columns)}"


def verdict_chances(**columns: str) -> list[str]:
    latent = order_latent(**columns)
    return [f"1.0 / (1.0 + exp(-{latent}))", f"1.0 - 1.0 / (1.0 + exp(-{latent}))"]


def grade_chances(**columns: str) -> list[str]:
    latent = order_latent(**columns)
    parts = [f"exp({latent} - 1.5)", "1.0", f"exp(-{latent} - 1.5)"]
    return [f"{p} / ({' + '.join(parts)})" for p in parts]


def order_scorer() -> ExprScorer:
    return ExprScorer(prediction=order_prediction())


def verdict_scorer() -> ExprScorer:
    return ExprScorer(probabilities=verdict_chances(), classes=VERDICTS)


def grade_scorer() -> ExprScorer:
    return ExprScorer(probabilities=grade_chances(), classes=GRADES)


def orders(spark: SparkSession, sf_dir: str, target: str | None = None) -> DataFrame:
    """All columns, or the model frame of one target with ``actual``."""
    df = derive(wide_table(spark, sf_dir, "orders"), ORDERS)
    if target is None:
        return df
    return df.selectExpr("row_key", *ORDER_FEATURES.names, f"{actual_of(target)} AS actual")


def actual_of(target: str) -> str:
    if target == "verdict":
        return "CASE verdict WHEN 'NG' THEN cast(0 AS double) ELSE cast(1 AS double) END"
    if target == "grade":
        return (
            "CASE grade WHEN 'A' THEN cast(0 AS double) WHEN 'B' THEN cast(1 AS double)"
            " ELSE cast(2 AS double) END"
        )
    return "outcome"


ORDERS_SQL = select_sql("orders", ORDERS)


def order_frame_sql(target: str) -> str:
    return f"SELECT *, {actual_of(target)} AS actual FROM ({ORDERS_SQL})"


def chances_sql(inner: str, chances: list[str], carry: str = "*") -> str:
    """Adds p0, p1, ... and the index of the largest (first wins) as ``prediction``."""
    columns = ", ".join(f"{c} AS p{i}" for i, c in enumerate(chances))
    names = [f"p{i}" for i in range(len(chances))]
    best = "CASE " + " ".join(
        f"WHEN {n} = greatest({', '.join(names)}) THEN cast({i} AS double)"
        for i, n in enumerate(names)
    ) + " END"
    return f"SELECT *, {best} AS prediction FROM (SELECT {carry}, {columns} FROM ({inner}))"


SCORED_VERDICTS_SQL = chances_sql(order_frame_sql("verdict"), verdict_chances())
SCORED_GRADES_SQL = chances_sql(order_frame_sql("grade"), grade_chances())


# --- lineitem as it might come out of a file: text, junk, odd names --------------

RAW = {
    "qty_text": (
        "CASE WHEN l_partkey % 10 = 0 THEN 'n.a.' ELSE cast(cast(l_quantity AS int) AS string) END"
    ),
    "price_text": (
        "CASE WHEN l_suppkey % 4 = 0 THEN 'see note'"
        " ELSE cast(cast(round(l_extendedprice) AS bigint) AS string) END"
    ),
    "hex_text": "CASE WHEN l_linenumber > 1 THEN concat(l_linenumber, 'd') END",
    "active": "CASE WHEN l_partkey % 29 <> 0 THEN CASE l_linestatus WHEN 'O' THEN 'True' ELSE 'False' END END",
    "flag": "CASE WHEN l_suppkey % 19 <> 0 THEN l_returnflag END",
    "discount": "CASE WHEN l_partkey % 31 = 0 THEN cast('NaN' AS double) ELSE l_discount END",
    "Conductivity_pct": "l_tax * 100",
}


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(wide_table(spark, sf_dir, "lineitem"), RAW)


RAW_SQL = select_sql("lineitem", RAW)
# Fixed pattern of the number rule, as the SQL side spells a full match.
NUMBER_SQL = (
    r"regexp_full_match({c}, '\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*')"
)


def number_sql(column: str) -> str:
    return NUMBER_SQL.replace("{c}", column)
