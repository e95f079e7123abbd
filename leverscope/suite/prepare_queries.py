"""Task resolution, feature choice, imputation, encoding and splits."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from leverscope.operators import prepare
from leverscope.operators.learners import preparation_stages
from leverscope.operators.profile import load_table
from leverscope.suite.frames import (
    LINE_FEATURES,
    LINES_SQL,
    ORDERS_SQL,
    derive,
    lines,
    orders,
    rounded,
    table,
    wide_table,
)

TARGETS = ("l_linestatus", "l_returnflag", "l_quantity", "nothing", "constant")


def target_cardinality(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr(
        *TARGETS[:3], "cast(NULL AS string) AS nothing", "'x' AS constant"
    )
    return prepare.target_cardinality(df, list(TARGETS))


CARDINALITY_SQL = """
WITH raw AS (SELECT *, cast(NULL AS string) AS nothing, 'x' AS constant FROM lineitem),
found AS ({})
SELECT target, distinct_values, CASE WHEN distinct_values = 2 THEN 'binary' ELSE 'regression' END AS auto_task,
       distinct_values = 2 AS binary_allowed, distinct_values = 3 AS multiclass_allowed FROM found
""".format(
    " UNION ALL ".join(
        f"SELECT '{t}' AS target, cast(least(count(DISTINCT {t}), 3) AS int) AS distinct_values FROM raw"
        for t in TARGETS
    )
)


CUSTOMER_TEXT = {
    "c_name": "c_name",
    "c_mktsegment": "c_mktsegment",
    "nation": "cast(c_nationkey AS string)",
    "one": "'x'",
    "none": "cast(NULL AS string)",
    "over_limit": "cast(c_custkey % 51 AS string)",
    "at_limit": "cast(c_custkey % 50 AS string)",
}


def id_like_columns(spark, sf_dir):
    df = derive(table(spark, sf_dir, "customer"), CUSTOMER_TEXT)
    found = prepare.level_counts(df, df.columns)
    return found.select(
        "column_name",
        F.least(F.coalesce("levels", F.lit(51)), F.lit(51)).cast("long").alias("levels_to_51"),
        "id_like",
        "row_count",
    )


ID_LIKE_SQL = """
WITH counted AS ({})
SELECT column_name, least(levels, 51) AS levels_to_51,
       levels <= 1 OR levels > 50 OR (row_count >= 20 AND levels > greatest(20, row_count // 2)) AS id_like,
       row_count FROM counted
""".format(
    " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, count(DISTINCT {e}) AS levels, count(*) AS row_count FROM customer"
        for n, e in CUSTOMER_TEXT.items()
    )
)


def feature_frame(spark, sf_dir):
    loaded, _ = load_table(table(spark, sf_dir, "part"))
    features = prepare.choose_features(loaded, "p_retailprice", skip=("p_partkey",))
    return prepare.feature_frame(loaded, features, "p_retailprice", keep=("p_partkey",))


# p_name has more than 50 levels and is left out; the numeric input comes first.
FEATURE_SQL = """
SELECT cast(p_partkey AS double) AS p_partkey, cast(p_size AS double) AS p_size, p_brand, p_type,
       p_retailprice FROM part
"""

AMOUNT = (
    "CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 7 = 0 THEN 'bad'"
    " ELSE cast(o_totalprice AS string) END"
)


def usable_rows(spark, sf_dir):
    df = derive(wide_table(spark, sf_dir, "orders"), {"row_key": "o_orderkey", "amount": AMOUNT})
    parts = [
        prepare.usable_rows(df, "amount", prepare.Task(kind)).select(
            F.lit(kind).alias("task"), "row_key"
        )
        for kind in ("regression", "multiclass")
    ]
    return parts[0].unionByName(parts[1])


USABLE_SQL = f"""
WITH raw AS (SELECT o_orderkey AS row_key, {AMOUNT} AS amount FROM orders)
SELECT 'regression' AS task, row_key FROM raw WHERE try_cast(amount AS double) IS NOT NULL
UNION ALL SELECT 'multiclass', row_key FROM raw WHERE amount IS NOT NULL
"""


def label_encode(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    classes = prepare.class_labels(df, "o_orderpriority")
    return prepare.encode_labels(df, "o_orderpriority", classes, "label_index").select(
        "o_orderkey", "o_orderpriority", "label_index"
    )


LABEL_SQL = """
SELECT o_orderkey, o_orderpriority,
       cast(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS double) AS label_index FROM orders
"""


def _filled(spark, sf_dir, features, total):
    """Per input: the fill value, the cells it fills, and a figure after filling."""
    df = lines(spark, sf_dir)
    fill = prepare.fill_values(df, features)
    kind, values = ("double", fill.numeric) if features.numeric else ("string", fill.categorical)
    counted = df.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(values[c]).cast(kind).alias("fill_value"),
                F.count_if(F.col(c).isNull()).alias("cells_filled"),
                total(fill.column(c)).alias("after"),
            ).alias(c)
            for c in features.names
        ]
    )
    return counted.select(F.inline(F.array(*features.names)))


def impute_median(spark, sf_dir):
    out = _filled(spark, sf_dir, prepare.Features(LINE_FEATURES.numeric, ()), F.avg)
    return out.select(
        "feature",
        F.round("fill_value", 6).alias("fill_value"),
        "cells_filled",
        F.round("after", 7).alias("mean_after"),
    )


MEDIAN_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {rounded('m')} AS fill_value, count(*) - count({c}) AS cells_filled,"
    f" {rounded(f"avg(coalesce({c}, m))", 7)} AS mean_after"
    f" FROM ({LINES_SQL}), (SELECT median({c}) AS m FROM ({LINES_SQL})) GROUP BY m"
    for c in LINE_FEATURES.numeric
)


def impute_mode(spark, sf_dir):
    out = _filled(spark, sf_dir, prepare.Features((), LINE_FEATURES.categorical), F.count)
    return out.withColumnRenamed("after", "filled_after")


MODE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT {c} FROM ({LINES_SQL}) WHERE {c} IS NOT NULL GROUP BY {c}"
    f" ORDER BY count(*) DESC, {c} LIMIT 1) AS fill_value, count(*) - count({c}) AS cells_filled,"
    f" count(*) AS filled_after FROM ({LINES_SQL})"
    for c in LINE_FEATURES.categorical
)


def one_hot(spark, sf_dir):
    """The flags as the learners get them, from the fitted preparation stages."""
    df = lines(spark, sf_dir)
    features = prepare.Features((), ("flag",))
    # Fitted on two of the levels: the third is unknown and has no 1, as missing flags have none.
    known = df.where("flag IN ('A', 'N')")
    stages = preparation_stages(features, prepare.Fill({}, {"flag": None}))
    ready = Pipeline(stages=stages).fit(known).transform(df)
    flags = vector_to_array("inputs")
    return ready.select("row_key", *[flags[i].cast("int").alias(f"flag_{v}") for i, v in enumerate("AN")])


ONE_HOT_SQL = "SELECT row_key, {} FROM ({})".format(
    ", ".join(f"CASE WHEN flag = '{v}' THEN 1 ELSE 0 END AS flag_{v}" for v in "AN"), LINES_SQL
)


def holdout_split(spark, sf_dir):
    return prepare.holdout_split(orders(spark, sf_dir).select("row_key"), "row_key")


SPLIT_ORDER = "substr(md5('42|split|' || row_key), 1, 15), row_key"
HOLDOUT_SQL = f"""
SELECT row_key, CASE WHEN row_number() OVER (ORDER BY {SPLIT_ORDER}) <= ceil(0.25 * count(*) OVER ())
       THEN 'test' ELSE 'train' END AS split FROM ({ORDERS_SQL})
"""


def stratified_split(spark, sf_dir):
    df = orders(spark, sf_dir).select("row_key", "grade")
    return prepare.holdout_split(df, "row_key", stratify="grade")


STRATIFIED_SQL = f"""
WITH rows AS (SELECT row_key, grade FROM ({ORDERS_SQL})),
counts AS (SELECT grade, count(*) AS n FROM rows GROUP BY grade),
shares AS (SELECT grade, n * ceil(0.25 * sum(n) OVER ()) / sum(n) OVER () AS exact,
                  ceil(0.25 * sum(n) OVER ()) AS wanted FROM counts),
taken AS (SELECT grade, floor(exact) + CASE WHEN
            row_number() OVER (ORDER BY floor(exact) - exact, grade) <= wanted - sum(floor(exact)) OVER ()
            THEN 1 ELSE 0 END AS test_rows FROM shares)
SELECT row_key, r.grade,
       CASE WHEN row_number() OVER (PARTITION BY r.grade ORDER BY {SPLIT_ORDER}) <= test_rows
            THEN 'test' ELSE 'train' END AS split
FROM rows r JOIN taken t ON r.grade = t.grade
"""

ENTRIES = {
    "target_cardinality": (target_cardinality, CARDINALITY_SQL),
    "id_like_columns": (id_like_columns, ID_LIKE_SQL),
    "feature_frame": (feature_frame, FEATURE_SQL),
    "usable_rows": (usable_rows, USABLE_SQL),
    "label_encode": (label_encode, LABEL_SQL),
    "impute_median": (impute_median, MEDIAN_SQL),
    "impute_mode": (impute_mode, MODE_SQL),
    "one_hot": (one_hot, ONE_HOT_SQL),
    "holdout_split": (holdout_split, HOLDOUT_SQL),
    "stratified_split": (stratified_split, STRATIFIED_SQL),
}
