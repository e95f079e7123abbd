"""Feature choice, task resolution, imputation values and the holdout split."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leverscope.errors import AnalysisError
from leverscope.functions.hashing import HASH_DIGITS, hash_long
from leverscope.functions.scalars import nan_to_null
from leverscope.operators.joins import BROADCAST_ROWS
from leverscope.operators.order import exact_medians, order_statistics
from leverscope.functions.scalars import quoted
from leverscope.operators.profile import BOOLEAN_MARK, validate_target

# The rule for text columns that identify rather than describe.
MOST_LEVELS = 50
ID_RULE_ROWS = 20
ID_RULE_LEVELS = 20
# Usable rows needed, rows needed to hold some out, the part held out.
LEAST_ROWS = 8
SPLIT_ROWS = 24
TEST_SHARE = 0.25

# With the default 512 registers a distinct-count sketch of at most 50 values has at
# most 50 filled registers, so it reads 512 * ln(512 / 462) < 53. A column whose
# sketch is above this mark therefore has more than 50 levels for certain.
SKETCH_MARK = 100


@dataclass(frozen=True)
class Features:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]

    @property
    def names(self) -> tuple[str, ...]:
        return self.numeric + self.categorical


@dataclass(frozen=True)
class Task:
    kind: str  # regression, binary, multiclass

    @property
    def is_classification(self) -> bool:
        return self.kind != "regression"


def target_cardinality(df: DataFrame, targets: list[str]) -> DataFrame:
    """Per column 0, 1, 2 or 3 ("three or more") distinct values, and what follows.

    Smallest and largest value settle 0 and 1; a third value exists exactly when
    some row lies strictly between them. Two map-side passes, no distinct.
    """
    ends = df.agg(
        *[
            F.struct(
                F.min(quoted(t)).alias("low"), F.max(quoted(t)).alias("high")
            ).alias(f"e{i}")
            for i, t in enumerate(targets)
        ]
    ).first()
    between = []
    for i, t in enumerate(targets):
        low, high = ends[i]["low"], ends[i]["high"]
        if low is None or low == high:
            between.append(F.lit(False))
        else:
            kind = df.schema[t].dataType
            between.append(
                F.coalesce(
                    F.bool_or(
                        (quoted(t) > F.lit(low).cast(kind)) & (quoted(t) < F.lit(high).cast(kind))
                    ),
                    F.lit(False),
                )
            )
    least = [0 if e["low"] is None else 1 if e["low"] == e["high"] else 2 for e in ends]
    row = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("target"),
                    F.when(between[i], 3).otherwise(least[i]).alias("distinct_values"),
                )
                for i, t in enumerate(targets)
            ]
        ).alias("found")
    )
    n = F.col("distinct_values")
    return row.select(F.inline("found")).select(
        "target",
        n.cast("int").alias("distinct_values"),
        F.when(n == 2, "binary").otherwise("regression").alias("auto_task"),
        (n == 2).alias("binary_allowed"),
        (n == 3).alias("multiclass_allowed"),
    )


def resolve_task(df: DataFrame, target: str, requested: str | None = "auto") -> Task:
    wanted = (requested or "auto").strip().lower()
    if wanted not in ("", "auto", "regression", "binary", "multiclass"):
        raise AnalysisError("invalidTask", "Use auto, regression, binary or multiclass.")
    if wanted == "regression":
        return Task("regression")
    found = target_cardinality(df, [target]).first()
    amount = "three or more" if found["distinct_values"] == 3 else found["distinct_values"]
    if wanted == "binary" and not found["binary_allowed"]:
        raise AnalysisError("invalidBinaryTarget", f"Two target values are needed, not {amount}.")
    if wanted == "multiclass" and not found["multiclass_allowed"]:
        raise AnalysisError(
            "invalidMulticlassTarget", f"Three target values are needed, not {amount}."
        )
    return Task(found["auto_task"] if wanted in ("", "auto") else wanted)


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, levels, id_like, row_count), exact wherever it matters.

    A sketch pass finds the columns certainly above the limit (their ``levels`` is
    the sketch); the others have few values, which a set aggregate counts exactly.
    """
    row_count, *sketches = df.agg(
        F.count(F.lit(1)), *[F.approx_count_distinct(quoted(c)).alias(c) for c in columns]
    ).first()
    low = [c for c, n in zip(columns, sketches) if n <= SKETCH_MARK]
    exact = {}
    if low:
        row = df.agg(*[F.size(F.collect_set(quoted(c))).alias(c) for c in low]).first()
        exact = dict(zip(low, row))
    out = []
    for c, sketch in zip(columns, sketches):
        levels = exact.get(c, sketch)
        id_like = (
            c not in exact
            or levels <= 1
            or levels > MOST_LEVELS
            or (row_count >= ID_RULE_ROWS and levels > max(ID_RULE_LEVELS, row_count // 2))
        )
        out.append((c, int(levels) if c in exact else None, id_like, row_count))
    return df.sparkSession.createDataFrame(
        out, "column_name string, levels int, id_like boolean, row_count long"
    )


def choose_features(df: DataFrame, target: str, skip: tuple[str, ...] = ()) -> Features:
    """Numeric columns first, then the text columns that are not id-like."""
    validate_target(df, target)
    fields = [f for f in df.schema.fields if f.name != target and f.name not in skip]
    odd = [f.name for f in fields if not isinstance(f.dataType, (T.NumericType, T.StringType))]
    if odd:
        raise AnalysisError("invalidColumns", f"Neither number nor text: {', '.join(odd)}.")
    numeric = tuple(f.name for f in fields if isinstance(f.dataType, T.NumericType))
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    id_like = (
        {r["column_name"] for r in level_counts(df, text).collect() if r["id_like"]}
        if text
        else set()
    )
    features = Features(numeric, tuple(c for c in text if c not in id_like))
    if not features.names:
        raise AnalysisError("noFeatures", "No column besides the target can serve as input.")
    return features


def feature_frame(
    df: DataFrame, features: Features, target: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    return df.select(*keep, *[quoted(c) for c in features.names], quoted(target))


def usable_rows(df: DataFrame, target: str, task: Task) -> DataFrame:
    """Rows whose target counts; a regression target must also be a number."""
    if task.is_classification:
        return df.where(quoted(target).isNotNull())
    value = quoted(target).try_cast("double")
    return df.where(nan_to_null(value).isNotNull())


def label_text(df: DataFrame, target: str) -> Column:
    """The target as class label: a whole number without decimals, a boolean as True or False."""
    value = quoted(target)
    text = value.cast("string")
    field = df.schema[target]
    if isinstance(field.dataType, T.BooleanType) or field.metadata == BOOLEAN_MARK:
        return F.when(value.cast("double") == 1.0, "True").when(value.isNotNull(), "False")
    if isinstance(df.schema[target].dataType, (T.FloatType, T.DoubleType)):
        whole = (value == F.floor(value)) & (F.abs(value) < F.lit(1e15))
        return F.when(whole, value.cast("long").cast("string")).otherwise(text)
    return text


def class_labels(df: DataFrame, target: str) -> list[str]:
    """Sorted distinct target texts. They are part of a fitted model, so they are kept on the driver."""
    rows = df.select(label_text(df, target).alias("label")).where(F.col("label").isNotNull()).distinct().collect()
    return sorted(r["label"] for r in rows)


def encode_labels(df: DataFrame, label: str, classes: list[str], name: str) -> DataFrame:
    """Add the class index as double: the label's place in the sorted classes, NULL for an unknown label.

    The column says how many classes there are; a learner that has to guess stops at 100.
    """
    places = df.sparkSession.createDataFrame(list(zip(classes, map(float, range(len(classes))))), f"`{label}` string, `{name}` double")
    small = len(classes) <= BROADCAST_ROWS
    encoded = df.join(F.broadcast(places) if small else places, label, "left")
    return encoded.withMetadata(name, {"ml_attr": {"name": name, "type": "nominal", "num_vals": len(classes)}})


@dataclass(frozen=True)
class Fill:
    """What stands in for a missing cell, per feature."""

    numeric: dict[str, float | None]
    categorical: dict[str, str | None]

    def column(self, name: str) -> Column:
        if name in self.numeric:
            value = self.numeric[name]
            return quoted(name) if value is None else F.coalesce(quoted(name), F.lit(value))
        value = self.categorical[name]
        return quoted(name) if value is None else F.coalesce(quoted(name), F.lit(value))


def fill_values(df: DataFrame, features: Features) -> Fill:
    """Exact medians and most frequent levels (ties: smallest).

    Medians use range narrowing; the level counts are bounded by the id-like rule.
    """
    medians = exact_medians(df, list(features.numeric))
    modes: dict[str, str | None] = {}
    if features.categorical:
        row = df.agg(*[F.mode(quoted(c), True).alias(c) for c in features.categorical]).first()
        modes = dict(zip(features.categorical, row))
    return Fill(medians, modes)


def _cut(
    df: DataFrame, key: str, wanted: dict[str, int], rows: dict[str, int]
) -> dict[str, tuple[int, object]]:
    """Per hash column: the (hash, key) pair at the given rank.

    Hashes are uniform, so the value at a rank is known up to a little; counting
    around that guess and sorting the few hashes left are the only passes.
    """
    wanted = {c: rank for c, rank in wanted.items() if rank > 0}
    top = 16**HASH_DIGITS - 1
    ranks, guesses = {}, {}
    for c, rank in wanted.items():
        ranks[c] = [r for r in (rank, rank + 1) if r <= rows[c]]
        slack = 4.0 * (rows[c] ** 0.5) / rows[c]
        near = [int(min(max(rank / rows[c] + d, 0.0), 1.0) * top) for d in (-slack, slack)]
        guesses[c] = {r: near for r in ranks[c]}
    marks = order_statistics(df, ranks, {c: (rows[c], 0, top) for c in wanted}, guesses)
    cuts = {}
    for c, rank in wanted.items():
        mark, last = marks[c][rank], None
        if marks[c].get(rank + 1) == mark:  # rows share the hash: the key decides
            less = df.where(F.col(c) < mark).count()
            ties = df.where(F.col(c) == mark).orderBy(key).limit(rank - less)
            last = ties.agg(F.max(key)).first()[0]
        cuts[c] = (mark, last)
    return cuts


# Leading bits of the split hash that one bucket of a class shares.
CUT_BITS = 12


def _class_cuts(hashed: DataFrame, key: str, stratify: str, wanted: list[tuple]) -> DataFrame:
    """(cut_class, cut_hash, cut_key): per class the last row that is held out.

    Two passes for any number of classes: rows per class and leading hash bits give the bucket
    that holds the last row, then the rows of these buckets alone, a 4,096th of a class, are ordered.
    """
    field = hashed.schema[stratify]
    asked = hashed.sparkSession.createDataFrame(
        wanted, T.StructType([T.StructField("cut_class", field.dataType), T.StructField("wanted", T.LongType())])
    )
    asked = F.broadcast(asked) if len(wanted) <= BROADCAST_ROWS else asked
    bucket = F.shiftright(SPLIT_HASH, 4 * HASH_DIGITS - CUT_BITS).alias("bucket")
    counts = hashed.groupBy(F.col(stratify).alias("of_class"), bucket).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("of_class").orderBy("bucket"))
    reached = counts.withColumn("upto", upto).join(asked, F.col("of_class").eqNullSafe(F.col("cut_class")))
    last = reached.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted"))).select(
        "cut_class", "bucket", (F.col("wanted") - F.col("upto") + F.col("n")).alias("left")
    )
    last = F.broadcast(last) if len(wanted) <= BROADCAST_ROWS else last
    rows = hashed.select(F.col(stratify).alias("of_class"), F.col(key).alias("cut_key"), F.col(SPLIT_HASH).alias("cut_hash"), bucket)
    near = rows.join(last, F.col("of_class").eqNullSafe(F.col("cut_class")) & (rows["bucket"] == last["bucket"]))
    place = F.row_number().over(Window.partitionBy("cut_class").orderBy("cut_hash", "cut_key"))
    return near.withColumn("place", place).where(F.col("place") == F.col("left")).select("cut_class", "cut_hash", "cut_key")


def _before(hash_column: Column, key: Column, cut: tuple[int, object]) -> Column:
    mark, last = cut
    if last is None:
        return hash_column <= F.lit(mark)
    return (hash_column < F.lit(mark)) | ((hash_column == F.lit(mark)) & (key <= F.lit(last)))


SPLIT_HASH = "split_hash"


def with_split_hash(df: DataFrame, key: str, seed: int | str = 42) -> DataFrame:
    """Add the hash ``holdout_split`` orders by, so that it can be stored with the rows."""
    return df.withColumn(SPLIT_HASH, hash_long(F.col(key), seed, "split"))


def holdout_allocation(class_rows: list[int], share: float = TEST_SHARE) -> list[int]:
    """Test rows per class: proportional, ceil(share * n) in all, largest remainder first."""
    total = sum(class_rows)
    wanted = math.ceil(share * total)
    exact = [n * wanted / total for n in class_rows]
    taken = [math.floor(x) for x in exact]
    order = sorted(range(len(class_rows)), key=lambda i: (taken[i] - exact[i], i))
    for i in order[: wanted - sum(taken)]:
        taken[i] += 1
    return taken


def holdout_split(
    df: DataFrame,
    key: str,
    seed: int | str = 42,
    share: float = TEST_SHARE,
    stratify: str | None = None,
) -> DataFrame:
    """Add ``split`` = train / test.

    The ceil(share * n) rows with the smallest key hash are the test rows (per
    class when stratified). The cut-off hash is found by range narrowing, so the
    table itself is filtered, never shuffled. Under 24 rows every row is both.
    """
    hashed = df if SPLIT_HASH in df.columns else with_split_hash(df, key, seed)
    if stratify is None:
        total = hashed.count()
        if total < SPLIT_ROWS:
            return hashed.withColumn("split", F.lit("both")).drop(SPLIT_HASH)
        narrow = hashed.select(key, SPLIT_HASH)
        wanted = {SPLIT_HASH: math.ceil(share * total)}
        cut = _cut(narrow, key, wanted, {SPLIT_HASH: total})[SPLIT_HASH]
        is_test = _before(F.col(SPLIT_HASH), F.col(key), cut)
    else:
        counted = hashed.groupBy(stratify).count().orderBy(stratify).collect()  # a row per class
        rows = [r["count"] for r in counted]
        if sum(rows) < SPLIT_ROWS or min(rows) < 2:
            return holdout_split(hashed, key, seed, share)
        wanted = [(r[stratify], n) for r, n in zip(counted, holdout_allocation(rows, share)) if n > 0]
        cuts = _class_cuts(hashed, key, stratify, wanted)
        same = hashed[stratify].eqNullSafe(cuts["cut_class"])
        joined = hashed.join(F.broadcast(cuts) if len(wanted) <= BROADCAST_ROWS else cuts, same, "left")
        mark, here = F.col("cut_hash"), F.col(SPLIT_HASH)
        is_test = (here < mark) | ((here == mark) & (F.col(key) <= F.col("cut_key")))
        hashed = joined.withColumn("is_test", F.coalesce(is_test, F.lit(False))).select(*hashed.columns, "is_test")
        return hashed.withColumn("split", F.when(F.col("is_test"), "test").otherwise("train")).drop(SPLIT_HASH, "is_test")
    return hashed.withColumn("split", F.when(is_test, "test").otherwise("train")).drop(SPLIT_HASH)
