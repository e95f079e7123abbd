"""Permutation importance and the direction each input pushes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leverscope.functions.scalars import finite_or_null, finite_or_zero, pair_correlation, pair_count
from leverscope.operators.ensemble import TreeScorer, added_cell_losses, added_losses, cell_codes
from leverscope.operators.order import bucket_digits, bucket_starts, hash_buckets
from leverscope.operators.prepare import Features
from leverscope.functions.scalars import quoted
from leverscope.operators.scorers import Scorer, response

# Repeats on a small and on an ordinary table, and where small ends.
SMALL_ROWS = 40
SMALL_REPEATS = 4
REPEATS = 8
# The least number of pairs, and the correlation counted as flat.
LEAST_PAIRS = 5
FLAT_CORRELATION = 0.08
FLAT_STEP = 1e-6
# Names carried through the permutation; ``actual`` is what a scored frame calls it.
ACTUAL = "actual"
OWN_LOSS = "own_loss"


def with_donors(
    df: DataFrame,
    key: str,
    row: list[str],
    repeats: int,
    seed: int | str = 42,
    digits: int | None = None,
) -> DataFrame:
    """Pair each row with ``repeats`` donor rows: (own, repeat, donor) per pair.

    Rows are put in a random order by key hash; in repeat r the donor is the row r
    places further on, the first rows following the last. Each repeat is thereby a
    permutation: every row is donor once. The rows are shuffled and sorted a single
    time, within hash buckets. Only the last few rows of a bucket need a donor from
    another one; those come from a table of each bucket's first ``repeats`` rows,
    which is broadcast (at most repeats x 65,536 rows).
    """
    located, heads = _located(df, key, row, repeats, seed, digits)
    paired = _stepped(located)
    return paired.join(F.broadcast(heads), "donor_place", "left").select(
        "own", "repeat", F.coalesce("near", "head").alias("donor")
    )


def _located(df: DataFrame, key: str, row: list[str], repeats: int, seed: int | str, digits: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows (own, donors, place, all_rows) in random order, donors missing at a bucket's end; and the rows that begin the buckets."""
    hashed = hash_buckets(df.select(key, *[quoted(c) for c in row]), key, seed, digits)
    packed = hashed.select(
        "hash_bucket", "hash_order", key, F.struct(*[quoted(c) for c in row]).alias("own")
    )
    order = Window.partitionBy("hash_bucket").orderBy("hash_order", key)
    placed = packed.select(
        "hash_bucket",
        "own",
        F.row_number().over(order).alias("bucket_place"),
        F.array(*[F.lead("own", r).over(order) for r in range(1, repeats + 1)]).alias("donors"),
    )
    starts = F.broadcast(bucket_starts(hashed))
    located = placed.join(starts, "hash_bucket").withColumn(
        "place", F.col("bucket_start") + F.col("bucket_place")
    )
    heads = located.where(F.col("bucket_place") <= repeats).select(
        F.col("place").alias("donor_place"), F.col("own").alias("head")
    )
    return located, heads


def _stepped(located: DataFrame) -> DataFrame:
    """A row per donor; where the donor lies in the next bucket its place stands instead."""
    return located.select(
        "own", "place", "all_rows", F.posexplode("donors").alias("step", "near")
    ).select(
        "own",
        (F.col("step") + 1).alias("repeat"),
        "near",
        F.when(
            F.col("near").isNull(), (F.col("place") + F.col("step")) % F.col("all_rows") + 1
        ).alias("donor_place"),
    )


def donor_lists(
    df: DataFrame, key: str, row: list[str], repeats: int, seed: int | str = 42, digits: int | None = None
) -> DataFrame:
    """The pairs of ``with_donors``, a row with its donors in one list: (own, donors, repeats).

    Only rows at a bucket's end, ``repeats`` a bucket, look for donors in the next one, so nothing
    else is joined and nothing is broadcast.
    """
    located, heads = _located(df, key, row, repeats, seed, digits)
    inner = F.element_at("donors", -1).isNotNull()
    every = F.array(*[F.lit(r) for r in range(1, repeats + 1)])
    ends = _stepped(located.where(~inner)).join(heads, "donor_place", "left")
    return located.where(inner).select("own", "donors", every.alias("repeats")).unionByName(
        ends.select("own", F.array(F.coalesce("near", "head")).alias("donors"), F.array("repeat").alias("repeats"))
    )


def tree_permutation_scores(
    df: DataFrame,
    features: Features,
    scorer: TreeScorer,
    key: str,
    actual: str,
    repeats: int,
    seed: int | str,
    digits: int | None,
) -> DataFrame:
    """``permutation_scores`` of an ensemble: per row the sum over all trees once, then per input and
    donor the trees of that input alone, where the row lies; rows are cells where the cells of the cuts are few. A sum per (feature, repeat) and task is shuffled."""
    plain = df.select(key, *[quoted(c) for c in features.names], quoted(actual).cast("double").alias(ACTUAL))
    ready = scorer.prepared(plain, "inputs").select(key, "inputs", ACTUAL)
    total = ready.agg(F.count(F.lit(1)).alias("rows"), F.var_pop(ACTUAL).alias("variance")).first()
    if scorer.trees.kept is not None:
        digits = bucket_digits(total["rows"]) if digits is None else digits
        hashed = hash_buckets(cell_codes(ready, scorer.trees, key), key, seed, digits)
        ordered = hashed.repartition("hash_bucket").sortWithinPartitions("hash_bucket", "hash_order", key)
        sums, _ = added_cell_losses(ordered, scorer.trees, repeats)
        added = df.sparkSession.createDataFrame([(*k, v) for k, v in sums.items()], "feature_pos int, repeat int, added double")
        return _losses(added, total)
    pairs = donor_lists(ready, key, ["inputs", ACTUAL], repeats, seed, digits).select(
        "own.inputs", F.col("own")[ACTUAL].alias(ACTUAL), F.col("donors.inputs").alias("donors"), "repeats"
    )
    return _losses(added_losses(pairs, scorer.trees), total)


def _losses(added: DataFrame, total: Row) -> DataFrame:
    return added.groupBy("feature_pos", "repeat").agg(
        F.lit(total["rows"]).alias("rows"),
        F.sum("added").alias("added_loss"),
        F.lit(total["variance"]).cast("double").alias("variance"),
    )


def permutation_scores(
    df: DataFrame,
    features: Features,
    scorer: Scorer,
    key: str = "row_key",
    actual: str = "actual",
    repeats: int = REPEATS,
    seed: int | str = 42,
    digits: int | None = None,
) -> DataFrame:
    """Added loss per (feature, repeat) when that feature alone is permuted.

    Loss is the squared error, or 1 for a miss. Each row's own loss is carried along
    and subtracted row by row, so a feature the model does not use adds exactly 0
    whatever the order of summation. Each pair of rows is expanded to one variant
    per feature and all of them are scored in one pass; the partial aggregate leaves
    a row per (feature, repeat) and task to shuffle.
    """
    names = features.names
    trees = getattr(scorer, "trees", None)
    if trees is not None:
        return tree_permutation_scores(df, features, trees, key, actual, repeats, seed, digits)

    def loss() -> Column:
        if scorer.classes is None:
            error = F.col("prediction") - F.col(ACTUAL)
            return error * error
        return (F.col("prediction") != F.col(ACTUAL)).cast("double")

    plain = df.select(key, *[quoted(c) for c in names], quoted(actual).alias(ACTUAL))
    own = scorer.score(plain).withColumn(OWN_LOSS, loss())
    pairs = with_donors(own, key, [*names, ACTUAL, OWN_LOSS], repeats, seed, digits)
    spread = pairs.select(
        "own",
        "donor",
        "repeat",
        F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("feature_pos"),
    )
    variants = spread.select(
        "feature_pos",
        "repeat",
        F.col("own")[ACTUAL].alias(ACTUAL),
        F.col("own")[OWN_LOSS].alias(OWN_LOSS),
        *[
            F.when(F.col("feature_pos") == i, F.col("donor")[c])
            .otherwise(F.col("own")[c])
            .alias(c)
            for i, c in enumerate(names, 1)
        ],
    )
    return scorer.score(variants).groupBy("feature_pos", "repeat").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(loss() - F.col(OWN_LOSS)).alias("added_loss"),
        F.var_pop(ACTUAL).alias("variance"),
    )


def permutation_importance(
    df: DataFrame,
    features: Features,
    scorer: Scorer,
    key: str = "row_key",
    actual: str = "actual",
    repeats: int = REPEATS,
    seed: int | str = 42,
    digits: int | None = None,
) -> DataFrame:
    """(feature_pos, feature, importance): mean drop of R² or accuracy, never below 0."""
    losses = permutation_scores(df, features, scorer, key, actual, repeats, seed, digits)
    scale = F.col("rows").cast("double")
    if scorer.classes is None:
        scale = scale * F.col("variance")
    drop = finite_or_null(F.try_divide("added_loss", scale))
    names = F.array(*[F.lit(c) for c in features.names])
    # features x repeats rows from here on.
    return losses.groupBy("feature_pos").agg(F.avg(drop).alias("drop")).select(
        F.col("feature_pos").cast("int").alias("feature_pos"),
        F.element_at(names, F.col("feature_pos").cast("int")).alias("feature"),
        F.greatest(finite_or_zero(F.col("drop")), F.lit(0.0)).alias("importance"),
    )


def rank_importance(importance: DataFrame, top: int | None = None) -> DataFrame:
    """Add share and rank; ties keep feature order; ``top`` cuts after the shares."""
    everything = Window.partitionBy()
    total = F.sum("importance").over(everything)
    by_size = Window.orderBy(F.desc("importance"), "feature_pos")
    ranked = importance.withColumns(
        {
            "share": F.col("importance") / F.when(total == 0, 1.0).otherwise(total),
            "rank": F.row_number().over(by_size),
        }
    )
    return ranked if top is None else ranked.where(F.col("rank") <= max(1, top))


def direction_of(correlation: Column) -> Column:
    return (
        F.when(correlation > FLAT_CORRELATION, "up")
        .when(correlation < -FLAT_CORRELATION, "down")
        .when(correlation.isNotNull(), "flat")
    )


def numeric_direction(scored: DataFrame, columns: list[str], answer: Column) -> DataFrame:
    """(feature, correlation, direction) of each numeric column with the response."""
    measures = [
        F.struct(
            F.lit(c).alias("feature"),
            F.when(
                pair_count(quoted(c), answer) >= LEAST_PAIRS,
                finite_or_null(pair_correlation(quoted(c), answer)),
            ).alias("correlation"),
        ).alias(f"m{i}")
        for i, c in enumerate(columns)
    ]
    each = scored.agg(*measures).select(
        F.inline(F.array(*[F.col(f"m{i}") for i in range(len(columns))]))
    )
    return each.withColumn("direction", direction_of(F.col("correlation")))


def categorical_direction(scored: DataFrame, columns: list[str], answer: Column) -> DataFrame:
    """(feature, correlation, direction): spread of the mean response over the levels.

    The spread is never negative, so a categorical input is up, flat or unknown.
    """
    levels = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("feature"), quoted(c).alias("level")) for c in columns]
        )
    )
    means = (
        scored.select(answer.alias("answer"), levels.alias("f"))
        .where(F.col("f.level").isNotNull() & F.col("answer").isNotNull())
        .groupBy("f.feature", "f.level")
        .agg(F.avg("answer").alias("mean"))
    )
    spread = means.groupBy("feature").agg(
        F.when(F.count(F.lit(1)) >= 2, F.max("mean") - F.min("mean")).alias("correlation")
    )
    present = scored.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return present.join(F.broadcast(spread), "feature", "left").withColumn(
        "direction",
        F.when(F.abs("correlation") < FLAT_STEP, "flat").when(F.col("correlation") > 0, "up"),
    )


def directions(scored: DataFrame, features: Features, answer: Column) -> DataFrame:
    parts = []
    if features.numeric:
        parts.append(numeric_direction(scored, list(features.numeric), answer))
    if features.categorical:
        parts.append(categorical_direction(scored, list(features.categorical), answer))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def class_push(scored: DataFrame, feature: str, classes: list[str]) -> DataFrame:
    """Correlation of one numeric input with each class's probability.

    Classes are expanded on the map side; one partial aggregate row each is shuffled.
    """
    value, chance = quoted(feature), F.col("chance")
    each = scored.select(
        quoted(feature), F.posexplode("probability").alias("class_index", "chance")
    )
    labels = F.array(*[F.lit(c) for c in classes])
    found = each.groupBy("class_index").agg(
        F.when(
            pair_count(value, chance) >= LEAST_PAIRS,
            finite_or_null(pair_correlation(value, chance)),
        ).alias("correlation")
    )
    return found.select(
        "class_index",
        F.element_at(labels, F.col("class_index") + 1).alias("label"),
        F.lit(feature).alias("feature"),
        F.coalesce(direction_of(F.col("correlation")), F.lit("flat")).alias("direction"),
        "correlation",
    )


def explain_importance(
    df: DataFrame,
    features: Features,
    scorer: Scorer,
    key: str = "row_key",
    actual: str = "actual",
    repeats: int | None = None,
    seed: int | str = 42,
    top: int | None = None,
) -> DataFrame:
    """The full importance table: importance, share, direction, correlation, rank."""
    if repeats is None:
        small = df.limit(SMALL_ROWS).count() < SMALL_ROWS
        repeats = SMALL_REPEATS if small else REPEATS
    found = permutation_importance(df, features, scorer, key, actual, repeats, seed)
    pushes = directions(scorer.score(df.select(*[quoted(c) for c in features.names])), features, response(scorer))
    return (
        rank_importance(found, top)
        .join(F.broadcast(pushes), "feature", "left")
        .select(
            "feature_pos", "feature", "importance", "share", "direction", "correlation", "rank"
        )
    )
