"""Process data with a known formula, for trying things out.

Every draw comes from the row's key (see ``functions.hashing``), so a table of any
size is made in parallel and is the same each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leverscope.functions.hashing import hash_long, normal, uniform
from leverscope.operators.order import order_statistics
from leverscope.sources.tables import write_csv

# Fixed values: (column, mean, spread, least, most, decimals) of each setting.
SETTINGS = (
    ("Temperature", 182.0, 14.0, 148.0, 218.0, 2),
    ("Pressure", 2.2, 0.35, 1.2, 3.4, 3),
    ("TimeSec", 45.0, 10.0, 15.0, 90.0, 1),
    ("AdditivePct", 2.6, 0.7, 0.5, 4.8, 3),
    ("PreheatMin", 18.0, 5.0, 6.0, 36.0, 1),
    ("CoolRate", 2.1, 0.4, 0.8, 3.6, 3),
    ("Humidity", 48.0, 9.0, 22.0, 78.0, 1),
)
# Upper ends of the line shares 0.42, 0.35, 0.23.
LINES = (("L1", 0.42), ("L2", 0.77), ("L3", 1.0))
# Effect of one unit of each setting, of each line, and of noise.
CONDUCTIVITY_SLOPES = {
    "Temperature": 0.16,
    "AdditivePct": 1.05,
    "TimeSec": 0.07,
    "Pressure": 0.55,
    "PreheatMin": 0.08,
    "CoolRate": -0.32,
    "Humidity": -0.016,
}
CONDUCTIVITY_BASE = 12.0
CONDUCTIVITY_HEAT_ADDITIVE = 0.012
CONDUCTIVITY_LINES = {"L1": 0.28, "L2": 0.0, "L3": -0.22}
CONDUCTIVITY_NOISE = 0.62
REJECT_SLOPES = {
    "Temperature": 0.22,
    "AdditivePct": 0.18,
    "TimeSec": 0.03,
    "Pressure": 0.15,
    "PreheatMin": 0.04,
    "CoolRate": -0.08,
    "Humidity": -0.006,
}
REJECT_LINES = {"L1": 0.12, "L2": 0.0, "L3": -0.10}
REJECT_NOISE = 0.55
# Columns that lose cells, the least number lost, rows per lost cell.
HOLE_COLUMNS = ("Humidity", "Pressure", "TimeSec", "AdditivePct", "PreheatMin")
LEAST_HOLES = 4
ROWS_PER_HOLE = 28

_MEANS = {name: mean for name, mean, *_ in SETTINGS}


def _slopes(slopes: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, slope in slopes.items():
        total = total + F.lit(slope) * (F.col(name) - F.lit(_MEANS[name]))
    return total


def _line_effect(effects: dict[str, float]) -> Column:
    effect = F.lit(effects["L3"])
    return (
        F.when(F.col("LineId") == "L1", effects["L1"])
        .when(F.col("LineId") == "L2", effects["L2"])
        .otherwise(effect)
    )


def conductivity() -> Column:
    """The outcome formula, without noise, over the setting columns."""
    both = (F.col("Temperature") - F.lit(_MEANS["Temperature"])) * (
        F.col("AdditivePct") - F.lit(_MEANS["AdditivePct"])
    )
    return (
        F.lit(CONDUCTIVITY_BASE)
        + _slopes(CONDUCTIVITY_SLOPES)
        + F.lit(CONDUCTIVITY_HEAT_ADDITIVE) * both
        + _line_effect(CONDUCTIVITY_LINES)
    )


def reject_score() -> Column:
    """Above zero a part is NG, else OK; without noise."""
    return _slopes(REJECT_SLOPES) + _line_effect(REJECT_LINES)


def _drawn(keys: DataFrame, key: str, seed: int) -> DataFrame:
    k = F.col(key)
    draws = {}
    for name, mean, spread, least, most, _ in SETTINGS:
        value = F.lit(mean) + F.lit(spread) * normal(k, seed, name)
        draws[name] = F.least(F.greatest(value, F.lit(least)), F.lit(most))
    pick = uniform(k, seed, "LineId")
    draws["LineId"] = (
        F.when(pick < LINES[0][1], LINES[0][0]).when(pick < LINES[1][1], LINES[1][0]).otherwise(LINES[2][0])
    )
    return keys.select(key).withColumns(draws)


def _with_holes(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Blank one cell in max(4, n / 28) rows: those with the smallest key hash."""
    marked = df.withColumn("hole_hash", hash_long(F.col(key), seed, "hole"))
    rows = marked.count()
    holes = min(max(LEAST_HOLES, rows // ROWS_PER_HOLE), rows)
    cut = order_statistics(marked.select("hole_hash"), {"hole_hash": [holes]})["hole_hash"][holes]
    turn = F.pmod(F.col("hole_hash"), F.lit(len(HOLE_COLUMNS)))
    blanked = {
        c: F.when(~((F.col("hole_hash") <= F.lit(cut)) & (turn == i)), F.col(c))
        for i, c in enumerate(HOLE_COLUMNS)
    }
    return marked.withColumns(blanked).drop("hole_hash")


def _rounded(drawn: DataFrame, key: str, outcome: Column, name: str) -> DataFrame:
    digits = {n: d for n, *_, d in SETTINGS}
    order = ["Temperature", "Pressure", "TimeSec", "AdditivePct", "PreheatMin", "CoolRate"]
    return drawn.select(
        key,
        *[F.round(c, digits[c]).alias(c) for c in order],
        "LineId",
        F.round("Humidity", digits["Humidity"]).alias("Humidity"),
        outcome.alias(name),
    )


def process_quality(keys: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Eight settings and ``TargetConductivity`` for each key."""
    noise = F.lit(CONDUCTIVITY_NOISE) * normal(F.col(key), seed, "noise")
    table = _rounded(
        _drawn(keys, key, seed), key, F.round(conductivity() + noise, 3), "TargetConductivity"
    )
    return _with_holes(table, key, seed)


def process_okng(keys: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Eight settings and ``QualityResult`` (OK or NG) for each key."""
    noise = F.lit(REJECT_NOISE) * normal(F.col(key), seed, "noise")
    verdict = F.when(reject_score() + noise > 0, "NG").otherwise("OK")
    return _with_holes(_rounded(_drawn(keys, key, seed), key, verdict, "QualityResult"), key, seed)


def generate_process_quality(spark: SparkSession, n: int = 200, seed: int = 42) -> DataFrame:
    return process_quality(spark.range(n).toDF("row_key"), "row_key", seed)


def generate_process_okng(spark: SparkSession, n: int = 200, seed: int = 42) -> DataFrame:
    return process_okng(spark.range(n).toDF("row_key"), "row_key", seed)


def write_sample(spark: SparkSession, path: str, kind: str = "quality", n: int = 200) -> None:
    """A generated sample as a headed CSV: ``quality`` or ``okng``."""
    make = generate_process_okng if kind == "okng" else generate_process_quality
    write_csv(make(spark, n).drop("row_key"), path, mode="overwrite")
