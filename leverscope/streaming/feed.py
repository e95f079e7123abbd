"""Rows that arrive in batches from a machine: typed, scored and stored as they come.

Typing and scoring keep no state, so a restarted query goes on from its checkpoint
and writes each batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from leverscope.functions.scalars import NA_TOKENS, quoted
from leverscope.operators.profile import NUMERIC, ColumnProfile, coerced_cell
from leverscope.operators.scorers import Scorer, batch_score
from leverscope.session import checkpoint_dir


def type_feed(raw: DataFrame, columns: list[ColumnProfile], keep: tuple[str, ...] = ()) -> DataFrame:
    """Text cells to the types a registered table already has; a new stream decides nothing.

    A missing-cell word is NULL and a cell is read as its column's profile says, as in a batch.
    """
    cells = []
    for c in columns:
        text = quoted(c.name).cast("string")
        present = F.when(~text.isin(*NA_TOKENS), text)
        encoding = c.encoding or ("number" if c.type == NUMERIC else "none")
        cells.append(coerced_cell(present, "text", c.type, encoding).alias(c.name))
    return raw.select(*keep, *cells)


def score_feed(typed: DataFrame, scorer: Scorer, class_index: int | None = None) -> DataFrame:
    return batch_score(typed, scorer, class_index)


def store_feed(scored: DataFrame, path: str, name: str) -> DataStreamWriter:
    """A Parquet sink; its file log makes a repeated batch harmless.

    A restart finds its place only in a folder that outlives the process: set spark.checkpoint.dir.
    """
    folder = checkpoint_dir(scored.sparkSession)
    return (
        scored.writeStream.queryName(name)
        .outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{folder}/feeds/{name}")
    )
