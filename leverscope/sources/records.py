"""CSV records of files that are split among tasks although cells hold line breaks.

A line break ends a record where the number of quotes before it in the file is even. Each split
counts its quotes, a running sum over the splits of a file says whether a split begins inside
a quoted cell, and then every task puts the lines of its split together. Only a record that
crosses from one split into the next travels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leverscope.errors import AnalysisError

WHOLE, BEGUN, INNER, ENDED = range(4)  # a record; its first, middle and last part


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """Lines (carriage returns kept) with the key of the split they begin in."""
    text = spark.read.option("lineSep", "\n").text(files)
    where = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return where.withColumn("split", F.xxhash64("file", "start"))


def _splits(lines: DataFrame) -> DataFrame:
    """(file, start, split, opened, total): whether the split begins inside quotes, and the file's quotes; a row per split."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    sums = lines.groupBy("file", "start", "split").agg(F.sum(quotes).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1
    return sums.select("file", "start", "split", opened.alias("opened"), F.sum("n").over(Window.partitionBy("file")).alias("total"))


def quoted_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(record) of all files but their headers, line breaks inside quotes kept; empty lines are no records.

    Quotes must stand as RFC 4180 has them: around a cell, and doubled inside it. A file whose
    quotes do not pair fails with ``invalidCsv``. What every task gets to know is a hash and two bits per split.
    """
    lines = _lines(spark, files)
    splits = _splits(lines).persist()
    try:
        known = splits.select("split", "opened", "start", F.col("total") % 2 == 1).collect()  # 16 bytes a split
    finally:
        splits.unpersist()
    if any(r[3] for r in known):
        raise AnalysisError("invalidCsv", "The quotes of a file do not pair.")
    keys = np.array([r["split"] for r in known], np.int64)
    order = np.argsort(keys)
    flags = np.array([(r["opened"], r["start"] == 0) for r in known], bool).reshape(-1, 2)[order]
    held = spark.sparkContext.broadcast((keys[order], flags))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (split, kind, text); a split's lines come in order, one split after the other."""
        at_key, flag = held.value
        last, inside, begun_here, header, open_ = None, False, False, False, []

        def close(split: int, ended: bool) -> list[tuple[int, int, str]]:
            nonlocal open_, begun_here
            text = "\n".join(open_)
            kind = (WHOLE if ended else BEGUN) if begun_here else (ENDED if ended else INNER)
            open_, begun_here = [], False
            return [(split, kind, text)]

        for batch in batches:
            names = batch.column("split").to_numpy()
            odd = pc.bit_wise_and(pc.count_substring(batch.column("value"), '"'), 1).to_numpy(zero_copy_only=False).astype(bool)
            values, rows = batch.column("value").to_pylist(), []
            for value, split, flips in zip(values, names.tolist(), odd.tolist()):
                if split != last:
                    if open_:
                        rows += close(last, False)
                    place = np.searchsorted(at_key, split)
                    last, inside, header, begun_here = split, bool(flag[place, 0]), bool(flag[place, 1]), False
                if not inside:
                    begun_here = True
                open_.append(value)
                inside ^= flips
                if not inside:
                    rows += close(split, True)
                    if rows[-1][1] == WHOLE and not rows[-1][2].strip("\r"):
                        rows.pop()
                    elif header:
                        rows.pop()
                        header = False
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string()))], names=["split", "kind", "text"])
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(close(last, False)[0], (pa.int64(), pa.int32(), pa.string()))], names=["split", "kind", "text"])

    found = lines.select("value", "split").mapInArrow(parts, "split long, kind int, text string")
    crossing = found.where(F.col("kind") != WHOLE).join(_splits(lines).select("file", "start", "split"), "split")
    # In a split the last part of one record comes before the first part of the next.
    along = Window.partitionBy("file").orderBy("start", F.col("kind") == BEGUN)
    numbered = crossing.withColumn("record", F.count_if(F.col("kind") == BEGUN).over(along))
    joined = numbered.groupBy("file", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "\n").alias("text"))
    whole = found.where(F.col("kind") == WHOLE).select("text").unionByName(joined.select("text"))
    # Where records end with CR LF, so do the lines inside cells; the reader makes them LF.
    bare = F.replace(F.rtrim("text", F.lit("\r")), F.lit("\r\n"), F.lit("\n"))
    return whole.select(F.when(F.endswith("text", F.lit("\r")), bare).otherwise(F.col("text")).alias("record"))
