"""Shared helpers: the tables, scratch tables in the cluster's shared folder, hash folds, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leverscope.errors import AnalysisError
from leverscope.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; every executor reaches it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """The path of a shared folder as a task's ``open()`` sees it; the folder must be mounted."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise AnalysisError("sharedFolderNotMounted", f"Tasks map files of {path}; mount that folder on every node and name it by file://.")
    return parsed.path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage is cut, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def place(docs: DataFrame, name: str) -> int | None:
    """Index of the column of this name in any case, None if there is none."""
    return next((i for i, c in enumerate(docs.columns) if c.lower() == name), None)


def mapped(docs: DataFrame, change: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], slice_rows: int = 1000) -> DataFrame:
    """Rows with all their columns, changed or dropped in Arrow batches; ``change()`` is called once per task."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = change()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                yield own(batch.slice(at, slice_rows))

    return docs.mapInArrow(task, docs.schema)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each run of one key, over batch borders; for partitions sorted by it."""
    held, last = [], None
    for batch in batches:
        values = batch.column(key).to_numpy()
        cut = np.r_[0, np.flatnonzero(np.diff(values)) + 1, len(values)] if len(values) else []
        for start, stop in zip(cut, cut[1:]):
            if held and values[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = values[start]
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def replaced(batch: pa.RecordBatch, at: int, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([values.cast(c.type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)


class Sieve:
    """A bitmap of hashed numbers, at most 128 MB however many there are: a clear bit means surely not among them."""

    LEAST, MOST = 20, 30  # bits, as powers of two

    def __init__(self, numbers: DataFrame):
        """``numbers``: one column of longs. Tasks hash, Spark gathers 4 KB pieces, the driver joins them."""
        spark, column = numbers.sparkSession, numbers.columns[0]
        count = numbers.count()
        self.power = min(self.MOST, max(self.LEAST, (16 * count).bit_length()))

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = self._at(batch.column(0).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], names=["piece", "bit"])

        pieces = numbers.filter(F.col(column).isNotNull()).mapInArrow(hashed, "piece long, bit long").groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
        bitmap = np.zeros(1 << (self.power - 3), np.uint8)
        for r in pieces.toLocalIterator():
            bitmap[r["piece"] << 12 : (r["piece"] + 1) << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
        self.held = spark.sparkContext.broadcast(bitmap)

    def __getstate__(self) -> dict:
        return self.__dict__

    def _at(self, numbers: np.ndarray) -> np.ndarray:
        x = numbers.astype(np.int64).view(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(64 - self.power)).astype(np.int64)

    def maybe(self, numbers: np.ndarray) -> np.ndarray:
        at = self._at(numbers)
        return (self.held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``(a, b)``: one row ``(node, component)`` per linked node.

    Alternating large and small stars: every node tells its larger neighbours of its smallest
    neighbour, then its smaller neighbours. Each round is written to the shared folder; a star
    with many rays is summed map-side first (``min``), so no node's neighbours meet in a list.
    The component is the smallest node. Null ends and self-links are ignored.
    """
    def ends(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    # (a, b) with b < a throughout: a points at something smaller.
    links = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, name)
    before = None
    while True:
        both = ends(links)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        links = stored(small, name)
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == before or now[0] == 0:
            break
        before = tuple(now)
    node = links.groupBy("a").agg(F.min("b").alias("component"))
    roots = node.select(F.col("component").alias("node"), "component").distinct()
    return node.select(F.col("a").alias("node"), "component").unionByName(roots)
