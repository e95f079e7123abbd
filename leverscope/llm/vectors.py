"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leverscope.llm.common import components, runs, stored

BITS, TABLES = 64, 8  # of a code; parts of a code that are a table's key, a byte each
SAMPLE = 4096  # distinct vectors from which the rotation is learnt, those of least hash
ROUNDS = 40
BLOCK = 1024  # vectors of a bucket that one task compares with as many others


def rotation(sample: np.ndarray) -> np.ndarray:
    """Projection (dimensions x bits) whose signs are codes: principal axes about the origin, then ITQ.

    No mean is taken off: the angle between two vectors seen from their mean is wider than their
    own, from which the number of tables and the radius follow.
    """
    _, axes = np.linalg.eigh(sample.T @ sample)
    axes = axes[:, ::-1][:, :BITS]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)
    reduced = sample @ axes
    turn = np.linalg.qr(np.random.default_rng(6).standard_normal((axes.shape[1],) * 2))[0]
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.where(reduced @ turn >= 0, 1.0, -1.0).T @ reduced)
        turn = (left @ right).T
    return axes @ turn


def codes(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """64-bit codes; fewer dimensions than bits leave the last bits 0."""
    signs = x @ projection >= 0
    bits = np.zeros((len(x), BITS), np.uint8)
    bits[:, : signs.shape[1]] = signs
    return np.packbits(bits, axis=1).view("<u8").ravel()


def _usable(e: Column) -> Column:
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.isNotNull() & fine & F.exists(e, lambda x: x != 0)


def _unit(column: pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), dtype=float).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square of a large or small component overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(classes: DataFrame, models: dict[int, np.ndarray]) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(e) for e in batch.column("e")])
            out = np.zeros(batch.num_rows, "<u8")
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                out[at] = codes(_unit(batch.column("e").take(pa.array(at))), models[int(d)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view("<i8"))], names=[*batch.schema.names, "code"])

    return classes.mapInArrow(task, "class long, first_id long, n long, label long, e array<double>, code long")


def _groups(code: np.ndarray, x: np.ndarray, table: int, mine: np.ndarray, other: np.ndarray, same: bool, threshold: float, radius: int) -> np.ndarray:
    """Linked pairs between two blocks of a bucket, unless an earlier table already holds the pair."""
    apart = code[mine][:, None] ^ code[other][None, :]
    near = np.bitwise_count(apart) <= radius
    planes = apart.view(np.uint8).reshape(*apart.shape, 8)
    near &= (planes[:, :, :table] != 0).all(axis=2)
    if same:
        near &= np.triu(np.ones(near.shape, bool), 1)
    i, j = np.nonzero(near)
    i, j = mine[i], other[j]
    linked = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
    return np.stack([i[linked], j[linked]])


def _links(coded: DataFrame, threshold: float) -> DataFrame:
    """Per bucket and class: vectors linked to it there, and a class of its component there."""
    share = np.arccos(threshold) / np.pi
    radius = int(np.ceil(BITS * share + 6 * (BITS * share * (1 - share)) ** 0.5))
    rows = coded.select("class", "n", "label", "e", "code", F.size("e").alias("d"), F.posexplode(F.array(
        *[F.shiftright("code", 8 * t).bitwiseAND(255) for t in range(TABLES)])).alias("t", "key"))
    bucket = ["label", "d", "t", "key"]
    sizes = rows.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("k")).filter("k > 1").drop("k")
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    rows = (rows.join(sizes, bucket).withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with"))
            .withColumn("g", F.xxhash64(*bucket, "i", "j")).select("g", "label", "t", "own", "i", "j", "class", "n", "code", "e"))

    def of_group(t: pa.Table) -> pa.RecordBatch | None:
        column = {c: t.column(c).to_numpy() for c in ("label", "t", "own", "i", "j", "class", "n", "code")}
        keys = list(zip(column["label"], column["t"], column["i"], column["j"]))
        if len(set(keys)) > 1:  # two buckets of one hash
            parts = [p for one in sorted(set(keys)) if (p := of_group(t.filter(pa.array([k == one for k in keys])))) is not None]
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None
        x = _unit(t.column("e").combine_chunks())
        code, i, j = column["code"].view(np.uint64), column["i"][0], column["j"][0]
        mine, other = np.flatnonzero(column["own"] == i), np.flatnonzero(column["own"] == j)
        found = [_groups(code, x, int(column["t"][0]), mine[a : a + BLOCK], other[b : b + BLOCK], i == j and a == b, threshold, radius)
                 for a in range(0, len(mine), BLOCK) for b in range(a if i == j else 0, len(other), BLOCK)]
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
        if not len(a):
            return None
        n = len(x)
        add = np.bincount(a, column["n"][b], n) + np.bincount(b, column["n"][a], n)
        root, before = np.arange(n), None
        while before is None or (root != before).any():
            before = root.copy()
            np.minimum.at(root, a, before[b])
            np.minimum.at(root, b, before[a])
            root = root[root]
        at = np.flatnonzero(add)
        return pa.RecordBatch.from_arrays([pa.array(column["class"][at]), pa.array(add[at].astype("i8")), pa.array(column["class"][root[at]])], names=["class", "add", "root"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "g"):
            if (out := of_group(table)) is not None:
                yield out

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(task, "class long, add long, root long")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal label and dimension are linked by a cosine of ``threshold`` or more, in double
    precision on the original components. Equal vectors are one class from the start, met
    map-side. Codes come from ITQ: principal axes of a bounded sample of classes, rotated so that
    signs lose least. Every class enters ``TABLES`` Hamming tables by a byte of its code; classes
    of a bucket are compared by code, then by cosine, and a pair counts in the first table that
    holds it. A bucket of more than ``BLOCK`` classes is dealt into blocks, one task for each two
    blocks; pairs leave a task as sums and a spanning star. Vectors with a common mean share more
    bits, so more pairs are compared, up to all, and none is lost. At cosine 0.93 a code bit differs with
    chance 0.12, so all eight bytes of a pair differ in 3 % of cases at the threshold, far fewer
    above it; no pair below it is linked.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a
    label, link with nothing. Repeated rows are vectors of their own and linked with each other;
    component_id is the smallest vec_id reachable. Equality is by a 128-bit hash. Labels that are
    no whole numbers (texts, dates) are told apart by a 64-bit hash.
    """
    named = vectors.toDF(*[c.lower() for c in vectors.columns])
    whole = isinstance(named.schema["label"].dataType, T.IntegralType)
    label = F.col("label").cast("long") if whole else F.when(F.col("label").isNotNull(), F.xxhash64("label")).alias("label")
    rows = named.select(F.col("vec_id").cast("long"), label, F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.withColumn("ok", F.coalesce(_usable(F.col("e")) & F.col("label").isNotNull(), F.lit(False)))
    rows = rows.withColumn("h1", F.xxhash64("label", "e")).withColumn("h2", F.xxhash64(F.lit(1), "e", "label"))
    usable = rows.filter("ok")
    classes = stored(usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.any_value("label").alias("label"),
                                                    F.any_value("e").alias("e")).withColumn("class", F.monotonically_increasing_id()), "vectors")
    models = {}
    for r in classes.select(F.size("e").alias("d")).distinct().collect():  # dimensions in use
        few = classes.filter(F.size("e") == r["d"]).orderBy("h1", "h2").limit(sample).select("e").collect()
        models[r["d"]] = rotation(_unit(pa.array([f["e"] for f in few])))
    coded = stored(_coded(classes.select("class", "first_id", "n", "label", "e"), models), "codes")
    found = stored(_links(coded, threshold), "links")
    added = found.groupBy("class").agg(F.sum("add").alias("add"))
    root = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")), "vectors")
    of = classes.select("h1", "h2", "class", "first_id", "n").join(added, "class", "left").join(root.withColumnRenamed("node", "class"), "class", "left").select(
        "h1", "h2", "first_id", (F.coalesce("add", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "class").alias("component"))
    of = of.join(of.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("h1", "h2", "n_links", "component_id")
    linked = usable.select("vec_id", "h1", "h2").join(of, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
