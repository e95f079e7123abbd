"""Near-duplicate documents by an LSH forest over MinHash, links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverscope.llm.common import Sieve, components, runs, stored
from leverscope.llm.words import WordHasher, shingles

TREES = 24
ROOT, DEEPER = 4, 4  # hash values that a region shares at least; more levels to which it may go
CROWD = 16  # members above which a region goes deeper for its first links and is then compared whole
SKETCH_BITS = 128
BLOCK = 256  # members of a crowded region that one task compares with as many others
COLUMNS = 4096  # shingles of one incidence matrix
_RANDOM = np.random.default_rng(20)
_FACTORS = (_RANDOM.integers(0, 1 << 32, TREES * (ROOT + DEEPER), dtype=np.uint64) | 1).astype(np.uint32)
_SHIFTS = _RANDOM.integers(0, 1 << 32, TREES * (ROOT + DEEPER), dtype=np.uint64).astype(np.uint32)


def _least_bits(percent: int) -> int:
    """Sketch bits that agree in a pair at the threshold, less five standard deviations."""
    p = 0.5 + percent / 200
    return int(SKETCH_BITS * p - 5 * (SKETCH_BITS * p * (1 - p)) ** 0.5)


def minima(found: np.ndarray) -> np.ndarray:
    """MinHash values of a set of 64-bit hashes, one for each function."""
    least = np.full(len(_FACTORS), 0xFFFFFFFF, dtype=np.uint32)
    high = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 2048):
        least = np.minimum(least, (high[at : at + 2048, None] * _FACTORS + _SHIFTS).min(axis=0))
    return least


def labels(least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per tree the hash of its first values (a region's root) and the next ones, 16 bits each; the bit sketch."""
    values = least.reshape(TREES, ROOT + DEEPER).astype(np.uint64)
    root = np.arange(1, TREES + 1, dtype=np.uint64)
    for i in range(ROOT):
        root = (root ^ values[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        root ^= root >> np.uint64(29)
    spread = (least * np.uint32(0x9E3779B1)).reshape(TREES, ROOT + DEEPER)
    path = np.zeros(TREES, dtype=np.uint64)
    for i in range(ROOT, ROOT + DEEPER):
        path = (path << np.uint64(16)) | (spread[:, i] >> np.uint32(16)).astype(np.uint64)
    bits = np.packbits((spread.ravel()[:SKETCH_BITS] >> np.uint32(31)).astype(np.uint8)).view(np.int64)
    return root.view(np.int64), path.view(np.int64), bits


def _class(found: np.ndarray) -> int:
    """64-bit fingerprint of a shingle set; equal sets are one class."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(docs: DataFrame, width: int) -> DataFrame:
    schema = "doc_id long, row long, n_shingles long, class long, root array<long>, path array<long>, bits0 long, bits1 long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                columns: list[list] = [[] for _ in range(6)]
                for text in part.column(2):
                    found = shingles(hashed(text.as_py()), width)
                    if len(found):
                        root, path, bits = labels(minima(found))
                        row = (len(found), _class(found), root, path, int(bits[0]), int(bits[1]))
                    else:
                        row = (0, None, None, None, None, None)
                    for column, value in zip(columns, row):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                                 names=["doc_id", "row", "n_shingles", "class", "root", "path", "bits0", "bits1"])

    return docs.mapInArrow(task, schema)


def _regions(rows: np.ndarray, level: int) -> Iterator[np.ndarray]:
    """Rows of one root, sorted by path: split by the next value while a region is crowded."""
    if len(rows) <= CROWD or level == DEEPER:
        if len(rows) > 1:
            yield rows
        return
    value = (rows["path"].view(np.uint64) >> np.uint64(16 * (DEEPER - 1 - level)))
    for part in np.split(rows, np.flatnonzero(np.diff(value)) + 1):
        yield from _regions(part, level + 1)


def _near(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of rows that set sizes and bit sketches allow to be linked."""
    apart = sum(np.bitwise_count((a[c] ^ b[c]).view(np.uint64)).astype(int) for c in ("bits0", "bits1"))
    low, high = np.minimum(a["n"], b["n"]), np.maximum(a["n"], b["n"])
    return (a["class"] != b["class"]) & (100 * low >= percent * high) & (SKETCH_BITS - apart >= _least_bits(percent))


ROW = np.dtype([("root", "i8"), ("path", "i8"), ("class", "i8"), ("n", "i8"), ("bits0", "i8"), ("bits1", "i8")])


def _candidates(forest: DataFrame, percent: int) -> DataFrame:
    """Sorted orders of the trees to candidate pairs, and the members of crowded roots (a = b)."""
    upper = np.triu_indices(CROWD, 1)

    def of_root(rows: np.ndarray) -> Iterator[tuple]:
        if len(rows) > CROWD:
            yield rows["class"], rows["class"], rows["root"]
        for region in _regions(rows, 0):
            n = len(region)
            if n <= CROWD:
                i, j = (x[upper[1] < n] for x in upper)
            else:  # neighbours in the order, and the first of all
                i = np.r_[np.zeros(n - 1, int), np.arange(1, n - 1)]
                j = np.r_[np.arange(1, n), np.arange(2, n)]
            near = _near(region[i], region[j], percent)
            a, b = region["class"][i[near]], region["class"][j[near]]
            yield np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), "i8")

    def packed(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b", "root"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, size = np.zeros(0, ROW), [], 0
        for batch in batches:
            rows = np.zeros(batch.num_rows, ROW)
            for name in ROW.names:
                rows[name] = batch.column(name).to_numpy()
            rows = np.concatenate([held, rows])
            starts = np.r_[0, np.flatnonzero(np.diff(rows["root"])) + 1]
            sizes = np.diff(np.r_[starts, len(rows)])
            for at, n in zip(starts[:-1][sizes[:-1] > 1], sizes[:-1][sizes[:-1] > 1]):
                found += of_root(rows[at : at + n])
            held = rows[starts[-1] :]
            size = sum(len(f[0]) for f in found)
            if size > 50_000:
                yield packed(found)
                found = []
        found += of_root(held) if len(held) > 1 else ()
        if found:
            yield packed(found)

    ordered = forest.repartition("root").sortWithinPartitions("root", "path", "class")
    return ordered.mapInArrow(task, "a long, b long, root long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = (pairs.join(sets.select(F.col("class").alias("a"), F.col("found").alias("x")), "a")
             .join(sets.select(F.col("class").alias("b"), F.col("found").alias("y")), "b"))
    return found.select("a", "b", "x", "y").mapInArrow(task, "a long, b long")


def _roots(spark, links: DataFrame) -> DataFrame:
    return stored(components(links, "near"), "near")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, row, n_shingles, component_id, kept.

    Equal shingle sets are one class from the start, met map-side. Every class goes into ``TREES``
    sorted orders of MinHash values. A region of an order shares its first ``ROOT`` values. Classes
    of a region are candidates if set sizes and a bit sketch (five deviations under the threshold)
    allow a link. While a region holds more than ``CROWD`` classes it goes a value deeper; at full
    depth it pairs neighbours and the first. Candidates are confirmed on full sets (``100 * common >=
    percent * all``): first one per class, then those whose ends are in different components, since
    a link within a component changes nothing. Going deeper only finds most links early: of a region
    crowded at its root, all members that are outside its largest component by then are compared
    with all members on full sets, block by block. A missed link at the threshold needs all orders
    to part the pair, (1 - 0.8 ** 4) ** 24 = 3e-6 and less above it, or the sketch to be that far off.

    Words: A-Z lower-cased, split at ASCII white space. Null and empty texts and texts of white
    space have no set and are linked with nothing; a text of fewer than ``width`` words is one
    shingle. component_id is the smallest doc_id of the component (null ids last), kept the rows that
    carry it, so repeated rows of one id stay together; with ``row``, a column of distinct longs,
    only that of the least number is kept. Sets, shingles and classes are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    named = docs.toDF(*[c.lower() for c in docs.columns])
    texts = named.select(F.col("doc_id").cast("long"), (F.col(row.lower()) if row else F.lit(0)).cast("long").alias("row"), F.col("text").cast("string"))
    sketched = stored(_sketch(texts, width), "sketch")
    full = sketched.filter("class is not null")
    classes = stored(full.groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.max("n_shingles").alias("n"), *[F.any_value(c).alias(c) for c in ("root", "path", "bits0", "bits1")]), "classes")
    forest = classes.select("class", "n", "bits0", "bits1", F.explode(F.arrays_zip("root", "path")).alias("at")).select("class", "n", "bits0", "bits1", "at.root", "at.path")
    found = stored(_candidates(forest.select(*ROW.names), percent), "candidates")
    pairs = stored(found.filter("a <> b").select("a", "b").distinct(), "pairs")
    crowded = found.filter("a = b").select(F.col("a").alias("class"), F.col("root"))

    member = pairs.select("a").union(pairs.select("b")).union(crowded.select("class")).distinct().toDF("class")
    member = stored(member, "members")
    key = "row" if row else "doc_id"
    wanted = Sieve(classes.join(member, "class", "left_semi").select(F.coalesce(f"first.{key}", F.lit(-1)).alias(key)))
    few = texts.select(F.coalesce(key, F.lit(-1)).alias("key"), "text")
    sets = stored(_sets(few, width, wanted).join(member, "class", "left_semi").dropDuplicates(["class"]), "sets")

    # One candidate per class first; most others then lie within a component.
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = stored(_confirmed(first, sets, percent), "links")
    root = _roots(spark, links)
    links = links.unionByName(stored(_confirmed(_between(pairs, root), sets, percent), "links"))
    root = _roots(spark, links)
    more = stored(_outsiders(crowded, root, sets, percent), "links")
    if more.limit(1).count():
        root = _roots(spark, links.unionByName(more))

    own = classes.select("class", "first").join(root.select(F.col("node").alias("class"), "component"), "class", "left").select(
        "class", "first", F.coalesce("component", "class").alias("component"))
    least = own.groupBy("component").agg(F.min("first").alias("least"))
    own = own.join(least, "component").select("class", "least")
    linked = full.select("doc_id", "row", "n_shingles", "class").join(own, "class").select(
        "doc_id", "row", "n_shingles", F.col("least.doc_id").alias("component_id"), F.col("least.row").eqNullSafe(F.col("row")).alias("kept"))
    alone = sketched.filter("class is null").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    if not row:  # all rows are 0 apart from their id
        linked = linked.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return linked.unionByName(alone)


def _sets(texts: DataFrame, width: int, wanted: Sieve) -> DataFrame:
    """Class and full set of the texts (key, text) whose key may be wanted; others are not split into words."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHasher()
        for batch in batches:
            some = batch.filter(pa.array(wanted.maybe(batch.column(0).to_numpy())))
            for at in range(0, some.num_rows, 1000):
                found = [shingles(hashed(t.as_py()), width) for t in some.column(1).slice(at, 1000)]
                found = [f for f in found if len(f)]
                yield pa.RecordBatch.from_arrays([pa.array([_class(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], names=["class", "found"])

    return texts.mapInArrow(task, "class long, found binary")


def _between(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    ends = pairs
    for end in ("a", "b"):
        ends = ends.join(root.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    return ends.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``, by products of bounded incidence matrices."""
    shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)))
    out = np.zeros((len(a), len(b)), np.float32)
    places = []
    for sets in (a, b):
        row, value = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(shared, value), max(0, len(shared) - 1))
        known = shared[at] == value if len(shared) else np.zeros(len(value), bool)
        order = np.argsort(at[known], kind="stable")
        places.append((row[known][order], at[known][order]))
    for first in range(0, len(shared), COLUMNS):
        sides = []
        for (row, at), n in zip(places, out.shape):
            cut = slice(*np.searchsorted(at, [first, first + COLUMNS]))
            dense = np.zeros((n, min(COLUMNS, len(shared) - first)), np.float32)
            dense[row[cut], at[cut] - first] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out


def _outsiders(crowded: DataFrame, root: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of members outside the largest component of a region that is crowded at its root.

    Such members are compared with all members, on full sets, in blocks: a task holds two blocks of
    a region and gives only links, one for each member and component; no pair is a row.
    """
    of = crowded.join(root.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    share = of.groupBy("root", "component").agg(F.count("*").alias("k"))
    regions = share.groupBy("root").agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.sum("k").alias("members"),
                                                F.max("k").alias("inner"), F.count("*").alias("parts")).filter("parts > 1")
    regions = regions.select("root", "major", F.ceil((F.col("members") - F.col("inner")) / BLOCK).cast("int").alias("outer"), F.ceil(F.col("members") / BLOCK).cast("int").alias("all"))
    members = of.join(regions, "root").withColumn("h", F.xxhash64("class"))
    left = members.filter("component <> major").withColumn("i", F.pmod("h", "outer")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("all") - 1))).withColumn("left", F.lit(True))
    right = members.withColumn("j", F.pmod("h", "all")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("outer") - 1))).withColumn("left", F.lit(False))
    columns = ["class", "component", "root", F.col("i").cast("long"), F.col("j").cast("long"), "left"]
    rows = left.select(*columns).unionByName(right.select(*columns)).withColumn("g", F.xxhash64("root", "i", "j")).select("g", "class", "component", "left")

    def of_block(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side, names, parts = (t.column(c).to_numpy() for c in ("left", "class", "component"))
        found = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("found")]
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        if len(a) and len(b):
            size = np.array([len(f) for f in found])
            both = _common([found[i] for i in a], [found[i] for i in b])
            linked = (100 * both >= percent * (size[a][:, None] + size[b][None, :] - both)) & (parts[a][:, None] != parts[b][None, :])
            i, j = np.nonzero(linked)
            _, first = np.unique(np.stack([i, parts[b][j]]), axis=1, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(names[a][i[first]]), pa.array(names[b][j[first]])], names=["a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "g"):
            yield from of_block(table)

    return rows.join(sets, "class").repartition("g").sortWithinPartitions("g").mapInArrow(task, "a long, b long")
