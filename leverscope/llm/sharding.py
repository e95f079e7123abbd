"""K-d tree partitioning of documents: DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leverscope.llm.common import stored

DIGIT = 10  # bits that one pass over the keys resolves
BITS = 60  # of a key: 18 of the dimension, 42 of the text (24 and a part of 18 bits where cuts may part the text's rows)
TOLERANCE = 0.0005  # share of a node's bytes by which a cut may miss its median
MOST_LEAVES = 1_000_000  # the table of nodes is broadcast: 40 bytes a leaf
SLOT_ROWS = 20_000  # rows that one slot-numbering group holds
WHOLE = 0.5  # of a leaf's bytes: documents of one text that weigh no more lie in one shard
PART = 0.002  # of a leaf's bytes that one point of a larger group weighs
GROUP_ROWS = 20_000  # rows of one text that one task joins


def _high_bits(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - bits)


def _rows(docs: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """One row per document: size, checksum, 128-bit hash of the text, and a value of each dimension."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = {c.lower() for c in docs.columns}
    size = (F.octet_length(text) + 1).cast("long")
    values = {}
    for i, dim in enumerate(dims):
        if dim == "size":
            value = F.least(F.floor(F.log2(size) * 8192), F.lit((1 << 18) - 1)).cast("long")
        elif dim in found:
            value = F.when(F.col(dim).isNull(), F.lit(0).cast("long")).otherwise(_high_bits(F.col(dim).cast("string"), 18))
        else:
            value = F.lit(0).cast("long")
        values[f"v{i}"] = value
    return docs.select(
        F.col("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), *[v.alias(n) for n, v in values.items()],
    ).withColumn("row", F.monotonically_increasing_id())


def _points(rows: DataFrame, dims: int, leaf: float) -> tuple[DataFrame, DataFrame]:
    """The rows with the part of their text's group they are in, and one weighted point per part.

    A group is the rows of one text. All of them take the group's least value of each dimension, so
    they follow each other in every order. A group of at most ``WHOLE`` leaves has one key: no cut
    parts it. A larger one has a key per part, each of ``PART`` of a leaf or less on average. Groups
    of many rows come in parts too (of one key), so that joins by group have no hot key.
    """
    least = [F.min(f"v{i}").alias(f"v{i}") for i in range(dims)]
    groups = rows.groupBy("t1", "t2").agg(F.sum("size").alias("w"), F.count("*").alias("n"), *least)
    cut = F.col("w") > WHOLE * leaf
    parts = F.greatest(F.when(cut, F.ceil(F.col("w") / (PART * leaf))).otherwise(1), F.ceil(F.col("n") / GROUP_ROWS))
    # At most 1 / WHOLE groups a leaf and one group per GROUP_ROWS rows.
    large = stored(groups.withColumn("cut", cut).withColumn("parts", parts.cast("long")).filter(cut | (F.col("n") > GROUP_ROWS))
                   .select("t1", "t2", "cut", "parts", *[F.col(f"v{i}").alias(f"g{i}") for i in range(dims)]), "kd")
    dealt = rows.join(F.broadcast(large), ["t1", "t2"], "left").select(
        "doc_id", "size", "text_crc32", "row", "t1", "t2", F.coalesce("cut", F.lit(False)).alias("cut"),
        F.coalesce(F.pmod(F.xxhash64("doc_id", "row"), F.col("parts")), F.lit(0)).alias("part"),
        *[F.coalesce(f"g{i}", f"v{i}").alias(f"v{i}") for i in range(dims)])
    points = dealt.groupBy("t1", "t2", "part").agg(F.sum("size").alias("size"), F.first("cut").alias("cut"), *least)
    tie = F.when(F.col("cut"), F.shiftleft(F.shiftrightunsigned("t1", 40), 18) + F.pmod(F.col("part"), F.lit(1 << 18))).otherwise(
        F.shiftrightunsigned("t1", 22))
    keys = [(F.shiftleft(f"v{i}", 42) + tie).alias(f"k{i}") for i in range(dims)]
    return dealt, points.select("t1", "t2", "part", "size", *keys, F.lit(0).cast("long").alias("low"))


def _nodes(df: DataFrame, nodes: list[dict], schema: str) -> DataFrame:
    """Driver-side nodes (one per leaf at most) as a DataFrame to broadcast."""
    rows = F.from_json(F.lit(json.dumps(nodes)), f"array<struct<{schema}>>")
    return F.broadcast(df.sparkSession.range(1).select(F.explode(rows).alias("n")).select("n.*"))


def _split(rows: DataFrame, dims: int) -> tuple[DataFrame, bool]:
    """Cut every node that has two leaves or more once; False when none is left."""
    spread = rows.filter("leaves > 1").groupBy("low", "leaves").agg(
        F.sum("size").alias("w"),
        *[f(F.shiftright(f"k{i}", 42)).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))],
    ).collect()  # a row per open node
    if not spread:
        return rows, False
    whole = [max(1, max(r[f"hi{i}"] for r in spread) - min(r[f"lo{i}"] for r in spread)) for i in range(dims)]
    open_ = {}
    for r in spread:
        dim = max(range(dims), key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / whole[i], -i))
        left = r["leaves"] // 2
        open_[r["low"]] = {"low": r["low"], "dim": dim, "left": left, "prefix": 0, "need": r["w"] * left / r["leaves"],
                           "slack": r["w"] * TOLERANCE, "cut": None}
    key = F.coalesce(*[F.when(F.col("dim") == i, F.col(f"k{i}")) for i in range(dims)])
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        todo = [{k: n[k] for k in ("low", "dim", "prefix", "need", "slack")} for n in open_.values() if n["cut"] is None]
        if not todo:
            break
        nodes = _nodes(rows, todo, "low:bigint,dim:int,prefix:bigint,need:double,slack:double")
        counted = (rows.join(nodes, "low").withColumn("key", key)
                   .filter(F.shiftright("key", shift + DIGIT) == F.col("prefix"))
                   .groupBy("low", "need", "slack", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("w")))
        upto = F.sum("w").over(W.partitionBy("low").orderBy("bin"))  # 1,024 bins of a node at most
        crossing = (counted.withColumn("upto", upto).filter("upto >= need")
                    .groupBy("low").agg(F.min_by(F.struct("bin", "w", "upto", "need", "slack"), "bin").alias("x")).select("low", "x.*").collect())
        for r in crossing:
            node = open_[r["low"]]
            before = r["need"] - (r["upto"] - r["w"])  # weight that the left side still needs from this bin
            if min(before, r["w"] - before) <= r["slack"] or shift == 0:
                after = before > r["w"] - before
                node["cut"] = (r["bin"] + after) << shift
            else:
                node |= {"prefix": r["bin"], "need": before}
    cuts = _nodes(rows, [{k: n[k] for k in ("low", "dim", "left", "cut")} for n in open_.values()],
                  "low:bigint,dim:int,left:bigint,cut:bigint")
    right = F.col("dim").isNotNull() & (key >= F.col("cut"))
    rows = rows.join(cuts, "low", "left").select(
        *[c for c in rows.columns if c not in ("low", "leaves")],
        (F.col("low") + F.when(right, F.col("left")).otherwise(0)).alias("low"),
        F.when(F.col("dim").isNull(), F.col("leaves")).when(right, F.col("leaves") - F.col("left")).otherwise(F.col("left")).alias("leaves"),
    )
    return stored(rows, "kd"), True


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int = 256 << 20,
              dims: tuple[str, ...] = ("size", "lang", "source")) -> DataFrame:
    """Put every document into one of ``shards`` leaves of a k-d tree (law ``bytes``).

    Points are the documents, coordinates their metadata (size on a log scale, hashed categories),
    weights their bytes. Each level cuts every open node at the weighted median of its widest
    dimension (the weighted share of its leaves where their number is odd) until a leaf has its
    target bytes. The median is found by narrowing: a pass sums bytes by the next ten bits of the
    key map-side, so no row moves and a node of any weight is split. Documents of equal text are one
    weighted point, with the least of their metadata, up to half a leaf; a cut goes before or after
    it, whichever is nearer the median. Heavier groups are dealt into points of 0.2 % of a leaf.
    Points with one dimension value follow text hash, then part.

    Without ``shards`` their number is total bytes / ``target_bytes``. Null text has size 1 and
    the checksum of empty text; null or missing metadata count as one value; repeated rows are
    rows of their own; no documents give no rows; a document larger than a leaf takes it alone.
    Columns: doc_id, size, text_crc32, law, shard, slot, grown_shard (always null here).
    """
    rows = stored(_rows(docs.toDF(*[c.lower() for c in docs.columns]), dims), "kd")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    leaves = shards or max(1, math.ceil(total / target_bytes))
    if leaves > MOST_LEAVES:
        raise ValueError(f"{leaves} leaves; raise target_bytes")
    rows, points = _points(rows, len(dims), total / leaves)
    points = stored(points, "kd").withColumn("leaves", F.lit(leaves).cast("long"))
    more = True
    while more:
        points, more = _split(points, len(dims))
    groups = max(1, count // (SLOT_ROWS * leaves) + 1)
    rows = rows.join(points.select("t1", "t2", "part", "low"), ["t1", "t2", "part"])
    rows = rows.select("doc_id", "size", "text_crc32", "row", "low", F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups)).alias("g"))
    counts = rows.groupBy("low", "g").agg(F.count("*").alias("n"))
    starts = counts.select("low", "g", (F.sum("n").over(W.partitionBy("low").orderBy("g")) - F.col("n")).alias("start"))
    inside = F.row_number().over(W.partitionBy("low", "g").orderBy("doc_id", "row"))
    return rows.withColumn("inside", inside).join(starts, ["low", "g"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("low").cast("int").alias("shard"),
        (F.col("start") + F.col("inside") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
