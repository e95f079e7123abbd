"""Divergence of sources within a language: which term counts set a source apart from the others."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leverscope.llm.common import stored

SCALE = 1_000_000_000
LEAST_DOCS = 3  # documents of a language that a term must be in
MOST_SCALE = 1_500_000_000  # four squares of it fit a long
RANKS = 200
CELLS, ALIKE = 1 << 18, 16  # pairs of sources over terms that both have, valued at once; of wide terms, about so many of each pair
HELD_TERMS, HELD_BYTES = 1_000_000, 64 << 20  # distinct terms, and bytes of texts, that a task counts before it emits
LETTERS = bytes(b if b >= 128 else b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256))


def _terms(text: bytes) -> list[bytes]:
    """Runs of letters and of all characters beyond ASCII, A-Z lower-cased."""
    return text.translate(LETTERS).split()


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) summed within a task as far as its memory bounds allow."""
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def emit(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, number) in held.items():
            terms = pa.array(n, pa.binary()).cast(pa.string())
            same = [pa.repeat(pa.scalar(v, pa.string()), len(n)) for v in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, terms, pa.array(n.values(), pa.int64()), pa.array([number[t] for t in n], pa.int64())], schema=kind)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        terms = size = 0  # at least what is held
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                words = _terms(text.as_py())
                n, number = held.setdefault((lang, source), (Counter(), Counter()))
                distinct = set(words)
                n.update(words)
                number.update(distinct)
                terms, size = terms + len(distinct), size + text.as_buffer().size
                if terms > HELD_TERMS:
                    terms = sum(len(c) for c, _ in held.values())
                if terms > HELD_TERMS // 2 or size > HELD_BYTES:
                    yield from emit(held)
                    held, terms, size = {}, 0, 0
        yield from emit(held)

    rows = docs.mapInArrow(task, "lang string, source string, term string, n long, docs long")
    # Dealt by language and term, so that sums over a term's sources need no further shuffle.
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _kept(counts: DataFrame, least_docs: int) -> DataFrame:
    """Rows of terms that enough documents hold, with the term's sum and number of sources; one row of each term leads."""
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("l_n", pa.int64()), ("sources", pa.int64()), ("leads", pa.bool_())])

    def same(a: pa.Table, b: pa.Table) -> np.ndarray:
        return (pc.equal(a["term"], b["term"]).to_numpy() & pc.equal(a["lang"], b["lang"]).to_numpy()).astype(bool)

    def emit(rows: pa.Table, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.diff(begin)
        n, number = (np.add.reduceat(rows[c].to_numpy(), begin[:-1]) for c in ("n", "docs"))
        first = np.zeros(len(rows), bool)
        first[begin[:-1]] = True
        more = [pa.array(np.repeat(n, size)), pa.array(np.repeat(size, size)), pa.array(first)]
        whole = pa.table([*(rows[c] for c in ("lang", "source", "term", "n")), *more], schema=kind)
        yield from whole.filter(pa.array(np.repeat(number >= least_docs, size))).combine_chunks().to_batches()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last term, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            ends = pa.Table.from_batches([held[0].slice(0, 1), batch.slice(batch.num_rows - 1)])
            if same(ends.slice(0, 1), ends.slice(1))[0]:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            begin = np.r_[0, np.flatnonzero(~same(rows.slice(1), rows.slice(0, len(rows) - 1))) + 1]
            yield from emit(rows.slice(0, begin[-1]), begin)
            held = rows.slice(begin[-1]).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield from emit(rows, np.array([0, len(rows)]))

    return counts.sortWithinPartitions("lang", "term").mapInArrow(task, "lang string, source string, term string, n long, l_n long, sources long, leads boolean")


def _chance(count: str, total: str, terms: str, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / (total + terms)), in exact whole numbers; longs where the product fits."""
    wide = f"(cast({count} + 1 as decimal(20, 0)) * cast({scale} as decimal(18, 0))) div cast({total} + {terms} as decimal(20, 0))"
    return F.expr(f"1 + case when {count} < {(1 << 62) // scale} then (({count} + 1) * {scale}) div ({total} + {terms}) else {wide} end")


def _distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")  # fits a long up to MOST_SCALE


def _together(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
    """Of whole terms of a language, for each two sources what the cells add that both have, in halves of 32 bits."""
    names = held["source"].combine_chunks().dictionary_encode()
    terms = held["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.argsort(terms, kind="stable")
    terms, at = terms[order], names.indices.to_numpy().astype(np.int64)[order]
    chance, zero = (held[c].to_numpy()[order] for c in ("p", "zero"))
    first = np.flatnonzero(held["mine"].to_numpy()[order])
    number = np.bincount(terms)
    begin, number = (np.cumsum(number) - number)[terms[first]], number[terms[first]]
    i = np.repeat(first, number)
    j = np.arange(len(i)) + np.repeat(begin - np.cumsum(number) + number, number)
    i, j = i[at[i] != at[j]], j[at[i] != at[j]]
    p, p0, q, q0 = chance[i], zero[i], chance[j], zero[j]

    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a - b) * (a - b) // b

    f = (distance(p, q) - distance(p, q0)) - (distance(p0, q) - distance(p0, q0))
    width = len(names.dictionary)
    pair = at[i] * width + at[j]
    found, slot = (np.arange(width * width), pair) if width * width <= len(pair) else np.unique(pair, return_inverse=True)
    high, low = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    np.add.at(high, slot, f >> 32)
    np.add.at(low, slot, f & 0xFFFFFFFF)
    some = np.flatnonzero(high | low)
    found = found[some]
    return pa.table({"lang": pa.repeat(key[0], len(found)), "source": names.dictionary.take(pa.array(found // width)), "item": names.dictionary.take(pa.array(found % width)),
                     "high": high[some], "low": low[some]})


def _pairs(groups: DataFrame, kept: DataFrame, scale: int) -> DataFrame:
    """For each source and other source of a language the distance summed over all kept terms.

    With f(a, b) the distance of the cell of counts a and b, the sum over all terms is terms * f(0, 0), plus
    f(a, 0) - f(0, 0) for each term the source has and f(0, b) - f(0, 0) for each the other has, plus
    f(a, b) - f(a, 0) - f(0, b) + f(0, 0) for each both have. So terms that one of them lacks are never
    paired. Terms are dealt into parts of about ``CELLS`` such cells, wide ones into slices by their sources.
    """
    # A language without kept terms has no chances: its sums have no addends but 0 * f(0, 0).
    of = groups.withColumn("w", F.col("terms")).withColumn("terms", F.greatest("terms", F.lit(1))).withColumn("zero", _chance("0L", "total", "terms", scale))
    mine = of.select("lang", "source", F.col("total").alias("s_total"), "terms", F.col("zero").alias("p0"), "w")
    theirs = of.select("lang", F.col("source").alias("item"), F.col("zero").alias("q0"))
    pairs = mine.join(theirs, "lang").filter("source <> item")
    parts = groups.groupBy("lang").agg(F.expr(f"1 + sum(cells) div {CELLS}").alias("parts"))
    dealt = (kept.filter("sources > 1").join(of.select("lang", "source", "total", "terms", "zero").join(parts, "lang"), ["lang", "source"])
             .withColumn("p", _chance("n", "total", "terms", scale)).withColumn("slices", F.expr(f"1 + {ALIKE} * sources * sources div {CELLS}"))
             .select("lang", "term", "source", "p", "zero", "slices", F.expr("pmod(xxhash64(term), greatest(1, parts div slices))").alias("part"), F.explode(F.expr("sequence(0, slices - 1)")).alias("slice"))
             .withColumn("mine", F.expr("pmod(xxhash64(source), slices) = slice")).drop("slices"))
    both = dealt.groupBy("lang", "part", "slice").applyInArrow(_together, "lang string, source string, item string, high long, low long")
    own = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))

    def weighed(weight: str, value: Column) -> Column:
        return value.cast("decimal(20, 0)") * F.col(weight).cast("decimal(18, 0)")

    single = (pairs.join(own, ["lang", "source"]).withColumn("p", _chance("n", "s_total", "terms", scale)).groupBy("lang", "source", "item")
              .agg(F.sum(weighed("m", _distance("p", "q0") - _distance("p0", "q0"))).alias("here"), F.sum(weighed("m", _distance("q0", "p") - _distance("q0", "p0"))).alias("there"))
              .select("lang", F.explode(F.array(F.struct("source", "item", F.col("here").alias("f")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("there").alias("f")))).alias("c"))
              .select("lang", "c.*"))
    shared = both.groupBy("lang", "source", "item").agg(F.expr("cast(sum(cast(high as decimal(20, 0))) as decimal(27, 0)) * cast(4294967296 as decimal(10, 0)) + sum(cast(low as decimal(20, 0)))").alias("f"))
    table = pairs.select("lang", "source", "item", weighed("w", _distance("p0", "q0")).alias("f")).unionByName(single).unionByName(shared)
    summed = table.groupBy("lang", "source", "item").agg(F.sum("f").cast("long").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")


def _own_terms(groups: DataFrame, kept: DataFrame, scale: int, ranks: int) -> DataFrame:
    """The terms a source has more of than its language, by distance from it.

    Terms with the same (count here, count in the language) have the same value, so cells of them
    are valued and ranked by the terms before them; only cells that begin within ``ranks`` are
    expanded into terms, in order of their bytes.
    """
    of = groups.select("lang", "source", "total", "terms").join(groups.groupBy("lang").agg(F.sum("total").alias("l_total")), "lang")

    def above(df: DataFrame) -> DataFrame:
        return df.withColumns({"p": _chance("n", "total", "terms", scale), "q": _chance("l_n", "l_total", "terms", scale)}).filter("p > q").withColumn("value", _distance("p", "q"))

    cells = above(kept.groupBy("lang", "source", "n", "l_n").agg(F.count("*").alias("m")).join(of, ["lang", "source"]))
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"))
    first = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m")).withColumn("r", F.row_number().over(by)).filter(F.col("r") <= ranks)
    begun = first.withColumn("upto", F.sum("m").over(by)).filter(F.col("upto") - F.col("m") < ranks)
    least = begun.groupBy("lang", "source").agg(F.min("value").alias("least"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    found = above(kept.join(of.join(least, ["lang", "source"]), ["lang", "source"])).filter("value >= least").withColumn("rank", rank).filter(F.col("rank") <= ranks)
    return found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, scale: int = SCALE, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources lie from each other and from their language.

    Terms are runs of letters and of characters beyond ASCII in the whole text, A-Z lower-cased; a
    language keeps those that at least ``least_docs`` of its documents hold. A group (lang, source)
    gives each kept term the chance p = 1 + floor(scale * (count + 1) / (total + terms)); a distance is
    floor((p - q)^2 / q). Part ``pair``: each other source of the language, distances summed over
    all kept terms. Part ``term``: terms of the source with p above the language's q, ``ranks`` at
    most. Ranks follow value downwards, then the item's bytes. All numbers are whole and exact.

    Tasks count terms in bounded tables, Spark sums them by term; a term of one language takes one row per
    source. The table of pairs, as asked for, has a row for each two sources of a language.
    Null text, lang and source count as ''; a group without terms has rows of part ``pair``
    alone; repeated rows are documents of their own; no documents give no rows; other columns are not read.
    """
    if not 0 < scale <= MOST_SCALE:
        raise ValueError(f"scale {scale}; at most {MOST_SCALE}")
    named = docs.toDF(*[c.lower() for c in docs.columns])
    rows = named.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = stored(_kept(_counted(rows), least_docs), "divergence-kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("sources").alias("cells"), F.count_if("leads").alias("leads"))
    terms = sums.groupBy("lang").agg(F.sum("leads").alias("terms"))
    groups = rows.groupBy("lang", "source").agg(F.lit(1)).select("lang", "source").join(sums, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = stored(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "cells", "terms")]), "divergence-groups")
    return _pairs(groups, kept, scale).unionByName(_own_terms(groups, kept, scale, ranks))
