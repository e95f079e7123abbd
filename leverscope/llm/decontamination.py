"""Benchmark decontamination by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverscope.llm.common import mapped, place, stored

Q = 8  # characters of a q-gram
ERRORS = 0.08  # edit budget as a share of an item's length
SHORTEST = 40  # normalised bytes under which an item is searched for as it stands, without edits
BLOCK_BYTES = 4 << 20  # benchmark text that one pass broadcasts and searches for
TABLE_BITS = 22
WINDOW = 1 << 20  # bytes of a text whose q-grams are held at once
DIAGONALS = 1 << 16  # of a region that one alignment tries
_WORD = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def normalised(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased, each run of ASCII white space one blank; and where each byte was."""
    space = _SPACE[raw]
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[:1] = True
    at = np.flatnonzero(keep)
    text = _LOWER[raw[at]]
    text[space[at]] = 32
    return text, at


def budget(length: int, errors: float = ERRORS) -> int:
    return int(length * errors)


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """64-bit hash of the q-gram at each position but the last q - 1, doubling its length."""
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    powers, h, size = {1: np.full(1, 0x9E3779B97F4A7C15, np.uint64)}, {1: text.astype(np.uint64) + np.uint64(1)}, 1
    while 2 * size <= Q:
        h[2 * size] = h[size][:-size] * powers[size] + h[size][size:]
        powers[2 * size] = powers[size] * powers[size]
        size *= 2
    out, have = h[size], size
    while have < Q:
        step = max(s for s in h if s <= Q - have)
        n = len(text) - have - step + 1
        out = out[:n] * powers[step] + h[step][have : have + n]
        have += step
    return out * np.uint64(0xD6E8FEB86659FD93)


class Index:
    """The q-grams of a block of items, sorted, behind a bit table that most others miss."""

    def __init__(self, items: list[tuple[int, bytes]], errors: float):
        self.ids = [i for i, _ in items]
        self.texts = [np.frombuffer(normalised(np.frombuffer(t, np.uint8))[0].tobytes().strip(b" "), np.uint8) for _, t in items]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.budgets = np.array([budget(len(t), errors) for t in self.texts], np.int64)
        # Of its len - q + 1 q-grams a region within k edits keeps all but q for each edit.
        self.least = np.maximum(1, self.lengths - Q + 1 - Q * self.budgets)
        hashes = [_gram_hashes(t) if len(t) >= SHORTEST else np.zeros(0, np.uint64) for t in self.texts]
        grams = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        at = np.concatenate([*[np.arange(len(h)) for h in hashes], np.zeros(0, int)])
        order = np.lexsort((at, item, grams))
        grams, item, at = grams[order], item[order], at[order]
        # Places of one q-gram no more than two band widths apart are one chain: the bands they
        # put a hit into are neighbours, so first and last place say them all.
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (item[1:] != item[:-1]) | (np.diff(at) > 2 * (self.budgets[item[1:]] + 1))
        self.grams, self.item, self.first = grams[new], item[new], at[new]
        self.last = at[np.r_[np.flatnonzero(new)[1:], len(at)] - 1] if len(at) else at
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.grams >> np.uint64(64 - TABLE_BITS)] = True
        self.longest = int(max([len(t) for t in self.texts if len(t) >= SHORTEST], default=0))
        self.words = ahocorasick.Automaton()
        for i, t in enumerate(self.texts):
            if 0 < len(t) < SHORTEST:
                word = t.tobytes().decode("latin-1")
                self.words.add_word(word, [*self.words.get(word, []), i])
        self.words.make_automaton()

    def whole(self, text: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """First place of each short item that stands in the text between non-words."""
        out: dict[int, tuple[int, int, int]] = {}
        if not len(self.words):
            return out
        inside = _WORD[text]
        for last, items in self.words.iter(text.tobytes().decode("latin-1")):
            start, end = last + 1 - len(self.texts[items[0]]), last + 1
            if items[0] in out or (start and inside[start - 1] and inside[start]) or (end < len(text) and inside[end] and inside[end - 1]):
                continue
            out.update(dict.fromkeys(items, (0, start, end)))
        return out

    def regions(self, text: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first and last possible start) of bands that hold enough of an item's q-grams.

        The text goes through in windows that overlap by the longest item and its bands, so each
        band lies whole in one of them.
        """
        overlap = self.longest + 2 * (budget(self.longest, 1.0) + 1) + Q
        step = max(WINDOW, overlap)
        for at in range(0, len(text) if self.longest else 0, step):
            for item, first, last in self._regions(text[at : at + step + overlap]):
                for low in range(first, last + 1, DIAGONALS):
                    yield item, at + low, at + min(last, low + DIAGONALS - 1)

    def _regions(self, text: np.ndarray) -> list[tuple[int, int, int]]:
        """Diagonals (place in the text less place in the item) are dealt into bands of the budget's
        width, each hit into its band and the one before, so that neighbouring bands overlap and
        any alignment of at most ``k`` edits lies within one of them. A hit adds one to a run of
        bands, so runs are summed by where they begin and end, however often a text or an item repeats
        itself. Neighbouring bands that hold enough are one region.
        """
        hashes = _gram_hashes(text)
        hits = np.flatnonzero(self.table[hashes >> np.uint64(64 - TABLE_BITS)])
        low, high = (np.searchsorted(self.grams, hashes[hits], side) for side in ("left", "right"))
        some = high > low
        hits, low, high = hits[some], low[some], high[some]
        if not len(hits):
            return []
        times = high - low
        which = np.repeat(low - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        item, hit = self.item[which], np.repeat(hits, times)
        width = self.budgets[item] + 1
        base = hit + self.lengths[item] + width  # diagonals from here are not below the width
        begin, end = (base - self.last[which]) // width - 1, (base - self.first[which]) // width
        span = int(end.max()) + 3
        keys, steps = np.unique(np.concatenate([item * span + begin, item * span + end + 1]), return_inverse=True)
        change = np.bincount(steps[: len(item)], minlength=len(keys)) - np.bincount(steps[len(item) :], minlength=len(keys))
        enough = np.flatnonzero(np.cumsum(change) >= self.least[keys // span])  # from this key to before the next
        if not len(enough):
            return []
        follows = np.r_[False, np.diff(enough) == 1]
        opened = enough[~follows]
        closed = enough[np.r_[~follows[1:], True]]
        item, first, last = keys[opened] // span, keys[opened] % span, keys[closed + 1] % span - 1
        width = self.budgets[item] + 1
        shift = self.lengths[item] + width
        return list(zip(item.tolist(), (first * width - shift).tolist(), ((last + 2) * width - shift - 1).tolist()))


def align(item: np.ndarray, text: np.ndarray, first: int, last: int, k: int) -> tuple[int, int, int] | None:
    """Least edits, start and end of the item in the text on the diagonals ``first`` to ``last``.

    The path starts on any diagonal free of charge and ends on any; it may leave the band by the
    budget on either side. Rows are item places, columns diagonals; None above ``k`` edits.
    """
    found = _contains(text[max(0, first) : max(0, last) + len(item)], item)
    if found >= 0:
        return 0, max(0, first) + found, max(0, first) + found + len(item)
    low, width = first - k, last - first + 2 * k + 1
    columns = low + np.arange(width, dtype=np.int32)
    big = np.int32(1 << 20)
    cost = np.where((columns >= 0) & (columns <= len(text)), np.int32(0), big)
    start = columns.copy()
    padded = np.concatenate([text, [0]]).astype(np.int16)
    ramp = np.arange(width, dtype=np.int32)
    for i, c in enumerate(item):
        at = columns + i  # text place that the diagonal meets in this row
        inside = (at >= 0) & (at < len(text))
        same = padded[np.clip(at, 0, len(text))] == c
        meet = np.where(inside, cost + ~same, big)
        skip_item = np.append(cost[1:] + 1, big)  # item character without partner: next diagonal of the row before
        take = skip_item < meet
        new = np.where(take, skip_item, meet)
        new_start = np.where(take, np.append(start[1:], 0), start)
        # Text characters without partner: a run along the row, one edit each.
        level = new - ramp
        best = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == best, ramp, np.int32(0)))
        ok = (columns + i + 1 >= 0) & (columns + i + 1 <= len(text))
        cost = np.where(ok, best + ramp, big)
        start = new_start[source]
        if i % 64 == 63 and cost.min() > k:
            return None
    at = int(np.argmin(cost))
    if cost[at] > k:
        return None
    return int(cost[at]), int(start[at]), int(columns[at]) + len(item)


def _contains(text: np.ndarray, item: np.ndarray) -> int:
    return text.tobytes().find(item.tobytes())


def _found_in(index: Index, text: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """Best match of each item that the text holds."""
    out, searched = index.whole(text), set()
    for item, first, last in index.regions(text):
        if item not in searched:  # as it stands first: a long item in a repetitive text takes no alignment
            searched.add(item)
            at = _contains(text, index.texts[item])
            if at >= 0:
                out[item] = (0, at, at + int(index.lengths[item]))
        if out.get(item, (1,))[0]:
            k = int(index.budgets[item])
            begin = max(0, first - k)
            around = (item, first - begin, last - first, text[begin : max(0, last + len(index.texts[item]) + k)].tobytes())
            if hash(around) in searched:  # the like was aligned before and comes first
                continue
            searched.add(hash(around))
            # A later region has to be better than the best one so far.
            match = align(index.texts[item], text, first, last, min(k, out[item][0] - 1) if item in out else k)
            if match and match < out.get(item, (1 << 20,)):
                out[item] = match
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Items in runs of about BLOCK_BYTES; the driver holds one run at a time."""
    held, size = [], 0
    items = benchmark.toDF(*[c.lower() for c in benchmark.columns]).filter("text is not null")
    for r in items.select(F.col("item_id").cast("long"), F.encode("text", "utf-8").alias("t")).orderBy("item_id", "t").toLocalIterator():
        held.append((r["item_id"], bytes(r["t"])))
        size += len(held[-1][1])
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """Every benchmark item that a document holds within its edit budget: one row per pair.

    Texts are compared with A-Z lower-cased and white space runs as one blank. An item of ``m``
    bytes may differ from its region by ``int(errors * m)`` edits; by the q-gram lemma the region
    shares ``m + 1 - q * (k + 1)`` q-grams with it on neighbouring diagonals. Shared q-grams are
    counted in overlapping bands of diagonals, and regions that meet the bound are aligned in their
    band. Long texts go through in windows, so memory follows the longest item (some 200 bytes for each of its
    own), not the text. Whole documents are searched; the items go out in blocks of bounded size, each block in
    one pass without a shuffle, however many there are.

    Columns: doc_id, item_id, edits, start, end (bytes of the document's UTF-8 text, end
    exclusive): the match of fewest edits, then first. Items of fewer than 40 bytes are found as they stand,
    between characters of no word. Null texts and empty items match nothing; repeated rows give repeated
    matches; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.toDF(*[c.lower() for c in docs.columns]).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, edits int, start long, end long"
    out = None
    for items in _blocks(benchmark):
        held = spark.sparkContext.broadcast(items)

        def task(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Index(held.value, errors)
            for batch in batches:
                rows = []
                for doc, text, at in _documents(batch):
                    for item, (edits, start, end) in sorted(_found_in(index, text).items()):
                        last = at[end - 1] + 1 if end > start else at[start]
                        rows.append((doc, index.ids[item], edits, int(at[start]), int(last)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                                     names=["doc_id", "item_id", "edits", "start", "end"])

        found = texts.mapInArrow(task, schema)
        out = stored(found, "leaks") if out is None else out.unionByName(stored(found, "leaks"))
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The rows that hold no benchmark item, with all their columns; blocks of items filter one after the other."""
    text = place(docs, "text")
    for items in _blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def change(held=held):
            index = Index(held.value, errors)

            def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
                clean = np.ones(batch.num_rows, bool)
                column = batch.column(text)
                for i in range(batch.num_rows):
                    if column[i].is_valid:
                        clean[i] = not _found_in(index, normalised(np.frombuffer(column[i].as_buffer(), np.uint8))[0])
                return batch.filter(pa.array(clean))

            return keep

        docs = mapped(docs, change)
    return docs


def _documents(batch: pa.RecordBatch) -> Iterator[tuple]:
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        if text.is_valid:
            raw = np.frombuffer(text.as_buffer(), np.uint8)
            if len(raw):
                yield doc, *normalised(raw)
