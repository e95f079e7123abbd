"""Interpolated modified Kneser-Ney bigram model: counted in Spark, mapped by workers, scored in Spark."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leverscope.errors import AnalysisError
from leverscope.llm.common import mounted, scratch_path, stored
from leverscope.llm.words import WordHasher

END = np.uint64(0xE0D0F0E0D0F0E0D1)  # hash of the end token; no text spells it
CHUNK = 1 << 20  # tokens that a worker counts or scores at once
HELD = 1 << 22  # counted entries that a worker holds before it passes them on
LOW32 = np.uint64(0xFFFFFFFF)


@dataclass
class Model:
    """What the driver knows of a model; the arrays are files of ``folder``."""

    folder: str
    parts: int  # files of each kind; a power of two
    vocabulary: list[int] = field(default_factory=list)  # words of each part, in hash order
    tokens: int = 0
    discounts: tuple = (0.0, 0.0, 0.0)
    unigram_discounts: tuple = (0.0, 0.0, 0.0)
    bigram_types: int = 0
    spared: float = 0.0  # count mass that the unigram level's discounts leave to all words alike

    @property
    def words(self) -> int:
        return sum(self.vocabulary)

    def bounds(self) -> np.ndarray:
        """First id of each part, and one past the last; the last id is the start of a text."""
        return np.arange(self.parts + 1, dtype=np.uint64) * np.uint64(self.words + 1) // np.uint64(self.parts)


def _write(folder: str, name: str, values: np.ndarray) -> None:
    """A retried or twin task replaces the file by an equal one."""
    path = f"{folder}/{name}"
    own = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    values.tofile(own)
    os.replace(own, path)


def _map(folder: str, name: str, dtype) -> np.ndarray:
    path = f"{folder}/{name}"
    return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)


def _blob(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Steps between ascending keys and the counts, byte planes apart: mostly zeros, which shuffles compress."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return steps.T.tobytes() + counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unblob(blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(blob, np.uint8).reshape(2, 8, -1)
    steps, counts = (np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes)
    return np.cumsum(steps, dtype=np.uint64), counts


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and their summed counts."""
    if counts is None:
        keys, counts = np.unique(keys, return_counts=True)
        return keys, counts.astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], (np.add.reduceat(counts, first) if len(keys) else counts)


def _chunks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Rows, their token counts, and the word hashes of whole texts with one end each, about CHUNK tokens."""
    hashed = WordHasher()
    for batch in batches:
        held, size, first = [], 0, 0
        for i, text in enumerate(batch.column(at)):
            held.append(np.append(hashed(text.as_py()), END))
            size += len(held[-1])
            if size >= CHUNK or i == batch.num_rows - 1:
                yield batch.slice(first, i + 1 - first), np.array([len(h) for h in held]), np.concatenate(held)
                held, size, first = [], 0, i + 1


def _parted(keys: np.ndarray, counts: np.ndarray, part_of: np.ndarray, parts: int) -> pa.RecordBatch:
    cut = np.searchsorted(part_of, np.arange(parts + 1))
    rows = [(p, _blob(keys[cut[p] : cut[p + 1]], counts[cut[p] : cut[p + 1]])) for p in range(parts) if cut[p] < cut[p + 1]]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "blob"])


class _Held:
    """Sums of a task, passed on part by part before they grow too large."""

    def __init__(self, part_of, parts: int):
        self.part_of, self.parts, self.sums, self.size = part_of, parts, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.sums.append(_summed(keys))
        self.size += len(self.sums[-1][0])
        if self.size >= HELD:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.sums:
            keys, counts = _summed(*(np.concatenate(c) for c in zip(*self.sums)))
            self.sums, self.size = [], 0
            yield _parted(keys, counts, self.part_of(keys), self.parts)


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5).astype(int), minlength=6)[1:5].tolist()


def _discounts(n: list[int]) -> tuple:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more; half the count where a class is empty."""
    out = []
    for i in (1, 2, 3):
        if n[0] and n[1] and n[i - 1] and n[i]:
            d = i - (i + 1) * n[0] / (n[0] + 2 * n[1]) * n[i] / n[i - 1]
        else:
            d = i / 2
        out.append(min(max(d, 0.0), float(i)))
    return tuple(out)


class Arrays:
    """A worker's view of a model: files mapped, read where a look-up touches them."""

    def __init__(self, model: Model, trained: bool):
        self.model, folder = model, model.folder
        self.shift = np.uint64(64 - (model.parts.bit_length() - 1))
        self.first = np.concatenate([[0], np.cumsum(model.vocabulary)]).astype(np.uint64)
        parts = range(model.parts)
        self.hashes = [_map(folder, f"words-{p}", "<u8") for p in parts]
        if trained:
            self.counts = [_map(folder, f"counts-{p}", "<u8") for p in parts]
            self.bounds = model.bounds()
            self.keys = [_map(folder, f"pairs-{p}", "<u8") for p in parts]
            self.numbers = [self._narrow(f"numbers-{p}", len(self.keys[p])) for p in parts]
            self.contexts = [_map(folder, f"contexts-{p}", "<f8").reshape(-1, 2) for p in parts]
            self.chances = [_map(folder, f"left-{p}", "<u8") for p in parts]

    def _narrow(self, name: str, n: int) -> np.ndarray:
        size = os.path.getsize(f"{self.model.folder}/{name}") // max(n, 1)
        return _map(self.model.folder, name, f"<u{size or 4}")

    def _by_part(self, parts: np.ndarray) -> Iterator[tuple[int, slice]]:
        cut = np.searchsorted(parts, np.arange(self.model.parts + 1))
        return ((p, slice(cut[p], cut[p + 1])) for p in range(self.model.parts) if cut[p] < cut[p + 1])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of ascending hashes, -1 for words the corpus did not teach."""
        out = np.full(len(hashes), -1, np.int64)
        part = hashes >> self.shift if self.model.parts > 1 else np.zeros(len(hashes), np.uint64)
        for p, at in self._by_part(part):
            known = self.hashes[p]
            if len(known):
                i = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
                out[at] = np.where(known[i] == hashes[at], i + int(self.first[p]), -1)
        return out

    def word_counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ascending ids."""
        out = np.zeros(len(ids))
        cut = np.searchsorted(ids.astype(np.uint64), self.first)
        for p in range(self.model.parts):
            at = slice(cut[p], cut[p + 1])
            if at.start < at.stop:
                out[at] = self.counts[p][ids[at] - int(self.first[p])]
        return out

    def _ranged(self, ids: np.ndarray) -> Iterator[tuple[int, slice]]:
        cut = np.searchsorted(ids, self.bounds)
        return ((p, slice(cut[p], cut[p + 1])) for p in range(self.model.parts) if cut[p] < cut[p + 1])

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        """Lower-order probability of ascending ids (-1 first: unknown): distinct left neighbours, discounted."""
        left = np.zeros(len(ids))
        known = ids >= 0
        own = ids[known].astype(np.uint64)
        found = np.zeros(len(own))
        for p, at in self._ranged(own):
            found[at] = self.chances[p][(own[at] - self.bounds[p]).astype(int)]
        left[known] = found
        types, n = self.model.bigram_types, self.model.words
        if not types:
            return np.full(len(ids), 1 / (n + 1))
        d = np.array([0.0, *self.model.unigram_discounts])
        return (left - d[np.minimum(left, 3).astype(int)]) / types + self.model.spared / types / (n + 1)

    def bigram(self, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Interpolated probability of ascending ``context << 32 | word`` keys; ``lower``: of the word alone."""
        d = np.array([0.0, *self.model.discounts])
        out = lower.copy()
        context = keys >> np.uint64(32)
        for p, at in self._ranged(context):
            known, numbers = self.keys[p], self.numbers[p]
            count = np.zeros(at.stop - at.start)
            if len(known):
                i = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
                count = np.where(known[i] == keys[at], numbers[i], 0).astype(float)
            total, spared = self.contexts[p][(context[at] - self.bounds[p]).astype(int)].T
            seen = total > 0
            safe = np.where(seen, total, 1)
            value = (count - d[np.minimum(count, 3).astype(int)]) / safe + spared / safe * lower[at]
            out[at] = np.where(seen, value, lower[at])
        return out


def _merged(rows: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    sums = [_unblob(b.as_buffer()) for b in rows.column("blob")]
    return (rows.column("part")[0].as_py(), *_summed(*(np.concatenate(c) for c in zip(*sums))))


def learn(docs: DataFrame) -> Model:
    """Count a bigram model of all given texts (a column ``text``; null is empty).

    Three passes of counts, each summed in the tasks, dealt out as sorted blobs by hash or id range
    and merged part by part: words (their rank by hash is their id), pairs, distinct left
    neighbours. The merged arrays are files in the shared folder, which must be mounted on every
    node; the driver gets sizes and counts of counts. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    folder = mounted(scratch_path(spark, "lm"))
    os.makedirs(folder)
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = Model(folder, 1 << max(0, wanted - 1).bit_length())
    parts = model.parts
    shift = np.uint64(64 - (parts.bit_length() - 1))

    def count_words(batches):
        held = _Held(lambda keys: keys >> shift if parts > 1 else np.zeros(len(keys), np.uint64), parts)
        for _, _, hashes in _chunks(batches, 0):
            yield from held.add(hashes)
        yield from held.rest()

    def merge_words(rows: pa.Table) -> pa.Table:
        part, keys, counts = _merged(rows)
        _write(folder, f"words-{part}", keys)
        _write(folder, f"counts-{part}", counts)
        return pa.table({"part": pa.array([part], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())]})

    _empty(folder, parts, ("words", "counts"))
    counted = texts.mapInArrow(count_words, "part int, blob binary")
    found = counted.groupBy("part").applyInArrow(merge_words, "part int, n long, total long").collect()  # a row a part
    sizes = {r["part"]: r["n"] for r in found}
    model.vocabulary = [sizes.get(p, 0) for p in range(parts)]
    model.tokens = sum(r["total"] for r in found)
    if model.words >= 1 << 32:
        raise AnalysisError("vocabularyTooLarge", "More than 4 billion distinct words.")
    bounds = model.bounds()

    def count_pairs(batches):
        arrays = Arrays(model, trained=False)
        held = _Held(lambda keys: np.searchsorted(bounds, keys >> np.uint64(32), side="right") - 1, parts)
        for _, lengths, hashes in _chunks(batches, 0):
            yield from held.add(_keys(*_ids(arrays, hashes)[:2], lengths, model.words)[0])
        yield from held.rest()

    def merge_pairs(rows: pa.Table) -> pa.Table:
        part, keys, counts = _merged(rows)
        low, high = int(bounds[part]), int(bounds[part + 1])
        _write(folder, f"pairs-{part}", keys)
        _write(folder, f"numbers-{part}", counts.astype("<u4") if counts.max() < 1 << 32 else counts)
        context = (keys >> np.uint64(32)).astype(np.int64) - low
        sums = [np.bincount(context, counts, minlength=high - low)]
        sums += [np.bincount(context[counts == k if k < 3 else counts >= 3], minlength=high - low) for k in (1, 2, 3)]
        _write(folder, f"sums-{part}", np.stack(sums, axis=1).astype("<f8"))
        words, left = _summed(keys & LOW32)
        passed = _parted(words, left, np.searchsorted(bounds, words, side="right") - 1, parts)
        n = passed.num_rows
        stats = pa.table({"part": pa.array([-1], pa.int32()), "blob": pa.array([None], pa.binary()), "counts": [_counts_of_counts(counts) + [len(keys)]]})
        return pa.concat_tables([pa.Table.from_batches([passed]).append_column("counts", pa.array([None] * n, pa.list_(pa.int64()))), stats])

    _empty(folder, parts, ("pairs", "numbers"))
    paired = stored(texts.mapInArrow(count_pairs, "part int, blob binary").groupBy("part")
                    .applyInArrow(merge_pairs, "part int, blob binary, counts array<long>"), "lm-pairs")
    counts = [r["counts"] for r in paired.filter("part = -1").select("counts").collect()]  # a row a part
    total = np.sum(counts, axis=0).tolist() if counts else [0] * 5
    model.discounts, model.bigram_types = _discounts(total[:4]), total[4]

    def merge_left(rows: pa.Table) -> pa.Table:
        part, words, left = _merged(rows)
        dense = np.zeros(int(bounds[part + 1] - bounds[part]), "<u8")
        dense[(words - bounds[part]).astype(int)] = left
        _write(folder, f"left-{part}", dense)
        return pa.table({"counts": [[*_counts_of_counts(left), int((left >= 3).sum())]]})

    for part in range(parts):
        _write(folder, f"left-{part}", np.zeros(int(bounds[part + 1] - bounds[part]), "<u8"))
    found = paired.filter("part >= 0").select("part", "blob").groupBy("part").applyInArrow(merge_left, "counts array<long>").collect()
    total = np.sum([r["counts"] for r in found], axis=0).tolist() if found else [0] * 5
    model.unigram_discounts = _discounts(total[:4])
    model.spared = sum(d * n for d, n in zip(model.unigram_discounts, (total[0], total[1], total[4])))
    _contexts(spark, model)
    return model


def _empty(folder: str, parts: int, kinds: tuple[str, ...]) -> None:
    for kind in kinds:
        for part in range(parts):
            open(f"{folder}/{kind}-{part}", "wb").close()


def _contexts(spark: SparkSession, model: Model) -> None:
    """Per context its total and the mass that discounts spare, once these are known."""
    bounds, d = model.bounds(), np.array(model.discounts)

    def write(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                name, n = f"{model.folder}/sums-{part}", int(bounds[part + 1] - bounds[part])
                sums = np.fromfile(name, "<f8").reshape(-1, 4) if os.path.exists(name) else np.zeros((n, 4))
                _write(model.folder, f"contexts-{part}", np.stack([sums[:, 0], sums[:, 1:] @ d], axis=1))
            yield batch

    spark.range(0, model.parts, 1, min(model.parts, 64)).mapInArrow(write, "id long").count()


def _ids(arrays: Arrays, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of a chunk, the position of each token among them; ids ascend, unknown (-1) first."""
    own, at = np.unique(hashes, return_inverse=True)
    ids, back = np.unique(arrays.ids(own), return_inverse=True)
    return ids, back[at], back


def _keys(ids: np.ndarray, at: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """``context << 32 | word`` of each token; an unknown word or context gives the highest numbers."""
    word = ids[at]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.r_[0, np.cumsum(lengths)[:-1]]] = start
    return (context.astype(np.uint64) << np.uint64(32)) | (word.astype(np.uint64) & LOW32), context


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document (doc_id, text): n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``score`` is the log10 probability of the words and the end under the interpolated bigram
    model; unknown words share the mass that the unigram level gives to no word, and an unseen
    context falls back to the unigram level. ``base_score`` is the smoothed unigram sum. Null and
    empty texts have the end alone; without training text every probability is 1; repeated rows
    are rows of their own; other columns are not read.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model, trained=True)
        v, n = model.words, model.tokens
        for rows, lengths, hashes in _chunks(batches, 1):
            doc = np.repeat(np.arange(len(lengths)), lengths)
            ids, at, _ = _ids(arrays, hashes)
            counts = np.zeros(len(ids))
            counts[ids >= 0] = arrays.word_counts(ids[ids >= 0])
            base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
            lower = arrays.unigram(ids)
            keys, context = _keys(ids, at, lengths, v)
            chance = lower[at]
            seen = context >= 0  # the context of an unknown word tells nothing
            own, first, back = np.unique(keys[seen], return_index=True, return_inverse=True)
            chance[seen] = arrays.bigram(own, lower[at[seen][first]])[back]
            sums = [np.bincount(doc, w, minlength=len(lengths)) for w in (base[at], np.log10(chance))]
            known = np.bincount(doc[(counts > 0)[at]], minlength=len(lengths))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), n)), pa.array(sums[0]), pa.array(sums[1]),
                 pa.array(10 ** (-sums[1] / lengths))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(task, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
