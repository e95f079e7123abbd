"""Language identification by nearest clustered centroids of TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leverscope.errors import AnalysisError
from leverscope.llm.common import mapped, place, replaced

DIMENSIONS = 1 << 12  # hashed n-gram features
CLUSTERS = 6  # centroids per language
SAMPLE = 800  # labelled texts per language from which its centroids are fitted
ROUNDS = 12
MOST_CENTROIDS = 4096  # 64 MB of broadcast model
REJECT_BELOW = 0.12  # best cosine under which a text is like no learned language
UNDETERMINED = "und"
_FOLD = np.zeros(0x110000, dtype=np.uint32)  # lower-cased letter, 0 for any other character
BLOCK_CHARS, BLOCK_TEXTS = 1 << 21, 512


def _alphabet() -> np.ndarray:
    """Code point to lower-cased letter, 0 (a word's edge) for what is no letter; built once per process."""
    if not _FOLD.any():
        for c in range(0x110000):
            if chr(c).isalpha():
                _FOLD[c] = ord(chr(c).lower()[0])
    return _FOLD


def _blocks(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Index of the first text, lengths and characters of runs of texts, an edge at both ends of each."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= BLOCK_CHARS or len(held) >= BLOCK_TEXTS or i == len(texts) - 1:
            chars = np.frombuffer(f" {'  '.join(held)} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
            yield first, np.array([len(t) for t in held]) + 2, chars
            first, held, size = i + 1, [], 0


def counts(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Sparse n-gram counts of whole texts: ``text * dimensions + feature`` ascending, and the count.

    N-grams run over lower-cased letters within a word, of which the first and last may be the
    word's edge; whatever is no letter is an edge.
    """
    alphabet, cells, numbers = _alphabet(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    shift = np.uint32(32 - (dimensions - 1).bit_length())
    for first, lengths, chars in _blocks(texts):
        letters = alphabet[chars]
        is_letter = letters > 0
        base = np.repeat(np.arange(len(lengths), dtype=np.int32) * np.int32(dimensions), lengths)
        scaled = letters * np.uint32(0x9E3779B1)
        two = scaled[:-1] * np.uint32(0x01000193) + scaled[1:]
        three = two[:-1] * np.uint32(0x01000193) + scaled[2:]
        seen = np.zeros(len(lengths) * dimensions, np.int64)
        for n, (rolled, keep) in enumerate(((scaled, is_letter), (two, is_letter[:-1] | is_letter[1:]), (three, is_letter[1:-1]))):
            mixed = rolled[keep] + np.uint32(n * 0x632BE5AB & 0xFFFFFFFF)  # an edge adds nothing to a hash: lengths differ by this
            mixed = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> shift
            seen += np.bincount(base[: len(keep)][keep] + mixed.astype(np.int32), minlength=len(seen))
        cell = np.flatnonzero(seen)
        cells.append(cell + first * dimensions)
        numbers.append(seen[cell])
    return np.concatenate(cells), np.concatenate(numbers)


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF vectors (text, feature, value); a text without letters has no entry."""
    dimensions = len(idf)
    cell, number = counts(texts, dimensions)
    text, feature = cell // dimensions, cell % dimensions
    value = (1 + np.log(number)) * idf[feature]
    norm = np.sqrt(np.bincount(text, value * value, minlength=len(texts)))
    return text, feature, value / norm[text]


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _document_frequencies(docs: DataFrame, dimensions: int) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and how many texts there are; over all rows."""
    def task(batches):
        seen, rows = np.zeros(dimensions, np.int64), 0
        for batch in batches:
            texts = _texts(batch.column(0))
            rows += len(texts)
            for at in range(0, len(texts), 256):
                cell, _ = counts(texts[at : at + 256], dimensions)
                seen += np.bincount(cell % dimensions, minlength=dimensions)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dimensions)), pa.array(np.r_[rows, seen])], names=["feature", "n"])

    # A fixed number of rows per task, summed map-side and by feature.
    found = docs.select("text").mapInArrow(task, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(dimensions + 1, np.int64)
    for feature, n in found:
        seen[feature + 1] = n
    return seen[1:], int(seen[0])


def _cluster(x: np.ndarray, clusters: int) -> np.ndarray:
    """Spherical k-means from spread-out starts (each the vector least like the starts so far)."""
    at = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[at[0]]
    while len(at) < min(clusters, len(x)):
        worst = int(np.argmin(near))
        if near[worst] > 1 - 1e-9:
            break
        at.append(worst)
        near = np.maximum(near, x @ x[worst])
    centres = x[at]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T, axis=1)
        centres = np.stack([x[own == k].mean(0) if (own == k).any() else centres[k] for k in range(len(centres))])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return centres


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, sample: int = SAMPLE) -> dict:
    """Model of the languages in ``lang``: IDF over all given texts, centroids per language.

    IDF covers all rows. Centroids are fitted on ``sample`` distinct texts a language (those of
    least text hash; each language is one task of bounded size), on all if it has no more.
    Rows without a language or without a letter teach nothing.
    """
    known = docs.filter(F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    frequency, rows = _document_frequencies(known, dimensions)
    idf = np.log((1 + rows) / (1 + frequency)) + 1
    known = known.filter(F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).limit(MOST_CENTROIDS).collect()}
    if len(sizes) * clusters > MOST_CENTROIDS:
        raise AnalysisError("tooManyLanguages", f"More than {MOST_CENTROIDS // clusters} languages.")
    # Hash below share first, so a language of many texts is thinned before any row moves. Copies
    # stay or go together, so the share follows the distinct texts; its slack is 20 times the sketch's error.
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    if sizes:
        share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, 2.0 * (sample + 20) / n)))])
        first = F.row_number().over(W.partitionBy("lang").orderBy("draw", "text"))
        picked = (known.withColumn("draw", draw).filter(F.col("draw") < F.element_at(share, F.col("lang")) * (1 << 30))
                  .dropDuplicates(["lang", "text"])  # copies of one text meet map-side
                  .withColumn("k", first).filter(F.col("k") <= sample).select("text", "lang"))

    def fit(rows: pa.Table) -> pa.Table:
        texts, lang = _texts(rows.column("text")), rows.column("lang")[0].as_py()
        text, feature, value = vectors(texts, idf)
        x = np.zeros((len(texts), dimensions))
        x[text, feature] = value
        centres = _cluster(x[x.any(axis=1)], clusters).astype(np.float32)
        return pa.table({"lang": [lang] * len(centres), "centre": [c.tobytes() for c in centres]})

    fitted = picked.groupBy("lang").applyInArrow(fit, "lang string, centre binary").orderBy("lang", "centre").collect() if sizes else []
    return {"idf": idf, "langs": [r["lang"] for r in fitted],
            "centres": np.array([np.frombuffer(r["centre"], np.float32) for r in fitted]).reshape(len(fitted), dimensions)}


def _nearest(texts: list[str], model: dict) -> tuple[list[str], np.ndarray]:
    """Language of the nearest centroid and the cosine; ``und`` and 0 where nothing can be compared."""
    idf, langs, centres = (model[k] for k in ("idf", "langs", "centres"))
    text, feature, value = vectors(texts, idf)
    found = np.flatnonzero(np.bincount(text, minlength=len(texts)))
    pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if len(langs) and len(found):
        x = np.zeros((len(texts), len(idf)), np.float32)
        x[text, feature] = value
        like = x[found] @ centres.T
        best = np.argmax(like, axis=1)
        score[found] = np.clip(like[np.arange(len(found)), best], 0, 1)
        for i, k in zip(found, best):
            pred[i] = langs[k]
    return pred, score


def _rejected(pred: list[str], score: np.ndarray, reject_below: float) -> np.ndarray:
    return np.array([p == UNDETERMINED for p in pred], bool) | (score < reject_below)


def identify(docs: DataFrame, model: dict, reject_below: float = REJECT_BELOW) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), one row per row.

    The language is that of the nearest centroid by cosine, the score that cosine. ``rejected``
    says that it is under ``reject_below``, or that there is nothing to compare: null text, no
    letter, or no learned language, which give ``und`` and score 0. Ties go to the language first
    in order. Repeated rows are rows of their own; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_CENTROIDS vectors

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_TEXTS):
                part = batch.slice(at, BLOCK_TEXTS)
                pred, score = _nearest(_texts(part.column(1)), held.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(_rejected(pred, score, reject_below))],
                                                 names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        task, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: dict, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows that ``identify`` does not reject, with all their columns; ``lang``, if there, becomes the language found."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = place(docs, "text"), place(docs, "lang")

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        pred, score = _nearest(_texts(batch.column(text)), held.value)
        batch = batch if lang is None else replaced(batch, lang, pa.array(pred, pa.string()))
        return batch.filter(pa.array(~_rejected(pred, score, reject_below)))

    return mapped(docs, lambda: change, BLOCK_TEXTS)
