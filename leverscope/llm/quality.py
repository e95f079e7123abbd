"""Text quality by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverscope.llm.common import stored

PREDICT_FROM = 0.3
ROUNDS = 25  # Newton steps at most
RIDGE = 1e-3
BINS = 1000  # of scores, for the class prior
WINDOW_WORDS = 64
CLIP = 6.0  # standard deviations
MARKS = b"!|#%$&*<>{}=_\\/@^~+"
NAMES = (
    "words", "word_bytes", "upper", "digit", "other_byte", "stop", "comma", "mark", "mark_words", "repeat", "distinct",
    "top_word", "window_least", "window_mean", "line_repeat", "lines", "short_line", "spelled_upper", *(f"mark_{chr(m)}" for m in MARKS[:7]),
)


def features(text: str | None) -> list[float]:
    """What a whole text looks like, in ``NAMES``; rates on a log scale, so that small ones differ too."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit, other = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum(), seen[128:].sum()
    marks = [int(seen[m]) for m in MARKS]
    letters = max(1, upper + lower + other)
    some = max(1, n)
    windows = [len(set(words[i : i + WINDOW_WORDS])) / min(WINDOW_WORDS, n - i) for i in range(0, max(1, n - WINDOW_WORDS // 2), WINDOW_WORDS)] if n else [1.0]
    lines = raw.split(b"\n")
    held = Counter(lines)
    counted = Counter(words)
    rate = lambda x, of: np.log1p(200.0 * float(x) / of)
    return [
        np.log1p(n), (size - n) / some, rate(upper, letters), rate(digit, max(1, size)), other / letters, rate(seen[46], some), rate(seen[44], some),
        rate(sum(marks), some), rate(sum(m > 0 for m in marks), some), rate(sum(map(eq, words, words[1:])), some), len(counted) / some,
        rate(max(counted.values(), default=0), some), min(windows), sum(windows) / len(windows),
        rate(sum(len(x) * (k - 1) for x, k in held.items()), max(1, size)), np.log1p(len(lines)), rate(sum(len(x) < 40 for x in lines), len(lines)),
        rate(sum(map(bytes.isupper, words)), some), *[rate(m, some) for m in marks[:7]],
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    return np.c_[np.ones(len(z)), z, z[:, 1:] ** 2]


def _featured(docs: DataFrame, extra: list[str]) -> DataFrame:
    """``extra`` columns and x: float32 features of ``text``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = np.array([features(t.as_py()) for t in part.column("text")], np.float32).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in extra], pa.array([r.tobytes() for r in x], pa.binary())], names=[*extra, "x"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return docs.select(*extra, "text").mapInArrow(task, f"{kinds}, x binary")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(float)


def _sums(table: DataFrame, of_batch) -> np.ndarray:
    """Sum over all rows of what ``of_batch(x, trusted)`` gives; tasks add up first, then Spark by place."""
    def task(batches):
        total = 0.0
        for batch in batches:
            total = total + of_batch(_matrix(batch), batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

    rows = table.mapInArrow(task, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # a row a place
    out = np.zeros(len(rows))
    for k, v in rows:
        out[k] = v
    return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _fit(table: DataFrame, mean, scale, prior: float, trusted: float, rows: float) -> np.ndarray:
    """Minimise prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]) for the logistic loss.

    While the second term is positive the risk is E_U[softplus(g)] - prior * E_P[g] and convex: a
    Newton step. Where it is negative the model explains more negatives than there can be, and the
    step goes against that term alone, back to where it is not. The weights of least risk are kept.
    """
    d = 2 * len(mean)  # intercept, values, squares of all but the first
    w = np.zeros(d)
    penalty = np.r_[0.0, np.full(d - 1, RIDGE)]
    best, least = w, np.inf
    for _ in range(ROUNDS):
        def of_batch(x, positive, w=w):
            z = _design(x, mean, scale)
            g = z @ w
            p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            hessian = (z * (p * (1 - p))[:, None]).T @ z
            zp, pp = z[positive], p[positive]
            return np.concatenate([z.T @ p, hessian.ravel(), zp.sum(0), zp.T @ pp, [_softplus(g).sum(), _softplus(g[positive]).sum()]])

        s = _sums(table, of_batch)
        grad_u, hessian, mean_p, grad_p = s[:d] / rows, s[d : d + d * d].reshape(d, d) / rows, s[d + d * d : 2 * d + d * d] / trusted, s[2 * d + d * d : 3 * d + d * d] / trusted
        negative = s[-2] / rows - prior * s[-1] / trusted
        risk = prior * (s[-1] / trusted - mean_p @ w) + max(0.0, negative) + penalty @ (w * w) / 2
        if risk < least:
            best, least = w, risk
        hessian += np.diag(penalty + 1e-9)
        if negative >= 0:
            step = np.linalg.solve(hessian, grad_u - prior * mean_p + penalty * w)
        else:
            step = -0.1 * np.linalg.solve(hessian, grad_u - prior * grad_p)
        size = np.abs(step).max()
        w = w - step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-4:
            break
    return best


def _prior(table: DataFrame, mean, scale, w: np.ndarray, trusted: float, rows: float) -> float:
    """Share of positives: the least ratio of unlabelled to trusted rows above any score.

    Above a score that only positives reach, unlabelled rows hold the prior's share of the trusted
    rows' mass. The score is chosen with a deviation's slack, so that thin tails decide nothing.
    """
    def of_batch(x, positive):
        g = _design(x, mean, scale) @ w
        at = np.clip((BINS / (1 + np.exp(-np.clip(g, -30, 30)))).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[positive], minlength=BINS)]).astype(float)

    s = _sums(table, of_batch)
    above_u, above_p = (np.cumsum(x[::-1])[::-1] / n for x, n in ((s[:BINS], rows), (s[BINS:], trusted)))
    slack = lambda n: np.sqrt(np.log(4 / 0.1) / (2 * n))
    at = int(np.argmin((above_u + slack(rows) + slack(trusted)) / np.maximum(above_p, 1e-12)))
    return float(np.clip(above_u[at] / max(above_p[at], 1e-12), 0.01, 0.99))


def learn(docs: DataFrame, trusted: DataFrame) -> Model | None:
    """Fit on all given documents: those whose doc_id is in ``trusted`` are positives, all are unlabelled.

    The features are written once; each Newton step sums gradient and Hessian over all rows in the
    tasks. First a classifier of trusted against all rows gives scores, from these comes the class
    prior, and with it the non-negative unbiased risk is minimised. None without trusted rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("trusted", F.lit(True))
    table = stored(_featured(texts, ["doc_id"]).join(marked, "doc_id", "left").select("x", F.coalesce("trusted", F.lit(False)).alias("trusted")), "quality")
    s = _sums(table, lambda x, positive: np.concatenate([[len(x), positive.sum()], x.sum(0), (x * x).sum(0)]))
    if not len(s) or not s[1]:
        return None
    rows, n = s[:2]
    d = len(NAMES)
    mean = s[2 : 2 + d] / rows
    scale = np.sqrt(np.maximum(s[2 + d :] / rows - mean * mean, 0)) + 1e-6
    first = _fit(table, mean, scale, min(0.5, n / rows), n, rows)
    prior = _prior(table, mean, scale, first, n, rows)
    return Model(mean, scale, _fit(table, mean, scale, prior, n, rows), prior)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (chance of good quality, 0 to 1), predicted (1 from PREDICT_FROM on).

    Whole texts count; null is empty; empty texts get the score of their features; without a model
    (nothing trusted) the score is 0.5. Repeated rows are rows of their own; other columns are
    not read.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = _design(_matrix(batch), model.mean, model.scale) @ model.weights if model else np.zeros(batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= PREDICT_FROM).astype(np.int32))], names=["doc_id", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _featured(texts, ["doc_id"]).mapInArrow(task, "doc_id long, score double, predicted int")
