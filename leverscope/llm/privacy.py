"""Personal data by patterns and a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverscope.llm.common import mapped, place, replaced

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)  # the label of what is no personal data
# The base patterns, written so that no start is tried twice: a match can begin only where a run does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_NUMBER = re.compile(r"\(?[0-9](?:[ ().-]{0,3}[0-9])+")
_GROUP = re.compile("[0-9]+")
_AT = re.compile(r"[^\s@]{1,64}@[^\s@]{1,255}")

SURE = 0.9  # belief from which a span is added
NEIGHBOUR = 60  # characters within which mentions are a chain
SWEEPS, DAMPING = 12, 0.5
STRONG, WEAK = 10, 7  # last digits that make numbers the same, or similar
ODDS = (-1.5, 1.0)  # bounds of what a mention's own shape may say, as log odds


def _luhn(digits: str) -> bool:
    own = [int(d) for d in reversed(digits)]
    return sum(own[::2] + [d * 2 - 9 * (d > 4) for d in own[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four patterns, leftmost and without overlap per kind; by kind, then start."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            out.append((0, start, domain.end()))
            done = domain.end()
        at = text.find("@", max(done, at + 1))
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


class Mentions:
    """The nodes of one document: base spans, clamped, and what else holds digits, an @ or a known local part."""

    def __init__(self, text: str):
        self.base = base_spans(text)
        nodes = [(s, e, k) for k, s, e in self.base]
        names = self._names(text, {text[s : text.index("@", s)] for k, s, e in self.base if k == 0})
        end = at = 0
        for start, stop in [*sorted((s, e) for _, s, e in self.base), (len(text), len(text))]:
            if start > end:
                here = at
                while at < len(names) and names[at][0] < start:
                    at += 1
                nodes += self._hidden(text, end, start, [n for n in names[here:at] if n[0] >= end and n[1] <= start])
            end = max(end, stop)
        nodes.sort()
        self.spans = [(s, e) for s, e, _ in nodes]
        self.labels = [k for _, _, k in nodes]  # None: to be inferred
        self.forms = [self._form(text[s:e], k) for s, e, k in nodes]

    @staticmethod
    def _names(text: str, locals_: set[str]) -> list[tuple[int, int]]:
        """Where the local parts of known addresses stand, by place: one pass for any number of them."""
        wanted = [name for name in locals_ if len(name) >= 5 and not name.isalpha()]
        if not wanted:
            return []
        automaton = ahocorasick.Automaton()
        for name in wanted:
            automaton.add_word(name, len(name))
        automaton.make_automaton()
        return sorted((last + 1 - size, last + 1) for last, size in automaton.iter(text))

    @staticmethod
    def _hidden(text: str, start: int, stop: int, names: list[tuple[int, int]]) -> list[tuple]:
        found = [m.span() for m in _AT.finditer(text, start, stop)] if text.find("@", start, stop) >= 0 else []
        found += [m.span() for m in _NUMBER.finditer(text, start, stop) if len(_DIGIT.findall(m.group())) >= WEAK]
        found += names
        out, end = [], -1
        for s, e in sorted(found):
            if s >= end:
                out.append((s, e, None))
                end = e
        return out

    @staticmethod
    def _form(piece: str, label) -> tuple[str, list[tuple[str, bool]], list[int]]:
        """Shape (one of a few hundred), keys shared with like mentions (and whether strong), possible kinds."""
        if "@" in piece:
            return "at", [("e" + piece.partition("@")[0].lower(), True)], [0]
        digits = "".join(_GROUP.findall(piece))
        if not digits or label == 0 or any(c.isalpha() for c in piece):
            return "name", [("e" + piece.lower(), True)], [0]
        groups = _GROUP.findall(piece)
        tail = groups[1:] if len(groups) > 1 and piece[0] == "+" else groups
        shape = f"{min(20, len(''.join(tail)))}/{min(6, len(tail))}{'(' * ('(' in piece)}{'.' * ('.' in piece)}"
        keys = [("t" + digits[-WEAK:], False)] if len(digits) >= WEAK else []
        if len(digits) >= STRONG:
            keys.append(("n" + digits[-STRONG:], True))
        kinds = [k for k, ok in ((1, len(groups) == 4 and all(len(g) < 4 and int(g) <= 255 for g in groups)), (2, 13 <= len(digits) <= 19), (3, WEAK <= len(digits) <= 15)) if ok]
        return shape, keys, kinds

    def clusters(self) -> dict[tuple[str, bool], list[int]]:
        out: dict[tuple[str, bool], list[int]] = {}
        for i, (_, keys, _) in enumerate(self.forms):
            for key in keys:
                out.setdefault(key, []).append(i)
        return {k: v for k, v in out.items() if len(v) > 1}


class Potentials:
    """Log potentials from corpus counts (``what``, ``label``): shapes, neighbouring labels, agreement of like mentions."""

    def __init__(self, counts: dict[tuple[str, int], int]):
        size = OUTSIDE + 1
        self.shapes: dict[str, np.ndarray] = {}
        pairs = np.ones((size, size))
        agree, differ = counts.get(("same", 1), 0), counts.get(("same", 0), 0)
        for (what, label), n in counts.items():
            if what.startswith("shape:"):
                self.shapes.setdefault(what[6:], np.full(size, 0.5))[label] += n
            elif what.startswith("after:"):
                pairs[int(what[6:]), label] += n
        for shape, n in self.shapes.items():
            self.shapes[shape] = np.clip(np.log(n / n[OUTSIDE]), *ODDS)
        joint = pairs / pairs.sum()
        self.chain = np.clip(0.3 * np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0))), -1, 1)
        strong = min(4.0, np.log((agree + 60) / (differ + 1)))
        self.same = {True: strong * np.eye(size), False: strong / 2 * np.eye(size)}

    def unary(self, shape: str, kinds: list[int]) -> np.ndarray:
        own = np.full(OUTSIDE + 1, -50.0)
        odds = self.shapes.get(shape, np.full(OUTSIDE + 1, ODDS[0]))
        own[kinds] = odds[kinds]
        own[OUTSIDE] = 0
        return own


def beliefs(mentions: Mentions, potentials: Potentials) -> np.ndarray:
    """Label probabilities of a document's mentions by loopy message passing.

    Like mentions share one hidden node for their key instead of an edge for each pair, so a number
    repeated a thousand times has a thousand edges. Neighbours are a chain.
    """
    size, n = OUTSIDE + 1, len(mentions.spans)
    clusters = mentions.clusters()
    own = np.zeros((n + len(clusters), size))
    for i, (label, (shape, _, kinds)) in enumerate(zip(mentions.labels, mentions.forms)):
        if label is None:
            own[i] = potentials.unary(shape, kinds)
        else:
            own[i] = -50
            own[i, label] = 0
    ends, tables = [], []
    for c, ((_, strong), members) in enumerate(clusters.items()):
        ends += [(i, n + c) for i in members]
        tables += [potentials.same[strong]] * len(members)
    for i in range(n - 1):
        if mentions.spans[i + 1][0] - mentions.spans[i][1] <= NEIGHBOUR:
            ends.append((i, i + 1))
            tables.append(potentials.chain)
    if ends:
        a, b = np.array(ends).T
        source, target = np.r_[a, b], np.r_[b, a]
        table = np.array(tables)
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
        sent = np.zeros((len(source), size))
        for _ in range(SWEEPS):
            total = own.copy()
            np.add.at(total, target, sent)
            given = total[source] - sent[back]
            new = np.logaddexp.reduce(given[:, :, None] + table, axis=1)
            sent = DAMPING * sent + (1 - DAMPING) * (new - new.max(axis=1, keepdims=True))
        np.add.at(own, target, sent)
    own = np.exp(own - own.max(axis=1, keepdims=True))
    return (own / own.sum(axis=1, keepdims=True))[:n]


def _worth(text: str) -> bool:
    return "@" in text or _DIGIT.search(text) is not None


def learn(docs: DataFrame) -> Potentials:
    """Count shapes, neighbouring labels and agreements over all texts; tasks sum first, keys are a few hundred."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py() or ""
                if not _worth(text):
                    continue
                m = Mentions(text)
                seen = [OUTSIDE if k is None else k for k in m.labels]
                counts.update((f"shape:{form[0]}", k) for form, k in zip(m.forms, seen))
                counts.update((f"after:{k}", j) for k, j, x, y in zip(seen, seen[1:], m.spans, m.spans[1:]) if y[0] - x[1] <= NEIGHBOUR)
                for members in m.clusters().values():
                    labels = Counter(k for i in members if (k := m.labels[i]) is not None)
                    if len(labels):
                        most = max(labels.values())
                        counts["same", 1] += most - 1
                        counts["same", 0] += sum(labels.values()) - most
        rows = sorted(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.int64())], names=["what", "label", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(task, "what string, label long, n long").groupBy("what", "label").agg(F.sum("n").alias("n")).collect()
    return Potentials({(r["what"], r["label"]): r["n"] for r in found})


def spans_of(text: str, potentials: Potentials) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: the base ones and the mentions believed to be personal data."""
    if not _worth(text):
        return [], []
    mentions = Mentions(text)
    added = []
    if None in mentions.labels:
        for (start, end), label, belief in zip(mentions.spans, mentions.labels, beliefs(mentions, potentials)):
            kind = int(np.argmax(belief))
            if label is None and kind != OUTSIDE and belief[kind] >= SURE:
                added.append((kind, start, end))
    return mentions.base, sorted([*mentions.base, *added])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans are one, named by the first."""
    out, end = [], 0
    for start, stop, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= end:
            out += [text[end:start], f"[{KINDS[kind].upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def tag(docs: DataFrame, potentials: Potentials) -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted.

    Counts and checksum are those of the base patterns; ``spans`` adds mentions that the field
    labels: digits, addresses without a full domain, repeats of an address's local part. Spans are
    in code points, end exclusive, by kind, then start. Null and empty texts have no spans (null
    stays null when redacted); repeated rows are rows of their own; other columns are not read.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                numbers: list[list[int]] = [[] for _ in KINDS]
                sums, joined, texts = [], [], []
                for value in part.column(1):
                    text = value.as_py()
                    base, spans = spans_of(text or "", potentials)
                    held = Counter(k for k, _, _ in base)
                    for k, column in enumerate(numbers):
                        column.append(held[k])
                    sums.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    joined.append(_joined(spans))
                    texts.append(redacted(text, spans) if spans else text)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in numbers], pa.array(sums), pa.array(joined), pa.array(texts, pa.string())],
                                                 names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "redacted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(task, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")


def redact(docs: DataFrame, potentials: Potentials) -> DataFrame:
    """All rows with all their columns, personal data replaced in ``text``; ``n_chars``, if there, follows the new text."""
    text, n_chars = place(docs, "text"), place(docs, "n_chars")

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column(text).to_pylist()
        spans = [spans_of(t or "", potentials)[1] for t in old]
        new = [redacted(t, s) if s else t for t, s in zip(old, spans)]
        if n_chars is not None:
            known = batch.column(n_chars).to_pylist()
            batch = replaced(batch, n_chars, pa.array([len(t) if s else n for t, s, n in zip(new, spans, known)], batch.column(n_chars).type))
        return replaced(batch, text, pa.array(new, pa.string()))

    return mapped(docs, lambda: change)
