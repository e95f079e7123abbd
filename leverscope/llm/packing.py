"""Hierarchical packing of documents into token windows of several lengths."""

from __future__ import annotations

import os
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cache
from unicodedata import is_normalized

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)  # context sizes, each twice the one before
TAIL = (1024, 512, 256, 128, 64)  # lengths into which a task's last, incomplete window is cut
STEP_TOKENS = 8 * WINDOW  # tokens of a step group
END = 1  # id after each document
PENDING_TOKENS = 1 << 19  # tokens that a task holds back to choose from
CACHE_PARTS, PART_CHARS = 500_000, 64  # bounds of a worker's tables of encoded parts and words
SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long, ids binary")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet by its rule: printable Latin-1 characters stand for themselves, the other bytes for 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in own)
    return {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Little-endian 32-bit ids of whole texts, by tables of what was already encoded.

    The vocabulary's splitter never joins characters across a blank or a line feed and drops
    both, so the ids of a text are those of its blank-separated parts in turn. A part of letters
    only, or of those and one full stop or comma, is one word for the vocabulary's model (and one
    mark); any other part goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.marks = {m: self._whole([m])[0] for m in ".,"}
        self.parts: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def _whole(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _new(self, parts: list[str]) -> dict[str, bytes]:
        found, others, words, marks, tokenize = {}, [], self.words, self.marks, self.model.tokenize
        if len(words) + len(parts) > CACHE_PARTS:
            words.clear()
        for part in parts:
            mark = marks.get(part[-1])
            word = part if mark is None else part[:-1]
            ids = words.get(word)
            if ids is None:
                if len(word) > PART_CHARS or not word.isalpha():
                    others.append(part)
                    continue
                spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                ids = words[word] = array("I", [t.id for t in tokenize(spelt)]).tobytes()
            found[part] = ids if mark is None else ids + mark
        if others:
            found.update(zip(others, self._whole(others)))
        return found

    def __call__(self, text: str) -> bytes:
        low = text.lower()
        # Lower case by character and by text differ for one letter; some lower case composes anew.
        if not text.isascii() and not ("\u03a3" not in text and is_normalized("NFC", text) and is_normalized("NFC", low)):
            return self._whole([text])[0]
        parts, known = low.replace("\n", " ").split(" "), self.parts
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            found = self._new([p for p in set(parts) if p not in known])
        if len(known) + len(found) > CACHE_PARTS:
            ids = b"".join([known[p] if p in known else found[p] for p in parts])
            known.clear()
            known[""] = b""
            known.update((p, i) for p, i in found.items() if len(p) <= PART_CHARS)
            return ids
        known.update(found)
        ids = b"".join([known[p] for p in parts])
        for p in [p for p in found if len(p) > PART_CHARS]:
            del known[p]
        return ids


@cache
def encoder(path: str) -> Encoder:
    """One per worker process, kept over its tasks."""
    return Encoder(path)


class Packer:
    """Windows of one task. A piece is ``(length, number, doc_id, start, doc_tokens, ids)``."""

    def __init__(self, task: int):
        self.pieces: list[tuple] = []  # pending, shortest first
        self.held = self.number = 0
        self.base = task << 33
        self.sequences = 0
        self.opened = dict.fromkeys(TIERS, 0)  # tokens emitted per tier
        self.rows: list[tuple] = []

    def _hold(self, doc_id, start, total, ids) -> None:
        self.number += 1
        insort(self.pieces, (len(ids) // 4, self.number, doc_id, start, total, ids))
        self.held += len(ids) // 4

    def _emit(self, pieces: list[tuple], tier: int) -> None:
        group = (self.opened[tier] // STEP_TOKENS) * len(TIERS) + TIERS.index(tier)
        offset = 0
        for length, _, doc_id, start, total, ids in pieces:
            self.rows.append((doc_id, start, length, total, self.base + self.sequences, offset, tier, self.base + group, ids))
            offset += length
        self.sequences += 1
        self.opened[tier] += tier

    def add(self, doc_id, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % WINDOW
        for start in range(0, whole, WINDOW):
            self._emit([(WINDOW, 0, doc_id, start, total, ids[4 * start : 4 * (start + WINDOW)])], WINDOW)
        if whole < total:
            self._hold(doc_id, whole, total, ids[4 * whole :])
        while self.held > PENDING_TOKENS:
            self._window()

    def _cut(self, piece: tuple, length: int) -> tuple:
        """The first tokens of a piece; the others are held again, routed by what is left."""
        _, number, doc_id, start, total, ids = piece
        self._hold(doc_id, start + length, total, ids[4 * length :])
        return (length, number, doc_id, start, total, ids[: 4 * length])

    def _take(self, at: int) -> tuple:
        piece = self.pieces.pop(at)
        self.held -= piece[0]
        return piece

    def _window(self) -> None:
        """Open a window for the longest pending piece, fill its gap from shorter ones, cut one at most."""
        window = [self._take(-1)]
        tier = next(t for t in TIERS if t >= window[0][0])
        gap = tier - window[0][0]
        while gap and self.pieces:
            at = bisect_right(self.pieces, gap, key=lambda p: p[0]) - 1
            if at >= 0:
                piece = self._take(at)
            else:
                piece = self._cut(self._take(0), gap)
            window.append(piece)
            gap -= piece[0]
        if gap:
            self._last(window)
        else:
            self._emit(window, tier)

    def _last(self, window: list[tuple]) -> None:
        """Cut a task's last tokens into shorter windows; fewer than the shortest are padded."""
        left = sum(p[0] for p in window)
        while window:
            size = next((t for t in TAIL if t <= left), left)
            part, room = [], size
            while room:
                piece = window.pop(0)
                if piece[0] > room:
                    length, number, doc_id, start, total, ids = piece
                    window.insert(0, (length - room, number, doc_id, start + room, total, ids[4 * room :]))
                    piece = (room, number, doc_id, start, total, ids[: 4 * room])
                part.append(piece)
                room -= piece[0]
            self._emit(part, next((t for t in TIERS if t >= size), WINDOW))
            left -= size

    def finish(self) -> None:
        while self.pieces:
            self._window()

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                   ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()), ("ids", pa.binary())])


def pack(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Pack all documents into windows of 256 to 2,048 tokens; one row per piece, ids included.

    ``vocabulary`` is the path of a word-level BPE file on every node. Each task encodes and packs
    the rows it scans, without a shuffle: whole windows of a long document at once, remainders
    routed to the shortest tier that holds them. The longest held piece opens a window of its
    tier; its gap takes the longest pieces of shorter tiers that fit whole, then one cut piece,
    so windows are full. Windows of one tier form step groups of equal tokens. A task's last
    tokens are cut into shorter full windows, and fewer than 64 remain to be padded.

    Null text is empty and has the end id alone; repeated rows are packed as rows of their own;
    null ids are kept; no documents give no rows; other columns are not read. A sequence id holds
    the task's number, so a retried task gives the same rows.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary), Packer(TaskContext.get().partitionId())
        end = END.to_bytes(4, "little")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, encode(text.as_py() or "") + end)
                if len(packer.rows) >= 2000:
                    yield packer.batch(ARROW)
        packer.finish()
        if packer.rows:
            yield packer.batch(ARROW)

    named = docs.toDF(*[c.lower() for c in docs.columns])
    return named.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(task, SCHEMA)
