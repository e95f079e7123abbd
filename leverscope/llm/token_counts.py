"""Token counts by byte-pair merging over a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLANK = "▁"  # how the vocabulary writes a blank
CACHE_WORDS, WORD_CHARS = 500_000, 64  # bounds of a worker's table of counted words
LIMIT = 4096
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Counter:
    """Counts the tokens of a text as a sentence-piece BPE model with byte fallback does.

    The text gets one blank in front. Of all adjacent symbols whose join is a piece, the pair of
    the best score is merged first, of equal ones the leftmost. A character that is no piece and
    was not merged counts once per byte.

    A merge can cross a place between two characters only if some piece holds them side by side,
    so places where none does part the text into segments that are merged on their own. In a
    vocabulary whose blanks stand only in front of words, blank-led words are such segments.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        scores = {model.id_to_piece(i).replace(BLANK, " "): model.get_score(i) for i in plain}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: order[s] for piece, s in scores.items()}
        self.beside = {piece[i : i + 2] for piece in self.rank for i in range(len(piece) - 1)}
        leads = all(pair[1] != " " or pair[0] == " " for pair in self.beside)
        self.characters = {piece for piece in self.rank if len(piece) == 1}
        self.words = re.compile(r" *[^ ]+| +" if leads else r"(?s).+")
        self.leads = leads
        self.known: dict[str, int] = {}

    def merged(self, text: str) -> int:
        """Tokens of one segment: its characters less the merges, and the further bytes of those that stay unknown."""
        n, rank = len(text), self.rank
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        if n > WORD_CHARS:
            after, before, size = array("q", after), array("q", before), array("q", size)
        # An entry is rank, place and length of the joined symbol in one number: 40 and 20 bits for the last two.
        heap = [rank[pair] << 60 | at << 20 | 2 for at, pair in enumerate(map(add, text, text[1:])) if pair in rank]
        heapify(heap)
        merges = 0
        while heap:
            top = heappop(heap)
            left, length = top >> 20 & 0xFFFFFFFFFF, top & 0xFFFFF
            right = after[left]
            if not size[left] or right >= n or size[left] + size[right] != length:
                continue  # one of the two was merged with another since
            merges += 1
            size[left], size[right] = length, 0
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                r = rank.get(text[left : following + size[following]])
                if r is not None:
                    heappush(heap, r << 60 | left << 20 | length + size[following])
            earlier = before[left]
            if earlier >= 0:
                r = rank.get(text[earlier : left + length])
                if r is not None:
                    heappush(heap, r << 60 | earlier << 20 | size[earlier] + length)
        if not self.characters.issuperset(text):
            merges -= sum(len(c.encode()) - 1 for c, s in zip(text, size) if s == 1 and c not in rank)
        return n - merges

    def segments(self, word: str) -> Iterator[str]:
        start, beside = 0, self.beside
        for at in range(1, len(word)):
            if word[at - 1 : at + 1] not in beside:
                yield word[start:at]
                start = at
        yield word[start:]

    def _new(self, word: str) -> int:
        known, number = self.known, 0
        for segment in self.segments(word):
            n = known.get(segment)
            if n is None:
                n = self._keep(segment, self.merged(segment))
            number += n
        return self._keep(word, number)

    def _keep(self, text: str, number: int) -> int:
        if len(text) <= WORD_CHARS:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[text] = number
        return number

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        text, known = " " + text.replace(BLANK, " "), self.known
        found = self.words.findall(text)
        try:
            return sum([known[w] for w in found])
        except KeyError:
            return sum(n if (n := known.get(w)) is not None else self._new(w) for w in found)


@cache
def counter(path: str) -> Counter:
    """One per worker process, kept over its tasks."""
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; ``over_limit``: more tokens than ``limit``.

    ``vocabulary`` is the path of a sentence-piece BPE model on every node; only its pieces and
    scores are read. One pass without a shuffle. Memory follows the longest stretch of a text that has
    no segment border, some 100 bytes a character; words counted once are kept in a bounded table.

    Null and empty texts have no bytes and no tokens; strings of special pieces inside a text are
    plain text; repeated rows and null ids are kept as rows; no documents give no rows; other
    columns are not read.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            tokens = pa.array([count(t.as_py() or "") for t in batch.column(1)], pa.int64())
            bytes_ = pc.fill_null(pc.binary_length(batch.column(1)).cast(pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), bytes_, tokens, pc.greater(tokens, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    named = docs.toDF(*[c.lower() for c in docs.columns])
    return named.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(task, SCHEMA)
