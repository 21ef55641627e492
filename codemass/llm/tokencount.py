"""Token counts of a byte-pair vocabulary by heap-and-linked-list merging.

The symbols of a chunk form a linked list; a heap holds the adjacent pairs that the vocabulary
knows, lowest rank (highest score) first, leftmost first among equals.  Popping a live pair joins
it and pushes its new neighbours.  A chunk's count is its number of initial symbols less the
merges made; no identifiers are made.

A text is cut only where no vocabulary piece spans the cut, so that the chunks merge on their own;
a worker keeps a bounded memo of the counts of chunks it has seen.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codemass.llm.frames import append_columns

SPACE = "▁"
#: Letters, one digit, other signs or a run of spaces, with the spaces before it.
FINE = re.compile(rf"{SPACE}*[^\W\d_²³¹]+|{SPACE}*[0-9]|{SPACE}*(?:[^\w{SPACE}\n]|[_²³¹]|(?![0-9])\d)+|{SPACE}*\n|{SPACE}+")
COARSE = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
MEMO = 200_000


class PairMerger:
    """Counts the tokens of chunks.  ``scores``: each mergeable piece's score."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        whole = all(len(FINE.findall(p)) <= 1 for p in scores)
        spaced = all(len(COARSE.findall(p)) <= 1 for p in scores)
        self.cut = FINE.findall if whole else COARSE.findall if spaced else lambda s: [s] if s else []
        self.memo = _Memo(self)

    def chunk(self, text: str) -> int:
        """Tokens of one chunk: a character that the vocabulary lacks is as many tokens as it has UTF-8 bytes."""
        scores = self.scores
        n = len(text)
        count = sum(1 if c in scores else len(c.encode()) for c in text)
        if n < 2:
            return count
        piece = list(text)
        after = list(range(1, n)) + [-1]
        before = list(range(-1, n - 1))
        heap = [(-s, i, 2) for i in range(n - 1) if (s := scores.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if not piece[i] or (j := after[i]) < 0 or len(piece[i]) + len(piece[j]) != size:
                continue
            joined = piece[i] = piece[i] + piece[j]
            piece[j] = ""
            count -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (s := scores.get(joined + piece[k])) is not None:
                    heapq.heappush(heap, (-s, i, len(joined) + len(piece[k])))
            h = before[i]
            if h >= 0 and (s := scores.get(piece[h] + joined)) is not None:
                heapq.heappush(heap, (-s, h, len(piece[h]) + len(joined)))
        return count

    def count(self, text: str) -> int:
        """Tokens of a whole text, a space put before it."""
        if not text:
            return 0
        self.memo.turn()
        return sum(map(self.memo.__getitem__, self.cut(SPACE + text.replace(" ", SPACE))))


class _Memo(dict):
    """Chunk to count, in two generations of at most MEMO chunks and one text's, so that frequent chunks stay."""

    def __init__(self, merger: PairMerger):
        super().__init__()
        self.merger, self.old = merger, {}

    def __missing__(self, chunk: str) -> int:
        n = self.old.get(chunk)
        if n is None:
            n = self.merger.chunk(chunk)
        if len(chunk) <= 64:
            self[chunk] = n
        return n

    def turn(self) -> None:
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()


_MERGERS: dict[str, PairMerger] = {}


def merger(model_path: str) -> PairMerger:
    """The merger of a model file, one for each worker."""
    if model_path not in _MERGERS:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        _MERGERS[model_path] = PairMerger({sp.id_to_piece(i): sp.get_score(i) for i in ids})
    return _MERGERS[model_path]


def count_tokens(docs: DataFrame, model_path: str, *, limit: int = 4096, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of each whole text.

    A row in, a row out, repeated rows too; no shuffle.  A null or empty text has 0 bytes and 0 tokens.
    Input columns with a result's name are replaced.  An empty table gives an empty one.
    """

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        tokens, size = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        count = merger(model_path).count
        column = batch.column(batch.schema.get_field_index(text))
        for i, s in enumerate(column):
            s = s.as_py()
            if s:
                tokens[i], size[i] = count(s), len(s.encode())
        return [pa.array(size), pa.array(tokens), pa.array(tokens > limit)]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return append_columns(docs, fields, run)
