"""Packing of tokenised documents into sequences by shortest-pack-first histogram packing.

1. Documents are tokenised where they lie and cut into pieces; a piece's length and checksums are its row.
2. Only the histogram of lengths (at most ``capacity`` counts) goes to the driver.  Lengths are placed
   longest first; each goes to the open pattern with the most room (the shortest pack), and pattern counts
   are updated instead of single packs.  A length that no room takes opens patterns with as many copies as fit.
3. Patterns that are left with much room are filled: the emptiest are dissolved, and their pieces are cut to the
   room of the others, again by counts of equal patterns.
4. Every piece gets its rank among the pieces of its length (hashed sub-ranges of documents are counted
   first, so no task ranks one whole length), and patterns join back to pieces by length and rank.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codemass.llm.frames import checkpointed

CAPACITY = 4096
END = 2
#: Pieces can be cut at multiples of 1/GRAINS of a sequence; room below 1/LEAST of it is not filled.
GRAINS, LEAST = 128, 32
MEMO = 200_000
#: Pieces that one task ranks at most, about: hashed sub-ranges of a length follow the corpus.
RANKED = 1_000_000
#: Texts of these characters only are cut into the tokenizer's own words here; words are then looked up one by one.
_PLAIN = re.compile(r"[\t\n\r\x0b\x0c\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\sa-zà-öø-ÿß0-9]+")
_GAPS = re.compile(r"[ \t\n\r]+")


def _visible() -> dict[int, str]:
    """How byte-level tokenizers write bytes: visible Latin-1 characters as they are, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


_VISIBLE = _visible()


class WordTokens(dict):
    """Word to its ids (unsigned little-endian 32-bit), from the tokenizers library; a bounded two-generation memo."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.old = Tokenizer.from_file(path), {}
        self.merges = self.tokenizer.model.tokenize
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        normal, split = str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)
        self.by_word = "Lowercase" in normal and "\\\\p{L}" in split.replace("\\p",
            "\\\\p") and "use_regex=False" in split and type(self.tokenizer.model).__name__ == "BPE"

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None and self.by_word and _PLAIN.fullmatch(word) and not self.special.search(word):
            # a word as the tokenizer's own stages leave it: only its merges are still to be made
            found = self.merges(word.encode().decode("latin-1").translate(_VISIBLE))
            ids = np.array([t.id for t in found], "<u4").tobytes()
        elif ids is None:
            ids = np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """A whole text's ids.  The words of a text are independent: no token spans white space."""
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()
        if not self.by_word:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _PLAIN.fullmatch(text) and not self.special.search(text):
            return b"".join(map(self.__getitem__, _WORDS.findall(text.lower())))
        return b"".join(
            self[w]
            if self.special.search(w) or not _PLAIN.fullmatch(w)
            else b"".join(map(self.__getitem__, _WORDS.findall(w.lower())))
            for w in _GAPS.split(text)
            if w
        )


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The memo of a tokenizer file, one for each worker."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def pieces(
    docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = END, key: str = "doc_id", text: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row for each piece of at most ``capacity`` ids: key, start, length, ids_crc32, doc_tokens, marks, and ids (binary) if asked for.

    marks: checksums (unsigned, little-endian 32-bit) of the piece's first 1, 2, ... grains; none for full pieces.
    """
    schema = T.StructType([
        docs.schema[key], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("marks", T.BinaryType()), *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ])
    last, grain = np.asarray([end], "<u4").tobytes(), max(1, capacity // GRAINS)

    def run(batches):
        tokens = word_tokens(path)
        for batch in batches:
            out, held = [], 0
            for k, s in zip(*(batch.column(batch.schema.get_field_index(c)) for c in (key, text)), strict=True):
                ids = tokens.ids(s.as_py() or "") + last
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    crc, marks = _marks(piece, 4 * capacity, grain)
                    out.append((k.as_py(), at, min(capacity, n - at), crc, n, marks, *([piece] if with_ids else [])))
                held += len(ids) if with_ids else 64 + len(ids) // grain
                if held > 8 << 20:
                    yield _rows(out, schema)
                    out, held = [], 0
            if out:
                yield _rows(out, schema)

    return docs.select(key, text).mapInArrow(run, schema)


def _marks(piece: bytes, full: int, grain: int) -> tuple[int, bytes]:
    """The piece's checksum, and those of its beginnings."""
    if len(piece) == full:
        return zlib.crc32(piece), b""
    crc, out = 0, []
    for at in range(0, len(piece), 4 * grain):
        crc = zlib.crc32(piece[at : at + 4 * grain], crc)
        out.append(crc)
    return crc, np.array(out[: len(piece) // (4 * grain)], "<u4").tobytes()


def _part_crc(whole: int, marks: bytes, grain: int, length: int, start: int, size: int) -> int:
    """The checksum of ``size`` ids from ``start`` on, from those of the beginnings that end there."""
    known = np.frombuffer(marks, "<u4")
    upto = lambda n: 0 if not n else whole if n == length else int(known[n // grain - 1])
    nothing = bytes(4 * size)
    return upto(start + size) ^ zlib.crc32(nothing, upto(start)) ^ zlib.crc32(nothing)


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest-pack-first: (copies, lengths) that hold every counted length once and fill at most ``capacity``.

    Lengths go longest first into the open pattern with the most room; a pattern with more copies than
    lengths are left splits in two.  Where no pattern has room, new ones take as many of the length as fit.  There are
    at most as many splits as placements, so the work follows the number of different lengths, not of pieces.
    """
    room: dict[int, list[list]] = defaultdict(list)  # room left: [copies, lengths]
    largest: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def keep(left: int, copies: int, lengths: tuple[int, ...]) -> None:
        if left == 0:
            done.append((copies, lengths))
            return
        if left not in room or not room[left]:
            heapq.heappush(largest, -left)
        room[left].append([copies, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            while largest and not room[-largest[0]]:
                heapq.heappop(largest)
            if not largest or -largest[0] < length:
                most = capacity // length
                for copies, each in ((left // most, most), (1, left % most)):
                    if copies and each:
                        keep(capacity - each * length, copies, (length,) * each)
                break
            free = -largest[0]
            copies, lengths = room[free].pop()
            used = min(copies, left)
            left -= used
            if copies > used:
                room[free].append([copies - used, lengths])
            keep(free - length, used, (*lengths, length))
    for entries in room.values():
        done += [(copies, lengths) for copies, lengths in entries]
    return done


class _Pack:
    """Copies of a pattern: what each holds as (length, rank of the first copy's piece, start in the piece, size), and its room."""

    __slots__ = ("copies", "held", "room")

    def __init__(self, copies: int, held: tuple, room: int):
        self.copies, self.held, self.room = copies, held, room

    def split(self, copies: int) -> _Pack:
        """Takes the first ``copies`` off."""
        taken = _Pack(copies, self.held, self.room)
        self.copies -= copies
        self.held = tuple((length, rank + copies, start, size) for length, rank, start, size in self.held)
        return taken


def filled(packed: list[tuple[int, tuple[int, ...]]], capacity: int = CAPACITY) -> list[_Pack]:
    """Patterns with their pieces' ranks, the emptiest dissolved into the room of the others.

    A dissolved piece is cut where room ends, at whole grains.  Equal copies are cut alike: each step uses up
    the copies of a pattern or of a piece, so the work follows the number of different patterns.
    """
    used: dict[int, int] = defaultdict(int)
    packs = []
    for copies, lengths in sorted(packed, key=lambda x: (x[1], x[0]), reverse=True):
        held = []
        for length in lengths:
            held.append((length, used[length], 0, length))
            used[length] += copies
        packs.append(_Pack(copies, tuple(held), capacity - sum(lengths)))
    grain, least = max(1, capacity // GRAINS), max(1, capacity // LEAST)
    usable = lambda p: p.room // grain * grain if p.room >= least else 0
    packs.sort(key=lambda p: p.room)
    space = sum(p.copies * usable(p) for p in packs)
    loose: list[_Pack] = []
    while packs and usable(packs[-1]):
        last = packs[-1]
        size = capacity - last.room
        # a dissolved copy takes its own room away, and its pieces come to the others; some room is lost to grains
        copies = min(last.copies, int(space * 0.98) // (size + usable(last)))
        if not copies:
            break
        space -= copies * (size + usable(last))
        gone = last.split(copies)
        loose += [_Pack(copies, (piece,), 0) for piece in gone.held]
        if not last.copies:
            packs.pop()
        else:
            break
    rooms = [p for p in packs if usable(p)]
    done = [p for p in packs if not usable(p)]
    while loose:
        piece = loose.pop()
        if not rooms:
            rooms.append(_Pack(piece.copies, (), capacity))
        target = rooms.pop()
        copies = min(piece.copies, target.copies)
        if piece.copies > copies:
            rest = piece
            piece = piece.split(copies)
            loose.append(rest)
        if target.copies > copies:
            rest = target
            target = target.split(copies)
            rooms.append(rest)
        length, rank, start, size = piece.held[0]
        size = size if size <= target.room else usable(target)
        target.held += ((length, rank, start, size),)
        target.room -= size
        if usable(target):
            rooms.append(target)
        else:
            done.append(target)
        if size < piece.held[0][3]:
            loose.append(_Pack(copies, ((length, rank, start + size, piece.held[0][3] - size),), 0))
    return done + rooms


def slots(packs: list[_Pack]) -> np.ndarray:
    """One row for each place of a pattern: length, first rank, rank past the last, start in the piece, size, first sequence, offset."""
    out, sequence = [], 0
    for p in packs:
        at = 0
        for length, rank, start, size in p.held:
            out.append((length, rank, rank + p.copies, start, size, sequence, at))
            at += size
        sequence += p.copies
    return np.array(sorted(out), np.int64).reshape(-1, 7)


class _Places:
    """Looks up the slots of a piece by its length and rank: ranges between all first and last ranks of a length."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        cuts, members = [], []
        for length in np.unique(rows[:, 0]).tolist():
            own = np.flatnonzero(rows[:, 0] == length)
            ends = np.unique(rows[own][:, 1:3])
            at = np.searchsorted(ends, rows[own, 1])
            count = np.searchsorted(ends, rows[own, 2]) - at
            range_of = np.repeat(at - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            cuts.append(np.stack([np.full(len(ends), length), ends]))
            members.append(np.stack([np.full(len(range_of), length), ends[range_of], np.repeat(own, count)]))
        cut, member = (np.concatenate(x, 1) if x else np.zeros((2 + (x is members), 0), np.int64) for x in (cuts, members))
        #: Lengths and ranks in one number: ranks stay below 2**48.
        self.cut = (cut[0] << 48) + cut[1]
        place = (member[0] << 48) + member[1]
        order = np.lexsort((rows[member[2], 3], place)) if len(place) else np.zeros(0, np.int64)
        self.member = member[2][order]
        self.begin = np.searchsorted(place[order], self.cut)
        self.end = np.searchsorted(place[order], self.cut, "right")

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and slots of pieces, a pair for each part of a piece."""
        at = np.searchsorted(self.cut, (length << 48) + rank, "right") - 1
        count = self.end[at] - self.begin[at]
        row = np.repeat(np.arange(len(at)), count)
        return row, self.member[np.repeat(self.begin[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]


def pack(
    docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = END, key: str = "doc_id", text: str = "text", with_ids: bool = True
) -> DataFrame:
    """Where each piece of each document lies: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its tokens and ``end``; a null or empty text is ``end`` alone.  Documents longer than ``capacity`` are
    cut into full pieces and a rest; pieces are cut further only to fill room that would be padding.  Repeated and null
    keys are packed as documents of their own.  An empty table gives an empty result.
    """
    cut = pieces(docs, path, capacity=capacity, end=end, key=key, text=text, with_ids=with_ids)
    cut = checkpointed(cut.withColumn("_row", F.monotonically_increasing_id()))
    salts = max(256, cut.count() // RANKED)
    salt = F.pmod(F.xxhash64("start", "_row"), F.lit(salts)).cast("int")
    cut = cut.withColumn("_salt", salt)
    counts = checkpointed(cut.groupBy("length", "_salt").count())
    ahead = F.sum("count").over(W.partitionBy("length").orderBy("_salt")) - F.col("count")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    # some numbers for each of the patterns, which follow the histogram whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast(slots(filled(patterns(histogram, capacity), capacity)))
    offsets = counts.select("length", "_salt", ahead.alias("_ahead"))
    ranked = cut.withColumn("_in", F.row_number().over(W.partitionBy("length", "_salt").orderBy("_row")) - 1)
    ranked = ranked.join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_ahead") + F.col("_in"))
    schema = T.StructType([
        docs.schema[key], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ])

    def place(batches):
        places, grain = _Places(shared.value), max(1, capacity // GRAINS)
        for batch in batches:
            if not batch.num_rows:
                continue
            start, length, crc, rank = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (1, 2, 3, 6))
            row, slot = places.find(length, rank)
            _, first, _, within, size, sequence, offset = places.rows[slot].T
            crc, whole = crc[row], batch.take(pa.array(row))
            cuts = np.flatnonzero(size < length[row])
            for i in cuts.tolist():
                crc[i] = _part_crc(int(crc[i]), whole.column(5)[i].as_py(), grain, int(length[row[i]]), int(within[i]), int(size[i]))
            arrays = [whole.column(0), start[row] + within, size, crc, whole.column(4), sequence + rank[row] - first, offset]
            if with_ids:
                ids = whole.column(7).to_pylist()
                for i in cuts.tolist():
                    ids[i] = ids[i][4 * int(within[i]) : 4 * int(within[i] + size[i])]
                arrays.append(pa.array(ids, batch.schema.field(7).type))
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names=[f.name for f in schema.fields])

    columns = [key, "start", "length", "ids_crc32", "doc_tokens", "marks", "_rank", *(["ids"] if with_ids else [])]
    return ranked.select(*columns).mapInArrow(place, schema)
