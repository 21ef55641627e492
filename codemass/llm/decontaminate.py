"""Benchmark decontamination by size-partitioned min-hash containment search.

Test items are partitioned by their number of shingles.  An item's sketch is its least shingle hashes; a partition's
sketches are as long as its upper size bound asks for: of an item's n shingles a document with containment t lacks at
most (1 - t) n, so one of the least floor((1 - t) n) + 1 hashes is always there.  A document is read once, whatever its
length: its shingle hashes are looked up among the sketches, a hit makes a candidate, and candidates are verified by
exact containment of the shingles' words.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codemass.llm import text as X
from codemass.llm.frames import checkpointed

SHINGLE, THRESHOLD = 5, 0.8
#: UTF-8 bytes of item texts up to which the items are broadcast; more are joined by sketch hash instead.
BROADCAST_BYTES = 16 << 20


def words_of(text: str | None) -> list[str]:
    """Lower-cased (A-Z) words: runs of digits, a-z and characters beyond ASCII."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    low = X.LOWER[raw]
    starts, ends, _ = X.spans(low, np.array([0, len(low)]), X.ALNUM)
    data = low.tobytes()
    return [data[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def shingles(words: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    """Different shingles of k words; fewer words are one shingle, none give none."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def hashed(found: set[tuple[str, ...]]) -> np.ndarray:
    """Hashes of shingles of one length, as gram_hashes of a document gives them; least first."""
    if not found:
        return np.zeros(0, np.uint64)
    rows = sorted(found)
    n = len(rows[0])
    data = " ".join(" ".join(r) for r in rows).encode()
    raw = np.frombuffer(data, np.uint8)
    starts, ends, _ = X.spans(raw, np.array([0, len(raw)]), X.ALNUM)
    return np.unique(X.gram_hashes(X.span_hashes(raw, starts, ends), n)[::n])


def sketch(found: set[tuple[str, ...]], threshold: float = THRESHOLD) -> np.ndarray:
    """An item's least shingle hashes, as many as the upper size bound of its partition asks for."""
    bound = (1 << len(found).bit_length()) - 1
    return hashed(found)[: math.floor((1 - threshold) * bound + 1e-9) + 1]


class Sketches:
    """Items' texts and sketches.  items: (id, text)."""

    def __init__(self, items: list[tuple], k: int = SHINGLE, threshold: float = THRESHOLD):
        self.k, self.threshold, self.items = k, threshold, []
        by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for key, text in items:
            found = shingles(words_of(text), k)
            if found:
                least = sketch(found, threshold)
                by_length[len(next(iter(found)))].append((least, np.full(len(least), len(self.items), np.int32)))
                self.items.append((key, text))
        #: Shingle length: sorted sketch hashes, and their items.
        self.lookup = {}
        for length, parts in by_length.items():
            h, m = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(h, kind="stable")
            self.lookup[length] = h[order], m[order]
        self._marks: dict[int, np.ndarray] = {}
        self._found: dict[int, set] = {}

    def marks(self, length: int) -> np.ndarray:
        """A bit map of the upper bits of a length's sketch hashes; made where it is used."""
        if length not in self._marks:
            self._marks[length] = np.zeros(1 << 20, bool)
            self._marks[length][(self.lookup[length][0] >> np.uint64(44)).astype(np.int64)] = True
        return self._marks[length]

    def shingles(self, i: int) -> set[tuple[str, ...]]:
        """An item's shingles, cut from its text again; the latest ones are remembered."""
        if i not in self._found:
            if len(self._found) >= 256:
                self._found.pop(next(iter(self._found)))
            self._found[i] = shingles(words_of(self.items[i][1]), self.k)
        return self._found[i]

    def candidates(self, raw: np.ndarray, offs: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) pairs with a sketch hash in common."""
        low = X.LOWER[raw]
        starts, ends, first = X.spans(low, offs, X.ALNUM)
        words = X.span_hashes(low, starts, ends)
        out: set[tuple[int, int]] = set()
        for length, (h, m) in self.lookup.items():
            grams = X.gram_hashes(words, length)
            at = np.flatnonzero(self.marks(length)[(grams >> np.uint64(44)).astype(np.int64)])
            left, right = np.searchsorted(h, grams[at], "left"), np.searchsorted(h, grams[at], "right")
            hit = right > left
            at, left, right = at[hit], left[hit], right[hit]
            row = np.searchsorted(first, at, "right") - 1
            inside = at + length <= first[np.minimum(row + 1, len(first) - 1)]
            for r, a, b in zip(row[inside].tolist(), left[inside].tolist(), right[inside].tolist(), strict=True):
                out.update((r, int(i)) for i in m[a:b])
        return sorted(out)


def verify(text: str | None, items: list[set[tuple[str, ...]]]) -> list[int]:
    """How many of each item's shingles the text holds."""
    words = words_of(text)
    by: dict[int, set] = {}
    out = []
    for found in items:
        n = len(next(iter(found)))
        if n not in by:
            by[n] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        out.append(len(found & by[n]))
    return out


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, k: int = SHINGLE, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(key, item, n_shingles, n_found, containment) for each document row that holds at least ``threshold`` of an item's
    different ``k``-word shingles, in whatever order and place.

    Items of fewer than k words are one shingle, which has to stand in the document as consecutive words.  Null or empty
    texts match nothing.  Item rows that repeat id and text are one item; another text under the same id is an item of
    its own.  Repeated document rows match each on their own.  Items of up to ``broadcast_bytes`` of text are broadcast as
    their texts and sketches (at most some 16 bytes for each word); a larger benchmark is joined by sketch hash, with
    the same rows.
    """
    schema = T.StructType([
        docs.schema[key], T.StructField(item, benchmark.schema[item].dataType), T.StructField("n_shingles", T.LongType()),
        T.StructField("n_found", T.LongType()), T.StructField("containment", T.DoubleType()),
    ])
    items = benchmark.select(F.col(item), F.col(item_text).alias("_item_text")).where(F.col("_item_text").isNotNull()).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("_item_text") + 32), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _joined(docs, items, schema, k, threshold, key, text, item)
    shared = docs.sparkSession.sparkContext.broadcast(Sketches(sorted((tuple(r) for r in items.collect()), key=str), k, threshold))

    def run(batches):
        sketches: Sketches = shared.value
        for batch in batches:
            column = batch.column(1)
            rows = []
            for r0, _, raw, offs in X.chunks(column):
                by: dict[int, list[int]] = defaultdict(list)
                for row, i in sketches.candidates(raw, offs):
                    by[r0 + row].append(i)
                for row, found in by.items():
                    wanted = [sketches.shingles(i) for i in found]
                    for i, own, n in zip(found, wanted, verify(column[row].as_py(), wanted), strict=True):
                        if n >= threshold * len(own) - 1e-9:
                            rows.append((batch.column(0)[row].as_py(), sketches.items[i][0], len(own), n, n / len(own)))
            if rows:
                yield _batch(rows, schema)

    return docs.select(key, text).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def _filter(hashes: DataFrame, per: int = 16) -> np.ndarray:
    """A bit map of hashes, ``per`` bits for each and 2**27 at most (16 MB): packed 64 to a word by upper bits."""
    bits = min(27, max(12, (per * hashes.count()).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")
    rows = hashes.select(F.shiftright(slot, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (bits - 6), np.int64)
    got = rows.toPandas()
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def _joined(docs: DataFrame, items: DataFrame, schema: T.StructType, k: int, threshold: float, key: str, text: str, item: str) -> DataFrame:
    """The same by a join of shingle hashes with sketch hashes; only a bit map of fixed size is broadcast.

    A document's shingles are cut in the lengths that items have; those that no sketch can hold stay where they are.
    """

    def sketches(batches):
        for batch in batches:
            for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := shingles(words_of(t), k):
                    h = sketch(found, threshold)
                    yield pa.RecordBatch.from_pydict(
                        {"_n": np.full(len(h), n), "h": h.view(np.int64), "k": pa.array([len(next(iter(found)))] * len(h), pa.int32())})

    named = items.select(F.xxhash64(item, "_item_text").alias("_n"), item, "_item_text")
    hashes = checkpointed(named.select("_n", "_item_text").mapInArrow(sketches, "_n long, h long, k int"))
    lengths = sorted(r["k"] for r in hashes.select("k").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(_filter(hashes))

    def stream(batches):
        marks = shared.value
        shift = np.uint64(64 - (len(marks) * 64).bit_length() + 1)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for r0, r1, raw, offs in X.chunks(batch.column(1)):
                low = X.LOWER[raw]
                starts, ends, first = X.spans(low, offs, X.ALNUM)
                words = X.span_hashes(low, starts, ends)
                for n in lengths:
                    at, row = X.gram_rows(first, n)
                    if not len(at):
                        continue
                    h = X.gram_hashes(words, n)[at]
                    slot = h >> shift
                    may = (marks[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                    if may.any():
                        yield pa.RecordBatch.from_pydict({"_d": ids[r0:r1][row[may]], "h": h[may].view(np.int64)})

    numbered = docs.select(F.xxhash64(key, text).alias("_d"), key, text)
    pairs = numbered.select("_d", text).mapInArrow(stream, "_d long, h long").join(hashes.select("_n", "h"), "h").select("_d", "_n").distinct()
    both = pairs.join(named, "_n").join(numbered, "_d").select(key, F.col(text).alias("_text"), item, "_item_text")

    def check(batches):
        for batch in batches:
            rows = []
            for d, t, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = shingles(words_of(s), k)
                n = verify(t, [found])[0]
                if n >= threshold * len(found) - 1e-9:
                    rows.append((d, i, len(found), n, n / len(found)))
            if rows:
                yield _batch(rows, schema)

    return both.mapInArrow(check, schema)
