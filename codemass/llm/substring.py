"""Substring deduplication with FM-indexes over content shards.

A window of ``WINDOW`` words goes by its minimizer, the least hash among its ``GRAM``-word grams: equal windows have
equal minimizers.  Consecutive windows of one minimizer form a segment.

1. Minimizers are counted over all documents (one shuffle of small rows); only those of two documents or more go on.
   Very frequent ones are known beforehand from a bounded sample of documents: they are broadcast, take no part in
   that shuffle, and their windows are dealt out one by one.  The sample decides how rows are dealt, not what is found.
2. Blocks of documents send each different segment of a minimizer that is shared, with the least document that has
   it, to the shard of that minimizer.
3. A shard builds an FM-index of its segments: suffix order, Burrows-Wheeler transform, and a wavelet matrix of packed
   bit vectors with sampled counts.  Windows are streamed through backward search; a window whose matching statistic
   reaches the window's length is reported with the least document of its suffix interval.
4. Blocks get back the windows that an earlier document has, and delete the words those windows cover.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codemass.llm import text as X
from codemass.llm.frames import free_name

WINDOW, GRAM = 13, 5
#: Windows of a segment at most.
RUN = 64
#: Documents and UTF-8 bytes of a block at most, on average.
BLOCK_DOCS, BLOCK_BYTES = 8192, 2 << 20
#: The sample that finds very frequent minimizers, how many of its documents have one, and the most that are broadcast.
SAMPLE_DOCS, FREQUENT, FREQUENT_MOST = 4096, 12, 1 << 18


def lowest_grams(words: np.ndarray, window: int) -> np.ndarray:
    """For each window of word hashes the least hash of its grams."""
    g = X.gram_hashes(words, GRAM)
    width, have = window - GRAM + 1, 1
    while have < width:  # a minimum over 2n is that of two over n
        step = min(have, width - have)
        g = np.minimum(g[:-step], g[step:]) if len(g) > step else g[:0]
        have += step
    return g


class Segments:
    """The windows of some rows and the segments that they form."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, frequent: np.ndarray, window: int = WINDOW):
        self.starts, self.ends, self.first = X.spans(raw, offs, X.NON_SPACE)
        self.words = X.span_hashes(raw, self.starts, self.ends)
        self.window = window
        at, row = X.gram_rows(self.first, window)
        low = lowest_grams(self.words, window)[at] if len(at) else np.zeros(0, np.uint64)
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (low[1:] != low[:-1])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else at
        new |= (np.arange(len(at)) - begin) % RUN == 0
        if len(frequent) and len(at):
            often = frequent[np.minimum(np.searchsorted(frequent, low), len(frequent) - 1)] == low
            new |= often
        else:
            often = np.zeros(len(at), bool)
        self.head = np.flatnonzero(new)
        self.size = np.diff(np.concatenate([self.head, [len(at)]]))
        self.word, self.row, self.low, self.often = at[self.head], row[self.head], low[self.head], often[self.head]
        self.hash = X.range_hashes(self.words, self.word, self.word + self.size + window - 1) if len(at) else np.zeros(0, np.uint64)


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence: for each bit of the symbols a packed bit vector with counts by word."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = []
        s = sequence
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = ((s >> bit) & 1).astype(bool)
            padded = np.zeros(-(-(len(s) + 1) // 64) * 64, bool)
            padded[: len(s)] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]).astype(np.int32)
            zeros = len(s) - int(ones.sum())
            self.levels.append((bit, packed, counts, zeros))
            s = np.concatenate([s[~ones], s[ones]])
        self.base = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, packed, counts, zeros in self.levels:
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[word] + np.bitwise_count(packed[word] & below)
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.base[symbol]


class FmIndex:
    """An index of texts of symbols from 1, each ended by a 0, for patterns of up to ``reach`` symbols."""

    def __init__(self, text: np.ndarray, symbols: int, reach: int):
        n = len(text)
        rank, have = text.astype(np.int64), 1
        while have < reach:  # the order by twice as many symbols
            ahead = np.zeros(n, np.int64)
            ahead[:-have] = rank[have:] + 1
            _, rank = np.unique(rank * np.int64(n + symbols + 2) + ahead, return_inverse=True)
            have *= 2
        self.order = np.argsort(rank, kind="stable")
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.matrix = WaveletMatrix(text[self.order - 1], symbols)

    def search(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the ``length`` symbols before each end in ``text``: matching statistics, suffix intervals.

        A search stops where its interval is down to one suffix, as that one is the pattern's own place.
        """
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.order), np.int64)
        statistic = np.zeros(len(ends), np.int64)
        alive = np.arange(len(ends))
        for k in range(1, length + 1):
            symbol = text[ends[alive] - k]
            a = self.before[symbol] + self.matrix.rank(symbol, lo[alive])
            b = self.before[symbol] + self.matrix.rank(symbol, hi[alive])
            lo[alive], hi[alive] = a, b
            more = b - a > 1
            alive = alive[more]
            statistic[alive] = k
            if not len(alive):
                break
        return statistic, lo, hi


def earliest(words: np.ndarray, size: np.ndarray, docs: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For segments (their words one after another): each window's earliest document, and each segment's first window.

    docs: a document of each segment.  A window's earliest document is the least of all segments that hold it.
    """
    n = len(size)
    symbol_values, symbol = np.unique(words, return_inverse=True)
    text = np.zeros(len(words) + n, np.int64)
    segment = np.repeat(np.arange(n), size)
    text[np.arange(len(words)) + segment] = symbol + 1
    begin = np.cumsum(size + 1) - (size + 1)
    windows = size - window + 1
    at = X.ranges(begin, windows)
    of = np.repeat(np.arange(n), windows)
    index = FmIndex(text, len(symbol_values) + 1, window)
    owner = np.repeat(docs, size + 1)[index.order]
    grams = X.gram_hashes(X.mix(text.astype(np.uint64)), window)[at]
    _, some, back = np.unique(grams, return_index=True, return_inverse=True)
    statistic, lo, hi = index.search(text, at[some] + window, window)
    least = docs[of[some]].copy()
    repeated = np.flatnonzero(statistic >= window)
    if len(repeated):
        repeated = repeated[np.argsort(lo[repeated], kind="stable")]
        cuts = np.stack([lo[repeated], hi[repeated]], 1).ravel()
        padded = np.concatenate([owner, [np.iinfo(np.int64).max]])
        least[repeated] = np.minimum.reduceat(padded, cuts)[::2]
    return least[back], np.cumsum(windows) - windows


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes * flat.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _flat(column: pa.ChunkedArray | pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column one after another, and how many each row has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    item = np.dtype(kind).itemsize
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return np.frombuffer(raw.tobytes(), kind), np.diff(offs) // item


def _frequent(known: DataFrame, key: str, text: str, total: int) -> np.ndarray:
    """Minimizers of FREQUENT documents or more among about SAMPLE_DOCS (least hashes), the most frequent; sorted."""
    modulus = max(1, total // SAMPLE_DOCS)
    sample = known.where(F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit("frequent")), F.lit(modulus)) == 0)
    counted = sample.mapInArrow(_minimizers(key, text, None), "low long, doc long, _block int").select("low", "doc").distinct().groupBy("low").count()
    rows = counted.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "low").limit(FREQUENT_MOST).select("low").collect()
    return np.sort(np.array([r["low"] for r in rows], np.int64).view(np.uint64))


def _minimizers(key: str, text: str, shared):
    def run(batches):
        frequent = shared.value if shared else np.zeros(0, np.uint64)
        for batch in batches:
            ids, block = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (key, "_block"))
            for r0, _, raw, offs in X.chunks(batch.column(batch.schema.get_field_index(text))):
                s = Segments(raw, offs, frequent)
                new = ~s.often
                if new.any():
                    row = r0 + s.row[new]
                    yield pa.RecordBatch.from_pydict(
                        {"low": s.low[new].view(np.int64), "doc": ids[row].astype(np.int64), "_block": block[row].astype(np.int32)})

    return run


def _untouched(docs: DataFrame, names: list[str], text: str, schema: T.StructType) -> DataFrame:
    """Rows that no other judges, with all their words."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            count, kept = [], []
            for _, _, raw, offs in X.chunks(batch.column(batch.schema.get_field_index(text))):
                starts, ends, first = X.spans(raw, offs, X.NON_SPACE)
                data, to = X.spaced(raw, starts, ends)
                data, bounds = data.tobytes(), to[first].tolist()
                count += np.diff(first).tolist()
                kept += [data[a : max(a, b - 1)].decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            arrays += [pa.array(count, pa.int64()), pa.array([0] * len(count), pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return docs.select(*names).mapInArrow(run, schema)


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed and kept (the words left, one space apart), each row's whole text judged.

    Words are runs of other than ASCII white space.  A word goes if a window of 13 words that covers it starts in a row
    of smaller key too; windows are judged on the input.  A null text has no words; a null key comes before none and has
    no row before it, so such a row keeps its words.  Rows of equal key do not judge one another.  Row order is not kept.
    Input columns with a result's name are replaced.  Words are compared by 32-bit codes of 64-bit hashes within shards
    of equal minimizer, so a false match needs 13 colliding words in a row.

    Blocks and shards are as many as the corpus's rows and bytes ask for.  A row's block follows its key and text, so rows of
    one key lie in many blocks; only copies that agree in both lie in one.
    """
    spark = docs.sparkSession
    new = {"n_words", "n_removed", "kept"}
    keep = [f for f in docs.schema.fields if f.name.lower() not in new]
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    n_blocks = max(1, -(-total // BLOCK_DOCS), -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64(F.col(key).cast("long"), F.col(text)), F.lit(n_blocks)).cast("int")
    known = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), text, block.alias("_block"))
    shared = spark.sparkContext.broadcast(_frequent(known, key, text, total))

    rows = known.mapInArrow(_minimizers(key, text, shared), "low long, doc long, _block int").repartition("low")
    by = W.partitionBy("low")
    several = rows.withColumns({"_a": F.min("doc").over(by), "_b": F.max("doc").over(by)}).where("_a < _b")
    wanted = several.select("_block", "low")

    own = free_name(docs, "_block")
    dealt = docs.where(F.col(key).isNotNull()).select([f.name for f in keep]).withColumn(own, block)

    def segments(table: pa.Table, lows: pa.Table) -> pa.Table:
        want = np.unique(lows.column("low").to_numpy().view(np.uint64)) if lows.num_rows else np.zeros(0, np.uint64)
        parts = []
        if table.num_rows:
            number = table.column(own)[0].as_py()
            ids = table.column(key).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
            for r0, _, raw, offs in X.chunks(table.column(text).combine_chunks()):
                s = Segments(raw, offs, shared.value)
                use = s.often.copy()
                if len(want) and len(s.low):
                    use |= want[np.minimum(np.searchsorted(want, s.low), len(want) - 1)] == s.low
                h, size, doc, word = s.hash[use], s.size[use] + WINDOW - 1, ids[r0 + s.row[use]], s.word[use]
                shard = np.where(s.often[use], h, s.low[use]) % np.uint64(n_blocks)
                codes = (s.words >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((doc, h))
                h, size, doc, word, shard = h[order], size[order], doc[order], word[order], shard[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                if len(first):
                    last = np.concatenate([first[1:], [len(h)]]) - 1
                    parts.append((h[first], size[first], doc[first], doc[last], shard[first], codes[X.ranges(word[first], size[first])]))
        if not parts:
            return out_segments.empty_table()
        h, size, low, high, shard = (np.concatenate([p[i] for p in parts]) for i in range(5))
        return pa.Table.from_arrays(
            [pa.array(shard.astype(np.int32)), pa.array(np.full(len(h), number, np.int32)), pa.array(h.view(np.int64)), pa.array(low), pa.array(high),
                _binary(np.concatenate([p[5] for p in parts]), size)],
            schema=out_segments,
        )

    out_segments = pa.schema([("shard", pa.int32()), ("_block", pa.int32()), ("h", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
            ("words", pa.binary())])
    sent = dealt.groupBy(own).cogroup(wanted.groupBy("_block")).applyInArrow(segments, "shard int, _block int, h long, low long, high long, words binary")

    out_found = pa.schema([("_block", pa.int32()), ("h", pa.int64()), ("least", pa.binary())])

    def search(table: pa.Table) -> pa.Table:
        flat, size = _flat(table.column("words"), np.uint32)
        h, low = table.column("h").to_numpy(), table.column("low").to_numpy()
        order = np.lexsort((low, h))
        first = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        some = order[first]  # each different segment with its least document
        begin = np.cumsum(size) - size
        least, at = earliest(flat[X.ranges(begin[some], size[some])], size[some], low[some])
        of = np.empty(len(h), np.int64)
        of[order] = np.cumsum(first) - 1
        count = size[some] - WINDOW + 1
        smallest = np.minimum.reduceat(least, at)
        use = np.flatnonzero(smallest[of] < table.column("high").to_numpy())
        of = of[use]
        return pa.Table.from_arrays(
            [table.column("_block").combine_chunks().take(pa.array(use)), pa.array(h[use]), _binary(least[X.ranges(at[of], count[of])], count[of])],
            schema=out_found
        )

    found = sent.groupBy("shard").applyInArrow(search, "_block int, h long, least binary")

    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def delete(table: pa.Table, marks: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not table.num_rows:
            return to_arrow_schema(schema).empty_table()
        ids = table.column(key).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        flat, size = _flat(marks.column("least"), np.int64) if marks.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        h = marks.column("h").to_numpy() if marks.num_rows else np.zeros(0, np.int64)
        # parts of a block's text may have sent the same segment each; their answers are alike
        h, some = np.unique(h, return_index=True)
        begin, size = (np.cumsum(size) - size)[some], size[some]
        n_words, n_removed, kept = [], [], []
        for r0, _, raw, offs in X.chunks(table.column(text).combine_chunks()):
            s = Segments(raw, offs, shared.value)
            stay = np.ones(len(s.words), bool)
            if len(h) and len(s.hash):
                own = s.hash.view(np.int64)
                k = np.minimum(np.searchsorted(h, own), len(h) - 1)
                hit = np.flatnonzero((h[k] == own) & (size[k] == s.size))
                k = k[hit]
                least = flat[X.ranges(begin[k], size[k])]
                gone = X.ranges(s.word[hit], size[k])[least < np.repeat(ids[r0 + s.row[hit]], size[k])]
                cover = np.zeros(len(s.words) + 1, np.int64)
                np.add.at(cover, gone, 1)
                np.add.at(cover, gone + WINDOW, -1)
                stay = np.cumsum(cover[:-1]) == 0
            count = np.diff(s.first)
            left = np.concatenate([[0], np.cumsum(stay)])[s.first]
            n_words.append(count)
            n_removed.append(count - np.diff(left))
            data, to = X.spaced(raw, s.starts, s.ends, stay)
            bounds = to[s.first]
            data = data.tobytes()
            kept += [data[a : max(a, b - 1)].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        arrays = [table.column(c).combine_chunks() for c in names] + [pa.array(np.concatenate(n_words), pa.int64()),
            pa.array(np.concatenate(n_removed), pa.int64()), pa.array(kept, pa.string())]
        return pa.Table.from_arrays(arrays, names=[f.name for f in schema.fields])

    judged = dealt.groupBy(own).cogroup(found.groupBy("_block")).applyInArrow(delete, schema)
    return judged.unionByName(_untouched(docs.where(F.col(key).isNull()), names, text, schema))
