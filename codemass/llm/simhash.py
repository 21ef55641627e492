"""Near-duplicates by SimHash fingerprints and bit-sliced comparison.

Fingerprints at most ``RADIUS`` bits apart agree in at least two of five bit groups, so each different fingerprint
goes to ten buckets, one for each pair of groups.  Within a bucket the bit planes are stored vertically: one word of a
plane holds a bit of 64 fingerprints, and carry-save counters in two bit planes count up to three differences for
all of them at once, a third plane marks those beyond.  A block is abandoned as soon as all of it is beyond.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codemass.llm import text as X
from codemass.llm.components import connected
from codemass.llm.frames import append_columns, checkpointed

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Bits in each of the five groups.
GROUPS = (13, 13, 13, 13, 12)
#: A bucket with more fingerprints is dealt out as pairs of sub-blocks of about this size.
BLOCK = 8192
#: One with still more is cut by the bits that its own do not tell, in five groups again.
HOT, SUB_GROUPS = 8 * BLOCK, (8, 8, 8, 8, 8)
_LANES = np.uint64(0x0101010101010101)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(raw: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each row's shingles of k words, one space apart, and the shingles of each row."""
    from xxhash import xxh64_intdigest

    low = X.LOWER[raw]
    starts, ends, first = X.spans(low, offs, X.NON_SPACE)
    flat, to = X.spaced(low, starts, ends)
    data = flat.tobytes()
    words = np.diff(first)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(words)), count)
    base = np.concatenate([[0], np.cumsum(count)[:-1]])
    begin = first[:-1][row] + np.arange(len(row)) - base[row]
    last = np.minimum(begin + k, first[1:][row]) - 1
    spans = zip(to[begin].tolist(), (to[last + 1] - 1).tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(data[a:b], SEED) for a, b in spans), np.uint64, len(row)), count


def fold(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each row's fingerprint: the bits set in over half of its hashes; 0 without any.

    Eight one-byte counters share a word; runs of at most 255 hashes are summed so, and then the runs of a row.
    """
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    ends = np.cumsum(count[full])
    runs = -(-count[full] // 255)
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    of = np.repeat(np.arange(len(full)), runs)
    at = (ends - count[full])[of] + 255 * (np.arange(len(of)) - first[of])
    bits = np.zeros(len(full), np.uint64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        more = 2 * np.add.reduceat(lanes, first, axis=0) > count[full][:, None]
        for byte in range(8):
            bits |= more[:, byte].astype(np.uint64) << np.uint64(8 * byte + j)
    out[full] = bits
    return out


def fingerprints(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with fp, the text's 64-bit fingerprint as a signed long; a text without words has 0."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = np.zeros(batch.num_rows, np.uint64)
        for r0, r1, raw, offs in X.chunks(batch.column(batch.schema.get_field_index(text)), 2 << 20):
            out[r0:r1] = fold(*shingle_hashes(raw, offs))
        return [pa.array(out.view(np.int64))]

    return append_columns(docs, [T.StructField("fp", T.LongType())], run)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: [bit, word], the fingerprints' bits packed in 64-bit words."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(queries: np.ndarray, vertical: np.ndarray) -> np.ndarray:
    """For each query, the packed mask of fingerprints at most three bits away (padding included).

    A word of 64 fingerprints is a block: it is abandoned as soon as all of it is beyond, for all queries.
    """
    found = np.zeros((len(queries), vertical.shape[1]), np.uint64)
    words = np.arange(vertical.shape[1])
    ones, twos, beyond = (np.zeros_like(found) for _ in range(3))
    for p in range(64):
        flip = np.where((queries >> np.uint64(p)) & np.uint64(1), _ALL, np.uint64(0))
        x = vertical[p][None, words] ^ flip[:, None]
        carry = ones & x
        ones ^= x
        beyond |= twos & carry
        twos ^= carry
        if p % 8 == 7:
            live = (beyond != _ALL).any(0)
            if not live.all():
                words = words[live]
                if not len(words):
                    return found
                ones, twos, beyond = ones[:, live], twos[:, live], beyond[:, live]
    found[:, words] = ~beyond
    return found


def group_roots(fps: np.ndarray) -> np.ndarray:
    """Of different fingerprints: for each the first one of its component, links being at most three bits.

    The planes are packed once; each fingerprint is a query once, in batches of 64, against those from its batch on.
    """
    n = len(fps)
    vertical, parent = planes(fps), np.arange(n)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for at in range(0, n, 64):
        batch = fps[at : at + 64]
        mask = near(batch, vertical[:, at // 64 :])
        query, word = np.nonzero(mask)
        bits = np.unpackbits(mask[query, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        a, b = at + query[row], at + 64 * word[row] + bit
        real = b < n
        # copies of one link between known components are one
        pairs = np.unique(np.stack([parent[a[real]], parent[b[real]]], 1), axis=0)
        for x, y in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
            x, y = top(x), top(y)
            parent[max(x, y)] = min(x, y)
    return np.array([top(i) for i in range(n)], np.int64)


def small_roots(fps: np.ndarray, group: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of small groups (adjacent rows), as row pairs; the pairs' planes are counted alike."""
    left, right = [], []
    for d in range(1, widest):
        i = np.flatnonzero(group[d:] == group[:-d])
        if len(i):
            ok = near(np.zeros(1, np.uint64), planes(fps[i] ^ fps[i + d]))[0]
            i = i[np.unpackbits(ok.view(np.uint8), bitorder="little")[: len(i)].astype(bool)]
            left.append(i)
            right.append(i + d)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _pairs_of(value: Column, groups: tuple[int, ...]) -> list[tuple[int, int, Column]]:
    """For each pair of bit groups: their numbers, and the bits of both as one number."""
    at = np.concatenate([[0], np.cumsum(groups)])
    part = [F.shiftrightunsigned(value, int(a)).bitwiseAND(F.lit((1 << g) - 1).cast("long")) for a, g in zip(at, groups, strict=False)]
    return [(i, j, F.shiftleft(part[i], max(groups)) + part[j]) for i, j in combinations(range(len(groups)), 2)]


def _counted(rows: DataFrame) -> DataFrame:
    """``rows`` of buckets (t, key) that hold more than one, with n, how many."""
    return rows.join(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), ["t", "key"])


def links(different: DataFrame) -> DataFrame:
    """Links (a, b) that have the components of all pairs of fingerprints at most three bits apart.

    ``different``: fp, each once.  A bucket of n fingerprints in sub-blocks gives at most n links a pair of
    sub-blocks, never all its pairs.  The members of a bucket of more than HOT go to ten buckets each by the bits that
    the bucket leaves open, as they can differ in three of those at most.
    """
    keys = [F.struct(F.lit(t).alias("t"), key.alias("key")) for t, (_, _, key) in enumerate(_pairs_of(F.col("fp"), GROUPS))]
    rows = _counted(different.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key"))
    at, rest = np.concatenate([[0], np.cumsum(GROUPS)]), F.lit(0).cast("long")
    for t, pair in enumerate(combinations(range(5), 2)):
        value, used = F.lit(0).cast("long"), 0
        for g in sorted(set(range(5)) - set(pair)):
            value += F.shiftleft(F.shiftrightunsigned("fp", int(at[g])).bitwiseAND(F.lit((1 << GROUPS[g]) - 1).cast("long")), used)
            used += GROUPS[g]
        rest = F.when(F.col("t") == t, value).otherwise(rest)
    subs = [
        F.struct((F.lit(10) + F.col("t") * 10 + s).alias("t"), (F.shiftleft("key", 16) + key).alias("key"))
        for s, (_, _, key) in enumerate(_pairs_of(F.col("rest"), SUB_GROUPS))
    ]
    hot = rows.where(F.col("n") > HOT).withColumn("rest", rest).select("fp", F.explode(F.array(*subs)).alias("k")).select("fp", "k.t", "k.key")
    rows = rows.where(F.col("n") <= HOT).select("fp", "t", "key", "n").unionByName(_counted(hot).select("fp", "t", "key", "n"))
    dealt = rows.withColumn("_parts", F.ceil(F.col("n") / BLOCK).cast("long")).withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("_parts")))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    # a sub-block needs no visit of its own where it meets others
    dealt = dealt.where("_parts = 1 or _own <> _with").select("fp", "t", "key", F.least("_own", "_with").alias("lo"), F.greatest("_own", "_with").alias("hi"))
    by = ["t", "key", "lo", "hi"]

    def run(batches):
        def ended(fps: np.ndarray, group: np.ndarray):
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([edges, [len(group)]]))
            wide = np.repeat(size > 16, size)
            a, b = small_roots(fps[~wide], group[~wide], 16 + 1)
            yield fps[~wide][a], fps[~wide][b]
            for e, s in zip(edges[size > 16], size[size > 16], strict=True):
                own = fps[e : e + s]
                yield own, own[group_roots(own)]

        group_no = 0
        carry_fp, carry_key = np.zeros(0, np.uint64), None
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5)], 1)
            if carry_key is not None:
                fp, key = np.concatenate([carry_fp, fp]), np.concatenate([carry_key, key])
            new = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(1))]) + group_no
            done = new < new[-1]
            group_no = int(new[-1]) + 1
            carry_fp, carry_key = fp[~done], key[~done]
            yield from _pairs(ended(fp[done], new[done]))
        if carry_key is not None:
            yield from _pairs(ended(carry_fp, np.zeros(len(carry_fp), np.int64)))

    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _pairs(found):
    for a, b in found:
        if len(a):
            yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key, fp, component_id (the smallest key reachable over links, itself included).

    Texts are lower-cased (A-Z), cut at ASCII white space into words and three-word shingles; a fingerprint bit is
    set if set in over half of the shingles' XXH64.  Rows whose fingerprints differ in three bits or fewer link;
    texts without words all have fingerprint 0.  A null key is no component's name: rows without any key in reach
    have a null component.  Repeated rows are kept.  An empty table gives an empty result.
    """
    marked = checkpointed(fingerprints(docs.select(key, text), text=text).select(key, "fp"))
    first = marked.groupBy("fp").agg(F.min(key).alias("_first"))
    nodes = connected(links(first.select("fp")))
    named = first.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("_first").alias("component_id"))
    names = named.join(least, "root").select("fp", "component_id")
    return marked.join(names, "fp").select(key, "fp", "component_id")
