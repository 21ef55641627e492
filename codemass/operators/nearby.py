"""A level of bounded searches over blocks of anchors: numbers of nodes, an anchor a row, a node's neighbours once a block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of an anchor and a neighbour that are told apart at once.
_PAIRS = 1 << 21
STATE = "block int, root int, met array<int>, ends array<int>, full boolean"


class _Block:
    """Anchors of a block, with what they have met and the least of what their lists add."""

    def __init__(self, roots: list, met: list, ends: list, keep: int):
        self.roots, self.met, self.ends, self.keep = roots, met, ends, keep
        size = np.array([len(m) for m in met], np.int64)
        at = np.arange(len(met))
        self.have = np.sort((np.repeat(at, size) << 32) | np.concatenate(met))
        fronts = [m[(e[-2] if len(e) > 1 else 0) :] for m, e in zip(met, ends, strict=True)]
        rows, nodes = np.repeat(at, [len(f) for f in fronts]), np.concatenate(fronts)
        order = np.argsort(nodes, kind="stable")
        self.rows, self.nodes = rows[order], nodes[order]
        self.room = keep + 1 - size
        self.most = np.full(len(met), 1 << 32, np.int64)
        self.new = np.empty(0, np.int64)

    def add(self, nodes: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> None:
        """The neighbours of nodes: ``values`` between each two ``offsets``."""
        low, high = (np.searchsorted(self.nodes, nodes, s) for s in ("left", "right"))
        many = high - low
        lists = np.repeat(np.arange(len(nodes)), many)
        rows = self.rows[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(lists))]
        sizes = (offsets[1:] - offsets[:-1])[lists]
        total, done = np.cumsum(sizes), 0
        while done < len(lists):
            # one list at least; none is longer than the bound and one
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + _PAIRS, "right")))
            n, row = sizes[done:upto], rows[done:upto]
            place = np.repeat(offsets[lists[done:upto]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            self._merge(np.repeat(row, n), values[place])
            done = upto

    def _merge(self, rows: np.ndarray, nodes: np.ndarray) -> None:
        fits = nodes <= self.most[rows]
        keys = np.unique(np.concatenate([self.new, (rows[fits] << 32) | nodes[fits]]))
        if not keys.size:
            return
        known = self.have[np.minimum(np.searchsorted(self.have, keys), len(self.have) - 1)] == keys
        keys = keys[~known]
        row = keys >> 32
        first = np.searchsorted(row, np.arange(len(self.roots)))
        rank = np.arange(len(keys)) - first[row]
        self.new = keys[rank < self.room[row]]
        last = rank == self.room[row] - 1
        self.most[row[last]] = keys[last] & 0xFFFFFFFF

    def levels(self) -> Iterator[tuple]:
        row = self.new >> 32
        cuts = np.searchsorted(row, np.arange(len(self.roots) + 1))
        for i, root in enumerate(self.roots):
            met = np.concatenate([self.met[i], self.new[cuts[i] : cuts[i + 1]] & 0xFFFFFFFF])
            yield root, met.astype(np.int32), [*self.ends[i], len(met)], len(met) > self.keep


def next_level(state: DataFrame, lists: DataFrame, *, keep: int, parts: int) -> DataFrame:
    """``state`` (see STATE) a level further: met grows by its least new neighbours, up to the bound and one, in order; ends by its length.

    ``lists``: node, _to (distinct numbers in order, the first keep + 1).  The last level of ``met`` is its front.  A front's nodes are shuffled
    once a block, and their lists go to each block that asks for them, so anchors that lie together share them.
    """
    last = F.when(F.size("ends") > 1, F.get("ends", F.size("ends") - 2)).otherwise(0)
    fronts = state.select("block", F.explode(F.slice("met", last + 1, F.size("met"))).alias("node"))
    asked = fronts.groupBy("node").agg(F.collect_set("block").alias("_blocks")).join(lists, "node")
    none = F.lit(None).cast("array<int>")
    rows = state.select("block", F.lit(0).alias("kind"), F.col("root").alias("key"), F.col("met").alias("a"), F.col("ends").alias("b")).union(
        asked.select(F.explode("_blocks").alias("block"), F.lit(1), "node", "_to", none))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def made(block: int, held: _Block):
            rows = list(held.levels())
            for at in range(0, len(rows), 256):
                root, met, ends, full = zip(*rows[at : at + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(root), pa.int32()), pa.array(root, pa.int32()), pa.array(met, pa.list_(pa.int32())),
                        pa.array(ends, pa.list_(pa.int32())), pa.array(full, pa.bool_())], names=["block", "root", "met", "ends", "full"])

        block, held, begun = None, None, ([], [], [])
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part, now = batch.slice(a, b - a), int(blocks[a])
                if now != block:
                    if begun[0]:
                        yield from made(block, held or _Block(*begun, keep))
                    block, held, begun = now, None, ([], [], [])
                own = part.filter(pc.equal(part.column(1), 0))
                for root, met, ends in zip(*(own.column(k) for k in (2, 3, 4)), strict=True):
                    begun[0].append(root.as_py())
                    begun[1].append(met.values.to_numpy().astype(np.int64))
                    begun[2].append(ends.as_py())
                some = part.filter(pc.equal(part.column(1), 1))
                if some.num_rows:
                    held = held or _Block(*begun, keep)
                    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(some.column(3)).to_numpy())]).astype(np.int64)
                    held.add(some.column(2).to_numpy().astype(np.int64), offsets, some.column(3).flatten().to_numpy().astype(np.int64))
        if begun[0]:
            yield from made(block, held or _Block(*begun, keep))

    return rows.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(run, STATE)
