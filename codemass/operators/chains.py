"""Chains without a budget, root by root: a task holds the graph as numbers and follows one root at a time.

Only the graph is shuffled, a copy for each task, and nothing is written: levels of a root live as long as its search.  A level's
nodes stand in the order of their least paths, so what a step meets first is extended and what it meets again is not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SNAP = "snapshot_id"
#: Nodes whose steps a row holds, and rows that are returned at once.
_BLOCK, _HELD = 1024, 10_000


class _Graph:
    """Steps by node in the order of their numbers; a step is twice the node it leads to, and one more where that ends a chain."""

    def __init__(self, nodes: np.ndarray, steps: np.ndarray):
        size = int(max(nodes.max(initial=-1), (steps >> 1).max(initial=-1))) + 1
        self.nodes, self.steps, self.size = nodes, steps, size
        self.begin = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(nodes, minlength=size), out=self.begin[1:])
        self.first, self.seen = np.empty(size, np.int64), np.zeros(size, np.bool_)

    def levels(self, root: int, max_depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, list, list]]:
        """For each level its steps that form simple paths: places of their origins in the level before and the steps; and the nodes and
        origins of all levels before."""
        if root >= self.size:
            return
        nodes, met, origins = np.array([root], np.int64), [], [np.zeros(1, np.int64)]
        try:
            for depth in range(1, max_depth + 1):
                met.append(nodes)
                self.seen[nodes] = True
                start = self.begin[nodes]
                many = self.begin[nodes + 1] - start
                if not (total := int(many.sum())):
                    return
                origin = np.repeat(np.arange(len(nodes)), many)
                steps = self.steps[np.repeat(start - (np.cumsum(many) - many), many) + np.arange(total)]
                again = np.flatnonzero(self.seen[steps >> 1])
                if again.size:
                    # what the root has met may lie on the path itself
                    to, at, on = steps[again] >> 1, origin[again], np.zeros(again.size, np.bool_)
                    for level in range(depth - 1, -1, -1):
                        on |= met[level][at] == to
                        at = origins[level][at]
                    if on.any():
                        free = np.ones(total, np.bool_)
                        free[again[on]] = False
                        origin, steps = origin[free], steps[free]
                yield origin, steps, met, origins
                if depth < max_depth:
                    to, place = steps >> 1, np.arange(len(steps))
                    # of equal indices the last assignment holds, so the first step to a node
                    self.first[to[::-1]] = place[::-1]
                    least = self.first[to] == place
                    nodes = to[least]
                    origins.append(origin[least])
        finally:
            for nodes in met:
                self.seen[nodes] = False

    def bounds(self, max_depth: int) -> np.ndarray:
        """How long a walk of ``max_depth`` steps at most that ends a chain can be, by node; 0 where none does."""
        bound = np.zeros(self.size, np.int64)
        ends = (self.steps & 1).astype(np.bool_)
        for depth in range(1, max_depth + 1):
            can = np.zeros(self.size, np.bool_)
            can[self.nodes[ends]] = True
            bound[can] = depth
            ends = can[self.steps >> 1]
        return bound


def _depths(graph: _Graph, roots: list[int], max_depth: int) -> Iterator[tuple]:
    for root in roots:
        deepest = chains = 0
        for depth, (_, steps, _, _) in enumerate(graph.levels(root, max_depth), 1):
            if n := int(np.count_nonzero(steps & 1)):
                deepest, chains = depth, chains + n
        if chains:
            yield root, deepest, chains


def _deepest(graph: _Graph, roots: list[int], max_depth: int, keep: int) -> Iterator[tuple]:
    """The ``keep`` deepest chains, then the least; a root is followed only where its longest walk might still bring one."""
    bound = graph.bounds(max_depth)
    kept: list[tuple] = []
    for root in sorted((r for r in roots if r < graph.size and bound[r]), key=lambda r: (-bound[r], r)):
        # roots come by their bounds, then by numbers, as chains by depths and numbers
        if len(kept) == keep and (kept[-1][0], kept[-1][1][0]) < (-bound[root], root):
            break
        levels = []
        for origin, steps, met, origins in graph.levels(root, max_depth):
            ending = (steps & 1).astype(np.bool_)
            levels.append((origin[ending], steps[ending] >> 1))
        own = []
        for depth in range(len(levels), 0, -1):
            at, to = levels[depth - 1]
            ids = np.empty((depth + 1, len(to)), np.int64)
            ids[depth] = to
            for level in range(depth - 1, -1, -1):
                ids[level] = met[level][at]
                at = origins[level][at]
            own += [(-depth, tuple(c)) for c in ids[:, np.lexsort(ids[::-1])[: keep - len(own)]].T.tolist()]
            if len(own) >= keep:
                break
        kept = sorted(kept + own)[:keep]
    for depth, ids in kept:
        yield list(ids), -depth


def _over_roots(roots: DataFrame, steps: DataFrame, follow: Callable, schema: str) -> DataFrame:
    """What ``follow`` makes of the graph and of each task's roots of a snapshot.

    ``roots``: snapshot_id, node.  ``steps``: node, _to, _emit, edge_seq, _kind; one from a node to another.  Nodes are numbers from 0, close together.
    """
    tasks = 2 * roots.sparkSession.sparkContext.defaultParallelism
    none = F.lit(None).cast("array<int>")
    each = F.struct("node", "edge_seq", "_kind", (F.col("_to") * 2 + F.col("_emit").cast("int")).alias("step"))
    blocks = steps.groupBy(F.floor(F.col("node") / _BLOCK).cast("int").alias("key")).agg(F.array_sort(F.collect_list(each)).alias("_s"))
    blocks = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(0).alias("kind"), "key", F.lit(None).cast("string").alias(SNAP),
        F.col("_s.node").alias("nodes"), F.col("_s.step").alias("steps"))
    own = roots.select(F.pmod(F.xxhash64("node"), F.lit(tasks)).cast("int").alias("task"), F.lit(1).alias("kind"), F.col("node").alias("key"), SNAP, none.alias("nodes"), none.alias("steps"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [{"int": pa.int32(), "bigint": pa.int64()}.get(c.split()[1], pa.list_(pa.int32())) for c in schema.split(", ")]
        made = lambda held: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        def followed(nodes, steps, mine):
            graph = _Graph(np.concatenate([np.empty(0, np.int32), *nodes]), np.concatenate([np.empty(0, np.int32), *steps]))
            for snapshot in sorted(mine):
                yield from follow(graph, sorted(mine[snapshot]))

        def rows():
            task, nodes, steps, mine = None, [], [], {}
            for batch in batches:
                tasks_here = batch.column(0).to_numpy()
                for now in sorted(set(tasks_here.tolist())):
                    if now != task:
                        yield from followed(nodes, steps, mine)
                        task, nodes, steps, mine = now, [], [], {}
                    part = batch.filter(pc.equal(batch.column(0), now))
                    graph = part.filter(pc.equal(part.column(1), 0))
                    if graph.num_rows:
                        nodes.append(graph.column(4).flatten().to_numpy())
                        steps.append(graph.column(5).flatten().to_numpy())
                    for key, snapshot in zip(*(c.to_pylist() for c in part.filter(pc.equal(part.column(1), 1)).select([2, 3]).columns), strict=True):
                        mine.setdefault(snapshot, []).append(key)
            yield from followed(nodes, steps, mine)

        held = []
        for row in rows():
            held.append(row)
            if len(held) == _HELD:
                yield made(held)
                held.clear()
        if held:
            yield made(held)

    dealt = blocks.union(own).repartitionById(tasks, "task").sortWithinPartitions("task", "kind", "key")
    return dealt.mapInArrow(run, schema)


def depths(roots: DataFrame, steps: DataFrame, *, max_depth: int) -> DataFrame:
    """(code, max_depth, chains) of every root that has a chain."""
    return _over_roots(roots, steps, lambda graph, own: _depths(graph, own, max_depth), "code int, max_depth int, chains bigint")


def deepest(roots: DataFrame, steps: DataFrame, *, max_depth: int, keep: int) -> DataFrame:
    """(codes, depth) of chains, among them the ``keep`` deepest of each snapshot, then the least."""
    return _over_roots(roots, steps, lambda graph, own: _deepest(graph, own, max_depth, keep), "codes array<int>, depth int")
