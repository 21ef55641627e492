"""Exact top-k inner products by columnar branch-and-bound.

Vectors are packed in blocks that hold their dimensions vertically (one row of the block for each dimension).
For a block of queries and a block of candidates, partial scores grow by a few dimensions at a time; after each
step a candidate stays only if its partial score plus a bound of what the remaining dimensions can add (the product
of the remaining masses, by Cauchy and Schwarz) reaches the query's k-th best score so far.  Survivors are compacted.

Blocks are dealt over a grid: query blocks to groups, candidate blocks to shards, both of bounded bytes.  A cell of the
grid is one task's group, so neither side of it grows with the tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CANDIDATES, QUERIES, STEP = 4096, 512, 8
#: Bytes of vectors that one side of a cell of the grid holds, about.
CELL_BYTES = 48 << 20
#: A block's vectors are alike in size: products of norms below 2**52 are exact in float64, below 2**62 in int64.
#: Vectors of greater norms are scored by whole numbers of any size, in blocks of this many rows.
SMALL, MIDDLE, HUGE_ROWS = 2.0**26, 2.0**31, 128
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_FULL = float(np.finfo(np.float64).max)
_BLOCK = "ids binary, flat binary, n int, block long"


def pack_blocks(vectors: DataFrame, key: str, values: str, rows: int, scale: int) -> DataFrame:
    """Rows of at most ``rows`` vectors: ids (int64), flat (floor(scale * x) as float64, dimension by dimension), n, block."""

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        held: dict[tuple[int, int], tuple[list, list]] = {}
        made = 0

        def block(ids: list, parts: list) -> pa.RecordBatch:
            nonlocal made
            made += 1
            flat = np.ascontiguousarray(np.stack(parts, 1))
            return pa.RecordBatch.from_pydict(
                {"ids": [np.asarray(ids, np.int64).tobytes()], "flat": [flat.tobytes()], "n": pa.array([len(ids)], pa.int32()), "block": [base + made]}
            )

        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with np.errstate(over="ignore"):
                    # what a double cannot hold once scaled is the end of its range
                    v = np.clip(np.floor(np.asarray(v.values, np.float64) * scale), -_FULL, _FULL)
                    norm = np.sqrt((v * v).sum())
                kind = (len(v), 0 if norm < SMALL else 1 if norm < MIDDLE else 2)
                ids, parts = held.setdefault(kind, ([], []))
                ids.append(k)
                parts.append(v)
                if len(ids) == (rows if kind[1] < 2 else min(rows, HUGE_ROWS)):
                    yield block(ids, parts)
                    held.pop(kind)
        for ids, parts in held.values():
            yield block(ids, parts)

    return vectors.select(key, values).mapInArrow(run, _BLOCK)


class _Block:
    """Vectors with their dimensions vertical, and for each dimension the mass that is left from it on."""

    def __init__(self, ids: bytes, flat: bytes, n: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.flat = np.frombuffer(flat, np.float64).reshape(-1, n)
        with np.errstate(over="ignore"):
            mass = self.flat**2
            rest = np.zeros((len(mass) + 1, n))
            rest[:-1] = np.cumsum(mass[::-1], 0)[::-1]
        self.rest = np.sqrt(rest)
        self.norm = float(self.rest[0].max())

    def whole(self, kind: type) -> np.ndarray:
        """The vectors as 64-bit or unbounded whole numbers."""
        if kind is object:
            return np.array([[int(x) for x in row] for row in self.flat], object).reshape(self.flat.shape)
        return self.flat.astype(kind)


def best(queries: _Block, candidates: _Block, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that may be among a query's k best: query rows, candidate rows, whole scores (int64).

    floor: each query's k-th best score so far (raised here).  Scores below it are left out; equal ones are not.
    Scores beyond int64 are its ends.
    """
    dims = len(queries.flat)
    reach = queries.norm * candidates.norm
    kind = np.float64 if reach < 2.0**52 else np.int64 if reach < 2.0**62 else object
    if kind is np.float64:
        mine, theirs = queries.flat, candidates.flat
    else:
        mine, theirs = queries.whole(kind), candidates.whole(kind)
    slack = 1e-6 + (reach * 1e-14 if kind is np.int64 else 0.0)
    # where numbers have no bound of size, nothing is left out before the whole score is known
    step = STEP if kind is not object else dims
    first = mine[:step].T @ theirs[:step]
    q_out, c_out, s_out = [], [], []
    for q in range(len(queries.ids)):
        alive = np.flatnonzero(candidates.ids != queries.ids[q])
        score = first[q][alive]
        for d in range(min(step, dims), dims, step):
            # rounding: the bound is raised by more than the error of the roots and sums
            bound = score + queries.rest[d, q] * candidates.rest[d, alive] * (1 + 1e-9) + slack
            stay = bound >= floor[q]
            if not stay.all():
                alive, score = alive[stay], score[stay]
            if not len(alive):
                break
            end = min(d + step, dims)
            score = score + mine[d:end, q] @ theirs[d:end, alive]
        if kind is object:
            score = np.array([min(max(s, _LOW), _HIGH) for s in score], np.int64)
        else:
            score = score.astype(np.int64)
        stay = score >= floor[q]
        alive, score = alive[stay], score[stay]
        if len(score) >= k:
            # all that reach the k-th best, ties included; of ties the smaller ids
            low = np.partition(score, len(score) - k)[len(score) - k]
            floor[q] = max(floor[q], low)
            stay = score >= low
            alive, score = alive[stay], score[stay]
            if len(alive) > k:
                order = np.lexsort((candidates.ids[alive], ~score))
                alive, score = alive[order[:k]], score[order[:k]]
        q_out.append(np.full(len(alive), q))
        c_out.append(alive)
        s_out.append(score)
    return np.concatenate(q_out), np.concatenate(c_out), np.concatenate(s_out)


def top_k(
    vectors: DataFrame, is_query: Column, *, k: int = 10, key: str = "vec_id", embedding: str = "embedding", scale: int = 1024, shards: int | None = None
) -> DataFrame:
    """Each query row's ``k`` highest integer inner products: query_id, rank (from 1), vec_id, score; ties to the smaller id.

    Components become floor(scale * x).  Queries are the rows where ``is_query`` holds; candidates are all rows but those of
    the query's own id.  Vectors that are null, empty or hold a null or non-finite component take no part, nor does a
    null id; vectors of another length than the query's are not compared with it.  Rows that repeat an id, with the
    same vector or another, are candidates and queries each of their own, so an id may fill several ranks.  Scores are
    exact; one beyond a long is the long's end and ties there.  An empty table gives an empty result.

    Query blocks meet candidate blocks in the cells of a grid of query groups and ``shards``.  A query block is sent to every
    shard, a candidate block to every group; by default both sides of a cell hold about CELL_BYTES.
    """
    sound = F.col(key).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    wide = F.transform(F.col(embedding), lambda x: x.cast("double"))
    clean = vectors.where(sound).select(F.col(key).cast("long").alias("_id"), wide.alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q"))
    sizes = clean.agg(F.sum(F.size("_v") * 8), F.sum(F.when(F.col("_q"), F.size("_v") * 8))).first()
    if shards is None:
        shards = max(24, -(-(sizes[0] or 0) // CELL_BYTES))
    groups = max(1, -(-(sizes[1] or 0) // CELL_BYTES))
    number = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    deal = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    candidates = pack_blocks(clean, "_id", "_v", CANDIDATES, scale)
    candidates = candidates.select("ids", "flat", "n", deal(shards).alias("shard"), F.explode(number(groups)).alias("group"))
    queries = pack_blocks(clean.where("_q"), "_id", "_v", QUERIES, scale)
    queries = queries.select("ids", "flat", "n", "block", deal(groups).alias("group"), F.explode(number(shards)).alias("shard"))
    out = pa.schema([("_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def cell(asked: pa.Table, held: pa.Table) -> pa.Table:
        blocks = [(r["block"], _Block(r["ids"], r["flat"], r["n"])) for r in asked.to_pylist()]
        floors = [np.full(len(q.ids), _LOW, np.int64) for _, q in blocks]
        parts = []
        for i in range(held.num_rows if blocks else 0):
            c = _Block(*(held.column(x)[i].as_py() for x in ("ids", "flat", "n")))
            for (block, q), floor in zip(blocks, floors, strict=True):
                if len(c.flat) == len(q.flat):
                    qi, ci, s = best(q, c, floor, k)
                    parts.append((block * QUERIES + qi, q.ids[qi], c.ids[ci], s))
        if not parts:
            return out.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(p)) for p in zip(*parts, strict=True)], schema=out)

    by = ["group", "shard"]
    found = queries.groupBy(*by).cogroup(candidates.groupBy(*by)).applyInArrow(cell, "_row long, query_id long, vec_id long, score long")
    order = W.partitionBy("_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
