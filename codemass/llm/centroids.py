"""Centroid clustering in whole numbers, with candidates filtered in a PCA-rotated space.

Vectors are stored once, in blocks: their whole components, the leading coordinates after rotation to the principal axes,
and the norm of what the other coordinates hold.  For a vector and a centroid the squared distance of the leading
coordinates plus the squared difference of the two residual norms is a lower bound of the squared distance.  A vector is
first measured against the centroid of least bound; only centroids whose bound does not exceed the best distance so far
are measured as well, in whole numbers.

A round is one pass over the stored blocks.  What leaves a task are sums for each cluster and component, so vectors
are never shuffled, and the driver sees the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codemass.llm.frames import checkpointed

ROWS = 4096
#: Components below this are measured in int64; blocks with greater ones in whole numbers of any size.
SMALL = 1 << 26
#: Sums leave a task as signed digits to this base, so that they are exact whatever the components' size.
BASE_BITS = 40
_HIGH = (1 << 63) - 1
_FULL = float(np.finfo(np.float64).max)
_BLOCK = "ids array<long>, flat binary, kind string, lead binary, rest binary"


class Rotation:
    """An orthonormal basis of principal axes, widest first, and the point that is rotated to zero."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, leading: int):
        self.mean, self.axes, self.leading = mean, axes, min(leading, len(mean))

    def project(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and residual norms of rows."""
        with np.errstate(all="ignore"):
            turned = (points - self.mean) @ self.axes
            return np.ascontiguousarray(turned[:, : self.leading]), np.sqrt((turned[:, self.leading :] ** 2).sum(1))


def fit_rotation(vectors: DataFrame, values: str, dims: int, leading: int) -> Rotation:
    """The principal axes of all vectors, from sums and products that are added up over tasks.

    The driver gets dims * (dims + 1) numbers.  Where they overflow, the axes are those of the components themselves.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, dims)
            x = np.concatenate([np.ones((len(x), 1)), x], 1)
            with np.errstate(all="ignore"):
                total += x.T @ x
        i, j = np.divmod(np.arange((dims + 1) ** 2), dims + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.reshape(-1))], names=["i", "j", "v"])

    parts = vectors.select(values).mapInArrow(moments, "i long, j long, v double")
    total = np.zeros((dims + 1, dims + 1))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]
    if not np.isfinite(total).all() or not total[0, 0]:
        return Rotation(np.zeros(dims), np.eye(dims), leading)
    mean = total[0, 1:] / total[0, 0]
    spread = total[1:, 1:] / total[0, 0] - np.outer(mean, mean)
    if not np.isfinite(spread).all():
        return Rotation(np.zeros(dims), np.eye(dims), leading)
    return Rotation(mean, np.ascontiguousarray(np.linalg.eigh(spread)[1][:, ::-1]), leading)


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); what a double cannot hold once scaled is the end of its range."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(np.asarray(x, np.float64) * scale), -_FULL, _FULL)


def pack(vectors: DataFrame, key: str, values: str, dims: int, rotation: Rotation) -> DataFrame:
    """Blocks of at most ROWS vectors: ids, flat (whole components in the narrowest kind), lead, rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, dims)
            keys = batch.column(0)
            size = np.abs(x).max(1) if len(x) else np.zeros(0)
            for fits, kinds in ((size < SMALL, ("i2", "i4")), (size >= SMALL, ("f8",))):
                rows = np.flatnonzero(fits)
                for at in range(0, len(rows), ROWS):
                    part = rows[at : at + ROWS]
                    block = x[part]
                    kind = kinds[0] if len(kinds) == 1 or np.abs(block).max() < 1 << 15 else kinds[1]
                    lead, rest = rotation.project(block)
                    ids = pa.array([keys.take(pa.array(part)).to_pylist()], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([block.astype(kind).tobytes()]), pa.array([kind]), pa.array([lead.tobytes()]), pa.array([rest.tobytes()])],
                        names=["ids", "flat", "kind", "lead", "rest"],
                    )

    return vectors.select(key, values).mapInArrow(run, _BLOCK)


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centres: list[list[int]], rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (the smaller number of equal ones), its squared distance, and how many pairs were measured.

    ``x`` holds the rows' whole components: int64, or Python's whole numbers (dtype object) where they are large.
    """
    big = x.dtype == object or any(abs(v) >= SMALL for c in centres for v in c)
    x = x.astype(object) if big else x
    c = np.array(centres, object if big else np.int64)
    c_lead, c_rest = rotation.project(c.astype(np.float64))
    with np.errstate(all="ignore"):
        mine, theirs = (lead**2).sum(1)[:, None], (c_lead**2).sum(1)[None, :]
        # rounding: the bound is lowered by more than the error of its sums
        slack = 1e-9 * (mine + rest[:, None] ** 2 + theirs + c_rest[None, :] ** 2) + 1e-6
        bound = mine - 2 * (lead @ c_lead.T) + theirs + (rest[:, None] - c_rest[None, :]) ** 2 - slack
    # a bound that overflows excludes nothing
    bound = np.where(np.isfinite(bound), bound, -np.inf)
    chosen = bound.argmin(1)
    best = ((x - c[chosen]) ** 2).sum(1)
    limit = np.array([float(b) for b in best]) if big else best.astype(np.float64)
    measured = len(x)
    first = chosen.copy()
    for k in range(len(c)):
        rows = np.flatnonzero((bound[:, k] <= limit) & (first != k))
        if not len(rows):
            continue
        measured += len(rows)
        d = ((x[rows] - c[k]) ** 2).sum(1)
        better = (d < best[rows]) | ((d == best[rows]) & (k < chosen[rows]))
        rows, d = rows[better], d[better]
        best[rows], chosen[rows] = d, k
        limit[rows] = [float(v) for v in d] if big else d
    return chosen, best, measured


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, leading: int) -> Iterator[tuple]:
    for batch in batches:
        for r in batch.to_pylist():
            x = np.frombuffer(r["flat"], r["kind"]).reshape(-1, dims)
            # doubles that hold whole numbers become whole numbers
            x = np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) if r["kind"] == "f8" else x.astype(np.int64)
            yield r["ids"], x, np.frombuffer(r["lead"]).reshape(len(x), leading), np.frombuffer(r["rest"])


def _digits(total: int) -> list[int]:
    """Signed digits of a sum, least first."""
    sign, total, out = (-1 if total < 0 else 1), abs(total), []
    while total:
        out.append(sign * (total & ((1 << BASE_BITS) - 1)))
        total >>= BASE_BITS
    return out


def _moved(store: DataFrame, centres: list[list[int]], rotation: Rotation) -> list[list[int]]:
    """The centroids after one round: exact floors of the components' means, empty clusters as before."""
    dims = len(centres[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for _, x, lead, rest in _blocks(batches, dims, rotation.leading):
            chosen, _, _ = nearest(x, lead, rest, centres, rotation)
            for k in np.unique(chosen):
                rows = x[chosen == k]
                added = [len(rows), *map(int, rows.sum(0))]
                held[int(k)] = [a + b for a, b in zip(held[int(k)], added, strict=True)] if int(k) in held else added
        out = [(k, i, place, digit) for k, totals in held.items() for i, t in enumerate(totals) for place, digit in enumerate(_digits(t))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["k", "i", "place", "v"])

    total = [[0] * (dims + 1) for _ in centres]
    for r in store.mapInArrow(sums, "k long, i long, place long, v long").groupBy("k", "i", "place").agg(F.sum("v").alias("v")).collect():
        total[r["k"]][r["i"]] += r["v"] << (BASE_BITS * r["place"])
    return [[s // t[0] for s in t[1:]] if t[0] else old for t, old in zip(total, centres, strict=True)]


def cluster(
    vectors: DataFrame, *, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", leading: int = 16,
    key: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """Each vector's cluster after ``rounds`` of Lloyd's algorithm in whole numbers:
    vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Components become floor(scale * x).  Vectors that are null, of another length than ``dims`` or that hold a null or
    non-finite component take no part.  The first centroids are the ``k`` vectors of smallest sha256 of ``seed:id``, those of
    equal ids by their components; fewer vectors make fewer centroids.  A vector without id is clustered like others, but is
    the first centroid of a cluster only where ids are too few.  Rows that repeat an id are vectors each of their own.
    Equal distances go to the smaller number; an empty cluster keeps its centroid.  Distances and their sums are exact;
    beyond a long they are its end.  An empty table gives no rows, and other columns of ``vectors`` do not matter.
    """
    sound = F.col(embedding).isNotNull() & (F.size(embedding) == dims) & F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    spark = vectors.sparkSession
    clean = vectors.where(sound).select(F.col(key).cast("long").alias("_id"), F.transform(embedding, lambda x: x.cast("double")).alias("_v"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.array(_whole(batch.column(1).flatten(), scale))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["_id", "_v"])

    clean = clean.mapInArrow(floors, "_id long, _v array<double>")
    rotation = fit_rotation(clean, "_v", dims, leading)
    store = checkpointed(pack(clean, "_id", "_v", dims, rotation))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    centres = [[int(x) for x in r["_v"]] for r in clean.orderBy(name.asc_nulls_last(), "_v").limit(k).select("_v").collect()]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centres:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centres = _moved(store, centres, rotation)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, lead, rest in _blocks(batches, dims, rotation.leading):
            chosen, best, _ = nearest(x, lead, rest, centres, rotation)
            best = [min(int(b), _HIGH) for b in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(chosen, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"]
            )

    placed = checkpointed(store.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    whole = min(sum(sums.values()), _HIGH)
    # one row for each of the k clusters
    told = spark.createDataFrame(
        [(n, min(s, _HIGH), whole, digest(centres[n])) for n, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
