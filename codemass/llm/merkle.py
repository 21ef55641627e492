"""A Merkle manifest of a dataset by slot pivots, in DataFrame functions only.

Leaves are numbered within their group by one sort over ranges.  At each level conditional aggregates spread the children
of a parent into ``fanout`` columns, one for each slot; the columns' concatenation is hashed for the parent, and the same
concatenation without a slot's own column is that child's siblings.  Runs go up a level at a time until a group has one
node, its subroot; the subroots of all groups are the leaves of one more tree.  Going down again, a run hands its
children the siblings of all levels above, so a leaf is joined with its run alone and never with each level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codemass.llm.frames import checkpointed
from codemass.llm.ranks import numbered

FANOUT = 8
_GROUP = ["_has", "_group"]


def field(value: Column) -> Column:
    """A value as it goes into a leaf: '-' if null, else its byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's values in the given order."""
    return F.sha2(F.concat(*map(field, values)), 256)


def siblings(path: Column) -> Column:
    """All siblings of a path of (left, right), level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and the siblings on its path give."""
    return F.aggregate(path, digest, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def _levels(n: int, fanout: int) -> int:
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


def _climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The runs of each level, and the groups whose only node is reached at each level (0: leaves).

    ``nodes``: the group, _pos, _n, _hash and _row (what a leaf carries).  Each level is written once and is ``fanout``
    times smaller than the one below.
    """
    runs, tops, row = [], [nodes.where("_n = 1")], nodes.schema["_row"].dataType
    for _ in range(_levels(nodes.agg(F.max("_n")).first()[0] or 0, fanout)):
        slot = F.pmod("_pos", F.lit(fanout))
        in_slot = lambda c, i: F.first(F.when(slot == i, F.col(c)), ignorenulls=True)  # noqa: B023, E731
        wide = [in_slot("_hash", i).alias(f"_h{i}") for i in range(fanout)]
        wide += [in_slot("_row", i).alias(f"_r{i}") for i in range(fanout)] if not runs else []
        parent = F.floor(F.col("_pos") / fanout).cast("long")
        run = nodes.where("_n > 1").groupBy(*_GROUP, parent.alias("_parent")).agg(F.max("_n").alias("_n"), *wide)
        runs.append(checkpointed(run))
        digest = F.sha2(F.concat(*[F.coalesce(f"_h{i}", F.lit("")) for i in range(fanout)]), 256)
        nodes = runs[-1].select(*_GROUP, F.col("_parent").alias("_pos"), F.ceil(F.col("_n") / fanout).cast("long").alias("_n"),
            digest.alias("_hash"), F.lit(None).cast(row).alias("_row"))
        tops.append(nodes.where("_n = 1"))
    return runs, tops


def _descend(runs: list[DataFrame], roots: list[DataFrame], fanout: int, keep: list[str]) -> DataFrame:
    """(group, _pos, _row, _hash, _path, keep...) of the leaves: _path has (left, right) of each level, lowest first.

    ``roots``: for each level the groups that end there, with the path above them and the columns ``keep``.
    """
    columns = [*_GROUP, "_pos", "_hash", "_row", "_path", *keep]
    nodes = roots[-1].select(*columns)
    for level in range(len(runs) - 1, -1, -1):
        h = [F.coalesce(f"_h{i}", F.lit("")) for i in range(fanout)]
        side = lambda some: F.concat(F.lit(""), *some)
        slots = [
            F.struct(F.lit(i).alias("slot"), F.col(f"_h{i}").alias("hash"), side(h[:i]).alias("left"), side(h[i + 1 :]).alias("right"),
                *([F.col(f"_r{i}").alias("row")] if not level else []))
            for i in range(fanout)
        ]
        above = nodes.select(*_GROUP, F.col("_pos").alias("_parent"), "_path", *keep)
        row = F.col("_slot.row") if not level else F.lit(None).cast(roots[level].schema["_row"].dataType)
        found = runs[level].join(above, [*_GROUP, "_parent"]).withColumn("_slot", F.explode(F.array(*slots))).where("_slot.hash is not null")
        own = F.array(F.struct("_slot.left", "_slot.right"))
        nodes = found.select(*_GROUP, (F.col("_parent") * fanout + F.col("_slot.slot")).alias("_pos"), F.col("_slot.hash").alias("_hash"),
            row.alias("_row"), F.concat(own, "_path").alias("_path"), *keep).unionByName(roots[level].select(*columns))
    return nodes


def proofs(leaves: DataFrame, *, key: str = "doc_id", group: str = "lang", digest: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """``leaves`` with subroot, root and path: for each level (lowest first, through the subroot to the root) the digests left
    and right of the leaf's own branch, concatenated.  ``siblings`` and ``fold`` read a path.

    Leaves ascend by ``key`` (null first), then by digest, within ``group``; groups ascend bytewise, null first.  Every
    ``fanout`` consecutive nodes make one, the last of a level also of fewer; a group of one leaf has that leaf as its
    subroot.  Rows that repeat a key are leaves each of their own; equal rows differ in place only.  A leaf without
    siblings has an empty path, an empty table gives no rows.  Columns named subroot, root or path are replaced.
    """
    rows = leaves.drop("subroot", "root", "path")
    start = rows.select(F.col(group).isNotNull().alias("_has"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_group"),
        F.col(key).alias("_key"), F.col(digest).alias("_hash"), F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("_row"))
    # written before it is sorted: looking for ranges would read and hash all rows once more
    start = checkpointed(start)
    runs, tops = _climb(numbered(start, _GROUP, [F.col("_key").asc_nulls_first(), "_hash"]).drop("_key"), fanout)
    ends = tops[0].select(*_GROUP, "_hash")
    for t in tops[1:]:
        ends = ends.unionByName(t.select(*_GROUP, "_hash"))
    # the tree of subroots: one group, whose leaves carry the group that they stand for
    ends = ends.select(F.lit(True).alias("_has"), F.lit("").alias("_group"), F.struct(*_GROUP).alias("_row"), "_hash")
    high, top = _climb(numbered(ends, _GROUP, ["_row"]), fanout)
    none = F.array().cast("array<struct<left:string,right:string>>")
    at_root = [t.withColumns({"_path": none, "root": F.col("_hash")}) for t in top]
    groups = _descend(high, at_root, fanout, ["root"])
    groups = checkpointed(groups.select(F.col("_row._has").alias("_has"), F.col("_row._group").alias("_group"), "_path", "root",
            F.col("_hash").alias("subroot")))
    found = _descend(runs, [t.join(groups, _GROUP) for t in tops], fanout, ["subroot", "root"])
    return found.select("_row.*", "subroot", "root", F.col("_path").alias("path"))
