"""Many breadth-first searches at once: 64 of them share a word, a bit each, and a node has a row for each word that has met it.

A level joins the words of the frontier with the edges once and merges them by ``bit_or``, so it shuffles at most nodes x words
rows however many searches meet at a node.  Names of searches come back when the result is read.

Where only numbers of nodes are asked for (``reached``), nodes that reach each other are one node of their count first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codemass.functions.checkpoint import checkpointed
from codemass.functions.spread import apart

SNAP = "snapshot_id"
_KEY = [SNAP, "node", "_word"]
_SEARCH = [SNAP, "_word", "_bit"]
_MERGED = "bit_or(shiftleft(1L, _bit))"


def _numbered(roots: DataFrame) -> DataFrame:
    """(snapshot_id, search, _word, _bit): the searches in the order of their names, 64 a word."""
    names = roots.select(SNAP, "search").distinct().orderBy(SNAP, "search").withColumn("_id", F.monotonically_increasing_id())
    return checkpointed(names.select(SNAP, "search", F.shiftright("_id", 6).alias("_word"), F.expr("cast(_id & 63 as int)").alias("_bit")))


def _each(words: DataFrame) -> DataFrame:
    """A row with _bit for every bit that is set in ``_bits``."""
    return words.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(63)))).where("(shiftright(_bits, _bit) & 1L) = 1L").drop("_bits")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on cycles: those that reach each other share a component, the greatest of them.

    ``edges``: src, dst, numbers.  Ends that lead nowhere or come from nowhere are cut off first.  Then the greatest number that reaches a
    node is its colour, and what leads back to a colour's own node within the colour is its component; edges between
    colours are on no cycle.  The rest goes round again.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e, found = edges.where("src <> dst").select("src", "dst").distinct(), None
    while True:
        e, size = checkpointed(e.repartition(parts, "src")), None
        while (n := e.count()) != size and n:
            size = n
            e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            e = checkpointed(e.repartition(parts, "src"))
        if not n:
            return spark.createDataFrame([], "node bigint, component bigint") if found is None else found
        colour = front = checkpointed(e.select(F.col("src").alias("node"), F.col("src").alias("c")).distinct().repartition(parts, "node"))
        while not front.isEmpty():
            step = front.withColumnRenamed("node", "src").join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("_c"))
            both = checkpointed(colour.join(step, "node", "left").select("node", F.greatest("c", "_c").alias("c"), F.coalesce(F.col("_c") > F.col("c"), F.lit(False)).alias("_new")))
            colour, front = both.drop("_new"), both.where("_new").drop("_new")
        of = lambda end: colour.select(F.col("node").alias(end), F.col("c").alias(f"_{end}"))
        back = checkpointed(e.join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select("src", "dst", F.col("_src").alias("c")).repartition(parts, "dst"))
        front = checkpointed(colour.where("node = c"))
        met = front
        while not front.isEmpty():
            step = back.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "c").distinct()
            front = checkpointed(step.join(met, "node", "left_anti"))
            met = met.union(front)
        one = met.select("node", F.col("c").alias("component"))
        found = one if found is None else found.union(one)
        e = back.join(met.select(F.col("node").alias("src")), "src", "left_anti").join(met.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(snapshot_id, search, reached): how many nodes each search meets, as ``searches`` without bounds counts them.

    Nodes that reach each other reach the same, so searches run over components, one for all that begin in the same one.  What still
    grows with the square is searches in different components times components.
    """
    roots = roots.select(SNAP, "search", "node").where("search is not null and node is not null")
    e = edges.select(SNAP, "src", "dst").where("src <> dst")
    ends = e.select(SNAP, F.col("src").alias("node")).union(e.select(SNAP, F.col("dst").alias("node"))).union(roots.select(SNAP, "node"))
    codes = checkpointed(ends.distinct().withColumn("_id", F.monotonically_increasing_id()))
    coded = lambda df, name: df.join(codes.select(SNAP, F.col("node").alias(name), F.col("_id").alias(f"_{name}")), [SNAP, name]).drop(name)
    e = checkpointed(coded(coded(e, "src"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct())
    group = components(e)
    placed = checkpointed(codes.select(SNAP, "node", F.col("_id").alias("_own")).join(group.select(F.col("node").alias("_own"), "component"), "_own", "left")
        .select(SNAP, "node", "_own", F.coalesce("component", "_own").alias("_at")))
    to = lambda end: placed.select(F.col("_own").alias(end), F.col("_at").alias(f"_{end}"))
    between = e.join(to("src"), "src").join(to("dst"), "dst").where("_src <> _dst").select(F.lit(0).alias(SNAP), F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    begins = roots.join(placed.select(SNAP, "node", "_at"), [SNAP, "node"]).groupBy(SNAP, "search").agg(F.collect_set("_at").alias("_ats"))
    # searches that begin in one and the same component share its search
    alike = F.when(F.size("_ats") == 1, F.concat(F.lit("c"), F.col("_ats")[0].cast("string"))).otherwise(F.concat_ws("\x00", F.lit("s"), SNAP, "search"))
    begins = checkpointed(begins.withColumn("_like", alike))
    first = begins.select(F.lit(0).alias(SNAP), F.col("_like").alias("search"), F.explode("_ats").alias("node")).distinct()
    levels, _, names = _search(between, first, None, None)
    sizes = placed.groupBy(F.col("_at").alias("node")).agg(F.count("*").alias("_n"))
    met = _each(_union(levels).join(sizes, "node")).groupBy(*_SEARCH).agg(F.sum("_n").alias("reached"))
    return begins.join(met.join(names, _SEARCH).select(F.col("search").alias("_like"), "reached"), "_like").select(SNAP, "search", "reached")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.union(more)
    return out


def searches(edges: DataFrame, roots: DataFrame, *, max_depth: int | None = None, quota: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(snapshot_id, search, node, hops) of all that each search reaches forward, and (snapshot_id, search, reached).

    ``edges``: snapshot_id, src, dst.  ``roots``: snapshot_id, search, node; a search may start at several nodes, which have 0 hops.
    A search that has met more than ``quota`` nodes goes no level further; what it has met is returned with its last level whole,
    and ``reached`` counts it.  Rows of null search or node are no roots; nodes without edges are met and lead nowhere; repeated
    edges and roots count once.
    """
    levels, counts, names = _search(edges, roots.select(SNAP, "search", "node").where("search is not null and node is not null"), max_depth, quota)
    total = _union(counts).groupBy(*_SEARCH).agg(F.sum("_n").alias("reached"))
    return (_each(_union(levels)).join(names, _SEARCH).select(SNAP, "search", "node", "hops"), total.join(names, _SEARCH).select(SNAP, "search", "reached"))


def _search(edges: DataFrame, roots: DataFrame, max_depth: int | None, quota: int | None) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Words of each level (snapshot_id, node, _word, _bits, hops), numbers of nodes by search, and the searches' names."""
    names = _numbered(roots)
    e = apart(checkpointed(edges.where("src <> dst").select(SNAP, F.col("src").alias("node"), "dst").distinct()))
    first = roots.join(names, [SNAP, "search"]).groupBy(*_KEY).agg(F.expr(_MERGED).alias("_bits"))
    front = checkpointed(first)
    state, levels, counts, depth = front.withColumnRenamed("_bits", "_seen"), [front.withColumn("hops", F.lit(0))], [], 0
    while True:
        counts.append(_each(front).groupBy(*_SEARCH).agg(F.count("*").alias("_n")))
        if quota is not None:
            # one row a search; the counts of earlier levels are written already
            total = checkpointed(counts[-1] if len(counts) == 1 else counts[0].union(counts[1]).groupBy(*_SEARCH).agg(F.sum("_n").alias("_n")))
            counts = [total]
            front = _open(front, total.where(F.col("_n") > quota))
        if max_depth is not None and depth >= max_depth or front.isEmpty():
            break
        depth += 1
        step = front.join(e, [SNAP, "node"]).groupBy(SNAP, F.col("dst").alias("node"), "_word").agg(F.bit_or("_bits").alias("_new"))
        seen, new = F.coalesce("_seen", F.lit(0)), F.coalesce("_new", F.lit(0))
        both = checkpointed(apart(state).join(step, _KEY, "full").select(*_KEY, seen.bitwiseOR(new).alias("_seen"), new.bitwiseAND(F.bitwise_not(seen)).alias("_bits")))
        state, front = both.drop("_bits"), both.where("_bits <> 0").drop("_seen")
        levels.append(front.withColumn("hops", F.lit(depth)))
    return levels, counts, names


def _open(front: DataFrame, closed: DataFrame) -> DataFrame:
    """``front`` without the bits of closed searches."""
    masks = closed.groupBy(SNAP, "_word").agg(F.expr(_MERGED).alias("_mask"))
    if masks.isEmpty():
        return front
    left = F.col("_bits").bitwiseAND(F.bitwise_not(F.coalesce("_mask", F.lit(0))))
    return front.join(masks, [SNAP, "_word"], "left").select(*_KEY, left.alias("_bits")).where("_bits <> 0")
