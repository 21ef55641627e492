"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

The sources' targets lie side by side on an axis of words.  Slot j of the mix goes to the source in whose target the j-th
van der Corput point falls, so every stretch of the mix holds each source close to its share.  A source's documents are
shuffled by a hash and its target is cut into as many blocks, equal to a word, as it has slots; the r-th slot of a
source takes the r-th block.  A target above the source's size goes round the shuffled documents again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codemass.llm.frames import checkpointed
from codemass.llm.ranks import numbered, running

WEIGHTS, TOTAL, MOST, BLOCK_WORDS, SEED = (5, 2, 1), 1.5, 2, 1024, 13
WORD = r"[^\x20\x09-\x0D]+"
_SOURCE = ["_null", "_name"]
#: Bits of a van der Corput point: more slots than that would share points.
_BITS = 48


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """Sources (_null, _name, source_size) with _pos and target.

    Weights repeat over the sources in order.  Targets share ``total`` times all sizes by weight and stop at ``most`` times
    the source's size; what is above goes to the others by weight until none is above.  Each step is one small sum.
    """
    placed = numbered(sources.withColumn("_all", F.lit(True)), ["_all"], _SOURCE).drop("_n")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = checkpointed(placed.withColumn("_weight", F.element_at(cycle, (F.col("_pos") % len(weights)).cast("int") + 1)))
    cap = (F.col("source_size") * most).cast("double")
    share = total * float(placed.agg(F.sum("source_size")).first()[0] or 0)
    level, full_before = 0.0, -1
    while True:
        full = cap < F.col("_weight") * level
        held, free, n = placed.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("_weight"))), F.count_if(full)).first()
        if n == full_before or not free:
            break
        level, full_before = (share - (held or 0.0)) / free, n
    return placed.withColumn("target", F.least(cap, F.col("_weight") * level)).drop("_weight")


def _point(j: Column) -> Column:
    """The j-th van der Corput point to the base 2, as a whole number of _BITS bits."""
    return F.conv(F.reverse(F.lpad(F.bin(j), _BITS, "0")), 2, 10).cast("long")


def _pieces(df: DataFrame) -> int:
    """Into how many pieces groups are cut: some for each task."""
    return 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def schedule(sources: DataFrame, block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(slots, sources): slots have the source, _rank (from 0 within it) and slot; sources get _words and _blocks.

    A source with a target that no point falls on gets one slot after all others.
    """
    words = F.round("target").cast("long")
    axis = running(sources.withColumns({"_words": words, "_all": F.lit(True), "_part": F.floor(F.col("_pos") / 4096)}), ["_all"], "_part", ["_pos"], "_words")
    axis = checkpointed(axis.select(*_SOURCE, "source_size", "target", "_pos", "_words", F.col("_before").alias("_low")))
    whole, many = axis.agg(F.sum("_words"), F.count("*")).first()
    whole = whole or 0
    n = -(-whole // block)
    spark, tasks = sources.sparkSession, _pieces(sources)
    # points meet the sources of their stretch of the axis; as many stretches as sources bound the pairs by twice the points
    width = max(1, -(-whole // max(tasks, n // 4096, many)))
    at = F.least(F.lit(max(whole - 1, 0)), F.floor(_point(F.col("id")) * F.lit(whole / 2.0**_BITS)).cast("long"))
    points = spark.range(0, n, 1, max(1, tasks // 16)).select(F.col("id").alias("slot"), at.alias("_at")).withColumn("_stretch", F.expr(f"_at div {width}"))
    held = axis.where("_words > 0").select(*_SOURCE, "_low", (F.col("_low") + F.col("_words")).alias("_high"),
        F.explode(F.sequence(F.expr(f"_low div {width}"), F.expr(f"(_low + _words - 1) div {width}"))).alias("_stretch"))
    found = points.join(held, "_stretch").where("_at >= _low and _at < _high").select(*_SOURCE, "slot")
    found = checkpointed(found.withColumn("_part", F.floor(F.col("slot") * tasks / max(n, 1)).cast("long")))
    counts = found.groupBy(*_SOURCE).agg(F.count("*").alias("_blocks"))
    axis = axis.join(counts, _SOURCE, "left")
    missed = axis.where("_blocks is null and _words > 0").select(*_SOURCE, F.lit(0).cast("long").alias("_rank"), (F.col("_pos") + n).alias("slot"))
    ranked = running(found.withColumn("_one", F.lit(1).cast("long")), _SOURCE, "_part", ["slot"], "_one")
    slots = ranked.select(*_SOURCE, F.col("_before").alias("_rank"), "slot").unionByName(missed)
    return slots, axis.withColumn("_blocks", F.coalesce("_blocks", (F.col("_words") > 0).cast("long"))).drop("_pos", "_low")


def _low(rank: Column) -> Column:
    """The first word of a source's block; the first blocks have the odd words."""
    return rank * F.expr("_words div _blocks") + F.least(rank, F.expr("_words % _blocks"))


def _block_of(word: Column) -> Column:
    size, odd = F.expr("_words div _blocks"), F.expr("_words % _blocks")
    cut = odd * (size + 1)
    return F.when(word < cut, F.floor(word / (size + 1))).otherwise(odd + F.floor((word - cut) / size)).cast("long")


def _placed(docs: DataFrame, key: str, source: str, text: str, weights: tuple[int, ...], total: float, most: int, block: int,
        seed: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's shuffled words, and the slots of the mix."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.col(key).cast("string"), F.lit("-"))
    rows = docs.select(F.col(key).alias("_key"), F.col(source).isNull().alias("_null"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_name"),
        size.alias("_size"), F.sha2(F.concat(F.lit(f"{seed}:"), name), 256).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    rows = checkpointed(rows)
    sources = rows.groupBy(*_SOURCE).agg(F.sum("_size").alias("source_size"))
    slots, sources = schedule(with_targets(sources, weights, total, most), block)
    part = F.floor(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") * _pieces(docs) / 2.0**32).cast("long")
    order = ["_hash", "_size", "_key", "_row"]
    return checkpointed(running(rows.withColumn("_part", part), _SOURCE, "_part", order, "_size", sources).drop("_part", "_hash")), slots


def _cut(placed: DataFrame, slots: DataFrame, most: int) -> DataFrame:
    """``placed`` once for each part that a block takes: slot, copy (0 for the first time round), start, length."""
    rounds = placed.where("_size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    rounds = rounds.withColumn("_from", F.col("_before") + F.col("copy") * F.col("source_size"))
    rounds = rounds.withColumn("_to", F.least(F.col("_from") + F.col("_size"), F.col("_words"))).where("_to > _from")
    parts = rounds.withColumn("_rank", F.explode(F.sequence(_block_of(F.col("_from")), _block_of(F.col("_to") - 1))))
    parts = parts.join(slots, [*_SOURCE, "_rank"])
    begin, end = F.greatest("_from", _low(F.col("_rank"))), F.least("_to", _low(F.col("_rank") + 1))
    return parts.withColumns({"start": begin - F.col("_from"), "length": end - begin})


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL,
        most: int = MOST, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix, a row for each part of a document: slot, source, key, copy, start and length (in words of the document).

    A document's size is its number of words; null, empty and blank texts have none and are in no part.  A null source is a
    source of its own, after all others.  Rows that repeat a key are documents each of their own, a null key is one like
    others.  Targets and blocks are as this module says: a source's parts add up to its target, rounded to a word, and no
    document is taken more than ``most`` times.  Reruns give the same mix.  An empty table gives no rows; other columns
    of ``docs`` do not matter.
    """
    placed, slots = _placed(docs, key, source, text, weights, total, most, block, seed)
    name = F.when(~F.col("_null"), F.col("_name"))
    return _cut(placed, slots, most).select("slot", name.alias("source"), F.col("_key").alias(key), "copy", "start", "length")


def taken(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL,
        most: int = MOST, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """What the mix takes of each row of ``docs``: key, size, source_size, target (the source's), taken (words, repeats counted).

    Defined for nulls, repeats and empties as ``mix`` is; rows that the mix leaves out have taken 0.
    """
    placed, slots = _placed(docs, key, source, text, weights, total, most, block, seed)
    row = ["_row", "_key", "_size", "source_size", "target"]
    parts = _cut(placed, slots, most).select(*row, "length").unionByName(placed.select(*row, F.lit(0).cast("long").alias("length")))
    sums = parts.groupBy(*row).agg(F.sum("length").alias("taken"))
    return sums.select(F.col("_key").alias(key), F.col("_size").alias("size"), "source_size", "target", "taken")
