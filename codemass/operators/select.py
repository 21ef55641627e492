"""Picking one row by a name that a user typed, in tiers; more than one fit is an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOWN = 8
DATA_KINDS = ("type", "class", "interface", "struct", "enum")


class SelectionError(ValueError):
    """No row, or more than one, fits a selector."""


def _tiers(tiers: list[Column]) -> Column:
    out = F.lit(None).cast("int")
    for k, test in reversed(list(enumerate(tiers))):
        out = F.when(test, k).otherwise(out)
    return out


def pick(rows: DataFrame, selector: str | None, tiers: list[tuple[str, Column]], shown: str, *, loose_first: bool = True) -> DataFrame:
    """The one row of ``rows`` in the first tier that any row fits; without a selector the only row.

    ``loose_first``: several rows in the first tier (ids) fall through to the next, as ids are unique if sound.
    At most nine rows reach the driver, to name the choices.
    """
    if selector is None:
        names = [r[0] for r in rows.select(shown).limit(SHOWN + 1).collect()]
        if len(names) == 1:
            return rows
        raise SelectionError("nothing to select from" if not names else f"choose one of: {_listed(names)}")
    ranked = rows.withColumn("_tier", _tiers([t for _, t in tiers])).where("_tier is not null")
    counts = {r["_tier"]: r["n"] for r in ranked.groupBy("_tier").agg(F.count("*").alias("n")).collect()}
    for k, (what, test) in enumerate(tiers):
        # a row counts for every tier that it fits, not only its best
        fits = rows.where(test)
        n = counts.get(k, 0) if k == 0 else fits.count()
        if n == 1:
            return fits
        if n > 1 and not (k == 0 and loose_first):
            names = [r[0] for r in fits.select(shown).orderBy(shown).limit(SHOWN + 1).collect()]
            raise SelectionError(f"{selector!r} is ambiguous by {what}: {_listed(names)}")
    raise SelectionError(f"nothing matches {selector!r}")


def _listed(names: list[str]) -> str:
    return ", ".join(map(str, names[:SHOWN])) + (" ..." if len(names) > SHOWN else "")


def capability(capabilities: DataFrame, selector: str | None) -> DataFrame:
    """The anchored capability of an id, a whole name, or a part of either, in any letter case."""
    anchored = capabilities.where("symbol_id is not null")
    key = F.concat_ws(":", "kind", "path", "line", "name")
    rows = anchored.withColumn("id", key) if "id" not in anchored.columns else anchored
    needle = F.lower(F.lit(selector or ""))
    tiers = [("id", F.lower("id") == needle), ("name", F.lower("name") == needle),
        ("part", F.contains(F.lower("name"), needle) | F.contains(F.lower("id"), needle))]
    return pick(rows, selector, tiers, "name")


def data_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols that describe data, by qualified name in any letter case, then by place."""
    return symbols.where(F.col("kind").isin(*DATA_KINDS)).orderBy(F.lower("qualified_name"), "path", "start_line", "id")


def data_symbol(symbols: DataFrame, selector: str | None) -> DataFrame:
    """The data symbol of an id, a qualified name, a name, or a part of the qualified name, in any letter case."""
    needle = F.lower(F.lit(selector or ""))
    tiers = [("id", F.lower("id") == needle), ("qualified name", F.lower("qualified_name") == needle), ("name", F.lower("name") == needle),
        ("part", F.contains(F.lower("qualified_name"), needle))]
    return pick(symbols.where(F.col("kind").isin(*DATA_KINDS)), selector, tiers, "qualified_name")
