"""What a data type's journey is told with: its boundaries, its events with both ends and their trust, and the calls that were looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codemass.operators.surfaces import SNAP, members
from codemass.schema import JOURNEY_ROLES

# How far an event is to be trusted, and what its evidence says.
TO_TYPE, TO_MEMBER = "exact-call-to-data-type", "exact-call-to-lifecycle-member; role-from-member-name"
BOUNDARY = "exact member containment; lifecycle verb '%s'"
TYPE_EVIDENCE = "%s; exact call resolves to selected %s"
MEMBER_EVIDENCE = "%s; exact call resolves to contained member '%s'; role derived from member name '%s'"
_PLACE = {"path": "path", "start_line": "line", "qualified_name": "name"}


def _stage(role: str = "role"):
    return F.array_position(F.array(*map(F.lit, JOURNEY_ROLES)), F.col(role))


def boundaries(types: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(snapshot_id, type_id, role, id, path, line, name, evidence, called): the members of each type that have a role, in the order of
    stages and places; ``called`` is whether an exact call reaches the member.

    A type without such members has no row.  ``types``: snapshot_id, type_id.
    """
    own = symbols.select(SNAP, "id", *[F.col(k).alias(v) for k, v in _PLACE.items()], F.col("name").alias("_verb"))
    ends = members(symbols, edges).where("role is not null").join(types, [SNAP, "type_id"]).select(SNAP, "type_id", "role", "id")
    known = symbols.select(SNAP, F.col("id").alias("source_id"))
    calls = edges.where("kind = 'calls' and resolution = 'exact'").join(known, [SNAP, "source_id"], "left_semi")
    called = calls.select(SNAP, F.col("target_id").alias("id")).distinct().withColumn("called", F.lit(True))
    rows = ends.join(own, [SNAP, "id"]).join(called, [SNAP, "id"], "left").fillna(False, ["called"])
    told = rows.select(SNAP, "type_id", "role", "id", "path", "line", "name", F.format_string(BOUNDARY, "_verb").alias("evidence"), "called")
    return told.orderBy(SNAP, "type_id", _stage(), "path", "line", "name", "id")


def events(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """The rows of ``surfaces.journeys`` with path, line and name of both ends, trust and a whole evidence, in the order of stages,
    sources and targets; calls from or to unknown symbols go.
    """
    ends = symbols.select(SNAP, "id", F.struct(*[F.col(k).alias(v) for k, v in _PLACE.items()], "kind", F.col("name").alias("short")).alias("_end"))
    both = found.join(ends.select(SNAP, F.col("id").alias("source_id"), F.col("_end").alias("source")), [SNAP, "source_id"]).join(
        ends.select(SNAP, F.col("id").alias("target_id"), F.col("_end").alias("target")), [SNAP, "target_id"])
    itself = F.col("target_id") == F.col("type_id")
    before = F.coalesce("evidence", F.lit(""))
    evidence = F.when(itself, F.format_string(TYPE_EVIDENCE, before, F.col("target.kind"))).otherwise(
        F.format_string(MEMBER_EVIDENCE, before, F.col("target.name"), F.col("target.short")))
    ends = [F.col(f"{side}.{part}").alias(f"{side}_{part}") for side in ("source", "target") for part in _PLACE.values()]
    told = both.select(SNAP, "type_id", "role", "source_id", "target_id", *ends, F.lit("calls").alias("relationship"),
        F.when(itself, TO_TYPE).otherwise(TO_MEMBER).alias("trust"), evidence.alias("evidence"))
    places = [f"{side}_{part}" for side in ("source", "target") for part in _PLACE.values()]
    return told.orderBy(SNAP, "type_id", _stage(), *places, "source_id", "target_id")


def examined(types: DataFrame, edges: DataFrame) -> DataFrame:
    """(snapshot_id, type_id, exact_calls_examined): how many exact calls the journey of each type was looked for among."""
    calls = edges.where("kind = 'calls' and resolution = 'exact' and target_id is not null").groupBy(SNAP).agg(F.count("*").alias("exact_calls_examined"))
    return types.select(SNAP, "type_id").join(calls, SNAP, "left").fillna(0, ["exact_calls_examined"])
