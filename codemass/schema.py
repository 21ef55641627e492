"""Closed domains and relation schemas.

Every nested list of a scan is a relation of its own here, keyed by ``snapshot_id``, so that one job analyses many
trees or commits at once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in their order, the sets made of them, and distances from value.
CATEGORIES = (
    "core-product", "user-surface", "essential-support", "developer-tooling", "testing", "observability",
    "verification", "audit-provenance", "process-machinery", "meta-machinery", "documentation", "unknown",
)
PRODUCT = ("core-product", "user-surface")
ESSENTIAL = (*PRODUCT, "essential-support")
MACHINERY = ("developer-tooling", "testing", "observability", "verification", "audit-provenance", "process-machinery", "meta-machinery")
ASSURANCE = ("testing", "verification", "audit-provenance", "meta-machinery")
RECURSIVE = ("observability", "verification", "audit-provenance", "process-machinery", "meta-machinery")
AUDIT = ("audit-provenance", "meta-machinery")
BASE_DISTANCE = {
    "core-product": 0, "user-surface": 0, "essential-support": 1, "developer-tooling": 2, "testing": 2, "observability": 2,
    "verification": 2, "audit-provenance": 3, "process-machinery": 3, "meta-machinery": 4, "documentation": 2, "unknown": 2,
}
SYMBOL_KINDS = (
    "file", "module", "namespace", "class", "interface", "struct", "enum", "trait", "function", "method", "constructor",
    "property", "field", "type", "unknown",
)
EDGE_KINDS = ("contains", "calls", "imports", "inherits", "implements", "references")
RESOLUTIONS = ("exact", "probable", "unresolved")
METABOLISM_STATUS = ("active", "superseded-candidate", "archive-candidate", "dormant", "bounded-orphan-candidate", "insufficient-evidence")
JOURNEY_ROLES = ("created", "transformed", "persisted", "emitted")
INDEX_STATUS = ("ok", "skipped", "failed")
CONTEXT_BANDS = ("insufficient-cohort", "lower-tail", "middle-range", "upper-tail")

FILES = "snapshot_id string, path string, language string, text string, lines int, code_lines int, bytes bigint, imports array<string>"
COMPONENTS = "snapshot_id string, path string, language string, code_lines bigint, category string, confidence double, value_distance int"
FILE_EDGES = "snapshot_id string, src string, dst string"
SYMBOLS = "snapshot_id string, id string, path string, language string, kind string, name string, qualified_name string, start_line int, end_line int, parent_id string, category string"
SYMBOL_EDGES = "snapshot_id string, edge_seq bigint, source_id string, kind string, target_name string, target_id string, resolution string, evidence string"
DIAGNOSTICS = "snapshot_id string, path string, language string, message string, severity string"


def among(category: Column | str, group: tuple[str, ...]) -> Column:
    """Whether a category belongs to a group; null is none."""
    column = F.col(category) if isinstance(category, str) else category
    return F.coalesce(column.isin(*group), F.lit(False))


def base_distance(category: Column | str) -> Column:
    """The least distance from value that a category has."""
    column = F.col(category) if isinstance(category, str) else category
    out = F.lit(BASE_DISTANCE["unknown"])
    for name, distance in BASE_DISTANCE.items():
        out = F.when(column == name, F.lit(distance)).otherwise(out)
    return out


def category_rank(category: Column | str) -> Column:
    """The category's place in CATEGORIES, from 0."""
    column = F.col(category) if isinstance(category, str) else category
    return (F.array_position(F.array(*map(F.lit, CATEGORIES)), column) - 1).cast("int")
