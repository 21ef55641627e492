"""Numeric and label functions as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codemass.functions.text import col
from codemass.schema import CATEGORIES


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole; 0 where there is no whole."""
    return F.when(col(whole) > 0, col(part) / col(whole)).otherwise(F.lit(0.0))


def optional_ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole; without a whole null if there is a part, else 0."""
    return F.when(col(whole) > 0, col(part) / col(whole)).when(col(part) > 0, F.lit(None).cast("double")).otherwise(F.lit(0.0))


def finite(value: Column | str) -> Column:
    """A number, or null for NaN and infinities."""
    v = col(value).cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


def saturating(depth: Column | str) -> Column:
    """depth / (depth + 3)."""
    return col(depth) / (col(depth) + 3.0)


def model_of(version: Column | str) -> Column:
    """The measurement model of a tool version: versions 0.3 to 0.12 share one; others have none."""
    major = F.regexp_extract(col(version), r"^(\d+)\.(\d+)(?:\.|$)", 1)
    minor = F.regexp_extract(col(version), r"^(\d+)\.(\d+)(?:\.|$)", 2)
    number = F.when(minor != "", minor).cast("int")
    return F.when((major == "0") & (number >= 3) & (number <= 12), F.lit("semantic-v1"))


def identity_key(repository: Column | str, sha: Column | str, version: Column | str, revision: Column | str) -> Column:
    """The key of one measurement: repository:sha:version:revision."""
    return F.concat_ws(":", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in (repository, sha, version, revision)])


def dominance(product: Column | str, machinery: Column | str) -> Column:
    """Which of two shares is the larger."""
    return F.when(col(product) > col(machinery), "product").when(col(machinery) > col(product), "machinery").otherwise("balanced")


def band(percentile: Column | str, cohort: Column | str) -> Column:
    """Where a percentile lies; cohorts under ten members tell nothing."""
    p = col(percentile)
    return F.when(col(cohort) < 10, "insufficient-cohort").when(p < 10, "lower-tail").when(p > 90, "upper-tail").otherwise("middle-range")


def clean_counts(counts: Column) -> Column:
    """An array of the twelve categories' counts from a map, junk and negatives as 0."""
    one = lambda c: F.greatest(F.coalesce(finite(F.try_element_at(counts, F.lit(c))), F.lit(0.0)), F.lit(0.0))
    return F.array(*[one(c) for c in CATEGORIES])


def shares(values: Column) -> Column:
    """Each value's share in the sum; zeros if the sum is 0."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def composition_distance(a: Column, b: Column) -> Column:
    """Half the sum of share differences, at most 1."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.least(F.lit(1.0), F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) * 0.5)


def ordered_sum(parts: list[Column]) -> Column:
    """Parts added from left to right, so that doubles come out alike everywhere."""
    return reduce(lambda x, y: x + y, parts)


def family(path: Column | str) -> tuple[Column, Column]:
    """The version family of a path and its number in it; nulls if the name has none."""
    from codemass.functions.text import file_name, parent

    # Fixed value: names that carry a version number.
    pattern = r"(?i)^(.*(?:release|stage|migration|migrate|schema|version|upgrade|v)[_-]?)(\d{2,})(.*)$"
    name = file_name(path)
    suffix = F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(suffix))
    hit = stem.rlike(pattern)
    folder = F.when(parent(path) == "", F.lit(".")).otherwise(parent(path))
    named = F.concat(folder, F.lit("/"), F.lower(F.concat(F.regexp_extract(stem, pattern, 1), F.lit("{n}"), F.regexp_extract(stem, pattern, 3))),
        F.lower(suffix))
    return F.when(hit, named), F.when(hit, F.regexp_extract(stem, pattern, 2).cast("long"))


# First words of member names that tell a data journey's stage.
CREATE_WORDS = ("create", "new", "build", "make", "parse", "load", "read", "hydrate", "deserialize", "clone", "copy")
TRANSFORM_WORDS = ("transform", "map", "normalize", "convert", "adapt", "apply", "merge", "update", "mutate", "replace", "with", "clean", "enrich")
PERSIST_WORDS = ("save", "store", "write", "insert", "upsert", "persist", "commit", "serialize", "dump", "archive")
EMIT_WORDS = ("emit", "publish", "send", "output", "export", "render", "respond", "response", "yield", "broadcast", "dispatch")


def member_role(kind: Column | str, name: Column | str) -> Column:
    """The stage of a data type's member: constructors create, else by the first word of the name; null if none."""
    words = F.filter(F.split(F.regexp_replace(col(name), "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+"), lambda w: w != "")
    first = F.lower(F.try_element_at(words, F.lit(1)))
    return (
        F.when(col(kind) == "constructor", "created")
        .when(first.isin(*CREATE_WORDS), "created")
        .when(first.isin(*PERSIST_WORDS), "persisted")
        .when(first.isin(*EMIT_WORDS), "emitted")
        .when(first.isin(*TRANSFORM_WORDS), "transformed")
    )


def is_repository(name: Column | str) -> Column:
    """Whether a name reads owner/repository."""
    return col(name).rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")


def is_sha(sha: Column | str) -> Column:
    """Whether a text is a full 40-digit commit hash."""
    return col(sha).rlike("^[0-9a-fA-F]{40}$")


def safe_member(name: Column | str) -> Column:
    """Whether an archive member's name stays inside its folder."""
    n = col(name)
    return n.isNotNull() & (n != "") & ~n.rlike(r"(^/)|(^|/)\.\.(/|$)|[\\:\x00]")


def rating(value: Column | str) -> Column:
    """A number with at most six decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", col(value)), "0+$", ""), r"\.$", "")
