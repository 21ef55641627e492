"""Line, token, path and phrase functions as columns; no Python runs on the rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which line ends count, comment families, import patterns, header marks, machinery words.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
C_BLOCK = ("c", "cpp", "csharp", "java", "javascript", "typescript", "tsx", "kotlin", "swift", "go", "rust", "php", "css")
HASH = ("python", "ruby", "powershell", "shell", "yaml", "toml", "php")
DASH = ("sql", "lua")
MARKUP = ("html", "xml")
_SCRIPT_IMPORTS = (r"""(?m)(?:from\s+|require\s*\(\s*)['"]([^'"]+)['"]""", r"""(?m)^\s*import\s+['"]([^'"]+)['"]""")
IMPORTS = {
    "python": (r"(?m)^\s*from\s+([\w.]+)\s+import\s+", r"(?m)^\s*import\s+([\w.]+)"),
    "javascript": _SCRIPT_IMPORTS,
    "typescript": _SCRIPT_IMPORTS,
    "tsx": _SCRIPT_IMPORTS,
    "csharp": (r"(?m)^\s*using\s+([\w.]+)\s*;",),
    "fsharp": (r"(?m)^\s*open\s+([\w.]+)",),
    "java": (r"(?m)^\s*import\s+([\w.]+)",),
    "kotlin": (r"(?m)^\s*import\s+([\w.]+)",),
    "go": (r'(?m)^\s*"([^\"]+)"\s*$',),
    "rust": (r"(?m)^\s*(?:use|mod)\s+([\w:]+)",),
}
GENERATED_MARKS = ("generated file", "auto-generated", "autogenerated", "do not edit", "code generated", "generated by")
HEADER_COMMENTS = ("#", "//", "/*", "*", "<!--", ";", "--")
MACHINERY_WORDS = ("audit", "verify", "validator", "validation", "receipt", "provenance", "telemetry", "diagnostic", "report", "reconcile", "checker",
    "monitor", "workflow", "pipeline")
SOURCE_PREFIXES = ("src/", "lib/", "app/", "source/")
PACKAGE_FILES = ("__init__.py", "index.js", "index.ts", "index.tsx", "index.jsx")


def col(c: Column | str) -> Column:
    """A column by name, or as it is."""
    return F.col(c) if isinstance(c, str) else c


def lines_of(text: Column | str) -> Column:
    """The lines of a text; a line end at the very end starts no further line, an empty text has none."""
    parts = F.split(col(text), LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def strip(line: Column) -> Column:
    """A line without white space at its ends."""
    return F.regexp_replace(line, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def code_lines(lines: Column | str, language: Column | str) -> Column:
    """Lines that are neither blank nor a comment, by the language's family.

    A C-family block comment counts from a line that starts with its opening to the line with its close.  Python
    docstrings and comment lines need the parser: see sources.parse.
    """
    lang = col(language)
    in_c, in_hash, in_dash, in_markup = (lang.isin(*g) for g in (C_BLOCK, HASH, DASH, MARKUP))
    state = F.struct(F.lit(False).alias("block"), F.lit(0).alias("n"))

    def step(acc: Column, raw: Column) -> Column:
        line = strip(raw)
        opens = in_c & line.startswith("/*")
        comment = (
            (in_c & line.startswith("//")) | (in_hash & line.startswith("#")) | (in_dash & line.startswith("--"))
            | (in_markup & line.startswith("<!--") & line.endswith("-->"))
        )
        closes = line.contains("*/")
        return (
            F.when(line == "", acc)
            .when(in_c & acc["block"], F.struct((~closes).alias("block"), acc["n"].alias("n")))
            .when(opens, F.struct((~closes).alias("block"), acc["n"].alias("n")))
            .when(comment, acc)
            .otherwise(F.struct(acc["block"].alias("block"), (acc["n"] + 1).alias("n")))
        )

    return F.aggregate(col(lines), state, step, lambda acc: acc["n"])


def imports_of(text: Column | str, language: Column | str) -> Column:
    """Imported names by the language's patterns, each once, sorted."""
    none = F.array().cast("array<string>")
    out = none
    for name, patterns in IMPORTS.items():
        found = F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(col(text), F.lit(p), F.lit(1)) for p in patterns])))
        out = F.when(col(language) == name, found).otherwise(out)
    return out


def looks_generated(lines: Column | str) -> Column:
    """Whether a comment among the first twelve lines says that the file is generated."""
    starts = "^(?:" + "|".join(map(re.escape, HEADER_COMMENTS)) + ")"
    marks = "|".join(map(re.escape, GENERATED_MARKS))

    def hit(raw: Column) -> Column:
        line = F.lower(strip(raw))
        return line.rlike(starts) & line.rlike(marks)

    return F.exists(F.slice(col(lines), 1, 12), hit)


def is_binary(content: Column | str) -> Column:
    """Whether bytes hold a zero among the first 4096, or over 5 % control bytes there."""
    head = F.hex(F.substring(col(content), 1, 4096))
    # each control byte is a pair of digits at an even place; keeping pairs apart makes matches line up
    pairs = F.regexp_replace(head, "(..)", "$1 ")
    bad = F.regexp_count(pairs, F.lit("(?:0[0-8]|0[EF]|1[0-9A-F]) "))
    return F.contains(pairs, F.lit("00 ")) | ((F.length(head) > 0) & (bad * 2.0 / F.length(head) > 0.05))


def tokens(value: Column | str) -> Column:
    """Lower-case letter and digit runs, camel case split at a small letter before a capital; each once."""
    split = F.lower(F.regexp_replace(col(value), "([a-z])([A-Z])", "$1 $2"))
    return F.array_distinct(F.regexp_extract_all(split, F.lit("[a-z0-9]+"), F.lit(0)))


def gram_tokens(value: Column | str) -> Column:
    """Tokens (camel case split after digits too) and the joins of two and of three neighbouring ones; each once."""
    parts = F.regexp_extract_all(F.lower(F.regexp_replace(col(value), "([a-z0-9])([A-Z])", "$1 $2")), F.lit("[a-z0-9]+"), F.lit(0))

    def grams(n: int) -> Column:
        at = F.when(F.size(parts) >= n, F.sequence(F.lit(1), F.size(parts) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(parts, i, n), ""))

    return F.array_distinct(F.concat(parts, grams(2), grams(3)))


def phrase_pattern(phrase: str) -> str:
    """The pattern of a phrase: short ones as whole words, longer ones as the start of a word."""
    return rf"(?U)\b{re.escape(phrase)}\b" if len(phrase) < 4 else rf"(?U)\b{re.escape(phrase)}\w*\b"


def phrase_hit(text: Column | str, phrase: str) -> Column:
    """Whether a lower-case text holds a phrase; phrases of several words anywhere."""
    return F.contains(col(text), F.lit(phrase)) if " " in phrase else col(text).rlike(phrase_pattern(phrase))


def mentions(text: Column | str, words: tuple[str, ...] = MACHINERY_WORDS) -> Column:
    """How often the words occur in a text, anywhere in it, one word at a time."""
    t = col(text)
    out = F.lit(0).cast("long")
    for w in words:
        out = out + ((F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w)).cast("long")
    return out


def normal_path(path: Column | str) -> Column:
    """A path with forward slashes, without './' before it and slashes around it."""
    return F.regexp_replace(F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), r"^\./", ""), "^/+|/+$", "")


def file_name(path: Column | str) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(col(path), "/"), -1)


def parent(path: Column | str) -> Column:
    """The folder of a path; '' for none."""
    return F.regexp_replace(F.regexp_replace(col(path), "[^/]*$", ""), "/$", "")


def stem_path(path: Column | str) -> Column:
    """A path without its last suffix; a name's leading dot starts no suffix."""
    return F.regexp_replace(col(path), r"(?<=[^/])\.[^./]+$", "")


def module_aliases(path: Column | str) -> Column:
    """Names by which a file may be imported: slashed and dotted, also without a source folder, also its package's."""
    stem = stem_path(path)
    forms = [stem]
    empty = F.lit(None).cast("string")
    forms += [F.when(stem.startswith(p), F.substr(stem, F.lit(len(p) + 1))).otherwise(empty) for p in SOURCE_PREFIXES]
    forms.append(F.when(file_name(path).isin(*PACKAGE_FILES), F.when(parent(path) == "", F.lit(".")).otherwise(parent(path))).otherwise(empty))
    both = F.array_compact(F.flatten(F.array(*[F.array(f, F.replace(f, F.lit("/"), F.lit("."))) for f in forms])))
    return F.array_distinct(F.filter(F.transform(both, normal_path), lambda a: a != ""))


def tail(name: Column | str) -> Column:
    """The last dotted part of a name."""
    return F.element_at(F.split(F.replace(normal_path(name), F.lit("/"), F.lit(".")), r"\."), -1)


def normal_target(target: Column | str) -> Column:
    """A relationship's target name: brackets trimmed, '::' and '->' as dots, its last word; import statements whole."""
    t = F.regexp_replace(F.regexp_replace(F.trim(col(target)), r"^[;(){}\[\]]+|[;(){}\[\]]+$", ""), "::|->", ".")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    last = F.regexp_replace(F.element_at(F.split(F.trim(t), " "), -1), r"^\.+|\.+$", "")
    # plain names are what they are; expressions on texts cost more than joins
    return F.when(col(target).rlike(r"^\w+(?:\.\w+)*$"), col(target)).when(t.rlike("^(?:import|from|using|open|use) "), t).otherwise(last)


def normal_module(target: Column | str) -> Column:
    """A module name as an import gives it, dotted."""
    t = F.regexp_replace(F.trim(col(target)), r"""^[;(){}\[\]"']+|[;(){}\[\]"']+$""", "")
    t = F.regexp_replace(F.replace(F.replace(t, F.lit("::"), F.lit(".")), F.lit("\\"), F.lit("/")), r"^(?:\.\.?/)+", "")
    t = F.when(t.startswith("@"), F.element_at(F.split(t, "/"), -1)).otherwise(t)
    return F.regexp_replace(F.replace(t, F.lit("/"), F.lit(".")), r"^\.+|\.+$", "")


def import_targets(raw: Column | str) -> Column:
    """Module names that an import statement may mean."""
    t = F.trim(col(raw))
    quoted = F.regexp_extract_all(t, F.lit("""["']([^"']+)["']"""), F.lit(1))
    named = F.regexp_extract_all(t, F.lit(r"\b(?:from|import|using|open|use)\s+([.\w:/-]+)"), F.lit(1))
    found = F.transform(F.concat(quoted, named, F.array(normal_target(t))), normal_module)
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def compact(reference: Column | str) -> Column:
    """A reference on one line, at most 180 characters."""
    t = F.trim(F.regexp_replace(col(reference), r"(?U)\s+", " "))
    return F.when(F.length(t) > 180, F.concat(F.substring(t, 1, 177), F.lit("..."))).otherwise(t)


def snippet(lines: Column | str, start: Column, end: Column, limit: int = 4000) -> Column:
    """The first characters of a range of lines (numbers from 1)."""
    a = F.greatest(start, F.lit(1))
    last = F.greatest(a, F.least(F.size(col(lines)), end))
    return F.substring(F.array_join(F.slice(col(lines), a, last - a + 1), "\n"), 1, limit)
