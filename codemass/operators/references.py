"""Literal path references between files and use that spreads from trusted boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codemass.functions.checkpoint import checkpointed
from codemass.functions.spread import apart
from codemass.functions.text import file_name, parent
from codemass.operators.traverse import closure

SNAP = "snapshot_id"
# Manifests, and suffixes of files that pass a reference on.
MANIFESTS = (
    "pyproject.toml", "package.json", "package-lock.json", "cargo.toml", "cargo.lock", "go.mod", "go.sum", "pom.xml", "build.gradle",
    "build.gradle.kts", "requirements.txt", "setup.py", "setup.cfg", "makefile", "justfile",
)
PASSING = (".sh", ".bash", ".zsh", ".fish", ".ps1", ".py", ".rb", ".pl", ".js", ".mjs", ".cjs", ".ts", ".json", ".toml", ".yaml", ".yml", ".ini", ".cfg")
# Fixed value: the characters that a path's borders are judged by.  A word is a longest run of them, a gap what lies between.
WORD = r"[A-Za-z0-9_./-]+"


def is_boundary(path: Column | str, category: Column | str) -> Column:
    """Whether a file's references are use from outside: workflows, tests and manifests."""
    p = F.col(path) if isinstance(path, str) else path
    c = F.col(category) if isinstance(category, str) else category
    name = F.lower(file_name(p))
    return p.startswith(".github/") | F.coalesce(c == "testing",
        F.lit(False)) | name.isin(*MANIFESTS) | (name.rlike(r"\.ya?ml$") & F.lower(p).contains("workflow"))


def passes_on(path: Column | str) -> Column:
    """Whether what a file refers to is used if the file is."""
    return F.lower(file_name(path)).rlike("(" + "|".join(s.replace(".", r"\.") for s in PASSING) + ")$")


def _endings(word: Column) -> Column:
    """A word and what is left of it after each of its slashes."""
    parts = F.split(word, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _gaps(text: Column) -> Column:
    """What lies before, between and after the words: one more than there are words."""
    return F.split(text, WORD, -1)


def meanings(form: Column, source: Column) -> Column:
    """The paths of which ``form`` is a reference when it stands in ``source``: at most two.

    A form is the path from the root, or the shortest path from the source's folder, either with './' before it unless
    that is a path that begins with a dot.  So '..' parts lead a form or are none of it.
    """
    return F.array_distinct(F.array_compact(F.array(*_meanings(form, source))))


def _folder(path: Column) -> Column:
    """``parent`` without expressions: what stands before the last slash."""
    return F.when(path.contains("/"), F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)).otherwise("")


def _meanings(form: Column, source: Column) -> tuple[Column, Column]:
    """The path from the root that a form may mean, and another one or null; only forms that go up are taken apart."""
    plain, own = F.when(form.startswith("./"), F.substring(form, 3, 2**31 - 1)).otherwise(form), _folder(source)
    folders = F.filter(F.split(own, "/"), lambda p: p != "")
    up = (F.length(F.regexp_extract(form, r"^((?:\.\./)*)", 1)) / 3).cast("int")
    # a source in no folder means the same from there; slashes alone are no folder
    placed = F.length(F.replace(own, F.lit("/"), F.lit(""))) > 0
    below = F.when(placed & (~form.startswith("./") | ~plain.startswith(".")), F.concat_ws("/", own, plain))
    rest = F.substring(form, up * 3 + 1, F.length(form))
    left = F.size(folders) - up
    # the shortest way does not go up from a folder only to come back into it
    shortest = (left >= 0) & (F.split(rest, "/")[0] != F.try_element_at(folders, left + 1))
    above = F.when(shortest, F.array_join(F.concat(F.slice(folders, 1, F.greatest(left, F.lit(0))), F.array(rest)), "/"))
    return plain, F.when(form.startswith("../"), above).otherwise(below)


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _plain_forms(texts: DataFrame, paths: DataFrame) -> DataFrame:
    """(snapshot_id, src, form, _deep): words, and their endings that hold a slash, whose last part is the name of a file, beside how many
    slashes paths of that name have.

    A form is as long as the path that it means, with or without './' before it, or shorter by the source's folders; only
    words that go up are cut at each slash.
    """
    rows = texts.select(SNAP, F.col("path").alias("src"), F.explode(F.array_distinct(_words(F.col("text")))).alias("_word"))
    deep = paths.select(SNAP, F.substring_index("path", "/", -1).alias("_name"), _slashes(F.col("path")).alias("_deep")).distinct()
    rows = rows.withColumn("_name", F.substring_index("_word", "/", -1)).join(deep, [SNAP, "_name"])
    d, n, own = F.col("_deep"), _slashes(F.col("_word")), _slashes(F.col("src"))
    cuts = F.when(F.col("_word").contains("../"), F.sequence(F.lit(0), n)).otherwise(F.array(d, d + 1, d - own, d - own + 1))
    rows = rows.select(SNAP, "src", "_word", "_deep", n.alias("_n"), F.explode(cuts).alias("_k"))
    # an ending without a slash would be a bare name at the end of another path, so only the whole word counts there
    rows = rows.where("_k = _n or _k between 1 and _n")
    return rows.select(SNAP, "src", F.expr("substring_index(_word, '/', -(_k + 1))").alias("form"), "_deep")


def _shapes(odd: DataFrame) -> DataFrame:
    """(snapshot_id, kind, key, m, lead, trail): how paths with characters that are in no word lie among a text's words.

    Each ending at a slash that holds such a character is m words apart from its first to its last, after ``lead``
    characters of a gap and before ``trail`` of one.  ``key`` is its anchor: the last word where a gap stands before it
    ('whole'), else the last part of its only word ('name').  One without any word has none ('gap').
    """
    ends = odd.select(SNAP, F.explode(_endings(F.col("path"))).alias("_s")).distinct()
    ends = ends.withColumns({"_w": _words(F.col("_s")), "_g": _gaps(F.col("_s"))})
    n, lead, trail = F.size("_w"), F.length(F.col("_g")[0]), F.length(F.element_at("_g", -1))
    shape = lambda kind, key, m, before, after: F.struct(F.lit(kind).alias("kind"), key.alias("key"), m.alias("m"), before.alias("lead"), after.alias("trail"))
    zero, last = F.lit(0), F.element_at("_w", -1)
    no_word = F.array(shape("gap", F.lit(""), zero, zero, F.length("_s")), shape("name", F.lit(""), zero, zero, F.length("_s")))
    alone = F.array(shape("name", F.substring_index(last, "/", -1), zero, zero, trail))
    apart = F.array(shape("whole", last, n - 1, zero, trail))
    # a gap in front either ends a longer one or follows the slash of the word before
    led = F.array(shape("whole", last, n - 1, lead, trail), shape("whole", last, n, zero, trail))
    kinds = F.when(n == 0, no_word).when(lead > 0, led).when(n > 1, apart).when(trail > 0, alone)
    return ends.select(SNAP, F.explode(kinds).alias("_shape")).select(SNAP, "_shape.*").distinct()


def _among(shape: Column, w: Column, g: Column) -> Column:
    """Every string of a text (its words and gaps) that has a shape and the borders of a path."""
    n = F.size(w)
    numbers = lambda upto: F.when(upto > 0, F.sequence(F.lit(0), upto - 1)).otherwise(F.array().cast("array<int>"))
    name = shape["kind"] == "name"
    here = F.filter(numbers(n), lambda i: F.when(name, F.substring_index(F.get(w, i), "/", -1)).otherwise(F.get(w, i)) == shape["key"])
    none = F.array().cast("array<string>")

    def at(i: Column) -> Column:
        first, after = i - shape["m"], F.get(g, i + 1)
        between = F.when(shape["m"] > 0, F.array_join(F.transform(F.sequence(first + 1, i), lambda j: F.concat(F.get(g, j), F.get(w, j))), "")).otherwise("")
        tail = F.concat(between, F.substring(after, F.lit(1), shape["trail"]))
        # what follows is no character of a word: more of the gap, or nothing
        ends = (shape["trail"] == 0) | (F.length(after) > shape["trail"]) | ((i + 1 == n) & (F.length(after) == shape["trail"]))
        start, before = F.get(w, first), F.get(g, first)
        pieces = F.filter(F.transform(_endings(start), lambda e: F.struct(e.alias("e"), F.concat(e, tail).alias("form"))),
            lambda p: (p["e"] == start) | p["form"].contains("/"))
        led = F.array(F.concat(F.substring(before, F.length(before) - shape["lead"] + 1, shape["lead"]), start, tail))
        begins = (F.length(before) > shape["lead"]) | ((first == 0) & (F.length(before) == shape["lead"]))
        found = F.when(shape["lead"] == 0, F.transform(pieces, lambda p: p["form"])).when(begins, led)
        return F.when((first >= 0) & ends, F.coalesce(found, none)).otherwise(none)

    size = shape["trail"]

    def inside(k: Column) -> Column:
        gap = F.get(g, k)
        places = F.filter(numbers(F.length(gap) - size + 1), lambda p: ((p > 0) | (k == 0)) & ((p + size < F.length(gap)) | (k == n)))
        return F.transform(places, lambda p: F.substring(gap, p + 1, size))

    return F.when(shape["kind"] == "gap", F.flatten(F.transform(numbers(n + 1), inside))).otherwise(F.flatten(F.transform(here, at)))


def _odd_forms(texts: DataFrame, odd: DataFrame) -> DataFrame:
    """(snapshot_id, src, form): strings of texts that lie among words as a path with other characters does.

    Anchors are joined with the distinct words of texts; only texts that hold one are read again, and there each shape is
    looked at where its anchor stands.
    """
    shapes = checkpointed(_shapes(odd))
    words = texts.select(SNAP, "path", F.explode(F.array_distinct(_words(F.col("text")))).alias("_word"))
    keys = words.select(SNAP, "path", F.explode(F.array(F.struct(F.lit("whole").alias("kind"), F.col("_word").alias("key")),
            F.struct(F.lit("name").alias("kind"), F.substring_index("_word", "/", -1).alias("key")))).alias("_key")).select(SNAP, "path", "_key.*").distinct()
    held = keys.join(shapes.where("kind <> 'gap'"), [SNAP, "kind", "key"]).select(SNAP, "path", *shapes.columns[1:])
    held = held.unionByName(texts.select(SNAP, "path").join(shapes.where("kind = 'gap'"), SNAP).select(SNAP, "path", *shapes.columns[1:]))
    held = held.groupBy(SNAP, "path").agg(F.collect_set(F.struct("kind", "key", "m", "lead", "trail")).alias("_shapes"))
    rows = texts.select(SNAP, "path", _words(F.col("text")).alias("_w"), _gaps(F.col("text")).alias("_g")).join(held, [SNAP, "path"])
    forms = F.flatten(F.transform("_shapes", lambda s: _among(s, F.col("_w"), F.col("_g"))))
    return rows.select(SNAP, F.col("path").alias("src"), F.explode(F.array_distinct(forms)).alias("form"))


def literal_references(files: DataFrame, sources: Column | None = None) -> DataFrame:
    """(snapshot_id, src, dst, form): files whose text names another file's path, from the root or from its own folder.

    A form is escaped as a whole: any character may be in a path.  Before it stands none of A-Z a-z 0-9 _ . - and, if
    it is a bare name, no slash; after it none of them and no slash.  So a form of such characters alone is a word of the
    text or a word's ending at a slash, and is joined with the paths by equality.  One with other characters takes
    part of the gaps between words: the words that anchor it are joined first (see ``_shapes``).  The longest form that a
    text has for a file holds, the first in order of equally long ones.  ``sources`` says which texts are read; null and empty
    ones name nothing, and no file names itself.
    """
    texts = (files if sources is None else files.where(sources)).where("text is not null").select(SNAP, "path", "text")
    paths = files.select(SNAP, "path")
    forms = _plain_forms(texts, paths)
    odd = paths.where(~F.col("path").rlike(f"^{WORD}$"))
    if not odd.isEmpty():
        forms = forms.unionByName(_odd_forms(texts, checkpointed(odd)), allowMissingColumns=True)
    meant = forms.select(SNAP, "src", "form", "_deep", F.explode(F.array(*_meanings(F.col("form"), F.col("src")))).alias("dst")).where("src <> dst")
    # what is deeper or flatter than paths of its name meets none
    meant = meant.where(F.col("_deep").isNull() | (F.col("_deep") == _slashes(F.col("dst")))).drop("_deep")
    hits = meant.join(paths.withColumnRenamed("path", "dst"), [SNAP, "dst"])
    return hits.groupBy(SNAP, "src", "dst").agg(F.min_by("form", F.struct(-F.length("form"), F.col("form"))).alias("form"))


def use(files: DataFrame, *, name_boundaries: bool = False) -> DataFrame:
    """(snapshot_id, path, kind, source, detail): files that texts refer to, as evidence of their use.

    ``static_path_references`` are a trusted boundary's own.  Where what it refers to passes references on, those of that file
    are ``boundary_path_references``, and so on: one search for all boundaries of a snapshot.  Files that refer to each other
    but that no boundary reaches are no evidence.  ``name_boundaries`` searches from each boundary and adds it as a column: a row
    of ``boundary_path_references`` for each boundary behind its source; null in direct references.
    """
    refs = checkpointed(literal_references(files, is_boundary("path", "category") | passes_on("path")))
    direct = refs.join(files.where(is_boundary("path", "category")).select(SNAP, F.col("path").alias("src")), [SNAP, "src"], "left_semi")
    passing = files.where(passes_on("path")).select(SNAP, F.col("path").alias("node"))
    whose = F.col("src") if name_boundaries else F.lit("")
    first = direct.select(SNAP, whose.alias("boundary"), F.col("dst").alias("node")).distinct().join(passing, [SNAP, "node"], "left_semi")
    reached = apart(closure(refs, first, through=passing).join(passing, [SNAP, "node"], "left_semi").select(SNAP, "boundary", F.col("node").alias("src")))
    row = lambda kind: [SNAP, F.col("dst").alias("path"), F.lit(kind).alias("kind"), F.col("src").alias("source"), F.col("form").alias("detail")]
    rows = direct.withColumn("boundary", F.lit(None).cast("string")).select(*row("static_path_references"), "boundary").unionByName(
        refs.join(reached, [SNAP, "src"]).select(*row("boundary_path_references"), "boundary"))
    return rows if name_boundaries else rows.drop("boundary")


def boundary_use(files: DataFrame) -> DataFrame:
    """(snapshot_id, path): files that a trusted boundary refers to, directly or through files that pass it on."""
    return use(files).select(SNAP, "path").distinct()
