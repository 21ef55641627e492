"""Symbols and relationships of source texts: a file's syntax tree becomes rows, many files a batch.

Python is parsed by its own ``ast``, languages with braces by ``sources.braces``.  Others, whose parser is not installed, keep a
file symbol and a warning.
"""

from __future__ import annotations

import ast
import io
import tokenize

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codemass.sources import braces

ROWS = (
    "snapshot_id string, row string, seq bigint, id string, path string, language string, kind string, name string, qualified_name string,"
    " start_line int, end_line int, parent_id string, target_name string, target_id string, resolution string, evidence string, message string, severity string"
)
TREE_LANGUAGES = ("javascript", "typescript", "tsx", "csharp", "fsharp", "java", "kotlin", "go", "rust", "ruby", "php", "c", "cpp", "swift", "lua",
    "shell", "powershell")


def dotted(node: ast.AST) -> str | None:
    """The dotted name of an expression, through subscripts and calls; null if it has none."""
    parts = []
    while True:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Subscript):
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Name):
            return ".".join([node.id, *reversed(parts)])
        else:
            return ".".join(reversed(parts)) or None


class _Walk(ast.NodeVisitor):
    def __init__(self, path: str, add):
        self.file, self.path, self.add, self.bound = f"{path}::<file>", path, add, {}
        self.stack = [(self.file, "", "file")]

    def symbol(self, node, name: str, kind: str) -> str:
        parent, prefix, _ = self.stack[-1]
        qualified = f"{prefix}.{name}".strip(".")
        key = f"{self.path}::{qualified}@{node.lineno}"
        self.add("symbol", id=key, kind=kind, name=name, qualified_name=qualified, start_line=node.lineno, end_line=node.end_lineno or node.lineno,
            parent_id=parent)
        self.add("edge", id=parent, kind="contains", target_name=qualified, target_id=key, resolution="exact", evidence="python AST lexical containment")
        self.stack.append((key, qualified, kind))
        return key

    def edge(self, source: str, kind: str, target: str | None, evidence: str) -> None:
        if target:
            self.add("edge", id=source, kind=kind, target_name=target, resolution="unresolved", evidence=evidence)

    def through_import(self, name: str | None) -> str | None:
        head, dot, rest = (name or "").partition(".")
        return self.bound[head] + dot + rest if head in self.bound else name

    def visit_FunctionDef(self, node) -> None:
        inside = self.stack[-1][2] == "class"
        self.symbol(node, node.name, "constructor" if inside and node.name == "__init__" else "method" if inside else "function")
        self.generic_visit(node)
        self.stack.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        key = self.symbol(node, node.name, "class")
        for base in node.bases:
            self.edge(key, "inherits", self.through_import(dotted(base)), "python AST class base")
        self.generic_visit(node)
        self.stack.pop()

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.bound[a.asname or a.name.split(".", 1)[0]] = a.name
            self.edge(self.file, "imports", a.name, "python AST import")

    def visit_ImportFrom(self, node) -> None:
        self.edge(self.file, "imports", "." * node.level + (node.module or "") or ".", "python AST from-import")
        for a in node.names if node.module else ():
            if a.name != "*":
                self.bound[a.asname or a.name] = f"{node.module}.{a.name}"

    def visit_Call(self, node) -> None:
        target = self.through_import(dotted(node.func))
        self.edge(self.stack[-1][0], "calls", target, "python AST call" + (" with import binding" if "." in (target or "") else ""))
        self.generic_visit(node)


def parse(path: str, language: str, source: str, lines: int) -> list[dict]:
    """Rows of one file.  A file that cannot be parsed keeps its own symbol and gets a diagnostic."""
    rows: list[dict] = []

    def add(row: str, **values) -> None:
        rows.append({"row": row, "seq": len(rows), "path": path, "language": language, **values})

    if language != "python" and language not in TREE_LANGUAGES:
        add("diagnostic", message=f"no parser for {language}", severity="info")
        return rows
    add("symbol", id=f"{path}::<file>", kind="file", name=path.rsplit("/", 1)[-1], qualified_name=path, start_line=1, end_line=max(1, lines))
    if language != "python":
        add("diagnostic", message="tree-sitter parser unavailable", severity="warning")
        return rows
    try:
        _Walk(path, add).visit(ast.parse(source))
    except SyntaxError as e:
        add("diagnostic", message=f"Python AST parse failed at line {e.lineno}: {e.msg}", severity="warning")
    except (ValueError, RecursionError) as e:
        add("diagnostic", message=f"Python AST parse failed: {type(e).__name__}", severity="warning")
    except Exception as e:  # one file's failure stays that file's
        add("diagnostic", message=f"parser failed: {type(e).__name__}: {e}", severity="error")
    return rows


def parsed(files: DataFrame) -> DataFrame:
    """Rows (symbol, edge, diagnostic) of all files (snapshot_id, path, language, text, lines)."""

    def run(batches):
        import pyarrow as pa

        kinds = {c: {"bigint": pa.int64(), "int": pa.int32()}.get(k, pa.string()) for c, k in (x.split() for x in ROWS.split(","))}
        for batch in batches:
            rows = [{"snapshot_id": s, **r} for s, p, g, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in parse(p, g, t or "", n)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in kinds.items()], names=list(kinds))

    files = files.select("snapshot_id", "path", "language", "text", "lines")
    braced = F.coalesce(F.col("language").isin(*braces.LANGUAGES), F.lit(False))
    rows = files.where(~braced).mapInArrow(run, ROWS)
    # texts are written already; whether any is braced is one look at their languages
    if files.where(braced).isEmpty():
        return rows
    return rows.unionByName(braces.rows_of(files), allowMissingColumns=True).select(*rows.columns)


def symbols(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Symbols with their file's category; of a repeated id the last holds."""
    own = rows.where("row = 'symbol'").drop("row", "target_name", "target_id", "resolution", "evidence", "message", "severity")
    last = own.groupBy("snapshot_id", "id").agg(F.max_by(F.struct(*own.columns), "seq").alias("r")).select("r.*")
    return last.drop("seq").join(components.select("snapshot_id", "path", "category"), ["snapshot_id", "path"], "left").withColumn("category",
        F.coalesce("category", F.lit("unknown")))


def edges(rows: DataFrame) -> DataFrame:
    """Relationships with edge_seq, in the order of paths and of each file's tree."""
    return rows.where("row = 'edge'").select(
        "snapshot_id", (F.xxhash64("path").bitwiseAND(F.lit((1 << 38) - 1)) * (1 << 24) + F.col("seq")).alias("edge_seq"),
        F.col("id").alias("source_id"), "kind", "target_name", "target_id", "resolution", "evidence"
    )


def diagnostics(rows: DataFrame) -> DataFrame:
    """(snapshot_id, path, language, message, severity)."""
    return rows.where("row = 'diagnostic'").select("snapshot_id", "path", "language", "message", "severity")


def python_notes(source: str, lines: list[str]) -> set[int]:
    """Numbers of lines that are comments alone or docstrings of the module and its nested classes and functions."""
    out: set[int] = set()
    try:
        for token in tokenize.generate_tokens(io.StringIO(source).readline):
            if token.type == tokenize.COMMENT and token.start[0] <= len(lines) and not lines[token.start[0] - 1][: token.start[1]].strip():
                out.add(token.start[0])
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    try:
        bodies = [ast.parse(source).body]
    except (SyntaxError, ValueError, RecursionError):
        return out
    while bodies:
        body = bodies.pop()
        if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
            out.update(range(body[0].lineno, (body[0].end_lineno or body[0].lineno) + 1))
        bodies += [n.body for n in body if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)]
    return out


def exported(source: str) -> list[tuple[str, int]]:
    """Names that a module's ``__all__`` lists as plain texts, and its line."""
    try:
        body = ast.parse(source).body
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and isinstance(node.value, ast.List | ast.Tuple | ast.Set):
            out += [(e.value, node.lineno) for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    return out


def python_exports(files: DataFrame) -> DataFrame:
    """(snapshot_id, kind, name, path, line, evidence_kind, detail) of names in ``__all__``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(s, name, p, line) for s, p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for name, line in exported(t or "")]
            if rows:
                s, name, p, line = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(name, pa.string()), pa.array(p, pa.string()),
                        pa.array(line, pa.int32())], names=["snapshot_id", "name", "path", "line"])

    python = files.where((F.col("language") == "python") & F.col("text").contains("__all__")).select("snapshot_id", "path", "text")
    rows = python.mapInArrow(run, "snapshot_id string, name string, path string, line int")
    return rows.select("snapshot_id", F.lit("public-api").alias("kind"), "name", "path", "line", F.lit("python-export").alias("evidence_kind"),
        F.concat(F.lit("__all__ exports "), F.col("name")).alias("detail"))


def with_python_lines(files: DataFrame) -> DataFrame:
    """``files`` with code_lines of Python counted by its parser; other languages as they are."""

    @F.pandas_udf("int")
    def count(source):
        import pandas as pd

        def one(s: str) -> int:
            lines = s.splitlines()
            notes = python_notes(s, lines)
            return sum(1 for n, line in enumerate(lines, 1) if line.strip() and n not in notes and not line.strip().startswith("#"))

        return pd.Series([one(s or "") for s in source], dtype="int32")

    # one pass over the source: other languages hand the counter nothing
    python = F.coalesce(F.col("language") == "python", F.lit(False))
    return files.withColumn("code_lines", F.when(python, count(F.when(python, F.col("text")))).otherwise(F.col("code_lines")))
