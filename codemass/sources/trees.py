"""Data sources of source trees: folders, git commits and tarballs, read as inert bytes on the executors.

Spark's own binary reader leaves out names that start with '.' or '_', which matter here; these do not.
Each gives (snapshot_id, path, content).
"""

from __future__ import annotations

import gzip
import io
import lzma
import os
import re
import subprocess
import tarfile
import threading
import zlib
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codemass.functions import text

SCHEMA = "snapshot_id string, path string, content binary"
FILES_A_PARTITION, BYTES_A_PARTITION = 256, 32 << 20

# Languages by suffix, folders that are not read, and bounds.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".cs": "csharp", ".fs": "fsharp",
    ".java": "java", ".kt": "kotlin", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp",
    ".hpp": "cpp",
    ".swift": "swift", ".lua": "lua", ".ps1": "powershell", ".sh": "shell", ".bash": "shell", ".sql": "sql", ".html": "html", ".css": "css", ".scss": "css",
    ".md": "markdown", ".rst": "documentation", ".yml": "yaml", ".yaml": "yaml", ".toml": "toml", ".json": "json", ".xml": "xml",
}
IGNORED = (
    ".git", ".hg", ".svn", ".idea", ".vscode", "node_modules", "vendor", ".venv", "venv", "env", "dist", "build", "target", "bin", "obj", ".next", ".nuxt",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", "coverage", ".coverage", "__pycache__",
)
MAX_FILE_BYTES = 1_000_000
MAX_FILES, MAX_BYTES, MAX_COMMITS, GIT_SECONDS = 150_000, 512 << 20, 200, 60
#: Oldest git that is asked for commits.
MIN_GIT = (2, 30)


class TreeError(ValueError):
    """A tree that cannot be read as asked; ``code`` names the reason."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class _Part(InputPartition):
    snapshot: str
    items: tuple[str, ...]


class FolderSource(DataSource):
    """format("source_tree").option("path", folder).option("snapshot", name): files of a folder that executors can reach.

    Ignored folders and unknown suffixes are left out before anything is read; unreadable files are skipped.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FolderReader(self.options["path"], self.options.get("snapshot", "tree"), int(self.options.get("maxFileBytes", MAX_FILE_BYTES)))


class _FolderReader(DataSourceReader):
    def __init__(self, root: str, snapshot: str, limit: int):
        self.root, self.snapshot, self.limit = os.path.abspath(root), snapshot, limit

    def partitions(self) -> list[_Part]:
        names = []
        for folder, folders, files in os.walk(self.root):
            folders[:] = [d for d in folders if d not in IGNORED]
            names += [os.path.relpath(os.path.join(folder, f), self.root).replace(os.sep, "/") for f in files if f not in IGNORED and suffix(f) in LANGUAGES]
        parts, held, size = [], [], 0
        for name in sorted(names):
            try:
                more = os.path.getsize(os.path.join(self.root, name))
            except OSError:
                continue
            if held and (len(held) == FILES_A_PARTITION or size + more > BYTES_A_PARTITION):
                parts.append(_Part(self.snapshot, tuple(held)))
                held, size = [], 0
            held.append(name)
            size += more if more <= self.limit else 0
        return [*parts, _Part(self.snapshot, tuple(held))]

    def read(self, partition: _Part):
        for name in partition.items:
            try:
                with open(os.path.join(self.root, name), "rb") as f:
                    data = f.read(self.limit + 1)
            except OSError:
                continue
            if len(data) <= self.limit:
                yield partition.snapshot, name, data


def suffix(name: str) -> str:
    """A name's last suffix in lower case; a leading dot starts none."""
    return PurePosixPath(name).suffix.lower()


class GitSource(DataSource):
    """format("git_tree").option("path", repository).option("commits", "sha,sha"): regular files of each commit.

    Each commit is a partition of its own; the repository is read by ``git archive`` and never checked out.  Links and
    other special members are skipped; unsafe names and too large trees fail.
    """

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options["path"], [s for s in self.options["commits"].split(",") if s])


class _GitReader(DataSourceReader):
    def __init__(self, root: str, commits: list[str]):
        self.root, self.commits = root, commits

    def partitions(self) -> list[_Part]:
        return [_Part(sha, ()) for sha in self.commits]

    def read(self, partition: _Part):
        run = subprocess.Popen(["git", "-C", self.root, "archive", "--format=tar", partition.snapshot], stdout=subprocess.PIPE, stderr=subprocess.PIPE)
        late = threading.Timer(GIT_SECONDS, run.kill)
        late.start()
        try:
            yield from ((partition.snapshot, name, data) for name, data in members(run.stdout, strict=False, stream=True) if wanted(name))
            run.stdout.read()  # what pads the archive
            failed = run.wait()
        except TreeError as e:
            # a git that fails writes no archive
            if e.code != "invalid-archive" or not run.wait():
                raise
            failed = run.returncode
        finally:
            late.cancel()
            run.kill()
            words = run.stderr.read().decode("utf-8", "replace")[:200]
            run.wait()
        if failed:
            raise TreeError("git-error", words)


def wanted(name: str) -> bool:
    """Whether a file of a tree is read: a known suffix and no ignored folder."""
    return suffix(name) in LANGUAGES and not set(PurePosixPath(name).parts) & set(IGNORED)


class TarballSource(DataSource):
    """format("source_tarball").option("path", "a.tar.gz,b.tar.gz"): each archive fails closed and is a partition of its own.

    All members lie under one folder, which is cut off; links and special members fail.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tarball"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TarballReader([p for p in self.options["path"].split(",") if p])


class _TarballReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[_Part]:
        return [_Part(p, ()) for p in self.paths]

    def read(self, partition: _Part):
        with open(partition.snapshot, "rb") as f:
            for name, content in members(f, strict=True):
                if wanted(name):
                    yield os.path.basename(partition.snapshot), name, content


def members(source, *, strict: bool, stream: bool = False, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES):
    """(path, content) of the regular files of a tar, given as bytes or as an open binary file, one at a time.

    strict: one top folder, which is cut off, and nothing but folders and files; else other members are skipped.
    stream: the file is a pipe without a way back.  A damaged or cut archive fails as invalid-archive.
    """
    seen, top, total = set(), None, 0
    opened = io.BytesIO(source) if isinstance(source, bytes) else source
    for m, read in _entries(opened, "r|*" if stream else "r:*"):
        if not m.isfile() and not m.isdir():
            if strict:
                raise TreeError("unsafe-archive", f"unsupported member type: {m.name!r}")
            continue
        parts = PurePosixPath(m.name).parts
        if not parts or "\x00" in m.name or "\\" in m.name or m.name.startswith("/") or ".." in parts or any(":" in p for p in parts):
            raise TreeError("unsafe-archive", f"unsafe path: {m.name!r}")
        if strict:
            top = top or parts[0]
            if parts[0] != top:
                raise TreeError("unsafe-archive", "more than one top-level folder")
            parts = parts[1:]
            if not parts and not m.isdir():
                raise TreeError("unsafe-archive", "top-level entry is no folder")
        if m.isdir():
            continue
        name = "/".join(parts)
        if name in seen:
            raise TreeError("unsafe-archive", f"duplicate path: {name}")
        seen.add(name)
        total += m.size
        if len(seen) > max_files:
            raise TreeError("too-many-files", f"over {max_files} files")
        if total > max_bytes:
            raise TreeError("extracted-too-large", f"over {max_bytes} bytes")
        yield name, read()


def _entries(source, mode: str):
    """(member, reader of its content) of a tar; what a damaged archive raises becomes a TreeError."""
    damage = (tarfile.TarError, EOFError, zlib.error, lzma.LZMAError, gzip.BadGzipFile)
    guarded = lambda call: _or_invalid(call, damage)
    archive = guarded(lambda: tarfile.open(fileobj=source, mode=mode))
    with archive:
        while (m := guarded(archive.next)) is not None:
            yield m, lambda m=m: guarded(lambda: archive.extractfile(m).read())
            archive.members = []  # headers of members that are done
        while guarded(lambda: archive.fileobj.read(1 << 20)):
            pass  # up to the checksum at the end


def _or_invalid(call, damage):
    try:
        return call()
    except damage as e:
        raise TreeError("invalid-archive", "not a readable tarball") from e


def check_tarball(path: str) -> int:
    """How many files a tarball has; fails as reading it would."""
    with open(path, "rb") as f:
        return sum(1 for _ in members(f, strict=True))


def checked(targets: DataFrame, path: str = "path") -> DataFrame:
    """``targets`` with code and message: why the tarball at ``path`` cannot be read, null if it can; read on the executors."""

    @F.pandas_udf("code string, message string")
    def check(paths):
        import pandas as pd

        def one(p):
            try:
                check_tarball(p)
            except (TreeError, OSError) as e:
                return getattr(e, "code", "unreadable"), str(e)
            return None, None

        return pd.DataFrame([one(p) for p in paths], columns=["code", "message"])

    free = targets.withColumn("_check", check(path))
    return free.select(*targets.columns, "_check.code", "_check.message")


def register(spark: SparkSession) -> None:
    """Makes the three formats known to a session."""
    for source in (FolderSource, GitSource, TarballSource):
        spark.dataSource.register(source)


def files(raw: DataFrame) -> DataFrame:
    """(snapshot_id, path, language, text, lines_of, lines, code_lines, bytes, imports) of raw (snapshot_id, path, content).

    Binary, too large and generated files and unknown suffixes are left out.  Bad UTF-8 is replaced.  code_lines of
    Python needs its parser: see parse.with_python_lines.
    """
    low = F.lower(F.regexp_extract("path", r"(?<=[^/])(\.[^./]+)$", 1))
    language = F.lit(None).cast("string")
    for end, name in LANGUAGES.items():
        language = F.when(low == end, name).otherwise(language)
    kept = raw.withColumn("language", language).where(
        F.col("language").isNotNull() & (F.octet_length("content") <= MAX_FILE_BYTES) & ~text.is_binary("content"))
    kept = kept.where(~F.exists(F.split("path", "/"), lambda p: p.isin(*IGNORED)))
    rows = kept.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).withColumn("lines_of", text.lines_of("text"))
    rows = rows.where(~text.looks_generated("lines_of"))
    return rows.select(
        "snapshot_id", "path", "language", "text", "lines_of", F.size("lines_of").alias("lines"), text.code_lines("lines_of", "language").alias("code_lines"),
        F.octet_length("content").cast("long").alias("bytes"), text.imports_of("text", "language").alias("imports"),
    )


def skipped_warnings(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """(snapshot_id, skipped): how many raw files were left out, for each snapshot that lost any."""
    counts = raw.groupBy("snapshot_id").agg(F.count("*").alias("a")).join(kept.groupBy("snapshot_id").agg(F.count("*").alias("b")), "snapshot_id", "left")
    return counts.select("snapshot_id", (F.col("a") - F.coalesce("b", F.lit(0))).alias("skipped")).where("skipped > 0")


def _git(root: str, *args: str) -> str:
    try:
        run = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=30)
    except FileNotFoundError as e:
        raise TreeError("git-not-found", "commits need git") from e
    except subprocess.TimeoutExpired as e:
        raise TreeError("git-timeout", " ".join(args)[:200]) from e
    if run.returncode:
        raise TreeError("git-error", run.stderr.strip()[:200])
    return run.stdout


def repository_root(path: str) -> str:
    """The top folder of the repository that ``path`` lies in; needs a git of MIN_GIT or newer."""
    if not os.path.isdir(path):
        raise TreeError("repository-missing", path)
    told = _git(path, "--version")
    version = re.search(r"(\d+)\.(\d+)", told)
    if not version or tuple(map(int, version.groups())) < MIN_GIT:
        raise TreeError("git-version", f"git {'.'.join(map(str, MIN_GIT))} or newer is needed, found {told.strip()!r}")
    root = _git(path, "rev-parse", "--show-toplevel").strip()
    if not os.path.isdir(root):
        raise TreeError("repository-missing", root)
    return root


def analyzer_revision(version: str) -> str:
    """The commit that this library is run from; ``release:version`` where it is no work tree."""
    here = os.path.dirname(os.path.abspath(__file__))
    for _ in range(5):
        if sha := static_sha(here):
            return sha
        here = os.path.dirname(here)
    return f"release:{version}"


def resolve_commit(root: str, ref: str) -> str:
    """The full hash of a ref."""
    sha = _git(root, "rev-parse", "--verify", "--end-of-options", f"{ref}^{{commit}}").strip().lower()
    if not re.fullmatch("[0-9a-f]{40}", sha):
        raise TreeError("invalid-commit", f"{ref!r} is no full commit hash")
    return sha


def commits(spark: SparkSession, root: str, last: str, *, first: str | None = None, limit: int = 50) -> DataFrame:
    """(frame, sha, authored_at, subject) of first-parent commits, oldest first.

    From ``first`` to ``last`` if given, which fails where that is more than ``limit``; else the last ``limit``.
    """
    if not 1 <= limit <= MAX_COMMITS:
        raise TreeError("invalid-limit", f"limit must be from 1 to {MAX_COMMITS}")
    root = repository_root(root)
    end = resolve_commit(root, last)
    shas = _git(root, "rev-list", "--first-parent", f"--max-count={limit + (first is not None)}", end).split()
    if first is not None:
        begin = resolve_commit(root, first)
        if begin not in shas:
            raise TreeError("history-range-too-large" if len(shas) > limit else "not-first-parent", f"{first!r} to {last!r}")
        shas = shas[: shas.index(begin) + 1]
        if len(shas) > limit:
            raise TreeError("history-range-too-large", f"{len(shas)} commits, limit {limit}")
    told = _git(root, "show", "-s", "--no-walk=unsorted", "--format=%H%x00%aI%x00%s", *reversed(shas)).splitlines()
    rows = [(k, *line.split("\x00", 2)) for k, line in enumerate(told)]
    return spark.createDataFrame(rows, "frame int, sha string, authored_at string, subject string")


def _git_bytes(root: str, *args: str, given: bytes | None = None) -> bytes:
    run = subprocess.run(["git", "-C", root, *args], input=given, capture_output=True, timeout=GIT_SECONDS)
    if run.returncode:
        raise TreeError("git-error", run.stderr.decode("utf-8", "replace").strip()[:200])
    return run.stdout


def _changed(root: str, sha: str, before: str | None) -> list[tuple[str, str | None]]:
    """(path, blob) of the files that a commit has new or otherwise than the one before, null where one is gone.

    Only regular files count; links and other entries are as good as gone.
    """
    if before is None:
        # the first tree is judged whole, as an archive is; later ones are told by what differs
        told = _git_bytes(root, "ls-tree", "-r", "-l", "-z", "--full-tree", sha).split(b"\0")
        entries = [(head.split()[0], head.split()[2], path) for head, _, path in (t.partition(b"\t") for t in told if t)]
        if sum(int(t.split()[3]) for t in told if t.startswith(b"100")) > MAX_BYTES:
            raise TreeError("extracted-too-large", f"over {MAX_BYTES} bytes")
    else:
        told = _git_bytes(root, "diff-tree", "-r", "-z", "--no-renames", "--no-commit-id", before, sha).split(b"\0")
        entries = [(head.split()[1], head.split()[3], path) for head, path in zip(told[::2], told[1::2], strict=False)]
    if len(entries) > MAX_FILES:
        raise TreeError("too-many-files", f"over {MAX_FILES} files")
    out = [(path.decode("utf-8", "replace"), blob.decode() if mode.startswith(b"100") else None) for mode, blob, path in entries]
    for path, _ in out:
        if "\\" in path or ":" in path:
            raise TreeError("unsafe-archive", f"unsafe path: {path!r}")
    return out


def commit_runs(spark: SparkSession, root: str, shas: list[str]) -> DataFrame:
    """(path, blob, first, last): in which of the given commits, counted from 0, each content of a path stands without a break.

    A commit is compared with the one before it, each in a task of its own, so the work follows the files that change.  Only
    ``wanted`` files and attribute files are told.
    """
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for frame, sha, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(frame, path, blob) for path, blob in _changed(root, sha, before) if wanted(path) or path.rsplit("/", 1)[-1] == ".gitattributes"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string()), strict=True)],
                        names=["frame", "path", "blob"])

    steps = spark.createDataFrame([(k, sha, shas[k - 1] if k else None) for k, sha in enumerate(shas)], "frame int, sha string, before string")
    told = steps.repartition(max(1, len(shas)), "frame").mapInArrow(run, "frame int, path string, blob string")
    until = F.coalesce(F.lead("frame").over(W.partitionBy("path").orderBy("frame")) - 1, F.lit(len(shas) - 1))
    return told.select("path", "blob", F.col("frame").alias("first"), until.alias("last")).where("blob is not null")


def blobs(root: str, wanted_: DataFrame) -> DataFrame:
    """(snapshot_id, path, content) of (path, blob), the blob in the place of the snapshot; those over MAX_FILE_BYTES are left out."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            paths, names = (c.to_pylist() for c in batch.columns)
            told = _git_bytes(root, "cat-file", "--batch-check=%(objectsize)", given="\n".join(names).encode() + b"\n").split()
            sizes = [int(t) for t in told]
            order, at = [i for i, n in enumerate(sizes) if n <= MAX_FILE_BYTES], 0
            while at < len(order):
                end, held = at, 0
                while end < len(order) and (end == at or held + sizes[order[end]] <= BYTES_A_PARTITION):
                    held += sizes[order[end]]
                    end += 1
                part = order[at:end]
                data, place, contents = _git_bytes(root, "cat-file", "--batch", given="\n".join(names[i] for i in part).encode() + b"\n"), 0, []
                for i in part:
                    place = data.index(b"\n", place) + 1
                    contents.append(data[place : place + sizes[i]])
                    place += sizes[i] + 1
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in part]), pa.array([paths[i] for i in part]), pa.array(contents, pa.binary())],
                    names=["snapshot_id", "path", "content"])
                at = end

    return wanted_.select("path", "blob").distinct().mapInArrow(run, SCHEMA)


def static_sha(root: str) -> str | None:
    """The commit of a work tree's HEAD by plain file reads; null if there is none."""
    git = os.path.join(root, ".git")
    try:
        if os.path.isfile(git):
            with open(git) as f:
                git = os.path.join(root, f.read().split(":", 1)[1].strip())
        with open(os.path.join(git, "HEAD")) as f:
            head = f.read().strip()
        if not head.startswith("ref:"):
            return head if re.fullmatch("[0-9a-f]{40}", head) else None
        ref = head[4:].strip()
        common = git
        if os.path.isfile(os.path.join(git, "commondir")):
            with open(os.path.join(git, "commondir")) as f:
                common = os.path.normpath(os.path.join(git, f.read().strip()))
        for base in (git, common):
            if os.path.isfile(os.path.join(base, ref)):
                with open(os.path.join(base, ref)) as f:
                    return f.read().strip()
        with open(os.path.join(common, "packed-refs")) as f:
            return next((line.split()[0] for line in f if line.rstrip().endswith(" " + ref)), None)
    except (OSError, IndexError):
        return None
