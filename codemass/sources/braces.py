"""Symbols, calls and imports of languages whose blocks stand in braces: nesting by counted brackets, no syntax tree.

A text loses its comments and the insides of its strings (line ends stay), and is cut after each bracket and semicolon into
rows.  Brackets open around a row give its level.  Among the rows of one level a bracket's partner is the next row, and what
stands since the last semicolon or brace is a bracket's head, in which brackets closed before are empty.  A head that reads
like a declaration makes a symbol.  Declarations open around a row give its depth in them, and the last one that opened that
depth is its scope.  It is one walk over a file's rows, where the file is, many files a batch; texts go no further.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codemass.functions.checkpoint import checkpointed
from codemass.functions.spread import spread

SNAP = "snapshot_id"
_FILE = [SNAP, "path"]
LANGUAGES = ("c", "cpp", "csharp", "java", "go", "rust", "javascript", "typescript", "tsx")
_SCRIPTS = ("javascript", "typescript", "tsx")
#: Kinds whose bodies hold members, not statements.
_BODIES = ("class", "interface", "struct", "enum", "trait")

# possessive throughout, so that no text makes a match run back over it
_COMMENT = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\Z)"
_DOUBLE = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"?'
_SINGLE = r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'?"
_BACK = r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`?"
#: What starts a comment, a directive and a string in each language, before anything else.
_PIECES = {
    "c": rf"{_COMMENT}|#[^\n\\]*+(?:\\(?s:.)[^\n\\]*+)*+|{_DOUBLE}|{_SINGLE}",
    "csharp": rf'{_COMMENT}|#[^\n]*+|\$?@\$?"[^"]*+(?:""[^"]*+)*+"?|\$?{_DOUBLE}|{_SINGLE}',
    "java": rf'{_COMMENT}|"""(?s:.*?)(?:"""|\Z)|{_DOUBLE}|{_SINGLE}',
    "go": rf"{_COMMENT}|`[^`]*+`?|{_DOUBLE}|{_SINGLE}",
    "rust": rf"{_COMMENT}|(?u:\b)[bc]?r(#*)\"(?s:.*?)(?:\"\1|\Z)|{_DOUBLE}|'(?:\\[^\n']{{1,9}}|\\'|[^'\\\n])'",
    "javascript": rf"{_COMMENT}|{_DOUBLE}|{_SINGLE}|{_BACK}",
}
_PIECES |= {k: _PIECES["javascript"] for k in _SCRIPTS} | {"cpp": _PIECES["c"]}
#: Runs of anything else: strings of two languages may also start with a letter or sign, where a word or a run of signs starts.
_RUNS = {
    "csharp": r"""(?:(?!\$?@\$?"|\$")[^"'`/#\w]++|[\w$]++)++""",
    "rust": r"""(?:[^"'`/#\w]++|(?!(?u:\b)[bc]?r#*")[\w$]++)++""",
}
# a slash where an expression begins starts a pattern
_PATTERN = r"/[^/\\\[\n*]*+(?:(?:\\[^\n\r\x85\u2028\u2029]|\[[^\]\\\n]*+(?:\\[^\n\r\x85\u2028\u2029][^\]\\\n]*+)*+\])[^/\\\[\n]*+)*+/"
_EXPRESSION = frozenset("(,=:[!&|?{};+")
#: A slash that may start a pattern: none that starts or ends a comment.
_SLASH = re.compile(r"(?<![*/])/(?![*/])")
_IMPORTS = {
    "c": r"#\s*include\s*[<\"][^>\"\n]++[>\"]",
    "java": r"(?m)^[ \t]*(import\s+[\w.*\s]+);",
    "csharp": r"(?m)^[ \t]*(?:global\s+)?(using\s+(?:static\s+)?[\w.]+(?:\s*=\s*[\w.<>]+)?)\s*;",
    "go": r"(?m)^[ \t]*(import\s*(?:\([^)]*\)|[\w.]*\s*[\"`][^\"`\n]*[\"`]))",
    "rust": r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(use\s+[^;]+);",
    "javascript": r"(?m)^[ \t]*(import\b[^;'\"()]*['\"][^'\"\n]+['\"])",
}
_IMPORTS |= {k: _IMPORTS["javascript"] for k in _SCRIPTS} | {"cpp": _IMPORTS["c"]}

_BEGIN = r"(?:^|\n|[;}\]]\s)\s*"
_SCRIPT = (
    ("function", _BEGIN + r"((?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)\s*(?:<[^(){}]*>)?\s*\(\)[^(){};]*\{)$"),
    ("class", _BEGIN + r"(?:@[\w.]+(?:\(\))?\s*)*((?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+([\w$]+)[^{}=;]*\{)$"),
    ("interface", _BEGIN + r"((?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+([\w$]+)[^(){};]*\{)$"),
    ("enum", _BEGIN + r"((?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+([\w$]+)\s*\{)$"),
    ("method", r"(?:^|\n|[,)])\s*((?:(?:public|private|protected|static|async|get|set|override)\s+)*\*?\s*(#?[\w$]+)\s*(?:<[^(){}]*>)?\s*\(\)\s*(?::[^(){}=;,]*)?\{)$"),
)
#: Kinds of declarations by language, with the pattern of a head: the declaration, and in it the name.
_HEADS = {
    "c": (
        ("function", r"^\s*([A-Za-z_][\w\s*]*?[\s*](\w+)\s*\(\)\s*(?:__attribute__\s*\(\)\s*)?\{)$"),
        ("struct", r"(\bstruct\s+(\w+)\s*\{)$"),
        ("enum", r"(\benum\s+(\w+)\s*\{)$"),
    ),
    "cpp": (
        ("class", r"((?:template\s*<[^(){};]*>\s*)?\b(?<!enum\s)class\s+(\w+)[^(){};=]*\{)$"),
        ("struct", r"((?:template\s*<[^(){};]*>\s*)?\b(?<!enum\s)struct\s+(\w+)[^(){};=]*\{)$"),
        ("enum", r"(\benum\s+(?:class\s+|struct\s+)?(\w+)[^(){};=]*\{)$"),
        ("namespace", r"(\bnamespace\s+([\w:]+)\s*\{)$"),
        ("function", r"(?:^|\b(?:public|private|protected)\s*:)\s*((?:template\s*<[^(){};]*>\s*)?[A-Za-z_][\w\s*&:<>,]*?[\s*&>](~?\w[\w:~]*)\s*\(\)\s*(?:(?:const|noexcept|override|final|try)\b\s*)*(?:->[^(){};=]*)?\{)$"),
        ("function", r"(?:^|\b(?:public|private|protected)\s*:)\s*((?:explicit\s+)?(~?\w[\w:~]*)\s*\(\)\s*(?:noexcept\s*)?(?::[^{};=]*)?\{)$"),
    ),
    "csharp": tuple((kind, r"^\s*((?:[^(){};=]|\(\))*?(?<!\.)" + rf"\b{word}\s+(\w[\w.]*)(?:[^(){{}};=]|\(\))*\{{)$")
        for kind, word in (("class", "class"), ("interface", "interface"), ("struct", "struct"), ("struct", "record"), ("enum", "enum"), ("namespace", "namespace"))) + (
        ("property", r"^\s*((?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|virtual|override|sealed|abstract|required|new)\s+)+[A-Za-z_][\w.<>,?\[\]\s]*?[\s>\]?](\w+)\s*\{)$"),
        ("constructor", r"^\s*((?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static)\s+)+([A-Z]\w*)\s*\(\)\s*(?::\s*(?:base|this)\s*\(\)\s*)?\{)$"),
        ("method", r"^\s*((?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|virtual|override|sealed|abstract|async|partial|extern|unsafe|new)\s+)*[A-Za-z_][\w.<>,?\[\]\s]*?[\w>\]?]\s+(\w+)\s*(?:<[\w,\s]*>)?\s*\(\)\s*(?:where\s[^(){};=]*)?[{;])$"),
    ),
    "java": (
        ("class", r"^\s*((?:[^(){};=]|\(\))*?\bclass\s+(\w+)[^(){};=]*\{)$"),
        ("interface", r"^\s*((?:[^(){};=]|\(\))*?(?<!@)\binterface\s+(\w+)[^(){};=]*\{)$"),
        ("enum", r"^\s*((?:[^(){};=]|\(\))*?\benum\s+(\w+)[^(){};=]*\{)$"),
        ("struct", r"^\s*((?:[^(){};=]|\(\))*?\brecord\s+(\w+)\s*(?:<[^(){}]*>)?\s*\(\)[^(){};=]*\{)$"),
        ("constructor", r"^\s*((?:@[\w.]+(?:\(\))?\s+)*(?:(?:public|private|protected)\s+)?(?:<[^(){}=]*>\s*)?([A-Z]\w*[a-z]\w*|[A-Z])\s*\(\)\s*(?:throws\s[^(){}=]*)?\{)$"),
        ("method", r"^\s*((?:@[\w.]+(?:\(\))?\s+)*(?:(?:public|private|protected|static|final|abstract|default|synchronized|native|strictfp)\s+)*(?:<[^(){}=]*?>\s*)?[A-Za-z_$][\w$.<>,?\[\]&\s]*?[\w$>\]]\s+(\w+)\s*\(\)\s*(?:throws\s[^(){}=]*)?[{;])$"),
        ("method", r"^\s*((?:@[\w.]+(?:\(\))?\s+)*(?:(?:public|private|protected|static|final|abstract|default)\s+)*[\w$]\s+(\w+)\s*\(\)\s*(?:throws\s[^(){}=]*)?[{;])$"),
    ),
    "go": (
        ("function", r"(?:^|\n|;)\s*(func\s+(\w+)\s*(?:\[[^\]]*\])?\s*\(\)[^{};]*\{)$"),
        ("method", r"(?:^|\n|;)\s*(func\s*\(\)\s*(\w+)\s*\(\)[^{};]*\{)$"),
    ),
    "rust": (
        ("function", _BEGIN + r"((?:pub(?:\(\))?\s+)?(?:(?:default|const|async|unsafe|extern)\s+(?:\"\"\s*)?)*fn\s+(\w+)[^{};]*?\(\)[^{};]*[{;])$"),
        ("struct", _BEGIN + r"((?:pub(?:\(\))?\s+)?struct\s+(\w+)[^{};=]*[{;])$"),
        ("enum", _BEGIN + r"((?:pub(?:\(\))?\s+)?enum\s+(\w+)[^{};=]*\{)$"),
        ("trait", _BEGIN + r"((?:pub(?:\(\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)[^{};=]*\{)$"),
    ),
} | {k: _SCRIPT for k in _SCRIPTS}
#: Words of the languages that stand before a bracket but call and declare nothing.
_WORDS = ("if", "for", "while", "switch", "return", "else", "do", "case")
_OWN_WORDS = {
    "c": ("sizeof", "typeof", "alignof", "defined"),
    "go": ("func", "go", "defer", "range", "select", "chan", "interface", "struct", "map", "var", "const", "type", "import"),
    "rust": ("fn", "match", "loop", "in", "as", "where", "impl", "pub", "unsafe", "move", "let", "mut", "ref", "dyn", "async", "await"),
    "java": ("catch", "try", "synchronized", "new", "throw", "super", "assert", "instanceof"),
    "javascript": ("catch", "with", "function", "new", "throw", "super", "await", "typeof", "in", "of", "yield", "delete", "void", "instanceof", "import", "var", "let", "const", "async"),
}
_OWN_WORDS["cpp"] = (*_OWN_WORDS["c"], "catch", "new", "delete", "throw", "noexcept", "decltype", "operator", "static_assert", "alignas", "requires")
_OWN_WORDS["csharp"] = (*_OWN_WORDS["java"], "foreach", "using", "lock", "typeof", "nameof", "await", "fixed", "when", "default", "base", "in", "is", "as", "checked", "unchecked")
_OWN_WORDS |= {k: _OWN_WORDS["javascript"] for k in _SCRIPTS}
_CHAINED = r"^\s*(?:\?\.|\.|->|::)([A-Za-z_$][\w$]*+)(?:(?:::)?<[^<>()]*>)?\s*$"
_CALLEE = r"(?<![\w$@.])((?:[A-Za-z_$][\w$]*+)(?:(?:\.|::|->|\?\.)#?[A-Za-z_$][\w$]*+)*+)(?:(?:::)?<[^<>()]*>)?!?\s*$"


_QUOTED = re.compile(r"""(?:[$@]{0,2}["'`]|[bc]?r#*"|/[^/*\s][^\n\r\x85\u2028\u2029]*/\Z)""", re.ASCII)
_SKIPPED = re.compile(r"//|/\*|#[^\n\r\x85\u2028\u2029]")
_ROWS = re.compile(r"[^{}();]*+[{}();]")
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_STATED = re.compile(r"(?:return|throw|new|else|case|await|yield|typeof|goto)(?u:\b)", re.ASCII)
_MADE = re.compile(r"(?u:\b)(?:new|function|func|fn)\s+[\w$.:<>]*\s*[\x85\u2028\u2029]?\Z|#!?\[[^\]]*\Z", re.ASCII)
_GENERIC = re.compile(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>")
_BASES = (("inherits", "extends", r"(?u:\b)implements(?u:\b)|(?u:\b)permits(?u:\b)"), ("implements", "implements", r"(?u:\b)permits(?u:\b)"))
_BASES = tuple((kind, re.compile(rf"(?u:\b){word}\s+([^{{}}]+?)\s*(?:{stop}|\{{)", re.ASCII)) for kind, word, stop in _BASES)
#: Declarations as they are found: what a list has at each place.
_POS, _KIND, _NAME, _HEAD, _START, _END, _AT, _DELIM, _SCOPE, _QUALIFIED = range(10)
#: Files, and rows of them, that are held at once.
_FILES, _HELD = 64, 10_000


def _compiled(pattern: str) -> re.Pattern:
    """Words and spaces of ASCII, edges of words of Unicode, lines that any line end begins."""
    pattern = pattern.replace(r"\b", r"(?u:\b)").replace("(?m)^", r"(?:\A|(?<=[\n\r\x85\u2028\u2029]))")
    if pattern.endswith(r"\s*$"):
        pattern = pattern[:-1] + r"[\x85\u2028\u2029]?\Z"
    return re.compile(pattern, re.ASCII)


class _Language:
    def __init__(self, name: str):
        self.name, self.script = name, name in _SCRIPTS
        pieces = _PIECES[name]
        self.pieces = re.compile(pieces + (f"|(?P<run>{_RUNS[name]})" if name in _RUNS else ""), re.ASCII)
        self.with_patterns = re.compile(f"{_COMMENT}|({_PATTERN}){pieces[len(_COMMENT):]}", re.ASCII) if self.script else None
        #: whether all heads are read from their first word on
        self.anchored = name in ("java", "csharp")
        self.words = frozenset((*_WORDS, *_OWN_WORDS[name]))
        #: kind, pattern, a word that it cannot do without, and whether a declaration may end at a semicolon
        self.heads = []
        for kind, pattern in _HEADS[name]:
            word = re.search(r"(?<!\w)(class|interface|struct|enum|record|namespace|trait|function|func|fn)\\s", re.sub(r"\(\?<!.*?\)", " ", pattern.replace(r"\b", " ")))
            self.heads.append((kind, _compiled(pattern).search, word and word[1], pattern.endswith(r"[{;])$")))
        self.imports, self.import_group = _compiled(_IMPORTS[name]), 0 if name in ("c", "cpp") else 1
        self.import_word = {"c": "include", "cpp": "include", "csharp": "using", "rust": "use"}.get(name, "import")

    def replaced(self, text: str, one) -> str:
        """``text`` with every comment, directive and string put through ``one``."""
        if not (self.script and _SLASH.search(text)):
            return self.pieces.sub(one, text)
        out, done, at = [], 0, 0
        while m := self.with_patterns.search(text, at):
            a, at = m.span()
            if m[1] is not None:
                before = text[max(0, a - 10) : a].rstrip(" \t\n\x0b\f\r")
                if not before or before[-1] not in _EXPRESSION:
                    at = a + 1
                    continue
            out += (text[done:a], one(m))
            done = at
        return "".join([*out, text[done:]])

    def declared(self, head: str, delim: str) -> tuple[str, str, str] | None:
        """Kind, name and text of the declaration that a head is."""
        if self.anchored and _STATED.match(head.lstrip(" \t\n\x0b\f\r")):
            return None
        for kind, search, word, ends in self.heads:
            if (ends or delim == "{") and (word is None or word in head) and (m := search(head)):
                name, whole = m[2], m[1]
                if name and name not in self.words and not _STATED.match(whole):
                    return kind, name, whole
        return None

    def target(self, text: str) -> str | None:
        """What stands before a round bracket, if that is called."""
        end = text.rstrip(" \t\n\x0b\f\r\x85\u2028\u2029")[-1:]
        if not (end and end.isascii() and (end.isalnum() or end in "_$>!")):
            return None
        m = _CALLEE.search(text)
        callee = m[1] if m else ""
        if callee:
            name = callee.rsplit(".", 1)[-1] if self.name == "java" else callee
        elif m := _CHAINED.search(text):
            name = m[1] if self.name == "java" else "()." + m[1]
        else:
            return None
        if callee in self.words or ("new" in text or "fn" in text or "func" in text or "[" in text) and _MADE.search(text):
            return None
        return name if len(name) <= 180 else _compact(name)


_CALLEE, _CHAINED = _compiled(_CALLEE), _compiled(_CHAINED)
_language = cache(_Language)


def _compact(reference: str) -> str:
    """A reference on one line, at most 180 characters."""
    t = _SPACE.sub(" ", reference).strip(" ")
    return t if len(t) <= 180 else t[:177] + "..."


def _blank(m: re.Match) -> str:
    """A comment's or directive's line ends; an empty string and the line ends of a string; else the piece."""
    p = m[0]
    if "run" in m.re.groupindex and m["run"] is not None:
        return p
    if _SKIPPED.match(p):
        return "\n" * p.count("\n")
    if len(p) > 1 and _QUOTED.match(p):
        return '""' + "\n" * p.count("\n")
    return p


def _uncommented(m: re.Match) -> str:
    return " " if m[0].startswith(("//", "/*")) else m[0]


def walk(text: str, language: str) -> tuple[list[list], list[tuple], bool]:
    """Declarations, calls (position, target, scope) of a text and whether its brackets do not match.

    Rows of a level are told by ``statements`` (pieces and round brackets since the last stop), ``waiting`` (a declaration whose
    partner may be next) and ``opened`` (whether the last row opens a declaration).
    """
    tools = _language(language)
    plain = tools.replaced(text, _blank) + ";"
    decls, calls, statements, waiting, opened, marks = [], [], {}, {}, {}, {}
    line, level, depth, low = 1, 0, 0, 0

    def called(brackets: list, first: int | None) -> None:
        for pos, t, scope, at_depth in brackets:
            if (first is None or pos < first) and not (language == "c" and not at_depth) and not (scope and scope[_KIND] in _BODIES and "=" not in t):
                target = tools.target(t)
                if target is not None:
                    calls.append((pos, target, scope))

    for pos, row in enumerate(_ROWS.findall(plain)):
        delim, begun = row[-1], line
        line += row.count("\n")
        if delim == "}" or delim == ")":
            level -= 1
            if level < low:
                low = level
            if ended := waiting.get(level):
                ended[_END] = line
                waiting[level] = None
            if opened.get(level):
                depth -= 1
                opened[level] = False
            have = statements.get(level)
            if delim == "}":
                if have:
                    called(have[1], None)
                    del statements[level]
            elif have:
                have[0].append((delim, line, pos))
            else:
                statements[level] = ([(delim, line, pos)], [])
            continue
        have = statements.get(level)
        if have is None:
            have = statements[level] = ([], [])
        pieces, brackets = have
        pieces.append((row, begun, pos))
        waiting[level], opened[level] = None, False
        if delim == "(":
            brackets.append((pos, row[:-1], marks[depth] if depth else None, depth))
        else:
            head = "".join([p[0] for p in pieces]) if len(pieces) > 1 else row
            first = None
            if found := tools.declared(head, delim):
                kind, name, whole = found
                offset, n, start = len(head) - len(whole), 0, 1
                for s, at, p in pieces:
                    if n > offset:
                        break
                    first, start = p, at + s.count("\n", 0, offset - n)
                    n += len(s)
                scope = marks[depth] if depth else None
                decl = [pos, kind, name, whole, start, None, line, delim, scope, f"{scope[_QUALIFIED]}.{name}" if scope else name]
                decls.append(decl)
                waiting[level] = decl
                if delim == "{":
                    opened[level] = True
                    depth += 1
                    marks[depth] = decl
            if brackets:
                called(brackets, first)
            del statements[level]
            if delim == ";":
                continue
        # an open bracket also begins the level inside of it
        level += 1
        if have := statements.pop(level, None):
            called(have[1], None)
        waiting[level] = None
    for _, brackets in statements.values():
        called(brackets, None)
    return decls, calls, level != 0 or low < 0


def _id(path: str, decl: list | None) -> str:
    return f"{path}::{decl[_QUALIFIED]}@{decl[_START]}" if decl else f"{path}::<file>"


def _last_line(decl: list, lines: int) -> int:
    return decl[_AT] if decl[_DELIM] == ";" else decl[_END] if decl[_END] is not None else lines


def _file_rows(path: str, language: str, text: str, lines: int):
    """The rows of one file, as dicts."""
    file_id = _id(path, None)
    yield {"row": "symbol", "seq": 0, "id": file_id, "kind": "file", "name": path.rsplit("/", 1)[-1], "qualified_name": path, "start_line": 1, "end_line": lines}
    decls, calls, odd = walk(text, language)
    if odd:
        yield {"row": "diagnostic", "seq": 1, "message": "brackets do not match; partial graph retained", "severity": "warning"}
    bases = 3 << 22
    for d in decls:
        key, parent, seq = _id(path, d), _id(path, d[_SCOPE]), d[_POS] * 4 + 4
        yield {"row": "symbol", "seq": seq, "id": key, "kind": d[_KIND], "name": d[_NAME], "qualified_name": d[_QUALIFIED], "start_line": d[_START],
            "end_line": _last_line(d, lines), "parent_id": parent}
        yield {"row": "edge", "seq": seq + 1, "id": parent, "kind": "contains", "target_name": d[_QUALIFIED], "target_id": key, "resolution": "exact",
            "evidence": f"brace nesting {d[_KIND]} containment"}
        if language == "java":
            bare = _GENERIC.sub(" ", d[_HEAD])
            for kind, pattern in _BASES:
                for name in re.split(r"[ \t-\r]*,[ \t-\r]*", m[1]) if (m := pattern.search(bare)) else ():
                    if name:
                        bases += 1
                        yield {"row": "edge", "seq": bases, "id": key, "kind": kind, "target_name": _compact(name), "resolution": "unresolved", "evidence": f"declaration {kind}"}
    for pos, target, scope in calls:
        yield {"row": "edge", "seq": pos * 4 + 7, "id": _id(path, scope), "kind": "calls", "target_name": target, "resolution": "unresolved", "evidence": "call before a bracket"}
    tools = _language(language)
    if tools.import_word in text:
        for k, m in enumerate(tools.imports.finditer(tools.replaced(text, _uncommented))):
            yield {"row": "edge", "seq": (1 << 23) + k, "id": file_id, "kind": "imports", "target_name": _compact(m[tools.import_group].strip(" ")), "resolution": "unresolved",
                "evidence": "import statement"}


def _file_outline(path: str, language: str, text: str, lines: int):
    """The symbols of one file with their calls, in the order of ``_OUTLINE``; of those with one id the greatest."""
    decls, calls, _ = walk(text, language)
    have: dict[tuple, tuple] = {}
    for d in decls:
        key, own = (d[_QUALIFIED], d[_START]), (d[_KIND], d[_QUALIFIED], d[_START], _last_line(d, lines))
        have[key] = max(have.get(key, own), own)
    count, first = dict.fromkeys(have, 0), {}
    for _, target, scope in calls:
        if scope:
            key = scope[_QUALIFIED], scope[_START]
            count[key] += 1
            if key not in first or target < first[key]:
                first[key] = target
    for key, (kind, qualified, start, end) in have.items():
        yield path, kind, qualified, start, end, count[key], first.get(key)


def _over_files(files: DataFrame, each, schema: str) -> DataFrame:
    """What ``each`` makes of every file in LANGUAGES, behind its snapshot_id."""
    sources = files.where(F.col("language").isin(*LANGUAGES)).select(*_FILE, "language", F.coalesce("text", F.lit("")).alias("text"),
        F.greatest(F.lit(1), F.col("lines")).cast("int").alias("lines"))

    def run(batches):
        import pyarrow as pa

        kinds = {c: {"bigint": pa.int64(), "int": pa.int32()}.get(k, pa.string()) for c, k in (x.split() for x in schema.split(","))}
        held = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], names=list(kinds))
        for batch in batches:
            for at in range(0, batch.num_rows, _FILES):
                for s, path, language, text, lines in zip(*(c.to_pylist() for c in batch.slice(at, _FILES).columns), strict=True):
                    for row in each(path, language, text, lines):
                        held.append((s, *row))
                        if len(held) >= _HELD:
                            yield made()
                            held.clear()
        if held:
            yield made()

    return sources.mapInArrow(run, schema)


_ROW = ("snapshot_id string, path string, language string, row string, seq bigint, id string, kind string, name string, qualified_name string, start_line int, end_line int,"
    " parent_id string, target_name string, target_id string, resolution string, evidence string, message string, severity string")
_OUTLINE = "snapshot_id string, path string, kind string, qualified_name string, start_line int, end_line int, calls bigint, first_call string"


def rows_of(files: DataFrame) -> DataFrame:
    """Rows (symbol, edge, diagnostic) of all files in LANGUAGES: snapshot_id, path, language, text, lines.

    Classes, interfaces, records, structs, enums, traits, functions, methods and constructors are symbols from their first line to
    their closing brace (to the semicolon where there is no body); calls and imports are unresolved relationships of the
    innermost symbol and of the file.  Null and empty texts keep the file's symbol alone.  A text whose brackets do not match keeps
    what was found, with a warning; a bracket that is never closed reaches to the last line.
    """
    # texts are spread before they are walked; what is found is written, without them, as symbols and edges are read apart
    names = [c.split()[0] for c in _ROW.split(",")][3:]
    each = lambda path, language, text, lines: ((path, language, *map(r.get, names)) for r in _file_rows(path, language, text, lines))
    return checkpointed(_over_files(spread(files, *_FILE), each, _ROW))


def outlines(files: DataFrame) -> DataFrame:
    """(snapshot_id, path, kind, qualified_name, start_line, end_line, calls, first_call) of the symbols in ``files`` but files: how many
    calls each makes itself, and the first of them in order of names.  ``files`` as for ``rows_of``; they are walked where they are.
    """
    return _over_files(files, _file_outline, _OUTLINE)
