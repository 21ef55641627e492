"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard
parser evaluates the and/or/with expressions that follow a tag.

The automaton reads each text as its lower-cased words, one space apart, so a phrase is found wherever
its words stand consecutively, whatever punctuation or line break lies between.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codemass.llm import text as X
from codemass.llm.frames import append_columns

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: More notice phrases, for the labels of this scan's own.
NOTICES = {
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "boost software license": "bsl",
    "creative commons zero": "cc0", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd",
    "all rights reserved": "proprietary", "isc license": "isc",
    "permission is hereby granted free of charge": "mit", "public domain": "public-domain",
}
TAG = "spdx license identifier"
_TAG_RAW = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\n\r]*)")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+\-:]+")
#: Identifier prefix to label; the first that fits holds, else the identifier itself is the label.
FAMILIES = (("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"), ("mpl", "mpl"),
    ("cc-by-nc", "cc-by-nc"), ("cc-by-sa", "cc-by-sa"), ("cc-by-nd", "cc-by-nd"), ("cc-by", "cc-by"), ("cc0", "cc0"), ("bsl", "bsl"), ("isc", "isc"))
#: Binding strength of the operators, loosest first.
STRENGTH = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    """The label of a licence identifier: its family's, else itself."""
    low = identifier.lower()
    return next((to for start, to in FAMILIES if low == start or low.startswith((start + "-", start + "+", start + "."))), low.rstrip("+"))


def evaluate(expression: str) -> tuple[frozenset[str], frozenset[str]] | None:
    """All labels of a licence expression, and those that hold whichever alternative is chosen; None if malformed.

    ``with`` binds an exception to its licence and adds no label; ``and`` joins obligations, ``or`` offers a choice.
    """
    output: list[tuple[frozenset[str], frozenset[str]]] = []
    operators: list[str] = []

    def apply() -> bool:
        if len(output) < 2:
            return False
        right, left, op = output.pop(), output.pop(), operators.pop()
        if op == "with":
            output.append(left)
        else:
            output.append((left[0] | right[0], left[1] & right[1] if op == "or" else left[1] | right[1]))
        return True

    operand = True  # the next token has to be an operand or "("
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low == "(":
            if not operand:
                return None
            operators.append(low)
        elif low == ")":
            if operand:
                return None
            while operators and operators[-1] != "(":
                if not apply():
                    return None
            if not operators:
                return None
            operators.pop()
        elif low in STRENGTH:
            if operand:
                return None
            while operators and operators[-1] != "(" and STRENGTH[operators[-1]] >= STRENGTH[low]:
                if not apply():
                    return None
            operators.append(low)
            operand = True
        else:
            if not operand:
                break  # the expression has ended; the rest of the line is other text
            output.append((frozenset([label_of(low)]),) * 2)
            operand = False
    while operators:
        if operators[-1] == "(" or not apply():
            return None
    return output[0] if len(output) == 1 and not operand else None


_AUTOMATON = None


def automaton():
    """The automaton over ' phrase ', one for each worker."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for phrase, label in [*NOTICES.items(), *BASE.items(), (TAG, "")]:
            _AUTOMATON.add_word(f" {phrase} ", (phrase, label))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def scan_words(normal: str, raw: str) -> tuple[int, int | None, int | None, str, str, float, str, str, list[tuple[int, str]]]:
    """Of a text as ' word word ... ': base places, first and last start, base labels, labels, score, required, choices, all places."""
    places, own, tagged = [], set(), False
    words = at = 0  # words that have ended before ``at``
    for end, (phrase, label) in automaton().iter(normal):
        words, at = words + normal.count(" ", at, end), end
        places.append((words - phrase.count(" ") - 1, phrase))
        if phrase == TAG:
            tagged = True
        else:
            own.add(label)
    certain, chosen = False, set()
    required = set(own)
    if tagged:
        for m in _TAG_RAW.finditer(raw.translate(_LOWER)):
            if value := evaluate(m[1]):
                certain = True
                own |= value[0]
                required |= value[1]
                chosen |= value[0] - value[1]
    base = sorted(p for p, phrase in places if phrase in BASE)
    labels = sorted({BASE[phrase] for _, phrase in places if phrase in BASE})
    hits = sum(phrase != TAG for _, phrase in places)
    score = 1.0 if certain else hits / (hits + 1.0)
    joined = [",".join(sorted(x)) for x in (own, required, chosen - required)]
    return len(base), base[0] if base else None, base[-1] if base else None, ",".join(labels), joined[0], score, joined[1], joined[2], sorted(places)


_LOWER = {i: i + 32 for i in range(65, 91)}


def scan_licenses(docs: DataFrame, *, text: str = "text", with_places: bool = False) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score, required and choices of each whole text.

    n_base counts every place of a base phrase; first_word and last_word are the least and greatest word number
    of those places (null without any).  labels also holds those of the other notices and of tag expressions.
    score is 1 for a well-formed tag expression, else hits / (hits + 1).  required holds the labels that bind whichever way the
    text's tag expressions are chosen (notices bind), choices the other labels: MIT OR GPL-2.0 requires nothing and offers
    gpl,mit.  with_places adds every place found.
    A row in, a row out; no shuffle.  Null and empty texts have no words, labels, required and choices "" and score 0.  Input columns
    with a result's name are replaced.
    """

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        n = batch.num_rows
        column = batch.column(batch.schema.get_field_index(text))
        words = np.zeros(n, np.int64)
        found: dict[int, tuple] = {}
        for r0, r1, raw, offs in X.chunks(column):
            low = X.LOWER[raw]
            inside = X.ALNUM[low]
            starts, _, first = X.spans(low, offs, X.ALNUM)
            words[r0:r1] = np.diff(first)
            # each word and one space after it; a word that ends a row gets its space from the join below
            keep = inside.copy()
            keep[1:] |= inside[:-1]
            keep[offs[:-1][offs[:-1] < len(raw)]] |= True
            normal = np.where(inside, low, np.uint8(32))[keep].tobytes()
            at = np.concatenate([[0], np.cumsum(keep)])[offs]
            for i in range(r1 - r0):
                s = normal[at[i] : at[i + 1]]
                if any(x in s for x in _HINTS):
                    spaced = " " + s.decode("utf-8", "replace").strip(" ") + " "
                    got = scan_words(spaced, column[r0 + i].as_py())
                    if got[8]:
                        found[r0 + i] = got
        rows = [found.get(i, (0, None, None, "", "", 0.0, "", "", [])) for i in range(n)]
        out = [pa.array(words)] + [pa.array([r[k] for r in rows], t) for k,
            t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string()))]
        if with_places:
            kind = pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string())]))
            out.append(pa.array([[{"word": w, "phrase": p} for w, p in r[8]] for r in rows], kind))
        return out

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("required", T.StringType()), T.StructField("choices", T.StringType())]
    if with_places:
        fields.append(T.StructField("places", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("phrase", T.StringType())]))))
    return append_columns(docs, fields, run)


#: Every phrase holds one of these; a text with none of them needs no automaton.
_HINTS = (b"licens", b"cc by", b"reserved", b"granted", b"redistribution", b"creative commons", b"public domain")
assert all(any(h.decode() in p for h in _HINTS) for p in (*BASE, *NOTICES, TAG))
