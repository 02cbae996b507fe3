"""Licence scan: Aho-Corasick over the words of a text, shunting-yard over licence expressions.

A text is lower-cased (A-Z only) and reduced to its words: runs of ASCII letters, digits and
non-ASCII characters. One automaton holds every notice phrase and the identifier tag, and finds all
their places in one pass. Where the tag ``SPDX-License-Identifier`` stands, the expression behind it
is brought to postfix order by the shunting-yard algorithm (``with`` binds closest, then ``and``,
then ``or``) and evaluated to how free the choice of licences leaves a reader.

Null and empty texts: no words, no places, empty labels, score 0. Each input row gives one output
row, repeated rows included; columns besides the id and the text are ignored. A malformed expression
keeps the identifiers read before the fault and counts as not free.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases of the contract and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases, in words, and their labels.
NOTICE_PHRASES = {
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# How free a licence leaves its reader, by the first parts of its identifier or label.
FREEDOM = {
    "mit": 1.0, "apache": 0.95, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "zlib": 1.0, "cc-by-nc": 0.2,
    "cc-by-nd": 0.4, "cc-by-sa": 0.5, "cc-by": 0.9, "mpl": 0.6, "lgpl": 0.5, "agpl": 0.2, "gpl": 0.3, "proprietary": 0.0,
}
UNKNOWN_FREEDOM = 0.1
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions array<string>"
)

_BINDING = {"with": 3, "and": 2, "or": 1}
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+:-]+)")
_VERSION = re.compile(r"v?[0-9.]+\+?$")
#: What may stand behind an expression: the end, or a sign that no expression goes on with.
_BEHIND = re.compile(r"\s*($|[^\s\w().+:])")
_EXPRESSION = re.compile(r"SPDX-License-Identifier:([^\n]*)", re.IGNORECASE | re.ASCII)
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def freedom(identifier: str) -> float:
    """The freedom of the known name that holds most of an identifier's dash-separated parts; a version may be glued to the last."""
    parts = identifier.split("-")
    for count in range(len(parts), 0, -1):
        name = "-".join(parts[:count])
        for form in (name, _VERSION.sub("", name)):
            if form in FREEDOM:
                return FREEDOM[form]
    return UNKNOWN_FREEDOM


def to_postfix(text: str) -> tuple[list[str], bool]:
    """(the expression in postfix order, whether it is well formed); reading stops at the first fault."""
    output: list[str] = []
    pending: list[str] = []
    operand_due, at = True, 0
    while m := _TOKEN.match(text, at):
        token, low = m[1], m[1].lower()
        if low in _BINDING:
            if operand_due:
                break
            while pending and pending[-1] != "(" and _BINDING[pending[-1]] >= _BINDING[low]:
                output.append(pending.pop())
            pending.append(low)
            operand_due = True
        elif token == "(":
            if not operand_due:
                break
            pending.append(token)
        elif token == ")":
            if operand_due or "(" not in pending:
                break
            while pending[-1] != "(":
                output.append(pending.pop())
            pending.pop()
        else:
            if not operand_due:
                break
            output.append(low.rstrip(".:-") or low)
            operand_due = False
        at = m.end()
    whole = not operand_due and "(" not in pending and bool(_BEHIND.match(text, at))
    if operand_due and pending and pending[-1] != "(":
        pending.pop()
    output.extend(op for op in reversed(pending) if op != "(")
    return output, whole


def evaluate(postfix: list[str]) -> tuple[float, list[str]]:
    """(freedom, licence names): ``or`` leaves the freer side, ``and`` the less free, ``with`` eases its licence."""
    stack: list[tuple[float, str, list[str]]] = []
    for token in postfix:
        if token not in _BINDING:
            stack.append((freedom(token), token, [token]))
            continue
        if len(stack) < 2:
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            name = f"{left[1]} with {right[1]}"
            stack.append(((left[0] + 1) / 2, name, [*left[2][:-1], name]))
        else:
            pick = max if token == "or" else min
            stack.append((pick(left[0], right[0]), left[1], left[2] + right[2]))
    names = [n for part in stack for n in part[2]]
    return (min(part[0] for part in stack) if stack else 0.0), names


@lru_cache(maxsize=8)
def _automaton(phrases: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for phrase, label in phrases:
        automaton.add_word(f" {phrase} ", (phrase.count(" ") + 1, label))
    automaton.make_automaton()
    return automaton


def scan(text: str | None, base: dict[str, str], notices: dict[str, str]) -> dict:
    """The licence evidence of one text."""
    words = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()).decode("utf-8", "surrogatepass")
    table = tuple((p, f"b:{n}") for p, n in base.items()) + tuple((p, f"n:{n}") for p, n in notices.items() if p not in base)
    places, base_labels, other, tagged = [], set(), set(), False
    if words:
        spaced, blanks, counted = f" {words} ", 0, 0
        for end, (length, label) in _automaton((*table, (TAG, "t:"))).iter(spaced):
            blanks, counted = blanks + spaced.count(" ", counted, end), end  # ends come in order, so each blank is counted once
            if label[0] == "b":
                places.append(blanks - length)
                base_labels.add(label[2:])
            elif label[0] == "n":
                other.add(label[2:])
            else:
                tagged = True
    values, expressions = [freedom(x) for x in sorted(base_labels | other)], []
    if tagged:
        for m in _EXPRESSION.finditer(text):
            postfix, whole = to_postfix(m[1])
            value, names = evaluate(postfix)
            if names:
                expressions.append(" ".join(postfix))
                other.update(n.replace(",", " ") for n in names)
                values.append(value if whole else 0.0)
    return {
        "n_words": words.count(" ") + 1 if words else 0, "n_base": len(places),
        "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | other)),
        "score": min(values, default=0.0), "expressions": expressions,
    }


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICE_PHRASES,
) -> DataFrame:
    """One row per document: words, places of base phrases, labels, freedom score and expressions."""
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py(), base, notices) for t in batch.column(1)]
            columns = [pa.array([f[name] for f in found], kind) for name, kind in zip(fields, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *fields])

    source = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return source.mapInArrow(run, SCHEMA)
