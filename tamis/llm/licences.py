"""Licence scans: Aho-Corasick finds tags and notice phrases, a shunting-yard parser reads expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tamis.llm.batches import chosen, steps, utf8, words_of

# The phrases of the contract and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases and their labels.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
}
# Licences under which text may be used again without sharing alike.
PERMISSIVE = ("0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc-by-4.0", "cc0-1.0", "isc", "mit", "unlicense", "zlib")

TAG_WORDS = "spdx license identifier"
TAG = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]+)", re.IGNORECASE)
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.:+-]*")
RANK = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> list[tuple[str, str]]:
    """Operators and identifiers of an expression in postfix order, by the shunting-yard algorithm.

    ``with`` binds tighter than ``and``, which binds tighter than ``or``. The expression ends
    where its grammar ends: what follows on the line (a comment's end) is left. Without a
    complete expression at the start the result is empty.
    """
    out: list[tuple[str, str]] = []
    stack: list[str] = []
    best: list[tuple[str, str]] = []
    operand_next = True
    for match in TOKEN.finditer(expression):
        token = match[0].lower().rstrip(".:")
        if token == "(":
            if not operand_next:
                break
            stack.append("(")
        elif token == ")":
            if operand_next or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(("op", stack.pop()))
            stack.pop()
        elif token in RANK:
            if operand_next:
                break
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[token]:
                out.append(("op", stack.pop()))
            stack.append(token)
            operand_next = True
            continue
        else:
            if not operand_next:
                break
            out.append(("id", token))
            operand_next = False
        if not operand_next and "(" not in stack:
            best = out + [("op", op) for op in reversed(stack)]
    return best


def evaluate(postfix: list[tuple[str, str]], allowed: frozenset[str]) -> tuple[set[str], bool]:
    """(licences named, whether the expression can be met by allowed licences alone)."""
    stack: list[tuple[set[str], bool]] = []
    for kind, token in postfix:
        if kind == "id":
            stack.append(({token}, token.rstrip("+") in allowed))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            # an exception only adds rights to the licence on its left
            stack.append(({f"{a}-with-{b}" for a in left[0] for b in right[0]}, left[1]))
        else:
            ok = left[1] and right[1] if token == "and" else left[1] or right[1]
            stack.append((left[0] | right[0], ok))
    return stack[0] if stack else (set(), False)


def automaton() -> ahocorasick.Automaton:
    """All phrases between blanks, as the words of a text joined by blanks hold them."""
    built = ahocorasick.Automaton()
    for phrase, label in NOTICE_PHRASES.items():
        built.add_word(f" {phrase} ", (label, phrase.count(" ") + 1, "notice"))
    for phrase, label in BASE_PHRASES.items():
        built.add_word(f" {phrase} ", (label, phrase.count(" ") + 1, "base"))
    built.add_word(f" {TAG_WORDS} ", ("", 3, "tag"))
    built.make_automaton()
    return built


def scan_text(text: bytes, phrases: ahocorasick.Automaton, allowed: frozenset[str]) -> dict:
    """Places and labels of one UTF-8 text; see ``scan_licences``."""
    words = words_of(text)
    joined = f" {b' '.join(words).decode('latin-1')} "
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    notices, tagged, blanks, seen = 0, False, 0, 0
    for end, (label, length, kind) in phrases.iter(joined):
        blanks += joined.count(" ", seen, end + 1)
        seen = end + 1
        if kind == "base":
            base.append(blanks - 1 - length)
            base_labels.add(label)
        elif kind == "notice":
            notices += 1
            labels.add(label)
        else:
            tagged = True
    expressions, usable = 0, True
    if tagged:
        for match in TAG.finditer(text):
            postfix = to_postfix(match[1].decode("utf-8", "replace"))
            if postfix:
                named, ok = evaluate(postfix, allowed)
                expressions += 1
                usable = usable and ok
                labels |= {f"spdx:{name}" for name in named}
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(base, default=None),
        "last_word": max(base, default=None),
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(labels | base_labels)),
        "score": 1.0 - 0.5 ** (len(base) + notices + 2 * expressions),
        "n_expressions": expressions,
        "permissive": usable if expressions else None,
    }


RESULT = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("n_expressions", pa.int64()),
        ("permissive", pa.bool_()),
    ]
)


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[str, ...] = PERMISSIVE) -> DataFrame:
    """Licence phrases and tags of every whole text, one row per row of ``docs``.

    ``n_base`` places where a phrase of the base list stands, ``first_word`` and ``last_word``
    their smallest and largest start (null without a place), ``base_labels`` and ``labels``
    (base, further notices, ``spdx:`` identifiers), ``score`` from 0 (nothing) towards 1,
    ``permissive`` whether all tagged expressions can be met by ``allowed`` (null without one).
    Null and empty texts have no words and score 0. Only the two named columns are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    permitted = frozenset(allowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton()
        for batch in steps(batches, 1):
            rows = [scan_text(text, phrases, permitted) for text in utf8(batch.column(1))]
            found = pa.RecordBatch.from_pylist(rows, RESULT)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], ["id", *RESULT.names])

    schema = (
        f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, n_expressions bigint, permissive boolean"
    )
    return chosen(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
