"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags in every text,
and a shunting-yard parser evaluates the and/or/with expressions that follow the tags.

Texts are folded to words (A-Z lower-cased; words are runs of digits, letters and non-ASCII
characters), so a phrase matches across line ends, punctuation and case. Row-wise: no shuffle, and a
task's memory follows one Arrow batch.

Edge cases: a null or empty text has no words and no findings (labels are empty strings, places
null, score 0); malformed expressions count up to their first fault; overlapping phrases all count;
repeated rows are scanned each on its own; further columns pass through `scan`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bytetext import ALNUM
from tessera.llm.runtime import read, row_wise

# The phrases every scan counts as its base, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notice phrases, folded to words.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2",
    "bsd 3 clause": "bsd-3",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution 4 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "cc0 1 0": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# How freely a text under the label may be reused, 1 most.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "bsd-2": 1.0, "bsd-3": 1.0, "isc": 1.0, "zlib": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0,
    "cc-by": 0.9, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "gpl-2": 0.3, "gpl-3": 0.3, "agpl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "proprietary": 0.0,
}
UNKNOWN_FREEDOM = 0.3
EXCEPTION_BONUS = 0.2

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:\-]*)")
_EXPRESSION = re.compile(rb"SPDX-License-Identifier[ \t]*:?([^\r\n]*)", re.IGNORECASE)


def family(identifier: str) -> str:
    """An identifier's label: lower case, without the version of a family that is labelled without one."""
    name = identifier.lower().removesuffix("-only").removesuffix("-or-later").removesuffix("+")
    name = re.sub(r"-(clause)\b", "", name)
    name = re.sub(r"\.0$", "", name)
    return re.sub(r"^(mpl|epl|lgpl|agpl|cc0|cc-by(?:-nc|-sa|-nd)*)-[\d.]+$", r"\1", name)


def _legal(expression: str) -> list[str]:
    """The tokens of the expression's longest well-formed beginning; open parentheses at its end are left open."""
    tokens: list[str] = []
    at, operand_next, depth, good = 0, True, 0, 0
    while m := _TOKEN.match(expression, at):
        at, token = m.end(), m[1]
        if token == "(":
            if not operand_next:
                break
            depth += 1
        elif operand_next and (token == ")" or token.lower() in _PRECEDENCE):
            break
        elif token == ")":
            if not depth:
                break
            depth -= 1
        elif token.lower() in _PRECEDENCE:
            operand_next = True
        elif operand_next:
            operand_next = False
        else:
            break
        tokens.append(token)
        if token != "(" and not operand_next:
            good = len(tokens)
    return tokens[:good]


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: the expression's longest well-formed beginning in postfix order, in linear time."""
    out: list[str] = []
    stack: list[str] = []
    for token in _legal(expression):
        low = token.lower()
        if token == "(":
            stack.append(token)
        elif token == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in _PRECEDENCE:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
        else:
            out.append(token)
    return out + [x for x in reversed(stack) if x != "("]


def evaluate(postfix: list[str], freedom: dict[str, float] | None = None) -> tuple[float, list[str]]:
    """(freedom, labels): `or` offers the freer side, `and` binds to both, `with` relaxes its licence."""
    freedom = FREEDOM if freedom is None else freedom
    labels: list[str] = []
    stack: list[tuple[float, int]] = []  # value, and where its labels begin
    for token in postfix:
        if token in _PRECEDENCE and len(stack) >= 2:
            (right, begin), (left, first) = stack.pop(), stack.pop()
            if token == "with":
                del labels[begin:]
                stack.append((min(1.0, left + EXCEPTION_BONUS), first))
            else:
                stack.append(((max if token == "or" else min)(left, right), first))
        else:
            stack.append((freedom.get(family(token), UNKNOWN_FREEDOM), len(labels)))
            labels.append(family(token))
    return (stack[-1][0], labels[stack[-1][1] :]) if stack else (0.0, [])


def fold(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


_FOLD = bytes(b or 0x20 for b in ALNUM)

FINDINGS = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("findings", pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("word", pa.int64())]))),
])
FINDINGS_DDL = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "findings array<struct<label: string, kind: string, word: long>>"
)


class Scanner:
    """The automaton and the evaluation of one text."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], freedom: dict[str, float]) -> None:
        import ahocorasick

        self.freedom = freedom
        self.automaton = ahocorasick.Automaton()
        for kind, phrases in (("notice", notices), ("base", base), ("tag", {TAG: ""})):
            for phrase, label in phrases.items():
                key = f" {phrase} "
                self.automaton.add_word(key.encode().decode("latin-1"), (len(key), len(phrase.split()), kind, label))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple:
        """The fields of FINDINGS, the findings as three lists; linear in the text and its hits."""
        folded = text.translate(_FOLD)
        words = folded.split()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        labels, kinds, places, score, starts, tagged = [], [], [], None, [], False
        spaces = last = 0
        for end, (length, size, kind, label) in self.automaton.iter(line):
            if kind == "tag":
                tagged = True
                continue
            # Hits come by their end: each piece of the line is counted once. A hit of `size` words has size + 1 spaces.
            spaces, last = spaces + line.count(" ", last, end + 1), end + 1
            at = spaces - size - 1
            labels.append(label)
            kinds.append(kind)
            places.append(at)
            score = min(1.0 if score is None else score, self.freedom.get(label, UNKNOWN_FREEDOM))
            if kind == "base":
                starts.append(at)
        if tagged:
            inside = np.frombuffer(folded, dtype=np.uint8) != 0x20
            begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
            for m in _EXPRESSION.finditer(text):
                value, found = evaluate(to_postfix(m[1].decode("utf-8", "replace")), self.freedom)
                if found:
                    labels += found
                    kinds += ["tag"] * len(found)
                    places += [int(np.searchsorted(begins, m.start()))] * len(found)
                    score = min(1.0 if score is None else score, value)
        base = {x for x, kind in zip(labels, kinds, strict=True) if kind == "base"}
        join = lambda names: ",".join(sorted(names))
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), join(base), join(set(labels)), score or 0.0, (labels, kinds, places)

    def column(self, texts: pa.Array) -> pa.Array:
        rows = [self.scan(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
        *fields, found = list(zip(*rows, strict=True)) or [[] for _ in FINDINGS]
        offsets = np.cumsum([0, *(len(labels) for labels, _, _ in found)]).astype(np.int32)
        item = FINDINGS.field("findings").type.value_type
        parts = [pa.array([x for row in found for x in row[k]], item.field(k).type) for k in range(3)]
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, fields=list(item)))
        return pa.StructArray.from_arrays([*(pa.array(v, f.type) for v, f in zip(fields, FINDINGS, strict=False)), listed], fields=list(FINDINGS))


def findings(text: Column, base: dict[str, str] | None = None, notices: dict[str, str] | None = None, freedom: dict[str, float] | None = None) -> Column:
    """The struct FINDINGS_DDL of a text column."""
    args = (BASE_PHRASES if base is None else base, NOTICE_PHRASES if notices is None else notices, FREEDOM if freedom is None else freedom)

    def run(batches):  # noqa: ANN001, ANN202
        scanner = Scanner(*args)
        for texts in batches:
            yield scanner.column(texts)

    return row_wise(run, FINDINGS_DDL)(F.coalesce(text, F.lit("")))


def scan(docs: DataFrame, text: str = "text", out: str = "license", **options: dict) -> DataFrame:
    """`docs` with the struct column `out`."""
    return docs.withColumn(out, findings(F.col(f"`{text}`"), **options))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: words, places of the base phrases, labels and score."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return scan(docs).select("doc_id", *(F.col(f"license.{n}").alias(n) for n in names))
