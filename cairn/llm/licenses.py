"""Licence scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates licence expressions.

One automaton holds the tag that introduces an expression ("SPDX-License-Identifier:") and the notices' phrases.  It runs over the lowered text, in which line
ends with the comment signs after them, and other white space, are one space, so that wrapped notices are found; starts are those in the text as it is.  An
expression after a tag runs to the end of its line, or to a full stop, comma or semicolon before white space, or to a dash by itself, whatever prose
follows, and is parsed by shunting-yard with the precedence WITH > AND > OR.  An expression is allowed where the policy allows it: an identifier by
itself, or with a + (or later), `x WITH exception` where it allows the exception and x, AND where it allows both sides and OR where it allows one.  A phrase stands for its identifier.  Where phrases overlap all are reported.

Defined results: null or empty text has no findings.  A tag whose expression doesn't parse, or has none, is reported with the expression as written,
no identifiers, valid false and allowed false.  A document is allowed if all its findings are; without findings it is allowed.  Repeated
notices are each found.  Phrases count only between non-word characters.  Texts are scanned whole; other columns aren't looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, tuned

FINDINGS = "array<struct<start:bigint,kind:string,expression:string,identifiers:array<string>,valid:boolean,allowed:boolean>>"

PHRASES = {
    "licensed under the apache license, version 2.0": "Apache-2.0",
    "released under the mit license": "MIT",
    "licensed under the mit license": "MIT",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
    "gnu general public license as published by the free software foundation, either version 3": "GPL-3.0-or-later",
    "gnu general public license as published by the free software foundation; either version 3": "GPL-3.0-or-later",
    "gnu general public license as published by the free software foundation, either version 2": "GPL-2.0-or-later",
    "gnu general public license as published by the free software foundation; either version 2": "GPL-2.0-or-later",
    "gnu lesser general public license as published by the free software foundation, either version 3": "LGPL-3.0-or-later",
    "gnu lesser general public license as published by the free software foundation; either version 3": "LGPL-3.0-or-later",
    "gnu lesser general public license as published by the free software foundation; either version 2.1": "LGPL-2.1-or-later",
    "gnu general public license, version 3": "GPL-3.0-only",
    "gnu general public license version 3": "GPL-3.0-only",
    "gnu general public license, version 2": "GPL-2.0-only",
    "gnu lesser general public license, version 3": "LGPL-3.0-only",
    "gnu affero general public license": "AGPL-3.0-only",
    "mozilla public license, version 2.0": "MPL-2.0",
    "redistribution and use in source and binary forms": "BSD-3-Clause",
    "licensed under cc by-nc 4.0": "CC-BY-NC-4.0",
    "licensed under cc by-nc-nd 4.0": "CC-BY-NC-ND-4.0",
    "licensed under cc by-sa 4.0": "CC-BY-SA-4.0",
    "licensed under cc by 4.0": "CC-BY-4.0",
    "creative commons attribution 4.0 international": "CC-BY-4.0",
    "creative commons attribution-noncommercial 4.0 international": "CC-BY-NC-4.0",
    "all rights reserved": "LicenseRef-proprietary",
    "dedicated to the public domain": "CC0-1.0",
    "boost software license - version 1.0": "BSL-1.0",
    "eclipse public license - v 2.0": "EPL-2.0",
}


@dataclass(frozen=True)
class Policy:
    tags: tuple[str, ...] = ("spdx-license-identifier:", "license-expression:")
    phrases: dict[str, str] = field(default_factory=lambda: dict(PHRASES))
    allowed: frozenset[str] = frozenset({"apache-2.0", "mit", "mit-0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "cc-by-3.0", "bsl-1.0", "0bsd", "python-2.0", "postgresql"})
    exceptions: frozenset[str] = frozenset({"llvm-exception", "classpath-exception-2.0", "gcc-exception-3.1", "swift-exception"})


#: Of the operators: (precedence, name).
_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9.+:-]+))")


def to_postfix(expression: str) -> list[str] | None:
    """The expression's identifiers and lower-case operators in postfix order; None if it isn't one."""
    out: list[str] = []
    stack: list[str] = []
    want = True  # an operand comes next
    at = 0
    expression = expression.strip()
    while at < len(expression):
        m = _TOKEN.match(expression, at)
        if not m:
            return None
        at = m.end()
        bracket, word = m.groups()
        if bracket == "(":
            if not want or stack[-1:] == ["with"]:
                return None
            stack.append("(")
        elif bracket == ")":
            if want:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif (op := word.lower()) in _BINDS:
            if want:
                return None
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[op]:
                out.append(stack.pop())
            stack.append(op)
            want = True
        else:
            if not want:
                return None
            out.append(word)
            want = False
    if want or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str], policy: Policy) -> bool | None:
    """Whether the policy allows the expression; None if WITH stands after something else than an identifier."""
    stack: list[tuple[bool, str | None]] = []  # (allowed, the identifier if it is one)
    for x in postfix:
        if x not in _BINDS:
            stack.append((x.lower().removesuffix("+") in policy.allowed, x.lower()))
            continue
        right, left = stack.pop(), stack.pop()
        if x == "with":
            if left[1] is None or right[1] is None:
                return None
            stack.append((left[0] and right[1] in policy.exceptions, None))
        else:
            stack.append((left[0] and right[0] if x == "and" else left[0] or right[0], None))
    return stack[0][0]


def automaton(policy: Policy) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in policy.tags:
        a.add_word(t, (len(t), None))
    for phrase, identifier in policy.phrases.items():
        a.add_word(phrase, (len(phrase), identifier))
    a.make_automaton()
    return a


def _between(text: str, a: int, b: int) -> bool:
    return not ((a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()))


_WRAP = re.compile(r"\s*\n\s*(?:(?:/\*+|//+|\*+(?!/)|\#+|;+|--|%+|>+|<!--)[ \t]*)?|[^\S\n]{2,}|[^\S\n ]")
_STOP = re.compile(r"[.,;](?=\s|$)|(?<=\s)(?:-+|[\u2013\u2014])(?=\s|$)")


def unwrapped(text: str) -> tuple[str, list[int], list[int]]:
    """text with line ends and other white space as one space, and at which places of both it was shortened to."""
    parts, ours, theirs, at, size = [], [0], [0], 0, 0
    for m in _WRAP.finditer(text):
        parts += (text[at : m.start()], " ")
        size += m.start() - at + 1
        at = m.end()
        ours.append(size)
        theirs.append(at)
    return "".join([*parts, text[at:]]), ours, theirs


def findings(text: str, a: ahocorasick.Automaton, policy: Policy) -> list[dict]:
    out = []
    low = text.lower()
    if len(low) != len(text):  # a few letters are longer in lower case; those stay as they are
        low = "".join(x if len(x) == 1 else c for c in text for x in (c.lower(),))
    short, ours, theirs = unwrapped(low)
    for last, (size, identifier) in a.iter(short):
        k = bisect_right(ours, last + 1 - size) - 1
        start = theirs[k] + last + 1 - size - ours[k]
        if identifier is not None:
            if _between(short, last + 1 - size, last + 1):
                out.append({"start": start, "kind": "phrase", "expression": identifier, "identifiers": [identifier], "valid": True, "allowed": identifier.lower() in policy.allowed})
            continue
        k = bisect_right(ours, last) - 1
        end = theirs[k] + last - ours[k] + 1
        stop = low.find("\n", end)
        written = text[end : stop if stop >= 0 else len(text)].strip().removesuffix("*/").removesuffix("-->").strip()
        if m := _STOP.search(written):
            written = written[: m.start()].strip()
        postfix = to_postfix(written)
        ok = evaluate(postfix, policy) if postfix else None
        out.append({"start": start, "kind": "tag", "expression": written, "identifiers": [x for x in postfix if x not in _BINDS] if postfix and ok is not None else [], "valid": ok is not None, "allowed": bool(ok)})
    return sorted(out, key=lambda x: (x["start"], x["kind"], x["expression"]))


def found(policy: Policy):  # noqa: ANN201
    of = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("expression", pa.string()), ("identifiers", pa.list_(pa.string())), ("valid", pa.bool_()), ("allowed", pa.bool_())]))

    def one(text: pa.Array) -> pa.Array:
        a = automaton(policy)
        return pa.array([findings(t, a, policy) if (t := x.as_py()) else [] for x in text], of)

    return F.arrow_udf(one, FINDINGS)


def scan(docs: DataFrame, policy: Policy = Policy(), text: str = "text") -> DataFrame:
    """doc_id, findings and whether the policy allows the document, a row for each of docs."""
    tuned(docs.sparkSession)
    out = docs.select(id_of(docs), found(policy)(docs[text].cast("string")).alias("findings"))
    return out.withColumn("allowed", F.forall("findings", lambda x: x["allowed"]))


def phrases(docs: DataFrame, policy: Policy = Policy(), text: str = "text") -> DataFrame:
    """doc_id, identifier, n: how many notices of each licence a document has."""
    every = scan(docs, policy, text).select("doc_id", F.explode("findings").alias("f")).where("f.kind = 'phrase'")
    return every.groupBy("doc_id", F.col("f.expression").alias("identifier")).agg(F.count("*").alias("n"))
