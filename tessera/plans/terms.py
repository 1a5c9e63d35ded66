"""Conditions on single terms, shared by both plans."""

from __future__ import annotations

import re

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.plans.ast import Fuzzy, Node, Prefix, Range, Regex, Term, Wildcard
from tessera.plans.automata import BadRegex, automaton


class UnsupportedRegex(ValueError):
    pass


class NeedsAutomaton(UnsupportedRegex):
    """The pattern has operators that Java's regular expressions lack."""


def java_regex(pattern: str) -> str:
    """The anchored Java form of an automaton pattern: . ? * + {n,m} | () [] "quoted" # are known; ~ & @ <n-m> aren't all.

    # is the empty language, @ any string; ~, & and <n-m>, which Java's have not, raise NeedsAutomaton.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]) if not pattern[i + 1].isalnum() else pattern[i + 1])
            i += 1
        elif c == '"':
            end = pattern.find('"', i + 1)
            if end < 0:
                raise UnsupportedRegex("a quoted part isn't closed")
            out.append("\\Q" + pattern[i + 1 : end] + "\\E")
            i = end
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise UnsupportedRegex("a class isn't closed")
            inner = pattern[i + 1 : end]
            out.append("[" + re.sub(r"([\[&~])", r"\\\1", inner) + "]")
            i = end
        elif c == "@":
            out.append("(?s:.*)")
        elif c == "#":
            out.append("(?!)")
        elif c in "~&<":
            raise NeedsAutomaton(f"{c} isn't one of Java's operators")
        elif c in "^$":
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return f"^(?s:{''.join(out)})$"


def checked_regex(pattern: str) -> None:
    """Raises UnsupportedRegex for a pattern that java_regex(), Java's own compiler or automaton() refuses."""
    try:
        form = java_regex(pattern)
    except NeedsAutomaton:
        try:
            automaton(pattern)
        except BadRegex as problem:
            raise UnsupportedRegex(f"/{pattern}/ isn't a regular expression: {problem}") from problem
        return
    try:
        if session := SparkSession.getActiveSession():
            session._jvm.java.util.regex.Pattern.compile(form)
        else:
            re.compile(re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), form, flags=re.S))
    except (re.error, IllegalArgumentException, Py4JJavaError) as problem:
        raise UnsupportedRegex(f"/{pattern}/ isn't a regular expression") from problem


def wildcard_regex(node: Wildcard) -> str:
    marks = {"?": ".", "*": ".*"}
    return "^(?s:" + "".join(marks[p] if special else "\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E" for p, special in node.parts) + ")$"


def osa(a: str, b: str) -> int:
    """Edits, an exchange of neighbours counting as one, no part edited twice."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]


def fuzzy_distance(term: Column, node: Fuzzy) -> Column:
    word = node.word

    @F.pandas_udf("int")
    def distance(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: osa(t, word)).astype("int32")

    return distance(term)


def fuzzy_candidate(term: Column, node: Fuzzy) -> Column:
    """Holds for every match: an exchange costs two plain edits at most."""
    return F.levenshtein(term, F.lit(node.word), 2 * node.edits) >= 0


def holds(node: Node, term: Column) -> Column:
    """The condition on a term; a fuzzy one needs its distance besides, see fuzzy_distance()."""
    if isinstance(node, Term):
        return term == node.word
    if isinstance(node, Prefix):
        return F.startswith(term, F.lit(node.prefix))
    if isinstance(node, Wildcard):
        return term.rlike(wildcard_regex(node))
    if isinstance(node, Regex):
        try:
            return term.rlike(java_regex(node.pattern))
        except NeedsAutomaton:
            return automaton(node.pattern).holds(term)
    if isinstance(node, Range):
        out = F.lit(True)
        if node.low is not None:
            out = out & ((term >= node.low) if node.include_low else (term > node.low))
        if node.high is not None:
            out = out & ((term <= node.high) if node.include_high else (term < node.high))
        return out
    raise TypeError(node)
