"""A query as one condition on an array of terms: no index, no join, one pass over the documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.ast import MUST, MUST_NOT, SHOULD, Bool, Boost, Fuzzy, MatchAll, Node, Phrase, Term
from tessera.plans.terms import holds, osa


def phrase_at(terms: Column, node: Phrase) -> Column:
    if not node.words:
        return F.lit(False)
    words = F.array(*map(F.lit, node.words))
    n = len(node.words)
    if node.slop:
        return sloppy(terms, node)
    last = F.size(terms) - (n - 1)
    at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.exists(at, lambda i: F.slice(terms, i, n) == words)


def slop_match(terms: list[str], words: tuple[str, ...], slop: int) -> bool:
    """Whether the words stand so that their displacements, place less place in the phrase, differ by slop at most."""
    places = [[p - i for p, t in enumerate(terms) if t == w] for i, w in enumerate(words)]
    if not all(places):
        return False
    for low in sorted({d for ds in places for d in ds}):
        taken, ok = set(), True
        for i, ds in enumerate(places):
            fit = [d + i for d in ds if low <= d <= low + slop and d + i not in taken]
            if not fit:
                ok = False
                break
            taken.add(fit[0])
        if ok:
            return True
    return False


def sloppy(terms: Column, node: Phrase) -> Column:
    words, slop = node.words, node.slop

    @F.pandas_udf("boolean")
    def near(column: pd.Series) -> pd.Series:
        return column.map(lambda ts: slop_match(list(ts), words, slop))

    every = F.lit(True)
    for w in dict.fromkeys(words):
        every = every & F.array_contains(terms, w)
    # Only documents that have all the words go through Python with their terms.
    return every & near(F.when(every, terms).otherwise(F.array().cast("array<string>")))


def fuzzy(terms: Column, node: Fuzzy) -> Column:
    word, edits = node.word, node.edits
    near = F.array_distinct(F.filter(terms, lambda t: F.levenshtein(t, F.lit(word), 2 * edits) >= 0))

    @F.pandas_udf("boolean")
    def any_within(column: pd.Series) -> pd.Series:
        return column.map(lambda ts: any((d := osa(t, word)) <= edits and d < max(1, min(len(t), len(word))) for t in ts))

    return any_within(near)


def condition(node: Node | None, terms: Column, field: str = "content") -> Column:
    """A boolean column that is never null."""
    if node is None:
        return F.lit(False)
    if isinstance(node, MatchAll):
        return F.lit(True)
    if isinstance(node, Boost):
        return condition(node.node, terms, field)
    if isinstance(node, Bool):
        must = [condition(n, terms, field) for occur, n in node.clauses if occur == MUST]
        should = [condition(n, terms, field) for occur, n in node.clauses if occur == SHOULD]
        never = [condition(n, terms, field) for occur, n in node.clauses if occur == MUST_NOT]
        if not must and not should:
            return F.lit(False)
        out = F.lit(True)
        if must:
            for c in must:
                out = out & c
        else:
            out = should[0]
            for c in should[1:]:
                out = out | c
        for c in never:
            out = out & ~c
        return out
    if node.field != field:
        return F.lit(False)
    if isinstance(node, Term):
        return F.array_contains(terms, node.word)
    if isinstance(node, Phrase):
        return phrase_at(terms, node)
    if isinstance(node, Fuzzy):
        return fuzzy(terms, node)
    return F.exists(terms, lambda t: holds(node, t))
