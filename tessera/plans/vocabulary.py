"""Which terms of a vocabulary a pattern or a misspelt word means, by equal grams and variants in place of a scan."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.ast import Fuzzy, Node, Regex, Wildcard
from tessera.plans.automata import ANY_CHAR, ANYTHING, BadRegex, Expression, cat, parsed, required_texts, text


def expression(node: Wildcard | Regex) -> Expression | None:
    """What the pattern is made of; None if that can't be told."""
    if isinstance(node, Wildcard):
        marks = {"?": ANY_CHAR, "*": ANYTHING}
        return cat(*[marks[p] if special else text(p) for p, special in node.parts])
    try:
        return parsed(node.pattern)
    except BadRegex:
        return None


def required_grams(node: Node, size: int) -> list[set[str]] | None:
    """For each alternative of the pattern the grams of all its terms; None if an alternative has none."""
    found = expression(node) if isinstance(node, Wildcard | Regex) else None
    if found is None:
        return None
    alternatives = [{t[i : i + size] for t in texts for i in range(len(t) - size + 1)} for texts in required_texts(found)]
    return alternatives if all(alternatives) else None


def with_grams(grams: DataFrame, alternatives: list[set[str]]) -> DataFrame | None:
    """The terms that have all the grams of an alternative; there is one at least."""
    found = None
    for needed in alternatives:
        terms = grams.where(F.col("gram").isin(*sorted(needed))).groupBy("term").agg(F.count_distinct("gram").alias("_n")).where(F.col("_n") == len(needed)).select("term")
        found = terms if found is None else found.unionByName(terms)
    return found.distinct() if found is not None and len(alternatives) > 1 else found


def deletions(word: str, edits: int, prefix: int) -> set[str]:
    """What is left of the word's first characters without up to so many of them."""
    start = word[:prefix]
    return {"".join(c for i, c in enumerate(start) if i not in gone) for n in range(edits + 1) for gone in combinations(range(len(start)), n)}


def near_candidates(variants: DataFrame, node: Fuzzy, prefix: int) -> DataFrame:
    """Every term within the edits shares a variant with the word, as each edit takes no more than a character from either start."""
    hashes = [F.xxhash64(F.lit(v)) for v in sorted(deletions(node.word, node.edits, prefix))]
    return variants.where(F.col("variant").isin(*hashes)).select("term").distinct()
