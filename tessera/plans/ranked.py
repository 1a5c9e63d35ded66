"""Scores of a whole query tree, and the best k of them found by bounds of windows of ids.

A term adds sqrt(tf) idf^2 / sqrt(length), a phrase the same with the times it occurs and the sum of its words' idf (with
slop: once), everything else 1; idf = 1 + ln(n / (df + 1)). Boosts multiply. A Bool adds up those of its clauses that hold;
negative ones add nothing. Each term's index has, for each window of ids, the most that it can add there. The same tree
over these gives a bound for all documents of a window. The windows with the highest bounds are scored first; of the
others, only those whose bound reaches the k-th score found are read at all.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.ast import MUST, MUST_NOT, SHOULD, Bool, Boost, MatchAll, Node, Phrase, Prefix, Range, Term
from tessera.plans.indexed import Postings
from tessera.plans.terms import holds

#: Windows scored before the first bound is known; further ones where k is large.
FIRST_WINDOWS = 16
#: Windows that are given by name, so that the files' statistics can tell which parts to read; more are joined.
NAMED_WINDOWS = 1000
#: Digits of scores, so that equal ones are ties however they were added up, and what that and the adding may be off by.
DIGITS, ROUNDING = 9, 1e-8


def leaves(node: Node | None, field: str = "content") -> list[Node]:
    """What the tree is made of, each once."""
    if isinstance(node, Boost):
        return leaves(node.node, field)
    if isinstance(node, Bool):
        return list(dict.fromkeys(leaf for _, n in node.clauses for leaf in leaves(n, field)))
    return [node] if node is not None and (isinstance(node, MatchAll) or node.field == field) else []


def total(node: Node | None, of: Callable[[Node], Column], negative: bool = True) -> Column:
    """The tree's score from those of its leaves, null where one doesn't hold; a bound if negative clauses are left out."""
    none = F.lit(None).cast("double")
    if isinstance(node, Boost):
        return total(node.node, of, negative) * node.factor
    if not isinstance(node, Bool):
        return of(node) if node in leaves(node) else none
    parts = {occur: [total(n, of, negative) for o, n in node.clauses if o == occur] for occur in (MUST, SHOULD, MUST_NOT)}
    positive = parts[MUST] + parts[SHOULD]
    if not positive:
        return none
    needed = parts[MUST] or [F.coalesce(*parts[SHOULD])]
    holds = reduce(lambda a, b: a & b, [c.isNotNull() for c in needed] + [c.isNull() for c in parts[MUST_NOT] if negative])
    zero = F.lit(0.0)
    return F.when(holds, reduce(lambda a, b: a + b, [F.coalesce(c, zero) for c in positive]))


@dataclass
class Ranked:
    """rows: content_id, score, best first, ties by content_id. windows: (term, window) blocks read, and those there are."""

    rows: DataFrame
    read: int
    there: int


class Ranking:
    def __init__(self, index: Postings, node: Node | None):
        self.index, self.node, self.leaves = index, node, leaves(node)
        self.words = sorted({w for leaf in self.leaves for w in self._words(leaf)})
        counts = index.vocabulary.where(F.col("term").isin(*self.words)).groupBy("term").agg(F.sum("documents")).collect() if self.words else []
        self.n = index.n_documents if index.n_documents is not None else index.documents.count()
        found = dict(tuple(r) for r in counts)  # as many rows as the query has words
        self.idf = {w: 1 + math.log(self.n / (found.get(w, 0) + 1)) if self.n else 0.0 for w in self.words}

    @staticmethod
    def _words(leaf: Node) -> tuple[str, ...]:
        return (leaf.word,) if isinstance(leaf, Term) else leaf.words if isinstance(leaf, Phrase) else ()

    def weight(self, leaf: Term | Phrase) -> float:
        return sum(self.idf[w] for w in self._words(leaf)) ** 2

    def _leaf_scores(self, index: Postings, i: int, leaf: Node) -> DataFrame | None:
        """content_id, leaf, s of the documents where a leaf holds."""
        if isinstance(leaf, Phrase):
            if not leaf.words:
                return None
            tf = F.lit(1) if leaf.slop else F.col("times")
            return index.phrase_places(leaf).select("content_id", F.lit(i).alias("leaf"), (F.sqrt(tf) / F.sqrt("length") * self.weight(leaf)).alias("s"))
        ids = index.documents if isinstance(leaf, MatchAll) else index.ids(leaf)
        return ids.select("content_id", F.lit(i).alias("leaf"), F.lit(1.0).alias("s"))

    def scored(self, index: Postings) -> DataFrame:
        """content_id, score of every document of the index for which the query holds."""
        parts = [self._leaf_scores(index, i, leaf) for i, leaf in enumerate(self.leaves) if not isinstance(leaf, Term)]
        terms = {leaf.word: i for i, leaf in enumerate(self.leaves) if isinstance(leaf, Term)}
        if terms:  # all in one reading
            given = F.create_map(*[F.lit(x) for w, i in terms.items() for x in (w, i)])
            weights = F.create_map(*[F.lit(x) for w in terms for x in (w, self.weight(Term(w)))])
            rows = index.postings.where(F.col("term").isin(*terms))
            parts.append(rows.select("content_id", given[F.col("term")].alias("leaf"), (F.sqrt(F.size("positions")) / F.sqrt("length") * weights[F.col("term")]).alias("s")))
        parts = [p for p in parts if p is not None]
        if not parts:
            return index.documents.limit(0).select("content_id", F.lit(0.0).alias("score"))
        held = reduce(DataFrame.unionByName, parts).groupBy("content_id").agg(*[F.max(F.when(F.col("leaf") == i, F.col("s"))).alias(f"s{i}") for i in range(len(self.leaves))])
        score = total(self.node, lambda leaf: F.col(f"s{self.leaves.index(leaf)}"))
        return held.select("content_id", F.round(score, DIGITS).alias("score")).where(F.col("score").isNotNull())

    def bounds(self) -> DataFrame:
        """segment, window, bound, blocks of the windows that can have a document for which the query holds."""
        index = self.index
        facts = [index.windows.where(F.col("term").isin(*self.words)).select("segment", "window", F.col("term").alias("key"), "impact", F.lit(1).alias("block"))] if self.words else []
        for i, leaf in enumerate(self.leaves):
            if isinstance(leaf, MatchAll):
                rows = index.documents.select("segment", F.floor(F.col("content_id") / index.window).cast("long").alias("window")).distinct().withColumn("block", F.lit(0))
            elif not isinstance(leaf, Term | Phrase):
                named = isinstance(leaf, Prefix | Range)
                rows = index.windows.where(holds(leaf, F.col("term"))) if named else index.windows.join(index.terms(leaf), "term", "left_semi")
                rows = rows.groupBy("segment", "window").agg(F.count(F.lit(1)).alias("block"))
            else:
                continue
            facts.append(rows.select("segment", "window", F.lit(f"\0{i}").alias("key"), F.lit(1.0).alias("impact"), "block"))
        if not facts:
            return index.windows.limit(0).select("segment", "window", F.lit(0.0).alias("bound"), F.lit(0).alias("blocks"))
        keys = [*self.words, *[f"\0{i}" for i, leaf in enumerate(self.leaves) if not isinstance(leaf, Term | Phrase)]]
        most = reduce(DataFrame.unionByName, facts).groupBy("segment", "window").agg(F.sum("block").alias("blocks"), *[F.max(F.when(F.col("key") == k, F.col("impact"))).alias(f"m{i}") for i, k in enumerate(keys)])

        def of(leaf: Node) -> Column:
            if not isinstance(leaf, Term | Phrase):
                return F.col(f"m{keys.index(chr(0) + str(self.leaves.index(leaf)))}")
            # A phrase is no more frequent than the rarest of its words.
            each = [F.col(f"m{keys.index(w)}") for w in dict.fromkeys(self._words(leaf))]
            if not each:
                return F.lit(None).cast("double")
            least = each[0] if len(each) == 1 else F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in each]), F.least(*each))
            return least * self.weight(leaf)

        return most.select("segment", "window", total(self.node, of, negative=False).alias("bound"), "blocks").where(F.col("bound").isNotNull())

    def best(self, k: int) -> Ranked:
        """The k best, as all scores in order would begin."""
        bounds = self.bounds()
        first = FIRST_WINDOWS + 2 * k // self.index.window
        begun = bounds.orderBy(F.desc("bound"), "segment", "window").limit(first).collect()  # so many rows
        there = bounds.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
        order = (F.desc("score"), F.asc("content_id"))
        parts, read, floor = [], sum(r.blocks for r in begun), None
        if begun:
            rows = self.scored(self.index.within([(r.segment, r.window) for r in begun])).orderBy(*order).limit(k)
            parts.append(rows)
            if len(begun) < first:
                return Ranked(rows, read, there)
            held = rows.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
            floor = held.least if held.n == k else None
        done = self.index.documents.sparkSession.createDataFrame([(r.segment, r.window) for r in begun], "segment int, window long")
        rest = bounds.join(F.broadcast(done), ["segment", "window"], "left_anti")
        if floor is not None:
            rest = rest.where(F.col("bound") * (1 + ROUNDING) + ROUNDING >= floor)
        some = rest.limit(NAMED_WINDOWS + 1).collect()
        read += sum(r.blocks for r in some) if len(some) <= NAMED_WINDOWS else rest.agg(F.sum("blocks")).first()[0]
        if some:
            within = self.index.within([(r.segment, r.window) for r in some]) if len(some) <= NAMED_WINDOWS else self.index.within_joined(rest.select("segment", "window"))
            parts.append(self.scored(within).orderBy(*order).limit(k))
        rows = reduce(DataFrame.unionByName, parts) if parts else self.scored(self.index.within([]))
        return Ranked(rows.orderBy(*order).limit(k), read, there)
