"""A query over an inverted index: posting lists joined, united and taken from each other."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.ast import MUST, MUST_NOT, SHOULD, Bool, Boost, Fuzzy, MatchAll, Node, Phrase, Prefix, Range, Term
from tessera.plans.scan import slop_match
from tessera.plans.terms import fuzzy_candidate, fuzzy_distance, holds
from tessera.plans.vocabulary import near_candidates, required_grams, with_grams

#: Ids in a window, of which the index says how much a term can add to a score there.
WINDOW = 1024
#: Characters of the grams that lead from a pattern to terms.
GRAM = 3
#: First characters of a term whose deletions are kept, and how many at once: edits that fuzzy terms allow.
VARIANT_PREFIX, VARIANT_EDITS = 7, 2
#: Terms that are given by name, so that the files' statistics can tell which parts of the postings to read; more are joined.
NAMED_TERMS = 200


@dataclass
class Postings:
    """documents: content_id; postings: term, content_id, positions array<int>; vocabulary: term, documents long.

    An index that is written has more, see segments.py: grams, variants and windows, length and window in postings, and
    segment in all that tells of single documents.
    """

    documents: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    grams: DataFrame | None = None
    variants: DataFrame | None = None
    windows: DataFrame | None = None
    n_documents: int | None = None
    window: int = WINDOW

    def within(self, windows: list[tuple[int, int]]) -> Postings:
        """The documents and postings of these (segment, window) alone."""
        of: dict[int, list[int]] = {}
        for segment, window in windows:
            of.setdefault(segment, []).append(window)

        def narrowed(df: DataFrame, window: Column) -> DataFrame:
            some = F.lit(False)
            for segment, names in of.items():
                some = some | ((F.col("segment") == segment) & window.isin(*names))
            return df.where(window.isin(*sorted({w for _, w in windows})) & some) if windows else df.limit(0)

        ids = F.floor(F.col("content_id") / self.window).cast("long")
        return replace(self, documents=narrowed(self.documents, ids), postings=narrowed(self.postings, F.col("window")))

    def within_joined(self, windows: DataFrame) -> Postings:
        """The same for more windows than can be named."""
        documents = self.documents.withColumn("window", F.floor(F.col("content_id") / self.window).cast("long"))
        return replace(self, documents=documents.join(windows, ["segment", "window"], "left_semi").drop("window"), postings=self.postings.join(windows, ["segment", "window"], "left_semi"))

    def ids(self, node: Node | None) -> DataFrame:
        """The distinct content_id of the documents for which the query holds."""
        if node is None:
            return self._none()
        if isinstance(node, MatchAll):
            return self.documents.select("content_id")
        if isinstance(node, Boost):
            return self.ids(node.node)
        if isinstance(node, Bool):
            return self._bool(node)
        if node.field != "content":
            return self._none()
        if isinstance(node, Phrase):
            return self._phrase(node)
        return self._postings(node).select("content_id").distinct()

    def _none(self) -> DataFrame:
        return self.documents.limit(0).select("content_id")

    def _bool(self, node: Bool) -> DataFrame:
        must = [n for occur, n in node.clauses if occur == MUST]
        should = [n for occur, n in node.clauses if occur == SHOULD]
        if must:
            # Selective lists first; all documents only where nothing else is asked for.
            must = [n for n in must if not isinstance(n, MatchAll)] or must[:1]
            out = self.ids(must[0])
            for n in must[1:]:
                out = out.join(self.ids(n), "content_id", "left_semi")
        elif should:
            out = self.ids(should[0])
            for n in should[1:]:
                out = out.unionByName(self.ids(n))
            out = out.distinct() if len(should) > 1 else out
        else:
            return self._none()
        for occur, n in node.clauses:
            if occur == MUST_NOT:
                out = out.join(self.ids(n), "content_id", "left_anti")
        return out

    def terms(self, node: Node) -> DataFrame:
        """The distinct terms of the vocabulary that a prefix, pattern, range or fuzzy word means."""
        if isinstance(node, Fuzzy):
            there = near_candidates(self.variants, node, VARIANT_PREFIX) if self.variants is not None and node.edits <= VARIANT_EDITS else self.vocabulary.where(fuzzy_candidate(F.col("term"), node)).select("term")
            near = there.withColumn("_d", fuzzy_distance(F.col("term"), node))
            shorter = F.least(F.char_length("term"), F.lit(len(node.word)))
            return near.where((F.col("_d") <= node.edits) & (F.col("_d") < F.greatest(shorter, F.lit(1)))).select("term")
        there = self.vocabulary
        if self.grams is not None and (needed := required_grams(node, GRAM)) is not None:
            there = with_grams(self.grams, needed) if needed else there.limit(0)
        return there.where(holds(node, F.col("term"))).select("term")

    def _postings(self, node: Node) -> DataFrame:
        """Rows of the index whose term meets the condition; a term itself is pushed down to the files."""
        # Terms of a prefix or range lie together in the files: their statistics tell where, and nothing is joined.
        if isinstance(node, Term | Prefix | Range) or self.grams is None and not isinstance(node, Fuzzy):
            return self.postings.where(holds(node, F.col("term")))
        terms = self.terms(node)
        if self.grams is not None:
            some = [r[0] for r in terms.limit(NAMED_TERMS + 1).collect()]
            if len(some) <= NAMED_TERMS:
                return self.postings.where(F.col("term").isin(*some)) if some else self.postings.limit(0)
        return self.postings.join(terms, "term", "left_semi")

    def phrase_places(self, node: Phrase) -> DataFrame:
        """content_id, times and, if the postings have it, length: documents with the phrase, and how often it stands there."""
        words = list(dict.fromkeys(node.words))
        rows = self.postings.where(F.col("term").isin(*words))
        known = [F.first("length").alias("length")] if "length" in self.postings.columns else []
        places = rows.groupBy("content_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places"), *known)
        places = places.where(F.size("places") == len(words))
        kept = ["content_id", *["length"] * len(known)]
        if node.slop:
            return places.where(_near(node)("places")).select(*kept, F.lit(1).alias("times"))
        starts = F.element_at("places", F.lit(node.words[0]))
        for i, w in enumerate(node.words[1:], 1):
            starts = F.array_intersect(starts, _shifted(F.element_at("places", F.lit(w)), i))
        return places.select(*kept, F.size(starts).alias("times")).where(F.col("times") > 0)

    def _phrase(self, node: Phrase) -> DataFrame:
        return self.phrase_places(node).select("content_id") if node.words else self._none()


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _near(node: Phrase):
    words, slop = node.words, node.slop

    @F.pandas_udf("boolean")
    def near(column: pd.Series) -> pd.Series:
        def check(places) -> bool:
            places = dict(places)
            terms = {p: w for w, ps in places.items() for p in ps}
            return slop_match([terms.get(i, "") for i in range(max(terms) + 1)], words, slop)

        return column.map(check)

    return near
