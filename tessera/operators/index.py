"""Search engines: over documents as they stand, and over an index that is updated in segments."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lexer import Lexer
from tessera.operators.segments import Conflict, Pointer, Segments, has_repeats, positions
from tessera.plans.ast import Builder, Query
from tessera.plans.indexed import WINDOW, Postings
from tessera.plans.parser import Parser
from tessera.plans.ranked import Ranking
from tessera.plans.scan import condition

__all__ = ["Conflict", "IndexEngine", "Pointer", "ScanEngine", "SearchResult", "files_of", "positions", "relevance", "top_hits"]

MAX_RESULTS = 262_144


@dataclass
class SearchResult:
    """Either errors, or the rows found."""

    errors: list[str] = field(default_factory=list)
    rows: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)
    limit: int | None = None

    @property
    def failed(self) -> bool:
        return bool(self.errors)

    def truncated(self) -> bool:
        """Whether there may be more than the limit let through: counts the rows."""
        return bool(self.limit) and self.rows is not None and self.rows.count() == self.limit


class ScanEngine:
    """Answers queries over documents (content_id, content) without an index."""

    def __init__(self, docs: DataFrame, lexer: Lexer = Lexer(), **options):
        self.docs, self.lexer, self.parser = docs, lexer, Parser(lexer, **options)
        self.builder = Builder(self.parser)

    def search(self, query: Query | str, limit: int | None = MAX_RESULTS) -> SearchResult:
        query = self.parser(query) if isinstance(query, str) else query
        if query.errors:
            return SearchResult(query.errors, None, query.warnings)
        # The condition refers to the terms many times; they are computed once, below it.
        terms = self.docs.select("content_id", F.explode(F.array(self.lexer.terms(F.col("content")))).alias("_terms"))
        return _limited(terms.where(condition(query.node, F.col("_terms"))).select("content_id"), limit, query.warnings)


def _limited(found: DataFrame, limit: int | None, warnings: list[str]) -> SearchResult:
    """The smallest ids, if there is a limit: the same ones each time."""
    return SearchResult([], found.orderBy("content_id").limit(limit) if limit else found, warnings, limit)


class IndexEngine:
    """An index under a path, in segments; see segments.py. Readers see the segments of one list, whatever writers do.

    Ids live with the index, so that they stay valid from one session to the next. Ranks count replaced documents among
    those that have a term, until their segment is merged.
    """

    def __init__(self, spark: SparkSession, path: str, lexer: Lexer = Lexer(), window: int = WINDOW, **options):
        """window: how many ids share the bounds of ranks; one index has one."""
        self.spark, self.path, self.lexer, self.parser = spark, path.rstrip("/"), lexer, Parser(lexer, **options)
        self.builder = Builder(self.parser)
        self.segments = Segments(spark, self.path, window)

    def tables(self, version: str | None = None) -> Postings:
        """Those of a version, or of the current one."""
        return self.segments.tables(version)

    def update(self, docs: DataFrame) -> None:
        """Puts documents (content_id, content) in, in place of those of the same id. Of an id given twice, any one text counts."""
        docs = docs.where("content_id is not null").select("content_id", "content")
        docs = docs.dropDuplicates(["content_id"]) if has_repeats(docs) else docs
        self.segments.append(self.segments.put(docs, self.lexer))
        self.segments.merge()

    def remove(self, ids: DataFrame) -> None:
        self.segments.append(self.segments.write(None, None, ids.where("content_id is not null")))
        self.segments.merge()

    def search(self, query: Query | str, limit: int | None = MAX_RESULTS, ranked: bool = False) -> SearchResult:
        """ranked: the best of them first, with their score; see ranked.py. Else the smallest ids, if there is a limit; truncated() says whether it was reached."""
        query = self.parser(query) if isinstance(query, str) else query
        if query.errors:
            return SearchResult(query.errors, None, query.warnings)
        tables = self.tables()
        if not ranked:
            return _limited(tables.ids(query.node), limit, query.warnings)
        ranking = Ranking(tables, query.node)
        if limit is None:
            return SearchResult([], ranking.scored(tables).orderBy(F.desc("score"), "content_id"), query.warnings)
        return SearchResult([], ranking.best(limit).rows, query.warnings)

    def vacuum(self, keep: int = 2) -> None:
        self.segments.pointer.vacuum(keep)


def relevance(postings: Postings, words: list[str]) -> DataFrame:
    """content_id, score: the sum over words of sqrt(tf) idf squared, idf = 1 + ln(n / (df + 1)), over sqrt(document length)."""
    rows = postings.postings.where(F.col("term").isin(*words)).join(postings.vocabulary, "term")
    n = postings.documents.agg(F.count(F.lit(1)).alias("_n"))
    idf = 1 + F.log(F.col("_n") / (F.col("documents") + 1))
    # n is one row.
    known = [F.first("length").alias("_length")] if "length" in rows.columns else []
    scored = rows.join(F.broadcast(n)).groupBy("content_id").agg(F.sum(F.sqrt(F.size("positions")) * idf * idf).alias("_s"), *known)
    if not known:
        scored = scored.join(postings.postings.groupBy("content_id").agg(F.sum(F.size("positions")).alias("_length")), "content_id")
    return scored.select("content_id", (F.col("_s") / F.sqrt("_length")).alias("score"))


def top_hits(scored: DataFrame, limit: int = MAX_RESULTS) -> DataFrame:
    return scored.orderBy(F.desc("score"), "content_id").limit(limit)


def files_of(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits joined with the files that have their content: one content may have several; entries without a path are left out."""
    return files.where("path is not null").join(hits.select("content_id").distinct(), "content_id", "left_semi")
