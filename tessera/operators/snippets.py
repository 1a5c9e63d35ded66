"""Where terms stand in a text, in characters, and the smallest stretch that holds all of a query's words."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tessera.functions.lexer import Lexer, fold


def offsets(docs: DataFrame, lexer: Lexer = Lexer(), text: str = "content") -> DataFrame:
    """content_id, pos, term, start, end: each term of each document with its place in characters, end excluded.

    A text is words and the gaps around them, one more than the words: a word starts after all gaps and words before.
    """
    term = F.col("word") if lexer.preserve_case else fold(F.col("word"))
    return _placed(docs, lexer, text).select("content_id", F.inline("words")).select("content_id", "pos", term.alias("term"), "start", "end")


@F.arrow_udf(ArrayType(IntegerType()))
def _running(sizes: pa.Array) -> pa.Array:
    """Each list's running sums."""
    flat = np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    at = sizes.offsets.to_numpy() - sizes.offsets[0].as_py()
    before = np.concatenate([[0], flat])[at[:-1]]
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((flat - np.repeat(before, np.diff(at))).astype(np.int32)))


def _placed(docs: DataFrame, lexer: Lexer, text: str, among: list[str] | None = None) -> DataFrame:
    """content_id, words array<struct<pos, word, start, end>> of each text with words, summed up where it stands; of those among alone, if given."""
    if lexer.custom:
        raise ValueError("a custom lexer doesn't tell where its terms stand")
    whole = F.coalesce(F.col(text), F.lit(""))
    found = F.regexp_extract_all(whole, F.lit(lexer.pattern), F.lit(0))
    lexed = docs.select("content_id", F.explode(F.array(found)).alias("found"), whole.alias("whole")).where(F.size("found") > 0)
    if among is not None:
        # Documents without all the words needn't be cut.
        terms = F.col("found") if lexer.preserve_case else F.transform("found", fold)
        lexed = lexed.select("*", F.explode(F.array(terms)).alias("terms")).where(reduce(lambda a, b: a & b, [F.array_contains("terms", w) for w in among])).drop("terms")
    # The last gap, behind the last word, begins no word.
    gaps = F.slice(F.split("whole", lexer.pattern, -1), 1, F.size("found"))
    sizes = F.zip_with("found", gaps, lambda w, g: F.char_length(w) + F.char_length(g))
    placed = lexed.select("content_id", "found", _running(sizes).alias("ends"))

    def word(w: Column, i: Column) -> Column:
        end = F.get("ends", i)
        return F.struct(i.alias("pos"), w.alias("word"), (end - F.char_length(w)).alias("start"), end.alias("end"))

    words = F.transform("found", word)
    return placed.select("content_id", (words if among is None else F.filter(words, lambda w: (w["word"] if lexer.preserve_case else fold(w["word"])).isin(*among))).alias("words"))


def snippets(docs: DataFrame, words: list[str], lexer: Lexer = Lexer()) -> DataFrame:
    """content_id, start, end: of each document with all the words, the shortest stretch with all of them, the first of such.

    One running pass over the words' places: a stretch that ends at one of them begins at the earliest of the last places
    of all words so far. Documents are told apart by content_id.
    """
    words = list(dict.fromkeys(words))
    if not words:
        raise ValueError("no words")
    term = F.col("word") if lexer.preserve_case else fold(F.col("word"))
    rows = _placed(docs, lexer, "content", words).select("content_id", F.inline("words")).withColumn("term", term)
    so_far = Window.partitionBy("content_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("term") == w, F.col("start")), ignorenulls=True).over(so_far) for w in words]
    first = last[0] if len(last) == 1 else F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in last]), F.least(*last))
    stretches = rows.select("content_id", first.alias("start"), "end").where("start is not null")
    best = F.min(F.struct((F.col("end") - F.col("start")).alias("size"), "start", "end")).alias("best")
    return stretches.groupBy("content_id").agg(best).select("content_id", "best.start", "best.end")
