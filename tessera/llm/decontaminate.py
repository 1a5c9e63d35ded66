"""Benchmark decontamination by winnowed fingerprints; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import KEY, attach, let, n_words, small, table, with_key, words, written

#: Words of a shared span that is surely found, and of a fingerprint: the smallest of SPAN - GRAM + 1 hashes is kept.
SPAN, GRAM = 10, 5


def _count_up(last: Column) -> Column:
    """1 to last; empty if last is less."""
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def gram_hashes(tokens: Column, gram: int) -> Column:
    """The hash of every run of gram words, in order."""
    return let(
        F.transform(tokens, lambda w: F.xxhash64(w)),
        lambda h: F.transform(_count_up(F.size(h) - (gram - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(gram)])),
    )


def winnowed(tokens: Column, span: int, gram: int) -> Column:
    """The distinct least hashes of all windows of span words: two texts that share span words share one of them."""
    window = span - gram + 1
    hashes = gram_hashes(tokens, gram)
    if window == 1:
        return F.array_distinct(hashes)
    return let(
        hashes,
        lambda g: F.array_distinct(
            F.transform(_count_up(F.size(g) - (window - 1)), lambda i: F.least(*[F.element_at(g, i + k) for k in range(window)]))
        ),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Every row of docs with n_words, n_hit, n_items long, items array<string>, starts array<struct<at, length>>.

    n_hit counts the words inside an occurrence of any window: span consecutive words of an item, or a whole item of
    fewer words. items are the item_ids with windows that occur, distinct and sorted as strings; starts says where
    windows occur, words counted from 0. A null or wordless text has no words and no hit; items without words have no
    window; null item_ids are left out of items but their windows count. Repeated rows are each answered; copies of one
    item are items of their own if their item_id differs. The result has the columns of docs, but none of the new names.

    Both sides are winnowed and joined on the fingerprint; each match is extended to the windows that hold it and these
    are compared word by word. Items of fewer than span words keep all their hashes of their whole length. Which side of
    a join is broadcast the planner decides by the sizes of written tables.
    """
    new = ["n_words", "n_hit", "n_items", "items", "starts"]
    docs = docs.drop(*new)
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("_iw")).where(F.size("_iw") > 0)
    items = items.distinct()
    # At most span numbers, whatever the benchmark's size.
    lengths = sorted(r[0] for r in items.select(F.least(F.size("_iw"), F.lit(span)).alias("n")).distinct().collect())
    counted = docs.withColumn("n_words", n_words(F.col("text")))
    if not lengths:
        return counted.withColumns({"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "starts": F.array().cast("array<struct<at:int,length:int>>")})
    grams = {m: (gram if m == span else m) for m in lengths}

    def prints(tokens: Column) -> Column:
        return F.array(
            *[
                F.struct(F.lit(m).alias("m"), F.when(F.size(tokens) >= m, winnowed(tokens, m, grams[m])).alias("hs"))
                for m in lengths
            ]
        )

    def spread(df: DataFrame, tokens: Column, keep: list[str]) -> DataFrame:
        return df.select(*keep, F.inline(let(tokens, prints))).select(*keep, "m", F.explode("hs").alias("h"))

    def of_length(tokens: Column, m: Column) -> Column:
        """An item has windows of span words, or one of its own length."""
        return F.least(F.size(tokens), F.lit(span)) == m

    item_prints = written(spread(items, F.col("_iw"), ["item_id", "_iw"]).where(of_length(F.col("_iw"), F.col("m"))), "item-prints")
    doc_prints = spread(with_key(docs), words(F.col("text")), KEY)
    hits = doc_prints.join(item_prints.select("m", "h").distinct(), ["m", "h"])
    hits = written(hits.groupBy(*KEY).agg(F.collect_set(F.struct("m", "h")).alias("_hits")), "hit-documents")

    # Around each place of a shared fingerprint: the words of all windows that can hold it, null beyond the text.
    def around(tokens: Column, place: Column, m: int) -> Column:
        reach = m - grams[m]
        return F.transform(F.sequence(place - reach, place + (m - 1)), lambda i: F.get(tokens, i))

    def places(tokens: Column, wanted: Column) -> Column:
        def of(m: int) -> Column:
            return let(
                gram_hashes(tokens, grams[m]),
                lambda g: F.transform(
                    F.filter(_count_up(F.size(g)), lambda i: F.array_contains(wanted, F.struct(F.lit(m).alias("m"), F.element_at(g, i).alias("h")))),
                    lambda i: F.struct(F.lit(m).alias("m"), F.element_at(g, i).alias("h"), (i - 1).alias("at"), around(tokens, i - 1, m).alias("near")),
                ),
            )

        return F.flatten(F.array(*[of(m) for m in lengths]))

    # Few documents have hits: they are found before their texts go anywhere.
    few = attach(docs.select("doc_id", "text"), small(hits.select(*KEY)), "inner")
    found = attach(with_key(few).dropDuplicates(KEY), hits, "inner")
    found = found.select(*KEY, F.inline(let(words(F.col("text")), lambda w: places(w, F.col("_hits")))))
    marks = item_prints.groupBy("item_id", "_iw").agg(F.collect_set(F.struct("m", "h")).alias("_hits"))
    marks = marks.select("item_id", F.inline(places(F.col("_iw"), F.col("_hits")))).withColumnsRenamed({"at": "_q", "near": "_inear"})
    same = F.zip_with("near", "_inear", lambda a, b: F.coalesce(a == b, F.lit(False)))
    reach = F.size("near") - F.col("m")
    starts = let(
        same,
        lambda e: F.transform(
            F.filter(F.sequence(F.lit(0), reach), lambda o: F.forall(F.slice(e, o + 1, F.col("m")), lambda x: x)),
            lambda o: (F.col("at") - reach + o).cast("int"),
        ),
    )
    windows = found.join(written(marks, "item-places"), ["m", "h"]).select(*KEY, "item_id", "m", F.explode(starts).alias("at"))
    facts = windows.groupBy(*KEY).agg(
        F.array_sort(F.collect_set(F.struct("at", F.col("m").alias("length")))).alias("starts"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    facts = written(facts.withColumn("n_hit", covered(F.col("starts"))), "contaminated")
    out = attach(counted, facts)
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        *docs.columns, "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        items_of.alias("items"),
        F.coalesce("starts", F.array().cast("array<struct<at:int,length:int>>")).alias("starts"),
    )


def covered(starts: Column) -> Column:
    """Words inside at least one of the sorted spans."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["at"] + x["length"] - F.greatest(s["end"], x["at"]))).cast("long").alias("n"),
            F.greatest(s["end"], x["at"] + x["length"]).cast("long").alias("end"),
        ),
        lambda s: s["n"],
    )


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_sql() -> str:
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({fold}, {pattern}) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({fold}, {pattern}) AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[s : s + m - 1], ' ') AS win FROM (
  SELECT item_id, w, least(len(w), {SPAN}) AS m, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) AS s FROM i WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT r, m, s, array_to_string(w[s : s + m - 1], ' ') AS win FROM (
  SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT r, dw.m, s, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.m = iw.m),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT r, s, m FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""
