"""License scans: phrases, and an exact set-similarity join of text blocks with notice templates; DataFrame functions only.

The sets are of pairs of consecutive words, so that words must stand in a notice's order and together. A block is a stretch
of words anywhere in the text, over lines and paragraphs, as long as the notice divided by the threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import KEY, attach, let, table, text_key, words, written

# The phrases of the contract and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Openings of well-known licence notices, and whole ones (text-...); words in lower case.
TEMPLATES = {
    "notice-apache-2.0": "licensed under the apache license version 2 0",
    "notice-bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "notice-cc-by-4.0": "licensed under cc by 4 0",
    "notice-cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "notice-gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "notice-gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "notice-mit": "released under the mit license",
    "notice-mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "text-apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
    "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
    "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license",
    "text-bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution",
    "text-gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
    "by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that "
    "it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
    "general public license for more details",
    "text-mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
    "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
    "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is "
    "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
    "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
}
THRESHOLD = 0.8


NO_PLACES = "array<struct<at:int,label:string>>"


def phrase_places(words: Column, phrases: dict[str, str] = PHRASES) -> Column:
    """array<struct<at, label>>, in order: where a phrase's words stand consecutively."""

    def of(phrase: str, label: str) -> Column:
        parts = phrase.split()
        last = F.size(words) - (len(parts) - 1)
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        hits = F.filter(at, lambda i: F.forall(F.array(*map(F.lit, range(len(parts)))), lambda k: F.element_at(words, i + k) == F.get(F.array(*map(F.lit, parts)), k)))
        return F.transform(hits, lambda i: F.struct((i - 1).alias("at"), F.lit(label).alias("label")))

    return F.array_sort(F.flatten(F.array(*[of(*x) for x in phrases.items()])))


@dataclass(frozen=True)
class Template:
    name: str
    words: list[str]

    @property
    def pairs(self) -> list[str]:
        """Its distinct pairs of consecutive words."""
        return sorted({" ".join(pair) for pair in zip(self.words, self.words[1:], strict=False)})

    def need(self, threshold: float) -> int:
        """Pairs that a block has at least."""
        return math.ceil(threshold * len(self.pairs) - 1e-9)

    def span(self, threshold: float) -> int:
        """Places of pairs in a block."""
        return math.ceil((len(self.words) - 1) / threshold - 1e-9)

    def least_words(self, threshold: float) -> int:
        """Distinct words that such a block has at least: as pairs link all the words, each missing pair takes one word at most."""
        return len(set(self.words)) - (len(self.pairs) - self.need(threshold))


def _templates(templates: dict[str, str]) -> list[Template]:
    found = [Template(name, text.split()) for name, text in templates.items()]
    if not found or any(len(t.words) < 2 for t in found):
        raise ValueError("templates need two words at least")
    return found


def scanned(docs: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """A written table of a row for each row of docs: KEY, n_words, places and, where a template may be met, words.

    The only pass over the texts, which are cut into words once. A text may meet a template if it has enough of its
    distinct words (the length filter, by documents); the words of others are null.
    """
    known = _templates(templates)
    vocabulary = F.array(*map(F.lit, sorted({w for t in known for w in t.words})))
    # A phrase may stand where its longest words do; then the words are compared.
    longest = sorted({max(p.split(), key=len) for p in PHRASES})

    def facts(found: Column) -> Column:
        maybe = F.array_contains(found, longest[0])
        for word in longest[1:]:
            maybe = maybe | F.array_contains(found, word)

        def plausible(own: Column) -> Column:
            enough = F.lit(False)
            for t in known:
                enough = enough | (F.size(F.array_intersect(own, F.array(*map(F.lit, sorted(set(t.words)))))) >= t.least_words(threshold))
            return enough

        return F.struct(
            F.size(found).cast("long").alias("n_words"),
            F.when(maybe, phrase_places(found)).otherwise(F.array().cast(NO_PLACES)).alias("places"),
            F.when(let(F.array_intersect(vocabulary, found), plausible), found).alias("words"),
        )

    rows = docs.select("doc_id", *text_key(F.col("text")), let(words(F.col("text")), facts).alias("facts"))
    return written(rows.select(*KEY, "facts.*"), "scanned")


def _index(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(token, template, size, need, span, rank) of the templates' pairs: a parameter of the call, and as small as that."""
    fields = F.explode(F.transform(F.split(F.lit("\n".join("\t".join(map(str, row)) for row in rows)), "\n"), lambda row: F.split(row, "\t")))
    numbers = [F.col("row")[i].cast("int").alias(n) for i, n in enumerate(("size", "need", "span", "rank"), 2)]
    return F.broadcast(spark.range(1).select(fields.alias("row")).select(F.col("row")[0].alias("token"), F.col("row")[1].alias("template"), *numbers))


def template_matches(scan: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """doc_id, _k1, _k2, blocks array<struct<at, template, containment>> of what scanned() gives.

    A block begins where one of the template's pairs stands and is as many places long as the template has, divided by
    threshold; it meets the template if it holds at least threshold of its distinct pairs. Every such block is found:
    pairs are ordered by how often the whole corpus has them, rarest first; a block that meets a template has one of
    the first n - ceil(threshold n) + 1 (prefix filter) and ceil(threshold n) places at least (length filter), and after
    its first one in that order as many are left (positional filter). Blocks that overlap are given as one: at is its
    first word, counted from 0, containment the best of them.
    """
    spark, known = scan.sparkSession, _templates(templates)
    rows = [(pair, t.name, len(t.pairs), t.need(threshold), t.span(threshold)) for t in known for pair in t.pairs]
    pairs = F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))
    places = scan.where("words IS NOT NULL").select(*KEY, F.posexplode(pairs).alias("at", "token"))
    hits = written(places.join(_index(spark, [(*row, 0) for row in rows]), "token").select(*KEY, "at", "template", "token"), "hits")
    # A row for each pair of the templates.
    frequency = {r["token"]: r["count"] for r in hits.groupBy("token").count().collect()}
    ranked = []
    for t in known:
        order = {pair: rank for rank, pair in enumerate(sorted(t.pairs, key=lambda x: (frequency.get(x, 0), x)))}
        ranked += [(*row, order[row[0]]) for row in rows if row[1] == t.name]
    found = hits.join(_index(spark, ranked), ["token", "template"])
    # Copies of one document give equal places.
    of_one = found.groupBy(*KEY, "template", "size", "need", "span").agg(F.array_sort(F.collect_set(F.struct("at", "rank"))).alias("hits"))
    candidates = of_one.where((F.size("hits") >= F.col("need")) & F.exists("hits", lambda h: F.col("size") - h["rank"] >= F.col("need")))

    def block(h: Column, i: Column) -> Column:
        # A place has one pair: span places have span hits at most.
        inside = F.filter(F.slice("hits", i + 1, F.col("span")), lambda x: x["at"] < h["at"] + F.col("span"))

        def common(inside: Column) -> Column:
            may = (F.size(inside) >= F.col("need")) & F.exists(inside, lambda x: F.col("size") - x["rank"] >= F.col("need"))
            return F.when(may, F.size(F.array_distinct(F.transform(inside, lambda x: x["rank"])))).otherwise(0)

        return F.struct(h["at"].alias("at"), let(inside, common).alias("common"))

    blocks = candidates.select(*KEY, "template", "size", "need", "span", F.inline(F.transform("hits", block))).where(F.col("common") >= F.col("need"))
    in_order = Window.partitionBy(*KEY, "template").orderBy("at")
    apart = F.coalesce(F.col("at") - F.lag("at").over(in_order) >= F.col("span"), F.lit(True)).cast("int")
    merged = blocks.withColumn("apart", apart).withColumn("number", F.sum("apart").over(in_order)).groupBy(*KEY, "template", "number")
    met = merged.agg(F.min("at").alias("at"), F.max(F.col("common") / F.col("size")).alias("containment"))
    return met.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "template", "containment"))).alias("blocks"))


NO_BLOCKS = "array<struct<at:int,template:string,containment:double>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs with n_words long, places and blocks, in place of such columns.

    places: where the phrases' words stand consecutively, words from 0; blocks: the stretches that meet a template, see
    template_matches(). A null or empty text has no word, place or block; rows of equal doc_id and text (nulls included)
    are copies of one document, each with the same result; an empty table gives none. A template has two words at least.
    """
    scan = scanned(docs.select("doc_id", "text"), templates, threshold)
    facts = scan.select(*KEY, "n_words", "places").dropDuplicates(KEY)
    blocks = template_matches(scan, templates, threshold)
    return attach(attach(docs, facts), blocks).withColumn("blocks", F.coalesce("blocks", F.array().cast(NO_BLOCKS)))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), TEMPLATES, THRESHOLD)
    matches = template_matches(scan, TEMPLATES, THRESHOLD).withColumnsRenamed({"doc_id": "id", "_k1": "k1", "_k2": "k2"})
    out = scan.join(matches, F.expr("doc_id <=> id AND _k1 = k1 AND _k2 = k2"), "left")
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    own = F.coalesce(F.transform("blocks", lambda b: b["template"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return out.select(
        "doc_id", "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0))["at"].cast("long").alias("first_word"),
        F.get("places", F.size("places") - 1)["at"].cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def op4_sql() -> str:
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in PHRASES.items())
    known = [(t, p) for t in _templates(TEMPLATES) for p in t.pairs]
    templates = ", ".join(f"('{t.name}', '{p}', {len(t.pairs)}, {t.need(THRESHOLD)}, {t.span(THRESHOLD)})" for t, p in known)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all({fold.format('text')}, {pattern}) AS w FROM d),
p(words, label) AS (VALUES {phrases}),
hit AS (SELECT r, s - 1 AS pos, label FROM (SELECT r, w, words, label, unnest(range(1, len(w) - len(words) + 2)) AS s FROM w, p)
  WHERE w[s : s + len(words) - 1] = words),
base AS (SELECT r, count(*) AS n, min(pos) AS a, max(pos) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY r),
t(name, token, size, need, span) AS (VALUES {templates}),
h AS (SELECT r, pos, t.* FROM (SELECT r, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS token FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM w)) JOIN t USING (token)),
m AS (SELECT r, name, max(k / size) AS c FROM (SELECT a.r, a.name, a.pos, any_value(a.size) AS size, any_value(a.need) AS need, count(DISTINCT b.token) AS k
  FROM h a JOIN h b ON a.r = b.r AND a.name = b.name AND b.pos BETWEEN a.pos AND a.pos + a.span - 1 GROUP BY a.r, a.name, a.pos) WHERE k >= need GROUP BY r, name),
own AS (SELECT r, max(c) AS c FROM m GROUP BY r),
labels AS (SELECT r, string_agg(x, ',' ORDER BY x) AS labels FROM (SELECT r, label AS x FROM hit UNION SELECT r, name FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(labels.labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(c, 0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN own USING (r) LEFT JOIN labels USING (r)"""
