"""Each stage of the corpus pipeline against a plain version, and run() and the registered queries on a small folder."""

import random

import __spark_entry__
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tessera.llm import bpe, common, lines, registry, toxicity

RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = " ".join(f"item{i}" for i in range(14))


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def rows():
    out = []
    for i in range(60):
        body = prose(60)
        out.append((i, "\n".join([body, *["A common line"] * (i % 3 == 0), *[prose(8)] * (i % 2)])))
    for i in range(60, 75):  # near copies, some of a copy
        w = out[i - 60][1].split(" ")
        w[RNG.randrange(len(w))] = "other"
        out.append((i, " ".join(w)))
    out += [(80, prose(9) + " " + ITEM.title() + " " + prose(9)), (81, "x " + " ".join(ITEM.split()[:9])), (82, prose(30) + " vile vile"), (83, "a common line"), (84, " A COMMON LINE\n")]
    out += [(90, None), (91, ""), (92, " \n"), (None, prose(20)), (None, None), (5, out[5][1]), (5, prose(25)), (93, "word " * 30_000)]
    out += [(100 + i, prose(20) + (" vile" if i % 2 else "")) for i in range(60)]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(100 + i, 0, i % 2) for i in range(60)] + [(None, 0, 1), (101, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("a", ITEM), ("b", None), ("c", "item0 item1 zzz")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain(r):
    return (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")


def kept(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()), key=plain)


def tokens(text, space=False):
    import re

    return (text or "").lower().split() if space else re.findall(common.WORD, (text or "").lower())


def plain_toxicity(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(docs, labels)
    return lambda rows: [r for r in rows if model.score(toxicity.words_of(r[1])) < 0.5]


def plain_lines(rows):
    """The first document, in order of doc_id and hashes of its text, keeps a common line."""
    found, out, seen = {}, [], set()
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if key := lines.line_key(line.encode()):
                found.setdefault(key, set()).add((i, t))
    hot = {k for k, docs in found.items() if len(docs) >= 10}
    for i, t, lang, source, n in sorted(rows, key=plain):
        stay, gone = [], 0
        for line in (t or "").split("\n"):
            key = lines.line_key(line.encode())
            if key in hot and key in seen:
                gone += 1
                continue
            seen.add(key)
            stay.append(line)
        new = "\n".join(stay)
        if not gone:
            out.append((i, t, lang, source, n))
        elif new.strip(common.SPACE):
            out.append((i, new, lang, source, len(new)))
    return out


def plain_near(rows):
    sets = []
    for i, t, *_ in rows:
        w = tokens(t, True)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    ids = {i: i for i, _ in sets if i is not None}
    group = list(range(len(sets)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, (i, s) in enumerate(sets):
        for b, (j, t) in enumerate(sets):
            if a < b and i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[top(a)] = min(i, least.get(top(a), i))
    stays = {i for i in ids if any(least[top(a)] == i for a, (j, _) in enumerate(sets) if j == i)}
    return [r for r in rows if r[0] is None or r[0] in stays]


def plain_clean(rows):
    item = ITEM.split()
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)} | {("item0", "item1", "zzz")}

    def hit(t):
        w = tokens(t)
        return any(tuple(w[k : k + n]) in windows for n in (3, 10) for k in range(len(w) - n + 1))

    return [r for r in rows if not hit(r[1])]


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("toxicity", "line_dedup", "near_duplicates", "decontamination", "byte_bpe")
    for k, version in enumerate((plain_toxicity(spark, docs, folder), plain_lines, plain_near, plain_clean)):
        before = kept(docs)
        out = stages[k](spark, docs, folder)
        assert out.columns == docs.columns
        docs = common.written(out, names[k])
        after = kept(docs)
        assert after == sorted(version(before), key=plain), names[k]
        assert 0 < len(after) < len(before), names[k]
    out = stages[4](spark, docs, folder)
    want = kept(docs)
    assert sorted(r.doc_id or -1 for r in out.collect()) == sorted(r[0] or -1 if r[0] != 0 else -1 for r in want)
    assert {r.decoded_sha256 for r in out.collect()} == {__import__("hashlib").sha256((t or "").encode()).hexdigest() for _, t, *_ in want}
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id or -1, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id or -1, r.ids_sha256) for r in out.collect())


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_suffix_dedup", "op3_winnowing", "op4_license_scan", "op5_jaccard_tiles", "op8_toxicity", "op9_byte_bpe", "op10_virtual_slots"])
def test_registered_queries_answer_every_row(spark, folder, name):
    assert name in __spark_entry__.queries()
    got = registry.QUERIES[name](spark, folder)
    assert sorted(r.doc_id or -1 for r in got.select("doc_id").collect()) == sorted(r[0] or -1 for r in rows())


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License\nx", 7, 8, 9, 1, 2, 3)], "doc_id long, text string, _k1 int, _k2 int, _id int, _own0 int, _bitmap int, n_words int")
    items = spark.createDataFrame([("a", ITEM)], "item_id string, text string")
    from tessera.llm import decontaminate, licenses

    kept = ["_k1", "_k2", "_id", "_own0", "_bitmap"]
    for out in (licenses.scan_licenses(docs), decontaminate.decontaminate(docs, items), lines.dedup_lines(docs), toxicity.score(docs, toxicity.Model(0.0, {}))):
        assert [out.first()[c] for c in kept] == [7, 8, 9, 1, 2]
    assert licenses.scan_licenses(docs).first().n_words == 6 and bpe.encode_decode(docs, __import__("public_tokenizers").path("byte_bpe_50k.tiktoken")).count() == 1
