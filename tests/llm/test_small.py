"""Edge rows, round trips and brute force for the other operators, on small tables."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tessera.llm import ann, bpe, chat, common, components, decontaminate, jaccard, licenses, lines, shards, shingles, suffixes, toxicity

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(30)]


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def test_bpe_is_what_tiktoken_gives(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello  world\n\n x", "é" * 500, "a\x1cb 漢字😀 <|endoftext|>", "x" * 3000, " \t "]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.encode_decode(rows, path).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == plain.encode_ordinary(t or "") and bytes(got[i].decoded).decode() == (t or "")
    assert bpe.encode_decode(rows.limit(0), path).count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\<|im_end|>\n", "<\\|im_end|>", None, "<|im_end|>\n<|im_start|>user\nx", "[INST]\\[/INST]<<s>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, None, None, "x"), (None, 0, "a\n<|im_start|>b", "y")]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r for r in out.withColumn("text", chat.formatted(F.col("segments"))).withColumn("back", chat.read_back(F.col("text"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()}
    assert [(t.role, t.text) for t in back[1].back] == [(r, t or "") for _, _, r, t in rows[:7]]
    assert back[1].loss == "".join(t or "" for _, _, r, t in rows[:7] if r == "assistant") and not back[1].valid
    assert [(t.role, t.text) for t in back[None].back] == [("a\n<|im_start|>b", "y")] and not back[2].valid
    fine = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(fine).first().valid and chat.format_chat(fine.limit(0)).count() == 0


def test_shards(spark):
    rows = [(i % 300, "x" * RNG.randint(0, 400)) for i in range(900)] + [(None, None)]
    out = shards.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 7, 256).collect()
    size = [sum(r.size for r in out if r.shard == s) for s in range(7)]
    assert sum(size) == sum(len(t or "") + 8 for _, t in rows) and max(size) - min(size) <= 0.02 * sum(size) / 7
    for s in range(7):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert {r.text_crc32 for r in out} == {zlib.crc32((t or "").encode()) for _, t in rows}
    old = shards.SlotMap.uniform(24, 1000)
    grown = old.grown(25)
    assert grown.version == 1 and all(b in (a, 24) for a, b in zip(old.shard_of, grown.shard_of, strict=True)) and grown.shard_of.count(24) == 40
    assert shards.shard_documents(spark.createDataFrame([], "doc_id long, text string"), 3).count() == 0


def test_decontamination_with_short_and_null_items(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, long), (2, "Short item, here"), (3, None), (4, "..."), (None, "alpha beta gamma"), (1, long)], "item_id long, text string")
    docs = [(1, "x " + long + " y"), (2, "a short ITEM here. b"), (3, None), (4, ""), (5, "one two three four five six seven eight nine"), (None, "alpha beta gamma"), (1, "x " + long + " y")]
    got = decontaminate.decontaminate(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, items int"), items).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, ",".join(r.items)) for r in got) == [(0, 3, 3, ""), (1, 14, 12, "1"), (1, 14, 12, "1"), (2, 5, 3, "2"), (3, 0, 0, ""), (4, 0, 0, ""), (5, 9, 0, "")]
    none = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), items.limit(0))
    assert none.agg(F.sum("n_hit")).first()[0] == 0


def test_licenses(spark):
    docs = [(1, "Released under the MIT License.\nx"), (2, None), (3, "released, under the mit"), (4, "cc by cc by"), (None, "Apache-License apache license")]
    out = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: ([(p.at, p.label) for p in r.places], [b.template for b in r.blocks]) for r in out.collect()}
    assert got[1] == ([(3, "mit")], ["notice-mit"]) and got[2] == ([], []) and got[3] == ([], [])  # three of the four pairs of words
    assert got[4][0] == [(0, "cc-by"), (2, "cc-by")] and got[None][0] == [(0, "apache"), (2, "apache")]


def test_license_blocks_are_stretches_of_words_in_order(spark):
    bsd = licenses.TEMPLATES["notice-bsd"].split()
    lines = "\n# ".join(" ".join(bsd[i : i + 8]) for i in range(0, len(bsd), 8))
    docs = [(1, lines), (2, "the software version 2 released by mit under the old license rules the day"), (3, "x " * 50 + lines.upper() + " y" * 50 + " " + lines), (4, " z ".join(bsd))]
    docs += [(5, "so.\n\n" + licenses.TEMPLATES["text-mit"].replace("the software is", "THE SOFTWARE\nis")), (6, " ".join(sorted(bsd)))]
    out = licenses.scan_licenses(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, blocks int"))
    got = {r.doc_id: [(b.at, b.template, b.containment) for b in r.blocks] for r in out.collect()}
    assert got[1] == [(0, "notice-bsd", 1.0)] and got[2] == got[4] == got[6] == []
    assert got[3] == [(50, "notice-bsd", 1.0), (100 + len(bsd), "notice-bsd", 1.0)]
    assert {t for _, t, _ in got[5]} == {"notice-mit-text", "text-mit"} and (1, "text-mit", 1.0) in got[5]
    empty = licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and "blocks" in empty.columns
    with pytest.raises(ValueError, match="two words"):
        licenses.scan_licenses(out, {"one": "word"})


def license_brute(text, templates, threshold):
    found, words = [], re.findall(common.WORD, (text or "").translate(toxicity._FOLD))
    pairs = list(zip(words, words[1:], strict=False))
    for name, template in templates.items():
        own = template.split()
        known = set(zip(own, own[1:], strict=False))
        last = None
        for at, pair in enumerate(pairs):
            if pair in known:
                share = len(known.intersection(pairs[at : at + math.ceil((len(own) - 1) / threshold - 1e-9)])) / len(known)
                if share >= threshold - 1e-9:
                    if last is not None and at - last < math.ceil((len(own) - 1) / threshold - 1e-9):
                        found[-1] = (*found[-1][:2], max(found[-1][2], share))
                    else:
                        found.append((at, name, share))
                    last = at
    return sorted(found)


def test_license_blocks_equal_brute_force(spark):
    rng = random.Random(4)
    templates = {"ab": "a b", "long": "a b c a b d e f g h b c d a e", "short": "c d e c d", "loop": "a a b a a"}
    docs = [(i, rng.choice([" ", "\n", ", "]).join(rng.choice("abcdefgh") if rng.random() < 0.4 else rng.choice(list(templates.values())) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    docs += [(None, docs[0][1]), (200, None), (0, docs[0][1]), (201, " ".join(templates["long"] for _ in range(3000)))]
    for threshold in (0.6, 0.8, 1.0):
        out = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), templates, threshold).collect()
        assert len(out) == len(docs)
        texts = {}
        for doc_id, text in docs:
            texts[doc_id] = license_brute(text, templates, threshold)
        for r in out:
            assert [(b.at, b.template, round(b.containment, 9)) for b in r.blocks] == [(a, t, round(c, 9)) for a, t, c in texts[r.doc_id]], (r.doc_id, threshold)


def jaccard_brute(rows, words, percent):
    sets = {}
    for doc, t in rows:
        w = (t or "").lower().split()
        sets[doc] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    group = {d: d for d in sets}

    def top(d):
        while group[d] != d:
            d = group[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


@pytest.mark.parametrize("words,percent,banded", [(4, 85, 2000), (5, 80, 2000), (2, 50, 1)])
def test_jaccard_against_brute_force(spark, monkeypatch, words, percent, banded):
    monkeypatch.setattr(jaccard, "BANDED", banded)
    rows = [(i, text(RNG.choice([0, 1, 3, 12, 40, 90]))) for i in range(60)]
    for i in range(60, 160):
        w = rows[RNG.randrange(60)][1].split()
        for _ in range(RNG.randint(0, 3)):
            if w:
                w[RNG.randrange(len(w))] = RNG.choice(WORDS)
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, " \n"), (502, "Only"), (503, "only")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_brute(rows, words, percent)


@pytest.mark.parametrize("percent", [50, 80])
def test_jaccard_of_repeated_ids_against_brute_force(spark, percent):
    rows = [(i, text(RNG.choice([0, 3, 12, 40]))) for i in range(40)]
    for i in range(40, 110):
        w = rows[RNG.randrange(40)][1].split()
        for _ in range(RNG.randint(0, 4)):
            if w:
                w[RNG.randrange(len(w))] = RNG.choice(WORDS)
        rows.append((i, " ".join(w)))
    rows += [RNG.choice(rows[:110]) for _ in range(40)]  # equal texts
    rows += [(RNG.randrange(120), RNG.choice(rows[:110])[1] + RNG.choice(["", " w1", " w2 w3"])) for _ in range(60)]  # differing ones
    # 201 has one text that links with nothing, and one that links with 200; each on two rows.
    rows += [(200, "a b c d e f g h"), *[(201, "p q r s t u v w"), (201, "A b c d e f g h")] * 2, (202, None), (202, None), (202, "lone words"), (None, "a b")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, percent).collect()
    # In order of doc_id, so that the least row of a group has its least doc_id.
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(1, None)]
    got = [r for r in got if r.doc_id is not None]
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    plain = jaccard_brute(list(enumerate(t for _, t in rows)), 2, percent)
    expected = sorted((doc, plain[i][0], rows[plain[i][1]][0]) for i, (doc, _) in enumerate(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected


def test_signatures_never_lose_a_link():
    for _ in range(200):
        x = np.unique(np.random.default_rng(RNG.randrange(10**6)).integers(0, 2**63, RNG.randint(1, 900), dtype=np.uint64))
        y = np.unique(np.r_[x[: max(1, int(len(x) * RNG.random()))], np.random.default_rng(RNG.randrange(10**6)).integers(0, 2**63, RNG.randint(0, 300), dtype=np.uint64)])
        if jaccard.linked(x, y, 80):
            for bits in (512, jaccard.signature_bits(max(len(x), len(y)))):
                most = jaccard.most_common(len(x), jaccard.signature(x, bits), np.array([len(y)]), jaccard.signature(y, bits)[None])[0]
                assert most >= np.intersect1d(x, y).size and 100 * most >= 80 * (len(x) + len(y) - most)


@pytest.mark.parametrize("bound", [0, 200_000])
def test_components(spark, monkeypatch, bound):
    monkeypatch.setattr(components, "ONE_TASK", bound)
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (60, 100), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 100: 50}


def test_shingles():
    texts = pa.array(["", None, "a", "A b", "a b c D", "a b c d", "  a\tb\x0bc d e "])
    sets = list(shingles.shingle_sets(texts, 4))
    assert [len(s) for s in sets] == [0, 0, 1, 1, 1, 1, 2] and sets[4] == sets[5] and sets[5][0] in sets[6]


@pytest.mark.parametrize("block,group,chunk", [(8 << 20, 200_000, 1 << 20), (2000, 2, 700)])
def test_suffixes_against_brute_force(spark, monkeypatch, block, group, chunk):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
    shared = [text(25) for _ in range(6)]
    rows = [(i, " é ".join(RNG.choice(shared) if RNG.random() < 0.5 else text(8) for _ in range(RNG.randint(0, 5)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "!" * 300), (103, "!" * 120), (104, shared[0][:50]), (105, shared[0][:49]), (106, "\0" * 60), (107, "a" + "\0" * 55)]
    got = suffixes.dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = suffixes.brute_force(rows)
    for r in got:
        assert (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) == expected[r.doc_id], r.doc_id
    assert len(got) == len(rows)


@pytest.mark.parametrize("bounds", [(700, 1500, 400), (1 << 20, 1500, 400), (2000, 1500, 137)])
def test_suffixes_of_long_texts_against_brute_force(spark, bounds):
    shared = [text(30) for _ in range(5)]
    long = lambda: " ".join(RNG.choice(shared) if RNG.random() < 0.5 else text(20) for _ in range(40))
    rows = [(i, long() if i % 7 == 3 else RNG.choice(shared) + text(5) if i % 2 else text(6)) for i in range(40)]
    rows += [(50, rows[3][1][300:] + "!"), (51, "?" + rows[3][1]), (52, rows[10][1])]
    got = suffixes.dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string"), 50, bounds).collect()
    assert {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got} == suffixes.brute_force(rows)


def test_suffixes_over_many_partitions(spark):
    shared = [text(25) for _ in range(4)]
    rows = [(i, RNG.choice(shared) + text(9) + RNG.choice(shared)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(60)
    got = suffixes.dedup_suffixes(docs, 50).collect()
    assert {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got} == suffixes.brute_force(rows) and len(got) == 300


def test_suffixes_of_repeated_and_null_ids(spark):
    t = text(40)
    rows = [(None, t), (5, t), (5, t), (7, t), (None, t)]
    got = sorted((r.doc_id or 0, len(r.kept)) for r in suffixes.dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, len(t)), (0, len(t)), (5, len(t)), (5, len(t)), (7, 0)]
    assert suffixes.dedup_suffixes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lean_steps_leave_workers_small():
    def resident():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Anonymous:")) / 1024

    common.worker_state()["model"] = [bytes(500) for _ in range(200_000)]  # as left by a step before

    def run(batches):
        for batch in batches:
            held = [bytes(1000) for _ in range(100_000)]
            yield pa.RecordBatch.from_arrays([pa.array([len(held)])], ["n"])

    before = resident()
    got = list(common.lean(run)(iter([pa.RecordBatch.from_arrays([pa.array([1])], ["n"])] * 2)))
    assert [b.column(0).to_pylist() for b in got] == [[100_000]] * 2 and not common.worker_state()
    assert resident() < before - 70


def test_toxicity_and_line_steps_leave_workers_small(spark, monkeypatch):
    steps, docs = [], spark.createDataFrame([(1, "a")], "doc_id long, text string")
    frame = type(docs)
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, real=frame.mapInArrow: steps.append(f) or real(self, f, *a))
    toxicity.score(docs, toxicity.Model(0.0, {}))
    lines.apply_bitmaps(docs, docs.select("doc_id", *common.text_key(F.col("text")), F.lit(None).cast("binary").alias("bitmap")))
    texts = [f"{i} " + "long text " * 200 for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["doc_id", "text"])
    for step, given in zip(steps, [batch, batch.append_column("bitmap", pa.nulls(2000, pa.binary()))], strict=True):
        common.worker_state()["model"] = "left by a step before"
        got = list(step(iter([given])))
        assert not common.worker_state()
        assert len(got) > 1 and all(b.nbytes < 2 * common.PART_BYTES for b in got)
        assert [x for b in got for x in b.column(1).to_pylist()] == texts


def test_near_duplicates_take_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, describe = spark.conf.get(key), [], jaccard.Join.describe
    monkeypatch.setattr(jaccard.Join, "describe", lambda self: seen.append(spark.conf.get(key)) or describe(self))
    rows = [(i, f"{i % 50} " + "long text " * 200) for i in range(100)]
    with monkeypatch.context() as m:
        m.setattr(common, "BATCH_BYTES", 10_000)
        got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert seen == ["10000"] and spark.conf.get(key) == before
    assert len(got) == 100 and all(r.component_id == r.doc_id % 50 for r in got)


def test_ranges_of_gram_hashes_hold_equally_many():
    data = np.frombuffer(random.Random(3).randbytes(200_000), np.uint8)
    h = np.unique(suffixes.anchors(data, np.array([len(data)]), 50)[1])
    counts = np.bincount((h >> np.uint64(60)).astype(np.int64), minlength=16)
    assert counts.max() < 1.3 * counts.mean()
    assert (suffixes.decoded(suffixes.coded(h)) == h).all() and (suffixes.decoded(suffixes.coded(h[:3])) == h[:3]).all()


def test_loser_tree_merges_in_order():
    def run(strings):
        strings = sorted(strings)
        lcp = [0] + [next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a)) for a, b in zip(strings, strings[1:])]
        return suffixes.Run(np.array(lcp, np.uint8), np.frombuffer(b"".join(s[n:] for s, n in zip(strings, lcp, strict=True)), np.uint8), 6)

    lists = [[bytes(RNG.choice(b"ab") for _ in range(6)) for _ in range(RNG.randint(0, 30))] for _ in range(7)]
    out = [(t, c) for _, _, t, c in suffixes.LoserTree([run(x) for x in lists])]
    assert [t for t, _ in out] == sorted(s for x in lists for s in x)
    for (a, _), (b, known) in zip(out, out[1:]):
        assert a[:known] == b[:known] and (known == 6 or a[known] != b[known])


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)] + [(1000 + i, [1.0] + [0.0] * 15) for i in range(60)]
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [1.0]), (None, [1.0] * 16)]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    index = ann.build(vectors)
    asked = vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = ann.search(index, asked.where(ann.usable(F.col("vector"), index.size)), 5).collect()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        best = ids[np.lexsort((ids, -np.round(s, 12)))[:5]]
        mine = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        hit, total = hit + len(set(best) & set(mine)), total + 5
        if q >= 1000:
            assert mine == best.tolist()
    assert hit >= 0.9 * total
    assert ann.build(vectors.where("vec_id = 2000")) is None


def test_every_query_finds_k_neighbours_if_there_are_so_many(spark):
    # Each vector is a centroid, far from the others: its list holds it alone.
    x = np.eye(40) + 0.001 * np.random.default_rng(4).normal(size=(40, 40))
    rows = [(i, x[i].tolist()) for i in range(40)] + [(100, x[0].tolist())] * 9
    # Many vectors under one vec_id fill what is nearest to query 7.
    rows += [(200, (x[7] + 0.0001 * v).tolist()) for v in np.random.default_rng(5).normal(size=(90, 40))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    graph = ann.Graph.of(ann.unit(x))
    postings = spark.createDataFrame([(i if i < 40 else 0 if i == 100 else 7, i, v) for i, v in rows], "list int, vec_id long, vector array<double>")
    asked = vectors.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = ann.search(ann.Index(postings, graph, 1.1, 40), asked, 5).collect()
    for q in range(10):
        assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [1, 2, 3, 4, 5]
    assert len({r.vec_id for r in got if r.query_id == 0}) == 5 and [r.vec_id for r in got if r.query_id == 0 and r["rank"] == 1] == [100]
    few = ann.search(ann.Index(postings.where("vec_id < 3"), graph, 1.1, 40), asked, 5).collect()
    assert len([r for r in few if r.query_id == 0]) == 2 and len([r for r in few if r.query_id == 9]) == 3


def test_toxicity(spark):
    def sentence(toxic, group):
        return " ".join([*(RNG.choice(WORDS) for _ in range(12)), *(["vile"] if toxic else []), *([group] if group else [])])

    rows = [(i, sentence(i % 3 == 0, RNG.choice(["women", "men", None])), int(i % 3 == 0)) for i in range(400)] + [(900, None, 0), (901, "", 0), (None, "x", 1)]
    # In the labels, women stand beside toxic words more often than men.
    rows += [(1000 + i, sentence(True, "women"), 1) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = docs.select("doc_id", F.col("label").alias("toxic"))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect() if r.doc_id is not None}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows if i is not None]) > 0.97
    plain = toxicity.train(docs, labels.limit(0))
    assert plain.weights == {} and toxicity.score(docs.limit(0), model).count() == 0
    words = lambda t: toxicity.words_of(t)
    assert abs(model.score(words("hello women")) - model.score(words("hello men"))) < 0.1
    assert toxicity.counterfactuals({"women"}) == [("women", "men"), ("women", "girls"), ("women", "boys")]


def test_toxicity_counts_every_swap(spark, monkeypatch):
    every = " ".join(t for group in toxicity.IDENTITY_TERMS for t in group)
    rows = [(i, every if i < 5 else "women" if i < 8 else "x", i % 2) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda documents, labels, swaps: seen.append(swaps))
    toxicity.train(docs, docs.select("doc_id", "toxic"), max_rows=10)
    plain = [pair for _, t, _ in rows for pair in toxicity.counterfactuals(toxicity.words_of(t))]
    assert len(plain) > 20 * 10 and seen == [{pair: plain.count(pair) for pair in plain}]


def test_counterfactuals_spare_neutral_mentions(spark, monkeypatch):
    """A confounded group: in the labels, one group stands in toxic texts alone, and the slur is missing in many of them."""
    rng = random.Random(8)

    def sentence(words):
        return " ".join([*(rng.choice(WORDS) for _ in range(10)), *words])

    rows = [(i, sentence(["vile"] if rng.random() < 0.7 else []) + ". " + sentence(["refugees"]) + ".", 1) for i in range(200)]
    rows += [(1000 + i, sentence(["citizens"]) if i % 4 == 0 else sentence([]), 0) for i in range(600)]
    rows += [(5000 + i, sentence(["vile"]), 1) for i in range(200)]
    neutral = [toxicity.words_of(sentence(["refugees"])) for _ in range(200)]
    toxic = [toxicity.words_of(sentence(["vile"])) for _ in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    false, recall = {}, {}
    for weight in (0.0, 30.0):
        monkeypatch.setattr(toxicity, "COUNTERFACTUAL", weight)
        model = toxicity.train(docs, docs.select("doc_id", "toxic"))
        false[weight] = np.mean([model.score(w) >= 0.5 for w in neutral])
        recall[weight] = np.mean([model.score(w) >= 0.5 for w in toxic])
    assert false[0.0] > 0.9 and false[30.0] < 0.1 and recall[30.0] >= recall[0.0] - 0.01, (false, recall)


def test_toxicity_scores_are_the_models(spark):
    """The score of every row against the plain sum over its words, and a bounded sample with a repeated doc_id."""
    rows = [(i, text(20) + (" vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)] + [(7, text(5), 0)] * 5 + [(70, None, 0), (71, "", 0), (None, "vile", 1), (72, "w1 " * 20000, 0)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, toxic int, toxicity double")
    model = toxicity.train(docs, docs.select("doc_id", "toxic").distinct())
    got = sorted((r.doc_id or -1, round(r.toxicity, 9)) for r in toxicity.score(docs, model).collect())
    assert got == sorted((d or -1, round(model.score(toxicity.words_of(t)), 9)) for d, t, _ in rows)
    again = toxicity.train(docs.repartition(5), docs.select("doc_id", "toxic").distinct().repartition(3), max_rows=40)
    assert again == toxicity.train(docs.repartition(2), docs.select("doc_id", "toxic").distinct(), max_rows=40)
    some = docs.where("doc_id = 7")
    assert toxicity.sampled(some, some.select("doc_id", "toxic").distinct(), 3, "toxic").count() == 3


@pytest.mark.parametrize("case", ["null ids", "one record", "one id"])
def test_shards_of_a_hot_key(spark, case):
    third = {"null ids": lambda: (None, text(RNG.randint(1, 9))), "one record": lambda: (7, "the same"), "one id": lambda: (7, text(RNG.randint(1, 9)))}[case]
    rows = [(i, text(RNG.randint(0, 9))) for i in range(4000)] + [third() for _ in range(2000)]
    out = shards.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8, 512).collect()
    size = [sum(r.size for r in out if r.shard == s) for s in range(8)]
    assert max(size) - min(size) <= 0.01 * sum(size) / 8, size
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    slots = {}
    for r in out:
        slots.setdefault(r.virtual_slot, []).append(r)
    assert max(map(len, slots.values())) < 100
    assert all(len({r.shard for r in s}) == 1 for s in slots.values())
    plain = sorted((d or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in out) == plain
