"""Cross-tokenizer alignment against a plain version that tokenises whole texts."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from tessera.llm import align

SCHEMA = "doc_id long, text string"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello  world, it's a test.", None, "", " ", "\n\n x\ty ", "  two  before", "tail  ", "naïve café 漢字仮名 😀😀👩‍👩‍👧 ok", "x▁y is spoilt", "fine before x▁y", "<|endoftext|> and <s> </s>", "a\x1cb c\x85d e\xa0f g　h",
    "1234567 89,000 ++==++ (a)(b)", "﷽ ﷽", "word " * 400 + "the end", "q" * 3000, "漢" * 900, "it's it's don't we'll", "\x00 \x01", "😀" * 700, "𝒳𝒴 ‍ ﻿", "ab\ncd ef\r\n gh", "' 's s' 's",
]


def rows():
    rng = random.Random(2)
    words = [w for t in TEXTS if t for w in t.split(" ") if len(w) < 50]
    out = list(enumerate(TEXTS))
    out += [(100 + i, rng.choice([" ", "  ", "\n", " "]).join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(150)]
    return [*out, (None, "null id"), (0, TEXTS[0]), (0, TEXTS[0])]


def plain(rows):
    a = tokenizers.Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = align.byte_letters()
    found, counts = [], Counter()
    for doc_id, text in rows:
        ids = ([], [])
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ids = (ids_a, ids_b)
        groups, links = [], []
        if ids[0]:
            ranges = []
            for names in (bytes_a, bytes_b):
                end, side = 0, []
                for name in names:
                    side.append((end, end + len(name)))
                    end += len(name)
                ranges.append(side)
            cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
            for cut in cuts:
                before = cuts[cuts.index(cut) - 1] if cut != cuts[0] else 0
                inside = [[k for k, (s, e) in enumerate(side) if s >= before and e <= cut] for side in ranges]
                groups.append("|".join(",".join(str(ids[s][k]) for k in inside[s]) for s in (0, 1)))
                links += [(ids_a[x], ids_b[y]) for x in inside[0] for y in inside[1] if max(ranges[0][x][0], ranges[1][y][0]) < min(ranges[0][x][1], ranges[1][y][1])]
        counts.update(links)
        found.append((doc_id, len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, n_a, n_b, n_groups, links, text in found:
        out.append((doc_id, n_a, n_b, n_groups, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


def collected(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def want():
    return plain(rows())


def test_registered_query(spark, tmp_path, want):
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert collected(align.op11_token_alignment(spark, str(tmp_path))) == want


def test_small_blocks_and_whole_texts_give_the_same(spark, want):
    """And an exchange of pairs in place of a broadcast; other columns of any names."""
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows()], SCHEMA + ", n int, piece int, block int")
    a, b = align.ByteLevel.read(A_PATH), align.Pieces.read(B_PATH)
    out = align.align(docs, a, b, keep_groups=True, block_bytes=2000).documents
    assert collected(out.drop("groups")) == want
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in out.collect() if r.n_groups)
    assert collected(align.align(docs, a, b, whole=True).documents) == want


def test_pairs_joined_by_exchange(spark, want, monkeypatch):
    monkeypatch.setattr(align, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(align, "SLICE_PIECES", 3)
    out = align.align(spark.createDataFrame(rows(), SCHEMA), align.ByteLevel.read(A_PATH), align.Pieces.read(B_PATH))
    assert collected(out.documents) == want and out.pairs.where("count < 1").isEmpty()


def test_pieces_with_white_space_at_their_ends_cut_no_later_text(spark):
    """Both tokens of "\\xa0 \\xa0" are one to the first tokenizer, also after a text that is the second half alone."""
    texts = ["\xa0", "\xa0 \xa0", "a\xa0", "\xa0b", "a\xa0 \xa0b", "foo\n", "\nbar", "foo\n \nbar", "\xa0 \xa0"]
    known = align.Known()
    assert [len(known.places(t, False)) for t in texts] == [1] * len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).coalesce(1)
    out = align.align(docs, align.ByteLevel.read(A_PATH), align.Pieces.read(B_PATH)).documents
    assert collected(out) == plain(list(enumerate(texts)))


def test_empty_table(spark):
    out = align.align(spark.createDataFrame([], SCHEMA), align.ByteLevel.read(A_PATH), align.Pieces.read(B_PATH))
    assert out.documents.count() == 0 and out.pairs.count() == 0


def test_tokenizers_cut_at_single_spaces():
    assert align.ByteLevel.read(A_PATH).cuts_at_spaces() and align.Pieces.read(B_PATH).cuts_at_spaces()


def test_rare_pairs_are_exchanged(spark, monkeypatch):
    links = [(f"p{i % 7}", i * i % 23) for i in range(200)]
    counts = Counter(pair for _, pair in links)
    pairs = spark.createDataFrame([(p, n, p % 2 == 0) for p, n in counts.items()], "pair long, count long, best boolean")
    expected = sorted((piece, pair, counts[pair], pair % 2 == 0) for piece, pair in links)
    for most in (0, 3, 6, 100):
        monkeypatch.setattr(align, "BROADCAST_PAIRS", most)
        got = align.with_counts(spark.createDataFrame(links, "piece string, pair long"), pairs).select("piece", "pair", "count", "best").collect()
        assert sorted(map(tuple, got)) == expected


def test_exchanges_leave_no_files_behind(spark, monkeypatch):
    """Once a table is written, the files of the exchanges before it are gone, without the driver's garbage being collected."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        names = (found.apply(i).getName() for i in range(found.size()))
        return {n for n in names if n.startswith("shuffle_")}

    before, left, write = files(), {}, align.written

    def written(df, name, *more, **named):
        out, until = write(df, name, *more, **named), time.time() + 5
        while (kept := files() - before) and time.time() < until:
            time.sleep(0.1)
        left[name] = len(kept)
        return out

    monkeypatch.setattr(align, "written", written)
    monkeypatch.setattr(align, "dropped", lambda *tables: None)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    align.align(spark.createDataFrame(rows(), SCHEMA).repartition(3), align.ByteLevel.read(A_PATH), align.Pieces.read(B_PATH))
    assert len(left) > 5 and not any(v for k, v in left.items() if k != "pieces"), left
    assert spark.conf.get(key) == setting


def test_packed_places_are_compressed():
    """Frequent places take less than their lowest byte, to which no exchange brings them; all come back."""
    rng = random.Random(3)
    for n in (0, 1, 5, 4000):
        places = np.array([int(300 ** rng.random()) - 1 for _ in range(n)], np.int32)
        packed = align.packed(places)
        assert align.unpacked(packed).tolist() == places.tolist() and len(packed) < max(32, n)
    assert align.unpacked(align.packed(np.array([1 << 30, 0, 70_000], np.int32))).tolist() == [1 << 30, 0, 70_000]
    assert len(align.unpacked(None)) == 0


def test_pieces_have_numbers_of_their_own_over_many_partitions(spark, want):
    """More partitions of pieces than are written as files: those that a task reads together don't share numbers."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = align.align(spark.createDataFrame(rows(), SCHEMA).repartition(3), align.ByteLevel.read(A_PATH), align.Pieces.read(B_PATH))
        assert collected(out.documents) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
