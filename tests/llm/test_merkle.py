"""The Merkle manifest against a plain version: trees of every shape, blocks of two sizes, nulls, ties, tampering."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from tessera.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    """(left siblings, right siblings) for each level."""
    out = []
    for row in tree[:-1]:
        start = i // 8 * 8
        out.append(("".join(row[start:i]), "".join(row[i + 1 : start + 8])))
        i //= 8
    return out


def plain(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[name] = levels([leaf(r) for r in trees[name]])
    top = levels([built[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, row in enumerate(trees[name]):
            steps = path(built[name], i) + path(top, k)
            lower = row[4] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            folded = leaf((*row[:4], lower)) if tampered else leaf(row)
            for left, right in steps:
                folded = h(left + folded + right)
            out.append((row[0], leaf(row), built[name][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def rows(sizes):
    rng = random.Random(8)
    out = []
    for lang, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "é A", "plain", "Mixed Case " * rng.randint(1, 9)])
            out.append((len(out), rng.choice([None, "web"]), lang, None if text is None else len(text), text))
    return out


SIZES = {"en": 700, "de": 64, "fr": 65, "x": 1, None: 9, "": 8, "é": 513}


def collected(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_registered_query_and_sql(spark, tmp_path):
    table = rows(SIZES)
    table += [(5, None, "en", None, "Tied"), (5, None, "en", None, "Tied"), (5, "b", "en", 1, "tied"), (None, None, "en", None, None), (None, None, None, None, None), (9000, "s", "en", 1, "Long " * 300_000)]
    spark.createDataFrame(table, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = collected(merkle.op13_merkle_manifest(spark, str(tmp_path)))
    assert got == plain(table)
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert sorted(c.sql(merkle.op13_sql()).fetchall(), key=str) == got


@pytest.mark.parametrize("sizes", [{"en": 4700, "de": 64}, {"a": 1}, {"a": 1, "b": 1}, {f"l{i:03}": 1 + i % 3 for i in range(150)}])
def test_small_blocks_of_many_rounds(spark, sizes):
    """Blocks of 64 nodes, so that proofs are put together in up to three rounds."""
    table = rows(sizes)
    leaf_column = merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    out = merkle.manifest(spark.createDataFrame(table, SCHEMA), leaf_column, height=1)
    got = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.fold(F.col("leaf"), F.col("proof")))
    want = [(*r[:5], r[3]) for r in plain(table)]
    assert collected(got) == sorted(want, key=str)


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "en", "a", 1, 2), (2, "en", "b", 3, 4)], "doc_id long, lang string, text string, _tree int, root int")
    column = merkle.leaf_of(F.col("doc_id"), F.col("text"))
    out = merkle.manifest(df, column).collect()
    assert {r.root for r in out} == {h(h("1:11:a") + h("1:21:b"))}
    assert merkle.manifest(df.limit(0), column).count() == 0


def test_traversal_holds_three_subtrees(monkeypatch):
    alive = []

    class Counted(merkle.Subtree):
        def __init__(self, levels):
            super().__init__(levels)
            alive.append(0)

        def add(self, digest, level=0):
            super().add(digest, level)
            assert sum(len(row) for row in self.nodes) <= 73

    monkeypatch.setattr(merkle, "Subtree", Counted)
    nodes = [h(str(i)) for i in range(4096)]
    tree = levels(nodes)
    walk = merkle.Traversal(4, 2, tree[2], [])
    paths = [p for d in nodes if (p := walk.add(d)) is not None] + list(walk.rest())
    assert len(paths) == 4096 and all([(len(left) // 64, left + right) for left, right in path(tree, i)] == paths[i] for i in range(0, 4096, 37))


def test_a_changed_node_is_noticed():
    nodes = [h(str(i)) for i in range(64)]
    walk = merkle.Traversal(2, 1, levels(nodes)[1], [])
    with pytest.raises(ValueError):
        for digest in [h("x"), *nodes[1:]]:
            walk.add(digest)
