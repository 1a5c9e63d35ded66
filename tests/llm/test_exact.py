"""Exact dedup against a plain version: groups of every size, ties, nulls, a filter that is too small, clashing names."""

import hashlib
import random
import re

import duckdb
import pytest
from tessera.llm import exact

SCHEMA = "doc_id long, text string"


def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    out = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(400)]
    out += [(1000 + i, "one hot\ttext") for i in range(300)] + [(2000 + i, " one  hot\n\x0btext") for i in range(2)] + [(3000, "one hot text"), (3001, "one\x1fhot text")]
    out += [(4000 + i, rng.choice(out[:400])[1].replace(" ", "  ", i % 3)) for i in range(150)]
    out += [(None, None), (None, ""), (5, None), (7, "\n"), (8, " "), (None, "lone"), (12, out[12][1]), (12, out[12][1]), (9000, "long " * 200_000), (9001, "long\n" * 200_000)]
    return out


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def plain(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(norm(text), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        staying = False
        for i in ids:
            kept = i == keep and not staying
            staying |= kept
            out.append((i, keep, len(ids), kept, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("filter_bytes", [exact.MAX_FILTER_BYTES, 512])
def test_against_plain_version(spark, filter_bytes):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    out = exact.mark_repeats(df.select("doc_id", exact.text_digest(df.text).alias("d")), "d", "doc_id", max_filter_bytes=filter_bytes)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.d) for r in out.collect()], key=str) == plain(rows())


def test_registered_query_and_sql(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(r) for r in exact.op12_exact_dedup(spark, str(tmp_path)).collect()], key=str)
    assert got == plain(rows())
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert sorted([tuple(r) for r in c.sql(exact.OP12_SQL).fetchall()], key=str) == got


def test_most_rows_pass_straight_through(spark):
    df = spark.createDataFrame([(i, f"text {i // 2 if i < 100 else i}") for i in range(5000)], SCHEMA)
    places = df.select(exact.F.xxhash64("text").alias("place")).groupBy("place").count().where("count > 1").select("place")
    bloom, n_blocks = exact.repeated_filter(places)
    block, bits = exact._bits(exact.F.xxhash64("text"), n_blocks)
    in_filter = "forall(bits, b -> getbit(element_at(words, int(b div 64) + 1), b % 64) = 1)"
    hit = df.withColumn("bits", exact.F.array(*bits)).join(bloom, block == bloom.block).where(in_filter)
    ids = {r.doc_id for r in hit.select("doc_id").collect()}
    assert set(range(100)) <= ids and len(ids) < 300


def test_drop_copies_keeps_all_columns(spark):
    df = spark.createDataFrame([(2, "a  b", 1, 2, 3), (1, "a b", 4, 5, 6), (1, "a b", 4, 5, 6), (3, None, 7, 8, 9), (None, "", 7, 8, 9)], "doc_id long, text string, kept int, _own0 int, keep_id int")
    out = exact.drop_copies(df)
    assert out.columns == df.columns and sorted(tuple(r) for r in out.collect()) == [(1, "a b", 4, 5, 6), (3, None, 7, 8, 9)]
    assert exact.drop_copies(df.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], SCHEMA)
    plan = exact.drop_copies(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
