import random

import duckdb
import pytest
from pyspark.sql import functions as F
from tessera.llm import lines


def brute(rows, min_docs, keep_first):
    """rows: (doc_id, text), distinct ids; {doc_id: text that stays}."""
    found = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if key := lines.line_key(line.encode()):
                found.setdefault(key, set()).add(doc)
    hot, seen, out = {k for k, d in found.items() if len(d) >= min_docs}, set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in (text or "").split("\n"):
            key = lines.line_key(line.encode())
            if key in hot and not (keep_first and key not in seen):
                continue
            seen.add(key)
            kept.append(line)
        out[doc] = None if text is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("keep_first", [False, True])
def test_against_brute_force(spark, keep_first):
    rng = random.Random(3)
    pool = [f"Line {i}" for i in range(40)] + ["", "  ", "\tLINE 1\r", "the same"]
    rows = [(i, "\n".join(rng.choice(pool[:5] if rng.random() < 0.5 else pool) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "the same\n" * 5000), (203, "unique ç line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for min_docs in (2, 10):
        got = {r.doc_id: r.text for r in lines.dedup_lines(docs, 1, min_docs, keep_first).collect()}
        assert got == brute(rows, min_docs, keep_first)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a\nb", 1), (None, "a\nb", 2), (1, "a", 3), (1, "a", 4)], "doc_id long, text string, n_lines int").withColumn("bitmap", F.lit("mine"))
    out = lines.dedup_lines(docs, 1, 2).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in out) == [(0, "b", 2, 1)] * 2 + [(1, "", 1, 1)] * 2
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_repeated_and_null_ids_against_the_sql(spark, tmp_path):
    rows = [(i // 2, f"five ids on ten texts\n{i}") for i in range(10)] + [(20 + i, f"nine ids and none\n{i}") for i in range(9)] + [(None, "nine ids and none"), (None, "other")]
    rows += [(40 + i, f" Ten IDS\nx{i}") for i in range(10)] + [(40, "ten ids"), (40, None), (None, None), (None, "ten ids\nlast"), (41, f" Ten IDS\nx{1}")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(r) for r in lines.op1_line_dedup(spark, str(tmp_path)).collect()], key=str)
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert sorted(c.sql(lines.OP1_SQL).fetchall(), key=str) == got
    assert sum(r[2] for r in got) == 13
