"""Line dedup: hashes of lines are range-partitioned and sorted by hash, document and place; bitmaps of kept lines come back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import KEY, SPACE, attach, compact, fresh, lean, partitions, parts, table, with_key, written

_STRIP = SPACE.encode()
DROP, PENDING, COUNT, FIRST = 0, 1, 2, 3


def line_key(line: bytes) -> bytes:
    """Stripped of white space at both ends, A-Z lower-cased; bytes.lower() leaves all but A-Z alone."""
    return line.strip(_STRIP).lower()


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in parts(batches):
            ids, k1, k2, texts = batch.columns
            rows, places, hashes = [], [], []

            def flush():
                take = pa.array(rows, pa.int64())
                h = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)
                return pa.RecordBatch.from_arrays(
                    [ids.take(take), k1.take(take), k2.take(take), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(places, pa.int32())],
                    ["doc_id", "_k1", "_k2", "h1", "h2", "pos"],
                )

            for row, text in enumerate(texts.cast(pa.binary()).to_pylist()):
                for place, line in enumerate((text or b"").split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars):
                        rows.append(row)
                        places.append(place)
                        hashes.append(digest(key))
                if len(rows) > 200_000:
                    yield flush()
                    rows, places, hashes = [], [], []
            if rows:
                yield flush()

    return run


def _stream(min_docs: int, keep_first: bool, by_id: bool, schema: pa.Schema):
    """Rows (kind, document, hash, place): DROP for lines of keys found in min_docs documents at least.

    A key that the partition holds alone is decided here. Of the first and the last key of a partition a COUNT row gives
    the documents counted here, and undecided lines go out as PENDING. With keep_first, the first line of a key goes out
    only if the key may have begun in an earlier partition, as FIRST. The pos of a COUNT row is 1 if it surely hasn't.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(part: pa.Table, kind: int) -> Iterator[pa.RecordBatch]:
            if len(part):
                kinds = pa.array(np.full(len(part), kind, np.int32))
                yield from pa.Table.from_arrays([kinds, *part.columns, pa.nulls(len(part), pa.int64())], schema=schema).to_batches()

        def count(key: tuple, docs: int, begun: bool) -> pa.RecordBatch:
            row = {"kind": COUNT, "_k1": 0, "_k2": 0, "h1": int(key[0]), "h2": int(key[1]), "pos": int(begun), "docs": int(docs)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        first = True  # no run of this partition is over yet
        # The run that the last batch ended in: its hash, last document, documents so far, and its rows while undecided.
        key, last, docs, held = None, None, 0, []

        def release(kind: int) -> Iterator[pa.RecordBatch]:
            """The rows held back, which begin with the first of their run."""
            for i, part in enumerate(held):
                if keep_first and i == 0:
                    if first:
                        yield from result(part.slice(0, 1), FIRST)
                    part = part.slice(1)
                yield from result(part, kind)
            held.clear()

        for batch in batches:
            if not len(batch):
                continue
            part = pa.Table.from_batches([batch])
            k1, k2, h1, h2 = (np.asarray(batch.column(i)) for i in (1, 2, 3, 4))
            ids = batch.column(0)

            def document(i: int, ids=ids, k1=k1, k2=k2) -> tuple:
                return (ids[i].as_py(),) if by_id else (ids[i].as_py(), k1[i], k2[i])

            codes = np.asarray(ids.dictionary_encode().indices.fill_null(-1))
            goes_on = key == (h1[0], h2[0])
            new_key = np.r_[not goes_on, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            same_doc = codes[1:] == codes[:-1] if by_id else (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (codes[1:] == codes[:-1])
            new_doc = np.r_[not goes_on or last != document(0), new_key[1:] | ~same_doc]
            if by_id:
                new_doc &= codes >= 0
            begins = np.flatnonzero(np.r_[True, new_key[1:]])
            ends = np.r_[begins[1:], len(h1)]
            counts = np.add.reduceat(new_doc.astype(np.int64), begins)
            if goes_on:
                counts[0] += docs
                if counts[0] >= min_docs:
                    yield from release(DROP)
            elif key is not None:
                if first:
                    yield from release(PENDING)
                    yield count(key, docs, False)
                    first = False
                held.clear()
            kinds = np.where(np.repeat(counts >= min_docs, ends - begins), DROP, -1)
            if first and len(begins) > 1 and counts[0] < min_docs:
                kinds[: ends[0]] = PENDING
            if keep_first:
                kinds[begins[1:]] = -1
                if not goes_on and kinds[0] >= 0:
                    kinds[0] = FIRST if first else -1
            if first and len(begins) > 1:
                yield from release(PENDING)
                yield count((h1[0], h2[0]), counts[0], False)
                first = False
            elif len(begins) > 1:
                held.clear()
            for kind in (DROP, PENDING, FIRST):
                yield from result(part.take(pa.array(np.flatnonzero(kinds == kind))), kind)
            key, last, docs = (h1[-1], h2[-1]), document(len(ids) - 1), int(counts[-1])
            if docs < min_docs:
                held.append(part.slice(int(begins[-1])))
        if key is not None:
            yield from release(PENDING)
            yield count(key, docs, not first)

    return run


def _bitmap(schema: pa.Schema):
    """Compressed bitmaps from the places of the lines that go; bit 0 of byte 0 is line 0, 1 means that the line goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(3)
            maps = []
            for p in places:
                p = np.asarray(p.values)
                bits = np.zeros(p.max() + 1, np.uint8)
                bits[p] = 1
                maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(maps, pa.binary())], schema=schema)

    return run


def dropped_lines(bitmap: bytes | None, n: int) -> np.ndarray:
    """n flags: which lines go."""
    if bitmap is None:
        return np.zeros(n, bool)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n]
    return np.concatenate([bits, np.zeros(n - len(bits), np.uint8)]).astype(bool)


def line_bitmaps(docs: DataFrame, min_chars: int = 1, min_docs: int = 10, keep_first: bool = False, by_id: bool = False) -> DataFrame:
    """doc_id, _k1, _k2, bitmap (zlib): for each document that loses lines, which ones.

    A line's key is the line stripped of white space and with A-Z lower-cased. Keys of at least min_chars code points
    that are found in at least min_docs documents lose all their lines in every document, or, with
    keep_first, all but the first in order of doc_id and place. A null or empty text is one empty line. Rows of equal doc_id and text (nulls included) are copies of one document and count once.
    With by_id, a doc_id is one document, however many texts its rows have, and rows without one count nowhere. An empty table gives
    none; columns but doc_id and text play no part.

    The lines' hashes, 128 bits, are range-partitioned by hash and document, so that a very common line spreads
    over several partitions, and sorted by hash, document and place. Each partition streams its runs; what a run that reaches the partition's
    edge leaves open is settled by adding up the counts of those runs, two rows for a partition.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    fields = [("doc_id", kind), ("_k1", T.LongType()), ("_k2", T.LongType()), ("h1", T.LongType()), ("h2", T.LongType()), ("pos", T.IntegerType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    lines = written(with_key(docs).mapInArrow(lean(_hash_lines(max(1, min_chars))), schema), "line-hashes")
    order = ["h1", "h2", *KEY, "pos"]
    # What counts as one document stands in one partition.
    ranged = lines.repartitionByRange(partitions(spark), "h1", "h2", *(KEY[:1] if by_id else KEY)).sortWithinPartitions(*order)
    out = T.StructType([T.StructField("kind", T.IntegerType()), *schema.fields, T.StructField("docs", T.LongType())])
    settled = written(ranged.mapInArrow(lean(_stream(min_docs, keep_first, by_id, to_arrow_schema(out))), out), "line-runs")
    hot = settled.where(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs)
    # hot has two rows for a partition at most.
    hot = hot.select("h1", "h2")
    drops = settled.where(F.col("kind") == DROP).select(*KEY, "pos").unionByName(
        settled.where(F.col("kind") == PENDING).join(F.broadcast(hot), ["h1", "h2"], "left_semi").select(*KEY, "pos")
    )
    if keep_first:
        # Of a partition's first key, the first line stays if the key begins there: at most a row for each partition.
        begun = settled.where((F.col("kind") == COUNT) & (F.col("pos") == 1)).select("h1", "h2")
        firsts = settled.where(F.col("kind") == FIRST).join(F.broadcast(hot), ["h1", "h2"], "left_semi")
        order_of = F.struct(*KEY, "pos")
        earliest = firsts.groupBy("h1", "h2").agg(F.min(order_of).alias("earliest"))
        kept = earliest.join(F.broadcast(begun), ["h1", "h2"], "left_anti")
        late = firsts.join(F.broadcast(kept), ["h1", "h2"], "left").where(F.col("earliest").isNull() | ~F.col("earliest").eqNullSafe(order_of))
        drops = drops.unionByName(late.select(*KEY, "pos"))
    places = drops.groupBy(*KEY).agg(F.collect_set("pos").alias("places"))
    maps = T.StructType([*schema.fields[:3], T.StructField("bitmap", T.BinaryType())])
    return places.mapInArrow(lean(_bitmap(to_arrow_schema(maps))), maps)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Every row of docs with its text reduced to the lines that stay, and n_lines, n_dropped long (in place of such columns)."""
    docs = docs.drop("n_lines", "n_dropped")
    columns = docs.columns
    joined = attach(docs, bitmaps.withColumnRenamed("bitmap", fresh(docs.columns, 1)[0]))
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, bitmap in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                if bitmap is None:
                    texts.append(text)
                    n_lines.append((text or "").count("\n") + 1)
                    n_dropped.append(0)
                    continue
                lines = (text or "").split("\n")
                gone = dropped_lines(bitmap, len(lines))
                texts.append("\n".join([line for line, g in zip(lines, gone.tolist(), strict=True) if not g]))
                n_lines.append(len(lines))
                n_dropped.append(int(gone.sum()))
            new = list(batch.columns[: len(columns)])
            new[at] = pa.array(texts, new[at].type)
            yield pa.RecordBatch.from_arrays([*new, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*columns, "n_lines", "n_dropped"])

    return joined.mapInArrow(lean(run), schema)


def dedup_lines(docs: DataFrame, min_chars: int = 1, min_docs: int = 10, keep_first: bool = False, by_id: bool = False) -> DataFrame:
    """docs without the lines of common keys; a null text stays null, other columns pass through. See line_bitmaps()."""
    return apply_bitmaps(docs, line_bitmaps(docs, min_chars, min_docs, keep_first, by_id))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compact(dedup_lines(docs, 1, 10, by_id=True)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


OP1_SQL = """
WITH l AS (
  SELECT r, doc_id, k, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k
    FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
hot AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (hot.key IS NOT NULL)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (hot.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN hot ON l.key = hot.key GROUP BY r"""
