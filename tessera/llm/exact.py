"""Exact dedup by two passes over a Bloom filter; DataFrame functions only.

The first pass counts places, hashes of keys cut to SLOTS_PER_ROW places for each row: a place with one row holds no
repeated key. Places with more fill the Bloom filter that the second pass holds against every row. Rows that it lets
through may be repeated: they alone are exchanged, to be compared by their whole keys. All others pass straight on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table, written

#: Places of the first pass for each row; one row in so many passes for repeated without being it.
SLOTS_PER_ROW = 64
#: Bits of the filter for each repeated place, two of which are set.
BITS_PER_PLACE = 16
#: Most bytes that the filter takes, and so that are broadcast. A fuller filter lets more rows through; results stay.
MAX_FILTER_BYTES = 64 << 20
#: The filter comes in blocks of so many 64-bit words, one broadcast row each.
BLOCK_WORDS = 64
#: Groups that hold more than one in so many of the rows compared are joined by broadcast: there are fewer than that.
HOT_GROUPS = 1000


def normalised(text: Column) -> Column:
    """Every run of white space of the contract as one space; a null text is empty. Single spaces aren't touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, lower-case hex: texts are equal if theirs are."""
    return F.sha2(normalised(text), 256)


def _power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def _bits(place: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """The block of a place, and the numbers of its two bits there."""
    mixed = F.xxhash64(place)
    bits = [F.shiftrightunsigned(mixed, k).bitwiseAND(BLOCK_WORDS * 64 - 1).cast("int") for k in (52, 40)]
    return mixed.bitwiseAND(n_blocks - 1).cast("int"), bits


def repeated_filter(places: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> tuple[DataFrame, int]:
    """A Bloom filter of the column place, at most max_bytes large, as rows (block, words), and the number of its blocks."""
    block_bits = BLOCK_WORDS * 64
    n_blocks = min(_power_of_two(places.count() * BITS_PER_PLACE // block_bits + 1), _power_of_two(max_bytes * 8 // block_bits + 1) // 2 or 1)
    block, bits = _bits(F.col("place"), n_blocks)
    set_bits = places.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
    word = F.floor(F.col("bit") / 64).cast("int")
    words = set_bits.groupBy("block", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("mask"))
    masks = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("masks"))
    every_word = F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1))
    return masks.select("block", F.transform(every_word, lambda w: F.coalesce(F.try_element_at("masks", w), F.lit(0).cast("long"))).alias("words")), n_blocks


def mark_repeats(
    df: DataFrame, key: str, order: str, keep_id: str = "keep_id", group_size: str = "group_size", kept: str = "kept", max_filter_bytes: int = MAX_FILTER_BYTES
) -> DataFrame:
    """df with keep_id (of the type of order), group_size long and kept boolean, in place of columns of such names.

    Rows of equal keys are one group; null keys are equal. Of a group, the row of the smallest order stays, nulls last;
    of rows that tie, one. keep_id is its order, null only if all of the group are. All other columns pass through,
    whatever their names. An empty table gives none. df is read three times, so it should be cheap or written; rows that
    may be repeated are written to the shared folder, so that a lost executor can't change which of them stays.
    """
    df = df.drop(keep_id, group_size, kept)
    columns = df.columns
    place, block, words, row, least, n = fresh([*columns, keep_id, group_size, kept], 6)
    slots = _power_of_two(SLOTS_PER_ROW * df.count() + 1)
    at = F.xxhash64(F.col(key)).bitwiseAND(slots - 1)
    # Few bytes a row go this way, and those of a large group meet before the exchange.
    repeated = df.select(at.alias("place")).groupBy("place").count().where("count > 1").select("place")
    bloom, n_blocks = repeated_filter(written(repeated, "repeated-places"), max_filter_bytes)
    in_block, bits = _bits(F.col(place), n_blocks)
    tested = df.withColumn(place, at).withColumn(block, in_block)
    tested = tested.join(F.broadcast(bloom.withColumnsRenamed({"block": block, "words": words})), block, "left")
    hit = [F.getbit(F.element_at(words, F.floor(bit / 64).cast("int") + 1), bit % 64) == 1 for bit in bits]
    maybe = F.coalesce(hit[0] & hit[1], F.lit(False))

    single = tested.where(~maybe).select(*columns, F.col(order).alias(keep_id), F.lit(1).cast("long").alias(group_size), F.lit(True).alias(kept))
    compared = written(tested.where(maybe).select(*columns).withColumn(row, F.monotonically_increasing_id()), "compared")
    first = F.min(F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("id"), F.col(row).alias("row")))
    groups = written(compared.groupBy(F.col(key).alias(place)).agg(first.alias(least), F.count(F.lit(1)).alias(n)), "groups")
    most = compared.count() // HOT_GROUPS
    large, others = groups.where(F.col(n) > most), groups.where(F.col(n) <= most)
    same = F.col(key).eqNullSafe(F.col(place))
    by_large = compared.join(F.broadcast(large), same, "left")
    joined = by_large.where(F.col(n).isNotNull()).unionByName(by_large.where(F.col(n).isNull()).drop(place, least, n).join(others, same))
    double = joined.select(*columns, F.col(f"{least}.id").alias(keep_id), F.col(n).alias(group_size), (F.col(f"{least}.row") == F.col(row)).alias(kept))
    return single.unionByName(double)


def drop_copies(docs: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose texts, normalised, an earlier row has; the first one in order stays, with all its columns.

    A null text equals an empty one; see mark_repeats() for ties, nulls and empty tables.
    """
    digest, keep_id, n, kept = fresh(docs.columns, 4)
    marked = mark_repeats(docs.withColumn(digest, text_digest(F.col(text))), digest, order, keep_id, n, kept)
    return marked.where(kept).select(*docs.columns)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_digest(F.col("text")).alias("text_sha256"))
    return mark_repeats(written(docs, "digests"), "text_sha256", "doc_id").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
  row_number() OVER g = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, r)"""
