"""What the operators share: the shared folder, written tables, keys of documents and ASCII case folding."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import string
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts, found in text in any case: ASCII letters and digits, and everything beyond ASCII.
WORD_ANY_CASE = r"[\p{Alnum}\x{80}-\x{10FFFF}]+"
#: The same on lower-cased text, for Python and DuckDB.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII characters that stand in no word.
NO_WORD = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: White space of the contracts.
SPACE = " \t\n\x0b\x0c\r"

_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode, if that is unset, a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex[:16]}-{name}"
    _made.add(path)
    return path


def compact(df: DataFrame) -> DataFrame:
    """In no more than a few partitions for each core: every file costs a task its set-up, and the store an entry."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def written(df: DataFrame, name: str, codec: str = "snappy", few_files: bool = True) -> DataFrame:
    """df as a written table in the shared folder: it cuts lineage, survives lost executors and has a known size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (compact(df) if few_files else df).write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of the batches that Python gets under small_batches().
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside hands Python its rows in batches of BATCH_BYTES; Spark's own measure is 10,000 rows of any length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def spent_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no files of its exchanges behind; they would stay until the driver's garbage is collected.

    For steps whose tables are written() and read again: a result that isn't written makes its exchanges anew each time.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def release() -> None:
    """Gives back to the system what this process has freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def worker_state() -> dict:
    """What a step keeps in a worker for its next tasks there; tasks of lean() steps drop it."""
    return sys.modules.setdefault("tessera_worker_state", type(sys)("tessera_worker_state")).__dict__.setdefault("kept", {})


#: Bytes that parts() cuts batches to.
PART_BYTES = 1 << 20


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about PART_BYTES, for steps that make Python objects of them."""
    for batch in batches:
        rows = max(1, len(batch) * PART_BYTES // max(1, batch.nbytes))
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def lean(run: Callable, keep: bool = False) -> Callable:
    """run, for mapInArrow, that leaves a worker as small as it can: workers are used again, and idle ones count too.

    keep: what worker_state() has stays, for the next tasks of the same step.
    """

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            worker_state().clear()
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return lean_run


def clean(spark: SparkSession) -> None:
    """Deletes every table that this process wrote; call it when no result that reads them is needed any more."""
    for path in list(_made):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        _made.discard(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more. What they were made of goes too: Spark removes a shuffle's
    files once the driver's garbage is collected, which may not be due for long after the job."""
    for df in tables:
        spark = df.sparkSession
        name = next((part for file in df.inputFiles()[:1] for part in file.split("/") if part.startswith("tessera-")), None)
        for path in [p for p in _made if name and p.endswith("/" + name)]:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
            _made.discard(path)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spaced(text: Column, keep: str = "") -> Column:
    """A-Z to a-z, and every ASCII character outside words, but for those to keep, to a space; far cheaper than a pattern."""
    gone = "".join(c for c in NO_WORD if c not in keep)
    return F.translate(text, gone + string.ascii_uppercase, " " * len(gone) + string.ascii_lowercase)


def split_words(spaced_text: Column) -> Column:
    return F.array_remove(F.split(spaced_text, " "), "")


def words(text: Column) -> Column:
    """The lower-cased words of the contracts; none of a null text."""
    return split_words(spaced(F.coalesce(text, F.lit(""))))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long")


#: Bytes up to which a table is broadcast, by its counted rows; beyond, the join shuffles.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame) -> DataFrame:
    """df, a written table of columns of 8 bytes, marked for broadcast if it is small."""
    most = BROADCAST_BYTES // (8 * (len(df.columns) + 1))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def text_key(text: Column) -> list[Column]:
    """Two columns that, with doc_id, stand for a document: rows of the same doc_id and text are copies of one document."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(7), text).alias("_k2")]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, however often and however deep in lambdas body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_key(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the two columns of text_key() and the text, with the other columns that are asked for."""
    return docs.select("doc_id", *text_key(F.col("text")), "text", *more)


def fresh(columns: list[str], n: int) -> list[str]:
    """n names that none of the columns has."""
    used = {c.lower() for c in columns}
    found, i = [], 0
    while len(found) < n:
        if (name := f"_own{i}") not in used:
            found.append(name)
        i += 1
    return found


def attach(docs: DataFrame, facts: DataFrame, how: str = "left") -> DataFrame:
    """docs with the columns of facts (KEY and new ones, one row for a document at most) in place of such ones.

    A null doc_id equals itself, and so does a null text. docs may have columns of any name.
    """
    docs = docs.drop(*[c for c in facts.columns if c not in KEY])
    names = fresh([*docs.columns, *facts.columns], 5)
    facts = facts.withColumnsRenamed(dict(zip(KEY, names[:3], strict=True)))
    # Columns, not expressions in the condition: a text that isn't asked for needn't go through the join.
    docs = docs.withColumns(dict(zip(names[3:], text_key(F.col("text")), strict=True)))
    same = (F.col(names[3]) == F.col(names[1])) & (F.col(names[4]) == F.col(names[2]))
    return docs.join(facts, F.col("doc_id").eqNullSafe(F.col(names[0])) & same, how).drop(*names)


KEY = ["doc_id", "_k1", "_k2"]
