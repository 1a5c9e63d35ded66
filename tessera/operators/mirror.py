"""The mirror of a watched tree: files as rows, changes as batches, and the joins between them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import path_ancestors, path_key
from tessera.sources.shared import shared_dir

FILE, DIRECTORY, ROOT, UNCERTAIN = "File", "Directory", "Root", "Uncertain"
CREATED, CHANGED, DELETED, RENAMED, FOUND = "Created", "Changed", "Deleted", "Renamed", "Found"
SUSPENDED, ACTIVE, FAILED = "Suspended", "Active", "Failed"
MAX_FILE_LENGTH = 64 << 20


@dataclass(frozen=True)
class Target:
    """What to watch: a directory with everything below, or one file. Paths are absolute and compared without case."""

    type: str
    path: str

    def __post_init__(self):
        if self.type not in (FILE, DIRECTORY):
            raise ValueError("a target is a file or a directory")
        path = self.path.replace("\\", "/")
        if not path or not (path.startswith("/") or path[1:3] == ":/" or "://" in path):
            raise ValueError("a target has an absolute path")
        if self.type == FILE and not path.rstrip("/"):
            raise ValueError("a root isn't a file")


def target_states(targets: DataFrame, listing: DataFrame) -> DataFrame:
    """targets (type, path) with a state: Suspended below another directory target that exists, Failed if missing, else Active."""
    t = targets.select("type", "path", path_key(F.col("path")).alias("_key"))
    exists = listing.select(path_key(F.col("path")).alias("_key")).distinct().withColumn("_exists", F.lit(True))
    known = t.join(exists, "_key", "left").withColumn("_exists", F.coalesce("_exists", F.lit(False)))
    above = known.select("type", "path", "_key", "_exists", F.explode(path_ancestors(F.col("_key"))).alias("_up"))
    dirs = known.where((F.col("type") == DIRECTORY) & F.col("_exists")).select(F.col("_key").alias("_up")).distinct()
    covered = above.where("_up <> _key").join(dirs, "_up", "left_semi").select("_key").distinct().withColumn("_covered", F.lit(True))
    state = F.when(F.col("_covered"), SUSPENDED).when(~F.col("_exists"), FAILED).otherwise(ACTIVE)
    return known.join(covered, "_key", "left").select("type", "path", state.alias("state"))


def watched(entries: DataFrame, targets: DataFrame, file_filter: Column | None = None) -> DataFrame:
    """Entries (path, entry_type) that a target names or that lie below a directory target; the filter is for files only.

    Each path meets the targets through its ancestors, an equi-join, however deep the tree.
    """
    if file_filter is not None:
        entries = entries.where((F.col("entry_type") != FILE) | file_filter)
    keyed = entries.withColumn("_key", path_key(F.col("path")))
    wanted = targets.select(F.col("type").alias("_type"), path_key(F.col("path")).alias("_up")).distinct()
    pairs = keyed.select("_key", F.explode(path_ancestors(F.col("_key"))).alias("_up")).distinct().join(wanted, "_up")
    hit = pairs.where((F.col("_up") == F.col("_key")) | (F.col("_type") == DIRECTORY)).select("_key").distinct()
    return keyed.join(hit, "_key", "left_semi").drop("_key")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change_type, content_id: what happened between two listings.

    before: path, content_id, length, mtime; after: path, length, mtime. Both may have a digest of the content too. Paths
    meet without regard to case. A new or changed file gets a new id, after the largest there was; a file that is found
    elsewhere with the same length and time in the place of one that went is renamed and keeps its id. With digests, which
    must be the same too, several such are paired in order of path: equal files may stand for each other. Without, the
    match must be unique on both sides, and another file of equal length and time passes for the old one.
    """
    mark = ["length", "mtime", *(["digest"] if "digest" in before.columns and "digest" in after.columns else [])]
    old = before.select(path_key(F.col("path")).alias("_key"), F.col("path").alias("old_path"), "content_id", *[F.col(c).alias(f"_{c}") for c in mark])
    new = after.select(path_key(F.col("path")).alias("_key"), "path", *mark)
    both = old.join(new, "_key", "full_outer")
    gone, came = both.where("path is null"), both.where("old_path is null")
    held = [f"_{c}" for c in mark]
    g, c = gone.select("old_path", "content_id", *held), came.select("path", *[F.col(m).alias(f"_{m}") for m in mark])
    if "digest" in mark:
        moved = places(g, held, ["old_path"]).join(places(c, held, ["path"]), [*held, "place"])
    else:
        alone = F.count(F.lit(1)).alias("_n")
        g = g.groupBy(*held).agg(F.first("old_path").alias("old_path"), F.first("content_id").alias("content_id"), alone).where("_n = 1").drop("_n")
        moved = g.join(c.groupBy(*held).agg(F.first("path").alias("path"), alone).where("_n = 1").drop("_n"), held)
    moved = moved.select("path", "old_path", "content_id")
    changed = both.where("path is not null and old_path is not null and not (length <=> _length and mtime <=> _mtime)")
    fresh = came.select("path").join(moved.select("path"), "path", "left_anti").select("path", F.lit(CREATED).alias("change_type")).unionByName(changed.select("path", F.lit(CHANGED).alias("change_type")))
    numbered = with_new_ids(fresh, before)
    removed = gone.select("old_path", "content_id").join(moved.select("old_path"), "old_path", "left_anti").select(F.col("old_path").alias("path"), F.lit(DELETED).alias("change_type"), F.lit(None).cast("string").alias("old_path"), "content_id")
    return (
        numbered.select("path", "change_type", F.lit(None).cast("string").alias("old_path"), "content_id")
        .unionByName(moved.select("path", F.lit(RENAMED).alias("change_type"), "old_path", "content_id"))
        .unionByName(removed)
    )


def places(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with place, from 1, in the given order among the rows of equal keys; nulls are equal and come first.

    Ranges of keys and order are numbered by themselves and then shifted, so that a frequent key spreads over tasks. The
    ranges are written to the shared folder: another sampling of them would number other rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-places-{uuid.uuid4().hex[:16]}"
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, *order)
    dealt.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    rows = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    # A row for each range and one more for each key at most.
    sizes = rows.groupBy("_part", *keys).agg(F.max("_row").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("_part").alias("_of"), *[F.col(k).alias(f"_of_{k}") for k in keys], F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(shift, same).withColumn("place", (F.col("_shift") + F.col("_row")).cast("long")).select(*df.columns, "place")


def with_new_ids(fresh: DataFrame, before: DataFrame) -> DataFrame:
    """Dense ids in order of path, after the largest of before."""
    top = before.agg(F.coalesce(F.max("content_id"), F.lit(-1)).alias("_top"))  # one row
    return places(fresh, [], ["path"]).join(F.broadcast(top)).withColumn("content_id", (F.col("_top") + F.col("place")).cast("long")).drop("_top", "place")


def apply_diff(before: DataFrame, after: DataFrame, diff: DataFrame) -> DataFrame:
    """path, content_id and the other columns of the listing after, with the ids that the difference gives or that stay."""
    given = diff.where(F.col("change_type") != DELETED).select(path_key(F.col("path")).alias("_key"), F.col("content_id").alias("_given"))
    kept = before.select(path_key(F.col("path")).alias("_key"), "content_id")
    return after.withColumn("_key", path_key(F.col("path"))).join(kept, "_key", "left").join(given, "_key", "left").select("path", F.coalesce("_given", "content_id").alias("content_id"), *[c for c in after.columns if c != "path"])


def deleted_below(files: DataFrame, gone: DataFrame) -> DataFrame:
    """Files at, or below, the paths that are gone."""
    keyed = files.withColumn("_key", path_key(F.col("path")))
    ups = keyed.select("_key", F.explode(path_ancestors(F.col("_key"))).alias("_up")).distinct()
    hit = ups.join(gone.select(path_key(F.col("path")).alias("_up")).distinct(), "_up", "left_semi").select("_key").distinct()
    return keyed.join(hit, "_key", "left_semi").drop("_key")


def orphaned(files: DataFrame, removed: DataFrame) -> DataFrame:
    """content_id of removed files that no other file has: what goes from the index."""
    left = files.join(removed.select("path"), "path", "left_anti").select("content_id")
    return removed.select("content_id").distinct().join(left, "content_id", "left_anti")


def moved_below(files: DataFrame, old: str, new: str) -> DataFrame:
    """Files with the path of a renamed file or directory put in place; ids stay."""
    at = path_key(F.col("path"))
    inside = (at == old.upper()) | F.startswith(at, F.lit(old.upper() + "/"))
    return files.withColumn("path", F.when(inside, F.concat(F.lit(new), F.substr("path", F.lit(len(old) + 1)))).otherwise(F.col("path")))


def needs_reread(moved: DataFrame, lag_ms: int = 400) -> Column:
    """A moved file is read again if it was never read to the end or at most lag_ms before the move."""
    return F.col("finished_ms").isNull() | (F.col("moved_ms") - F.col("finished_ms") < lag_ms)


def scan_times(files: DataFrame) -> DataFrame:
    """content_id with the earliest scan of the files that share it; null as soon as one was never scanned."""
    return files.groupBy("content_id").agg(F.when(F.bool_or(F.col("finished_ms").isNull()), None).otherwise(F.min("finished_ms")).alias("finished_ms"))


def content_groups(files: DataFrame) -> DataFrame:
    return files.groupBy("content_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def child_counts(entries: DataFrame) -> DataFrame:
    parent = F.regexp_replace("path", r"[/\\][^/\\]*$", "")
    return entries.groupBy(parent.alias("parent")).agg(
        *[F.count_if(F.col("entry_type") == kind).alias(name) for kind, name in ((DIRECTORY, "directories"), (FILE, "files"), (UNCERTAIN, "unclassified"))]
    )


def tree_lines(entries: DataFrame, note: Column | None = None) -> DataFrame:
    """(key, line): a printed tree; files, then unclassified entries (name?), then directories (name/), by name without case.

    note: text to put after a name, such as a mark for hits. Order the result by key.
    """
    parts = F.split(F.regexp_replace("path", r"^[/\\]+", ""), r"[/\\]")
    depth = F.size(parts)
    kind = F.when(F.col("entry_type") == FILE, "0").when(F.col("entry_type") == UNCERTAIN, "1").otherwise("2")
    above = F.transform(F.slice(parts, 1, F.greatest(depth - 1, F.lit(0))), lambda p: F.concat(F.lit("2"), F.upper(p)))
    name = F.element_at(parts, -1)
    key = F.concat(above, F.array(F.concat(kind, F.upper(name))))
    mark = F.when(F.col("entry_type") == DIRECTORY, "/").when(F.col("entry_type") == UNCERTAIN, "?").otherwise("")
    line = F.concat(F.repeat(F.lit("\t"), depth - 1), name, mark, F.coalesce(note, F.lit("")) if note is not None else F.lit(""))
    return entries.select(key.alias("key"), line.alias("line"))


def latest_events(changes: DataFrame) -> DataFrame:
    """The last change of each path, in order of arrival."""
    order = Window.partitionBy(path_key(F.col("path"))).orderBy(F.desc("seq"))
    return changes.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def size_order(tasks: DataFrame) -> DataFrame:
    """Smallest files first, ties in order of arrival."""
    return tasks.orderBy("length", "seq")


def size_places(tasks: DataFrame) -> DataFrame:
    """tasks with their place in size_order, from 1; null lengths come first."""
    return places(tasks, [], ["length", "seq"])
