"""A stream of file changes from polled listings, and an index that follows it."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tessera.functions.lexer import Lexer
from tessera.operators.index import IndexEngine, Pointer, SearchResult, files_of
from tessera.operators.mirror import CHANGED, CREATED, DELETED, FILE, RENAMED, apply_diff, orphaned, snapshot_diff
from tessera.sources.files import below, listing, read_texts, retried

#: Changed files up to which they are read by name.
BY_NAME = 10_000
CHANGES = "seq long, ts timestamp, entry_type string, change_type string, path string, old_path string"


class Polled(SimpleDataSourceStreamReader):
    """Reads on the driver. Each poll's changes are written to a journal first, so that a batch can be read again."""

    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split(os.pathsep) if p]
        self.journal = options["journal"]
        self.accept = re.compile(options.get("pattern", ""), re.I)
        os.makedirs(self.journal, exist_ok=True)

    def _list(self) -> dict[str, list]:
        found = {}
        for top in self.paths:
            single = [(os.path.dirname(top), [], [os.path.basename(top)])] if os.path.isfile(top) else os.walk(top)
            for folder, _, names in single:
                for name in names:
                    path = os.path.join(folder, name)
                    if self.accept.search(path):
                        try:
                            s = os.stat(path)
                            found[path] = [s.st_size, s.st_mtime_ns, s.st_ino]
                        except OSError:
                            pass  # gone meanwhile
        return found

    def initialOffset(self) -> dict:
        return {"poll": 0, "seq": 0}

    def _file(self, poll: int) -> str:
        return os.path.join(self.journal, f"{poll:012d}.json")

    def _state(self) -> dict[str, list]:
        try:
            with open(os.path.join(self.journal, "state.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    def read(self, start: dict):
        poll, seq = start["poll"], start["seq"]
        if os.path.exists(self._file(poll)):  # read before, by a run that didn't get to commit
            rows = self._load(poll)
            return iter(rows), {"poll": poll + 1, "seq": seq + len(rows)}
        before, after = self._state(), self._list()
        gone = {p: v for p, v in before.items() if p not in after}
        by_inode = {v[2]: p for p, v in gone.items()}
        now, out = time.time(), []
        for path, v in sorted(after.items()):
            if path not in before:
                old = by_inode.get(v[2])
                if old and gone[old][:2] == v[:2]:
                    gone.pop(old)
                    out.append((RENAMED, path, old))
                else:
                    out.append((CREATED, path, None))
            elif before[path] != v:
                out.append((CHANGED, path, None))
        out += [(DELETED, p, None) for p in sorted(gone)]
        if not out:
            return iter([]), start
        rows = [[seq + i, now, FILE, change, path, old] for i, (change, path, old) in enumerate(out)]
        for name, content in ((self._file(poll), rows), (os.path.join(self.journal, "state.json"), after)):
            part = f"{name}.{uuid.uuid4().hex}"
            with open(part, "w") as f:
                json.dump(content, f)
            os.replace(part, name)
        return iter(self._load(poll)), {"poll": poll + 1, "seq": seq + len(rows)}

    def _load(self, poll: int) -> list[tuple]:
        from datetime import datetime

        with open(self._file(poll)) as f:
            return [(s, datetime.fromtimestamp(t), kind, change, path, old) for s, t, kind, change, path, old in json.load(f)]

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([row for poll in range(start["poll"], end["poll"]) for row in self._load(poll)])

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.journal):
            if name[:12].isdigit() and int(name[:12]) < end["poll"]:
                os.remove(os.path.join(self.journal, name))


class FileChanges(DataSource):
    """format("file_changes"), options paths (joined as in PATH), journal (a folder), pattern (what names must contain)."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return CHANGES

    def simpleStreamReader(self, schema) -> Polled:
        return Polled(dict(self.options))


@dataclass
class FileIndex:
    """Files below watched paths, and an index of their texts: refresh() brings both up to date, search() gives paths.

    path: where the index and the table of files live. Content ids are kept with the files from session to session.
    """

    spark: SparkSession
    path: str
    targets: list[str]
    pattern: str | None = None
    lexer: Lexer = field(default_factory=Lexer)
    max_length: int = 64 << 20
    charset: str = "UTF-8"
    listeners: list = field(default_factory=list)

    def __post_init__(self):
        self.engine = IndexEngine(self.spark, f"{self.path}/index", self.lexer)
        self.pointer = Pointer(self.spark, f"{self.path}/state")

    def files(self) -> DataFrame:
        """path, content_id, length, mtime, digest."""
        return self._state("files", "path string, content_id long, length long, mtime timestamp, digest long")

    def failures(self) -> DataFrame:
        """path, error of what the last refresh couldn't read; a file that was read before keeps its former text."""
        return self._state("failed", "path string, error string")

    def _state(self, name: str, schema: str) -> DataFrame:
        version = self.pointer.get()
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/state/{name}-{version}")

    def watch(self, target: str) -> None:
        self.targets.append(target)

    def _read(self, paths: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
        """(path, content, digest) and (path, error) of these paths, written; few paths are read by name, many by a scan."""
        some = [r[0] for r in paths.limit(BY_NAME + 1).collect()]
        named = len(some) <= BY_NAME
        if not some:
            return self.spark.createDataFrame([], "path string, content string, digest long"), self.spark.createDataFrame([], "path string, error string")
        texts, _, failed = read_texts(self.spark, some if named else self.targets, None if named else self.pattern, self.charset, self.max_length, exclude=self.path)
        texts = texts.select("path", "content", F.xxhash64("content").alias("digest"))
        for df, name in ((texts, "fresh"), (failed, "failed")):
            df = df if named else df.join(paths, "path", "left_semi")
            retried(lambda df=df, name=name: df.write.mode("overwrite").parquet(f"{self.path}/state/{name}-{run}"))
        return tuple(self.spark.read.parquet(f"{self.path}/state/{name}-{run}") for name in ("fresh", "failed"))

    def refresh(self) -> DataFrame:
        """What changed since the last time. The index is changed before the files are, so that no path leads to nothing.

        The listing tells which files are new or changed; only these are read. What can't be read is in failures().
        """
        number, _ = self.pointer.current()
        before, run = self.files(), uuid.uuid4().hex[:12]
        there = listing(self.spark, self.targets, self.pattern).where(F.col("length") < self.max_length)
        retried(lambda: there.where(~below(F.col("path"), self.path)).write.mode("overwrite").parquet(f"{self.path}/state/listing-{run}"))
        there = self.spark.read.parquet(f"{self.path}/state/listing-{run}")
        same = there.join(before, ["path", "length", "mtime"]).select("path", "length", "mtime", "digest")
        texts, failed = self._read(there.join(same, "path", "left_anti").select("path"), run)
        failed.write.mode("ignore").parquet(f"{self.path}/state/failed-{run}")
        read = there.join(texts.select("path", "digest"), "path").select("path", "length", "mtime", "digest")
        kept = before.join(failed.select("path"), "path", "left_semi").select("path", "length", "mtime", "digest")
        after = same.unionByName(read).unionByName(kept)
        retried(lambda: snapshot_diff(before, after).write.mode("overwrite").parquet(f"{self.path}/state/diff-{run}"))
        diff = self.spark.read.parquet(f"{self.path}/state/diff-{run}")
        fresh = diff.where(F.col("change_type").isin(CREATED, CHANGED)).select("path", "content_id")
        apply_diff(before, after, diff).write.parquet(f"{self.path}/state/files-{run}")
        changed = diff.where(F.col("change_type") == CHANGED).select("path")
        removed = before.join(changed, "path", "left_semi").unionByName(before.join(diff.where(F.col("change_type") == DELETED).select("path"), "path", "left_semi"))
        gone = orphaned(before, removed)
        if gone.limit(1).count():
            self.engine.remove(gone)
        if fresh.limit(1).count():
            self.engine.update(texts.join(fresh, "path").select("content_id", "content"))
        self.pointer.set(run, number)
        for listener in self.listeners:
            listener(diff)
        return diff

    def follow(self, changes: DataFrame, checkpoint: str, interval: str = "400 milliseconds"):
        """Refreshes after every batch of changes; a burst within the interval is one batch."""
        return changes.writeStream.foreachBatch(lambda batch, _: self.refresh()).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()

    def search(self, query, limit: int | None = None) -> SearchResult:
        """rows: path and content_id, in order of path without regard to case."""
        found = self.engine.search(query, limit)
        if found.failed:
            return found
        return SearchResult([], files_of(found.rows, self.files()).select("path", "content_id").orderBy(F.upper("path")), found.warnings)
