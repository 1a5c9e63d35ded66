"""What changes do to a watched tree: the state machine, replayed for each target by itself."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.mirror import CHANGED, CREATED, DELETED, DIRECTORY, FILE, FOUND, RENAMED, UNCERTAIN


@dataclass
class Tree:
    """entries: {key: (path, type, content id or None)}; keys are paths without regard to case.

    accepts(path, type): whether an entry is watched. New and changed files get new ids, moved ones keep theirs.
    """

    accepts: object = staticmethod(lambda path, kind: True)
    entries: dict = field(default_factory=dict)
    next_id: int = 0
    log: list = field(default_factory=list)

    @staticmethod
    def key(path: str) -> str:
        return path.replace("\\", "/").upper()

    def _below(self, key: str) -> list[str]:
        return [k for k in self.entries if k == key or k.startswith(key + "/")]

    def create(self, path: str, kind: str) -> None:
        content = None
        if kind == FILE:
            content, self.next_id = self.next_id, self.next_id + 1
        self.entries[self.key(path)] = (path, kind, content)
        self.log.append((CREATED, path, None, content))

    def delete(self, path: str) -> None:
        for k in self._below(self.key(path)):
            gone, _, content = self.entries.pop(k)
            self.log.append((DELETED, gone, None, content))

    def move(self, old: str, new: str) -> None:
        for k in self._below(self.key(old)):
            path, kind, content = self.entries.pop(k)
            moved = new + path[len(old) :]
            self.entries[self.key(moved)] = (moved, kind, content)
            self.log.append((RENAMED, moved, path, content))

    def apply(self, change: str, kind: str, path: str, old: str | None = None) -> None:
        """A rename out of what is watched deletes the old path, one into it creates the new one."""
        there = self.entries.get(self.key(path))
        if change == RENAMED:
            into, out_of = self.accepts(path, kind), self.accepts(old, kind)
            was = self.entries.get(self.key(old))
            if into and (not out_of or was is None):
                self.apply(CREATED, kind, path)
            elif into:
                if self.key(path) != self.key(old):
                    self.delete(path)
                if kind in (UNCERTAIN, was[1]):
                    self.move(old, path)
                else:
                    self.delete(old)
                    self.create(path, kind)
            elif out_of:
                self.delete(old)
            return
        if not self.accepts(path, kind):
            return
        if change == DELETED:
            self.delete(path)
        elif there is None:
            self.create(path, kind)
        elif there[1] != kind or kind == FILE and change != FOUND:
            self.delete(path)
            self.create(path, kind)


def replay(changes: DataFrame, target: str = "target") -> DataFrame:
    """target, path, entry_type, content_id: the tree that each target's changes, in order of seq, leave.

    changes: target, seq, entry_type, change_type, path, old_path. A target's changes depend on each other and are
    replayed one after another; targets are independent. Content ids count up within a target.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree()
        for r in pdf.sort_values("seq").itertuples():
            tree.apply(r.change_type, r.entry_type, r.path, r.old_path if isinstance(r.old_path, str) else None)
        rows = [(pdf[target].iloc[0], p, k, c) for p, k, c in tree.entries.values()]
        return pd.DataFrame(rows, columns=[target, "path", "entry_type", "content_id"]).astype({"content_id": "Int64"})

    kind = changes.schema[target].dataType.simpleString()
    return changes.groupBy(target).applyInPandas(run, f"{target} {kind}, path string, entry_type string, content_id long")


def debounced(events: DataFrame, key: str, gap: str, time: str = "ts") -> DataFrame:
    """One row for each burst of events of a key: bursts end after a quiet gap. For batches and streams alike."""
    return (
        events.groupBy(key, F.session_window(time, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.max(time).alias("last"))
        .select(key, F.col("w.start").alias("first"), "last", "n_events")
    )


def active_changes(changes: DataFrame, targets: DataFrame) -> DataFrame:
    """Changes of targets that are active still."""
    return changes.join(targets.where(F.col("state") == "Active").select("target"), "target", "left_semi")


__all__ = ["CHANGED", "CREATED", "DELETED", "DIRECTORY", "FILE", "FOUND", "RENAMED", "Tree", "active_changes", "debounced", "replay"]
