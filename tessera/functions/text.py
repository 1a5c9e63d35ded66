"""Small functions on paths, query strings, statuses and arrays."""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters that a backslash takes their meaning from in a query.
SPECIAL = '&|+-!(){}[]^"~*?:\\/'
_SPECIAL_CLASS = "[" + "".join("\\" + c for c in SPECIAL) + "]"
# Units of a status, in milliseconds.
UNITS = (("d", 86_400_000), ("h", 3_600_000), ("m", 60_000), ("s", 1000), ("ms", 1))


def escape_query(text: Column) -> Column:
    return F.regexp_replace(text, f"({_SPECIAL_CLASS})", r"\\$1")


def escape_query_text(text: str) -> str:
    return re.sub(f"({_SPECIAL_CLASS})", r"\\\1", text)


def unescape_query(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({_SPECIAL_CLASS})", "$1")


def unescape_query_text(text: str) -> str:
    return re.sub(rf"\\({_SPECIAL_CLASS})", r"\1", text)


def clipboard_query(text: str) -> str:
    """A pasted text as a query: after 'search: ' as it is, one word escaped, several words or lines quoted."""
    if text.startswith("search: "):
        return " ".join(text[len("search: ") :].splitlines())
    lines = [line.strip() for line in text.splitlines() if line.strip()]
    if not lines:
        return ""
    if len(lines) == 1 and len(lines[0].split()) == 1:
        return escape_query_text(lines[0])
    return '"' + " ".join(escape_query_text(line) for line in lines) + '"'


def example_query(line: Column) -> Column:
    """The query of an example line: what stands before //, without white space at its end."""
    return F.rtrim(F.get(F.split(line, "//"), F.lit(0)))


def path_key(path: Column) -> Column:
    """Paths are compared without regard to case."""
    return F.upper(path)


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, r"[/\\]"), lambda p: p != "")


def path_join(parts: Column, separator: str = "/") -> Column:
    return F.array_join(parts, separator)


def path_ancestors(path: Column, separator: str = "/") -> Column:
    """The path itself and every directory above it, longest last; a leading separator stays."""
    parts = F.split(path, r"[/\\]")
    return F.filter(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator)), lambda p: p != ""
    )


def duration_text(ms: Column) -> Column:
    """In the largest unit of which there are more than two, truncated; else in milliseconds."""
    out = F.concat(ms.cast("long").cast("string"), F.lit("ms"))
    for name, size in reversed(UNITS):
        out = F.when(ms > 2 * size, F.concat(F.floor(ms / size).cast("string"), F.lit(name))).otherwise(out)
    return out


def scan_status(started_ms: Column, finished_ms: Column, now_ms: Column) -> Column:
    """'3m ago', 'scanning 5s' or 'not scanned'; null: never."""
    return (
        F.when(finished_ms.isNotNull(), F.concat(duration_text(now_ms - finished_ms), F.lit(" ago")))
        .when(started_ms.isNotNull(), F.concat(F.lit("scanning "), duration_text(now_ms - started_ms)))
        .otherwise("not scanned")
    )


def task_state(canceled: Column, failed: Column, repeat: Column) -> Column:
    state = F.concat_ws(" ", F.when(canceled, "canceled"), F.when(failed, "failed"), F.when(repeat, "to be repeated"))
    return F.when(state == "", "completed").otherwise(state)


def first_index(values: Column, holds) -> Column:
    """The first index for which holds(value); -1 if there is none."""
    return F.coalesce(F.array_position(F.transform(values, lambda v: F.coalesce(holds(v), F.lit(False))), True), F.lit(0)) - 1


def last_index(values: Column, holds) -> Column:
    found = first_index(F.reverse(values), holds)
    return F.when(found < 0, -1).otherwise(F.size(values) - 1 - found)


def first_index_of(values, holds) -> int:
    """For a predicate that is false first and then true."""
    at = bisect_left(values, True, key=holds)
    return at if at < len(values) else -1


def last_index_of(values, holds) -> int:
    """For a predicate that is true first and then false."""
    return bisect_left(values, True, key=lambda v: not holds(v)) - 1
