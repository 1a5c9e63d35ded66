"""An index in segments: each is written once, a pointer lists those that count, and small ones are merged.

An edit writes a segment of its own documents and ids, so its cost follows its own size. What a segment mentions, to put
or to remove, no longer counts in the segments before. FAN neighbouring segments of like size become one, so that there
are few of them and a document is written anew only so often as the index grows by that factor.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lexer import Lexer
from tessera.plans.automata import BEGIN, END
from tessera.plans.indexed import GRAM, VARIANT_EDITS, VARIANT_PREFIX, WINDOW, Postings

#: Segments of like size that are merged into one.
FAN = 4
#: Times that an edit of the list is made anew when another writer was first.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer was first."""


class Pointer:
    """Which version of what lies under a path is the current one: numbered files, each whole as soon as it is there."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._rename_options = spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._path = lambda name: self._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
        self._fs = self._path("").getFileSystem(self._conf)

    def names(self) -> list[str]:
        if not self._fs.exists(self._path("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")))

    def pointers(self) -> list[str]:
        return [n for n in self.names() if n.startswith("CURRENT-")]

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def current(self) -> tuple[int, str | None]:
        """The number of the current pointer, -1 if there is none, and its version."""
        names = self.pointers()
        return (int(names[-1][8:]), self.read(names[-1])) if names else (-1, None)

    def get(self) -> str | None:
        return self.current()[1]

    def set(self, version: str, after: int) -> None:
        """Makes version the one after the pointer numbered after, which its writer began from; Conflict if another one came first.

        The file is written under another name and then renamed, never over one that is there: no reader sees half of it,
        and a writer that dies before leaves nothing that counts.
        """
        path, draft = (self._fs.makeQualified(self._path(n)) for n in (f"CURRENT-{after + 1:012d}", f".draft-{uuid.uuid4().hex}"))
        stream = self._fs.create(draft, False)
        stream.write(bytearray(version.encode()))
        stream.close()
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, path, self._rename_options)
        except Py4JJavaError as problem:
            self._fs.delete(draft, False)
            if self._fs.exists(path):
                raise Conflict(f"version {after + 1} is already written") from problem
            raise

    def vacuum(self, keep: int) -> None:
        """Deletes what is named as in name-version, of all but the versions that the newest pointers name, and their pointers."""
        pointers = self.pointers()
        live = {part.split(":")[0] for p in pointers[-keep:] for part in self.read(p).split(",")}
        for n in self.names():
            if n in pointers[:-keep] or "-" in n and n[0] != "." and n not in pointers and n.rsplit("-", 1)[1] not in live:
                self._fs.delete(self._path(n), True)


def has_repeats(docs: DataFrame) -> bool:
    """Whether a content_id, or none, is that of several rows; reads and exchanges the ids alone."""
    return not docs.groupBy("content_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def document_terms(docs: DataFrame, lexer: Lexer = Lexer(), text: str = "content", length: bool = False) -> DataFrame:
    """content_id, term, positions array<int>: those of each row by itself, whose tokens are sorted where they stand."""
    lexed = docs.select("content_id", F.explode(F.array(lexer.terms(F.col(text)))).alias("terms")).where(F.size("terms") > 0)
    rows = lexed.select("content_id", F.explode(F.array(F.array_sort(F.transform("terms", lambda t, i: F.struct(t.alias("t"), i.alias("p")))))).alias("s"))
    starts = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i)["t"] != F.get("s", i - 1)["t"]))
    rows = rows.select("content_id", "s", F.explode(F.array(starts)).alias("starts"))
    runs = F.transform("starts", lambda at, k: F.struct(F.get("s", at)["t"].alias("term"), F.transform(F.slice("s", at + 1, F.coalesce(F.get("starts", k + 1), F.size("s")) - at), lambda x: x["p"]).alias("positions")))
    return rows.select("content_id", *[F.size("s").alias("length")] * length, F.inline(runs)).select("content_id", "term", "positions", *["length"] * length)


def positions(docs: DataFrame, lexer: Lexer = Lexer(), text: str = "content") -> DataFrame:
    """content_id, term, positions array<int>: one row for each distinct term of a document. Rows of one id, or of none, are one document.

    Only the rows of repeated ids are exchanged.
    """
    if not has_repeats(docs):
        return document_terms(docs, lexer, text)
    again = docs.groupBy("content_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("content_id").alias("_again"))
    same = F.col("content_id").eqNullSafe(F.col("_again"))
    parts = document_terms(docs.join(again, same, "left_semi"), lexer, text).groupBy("content_id", "term")
    return document_terms(docs.join(again, same, "left_anti"), lexer, text).unionByName(parts.agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")))


def grams(vocabulary: DataFrame) -> DataFrame:
    """(gram, term): the runs of GRAM characters of each term between its marks."""
    marked = F.concat(F.lit(BEGIN), "term", F.lit(END))
    places = F.sequence(F.lit(1), F.char_length(marked) - (GRAM - 1))
    return vocabulary.select(F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(marked, i, F.lit(GRAM))))).alias("gram"), "term")


def variants(vocabulary: DataFrame) -> DataFrame:
    """(variant, term): hashes of what is left of a term's first characters without up to VARIANT_EDITS of them."""
    start = F.substring("term", 1, VARIANT_PREFIX)
    # Two places to leave out; one past the end leaves nothing out.
    places = combinations([*range(VARIANT_PREFIX), *[VARIANT_PREFIX] * VARIANT_EDITS], VARIANT_EDITS)
    gone = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(set(places))])
    left = F.transform(gone, lambda g: F.concat(F.substring(start, F.lit(1), g["a"]), F.substring(start, g["a"] + 2, g["b"] - g["a"] - 1), F.substring(start, g["b"] + 2, F.lit(VARIANT_PREFIX))))
    return vocabulary.select(F.explode(F.array_distinct(left)).alias("variant"), "term").select(F.xxhash64("variant").alias("variant"), "term")


@dataclass(frozen=True)
class Segment:
    """documents: how many it has; mentioned: how many ids it has or removes."""

    name: str
    documents: int
    mentioned: int

    def __str__(self):
        return f"{self.name}:{self.documents}:{self.mentioned}"


def parse_segments(version: str | None) -> list[Segment]:
    return [Segment(name, int(n), int(m)) for part in (version or "").split(",") if part for name, n, m in [part.split(":")]]


def to_merge(segments: list[Segment]) -> slice | None:
    """The smallest run of FAN last segments or more of like sizes: the largest has less than FAN times what the others have.

    Sizes are alike if they have no more digits to the base FAN than the run's. So what is written anew belongs to a
    segment that has grown by a third at least.
    """

    def tier(segment: Segment) -> int:
        digits, n = 0, segment.mentioned
        while n >= FAN:
            n, digits = n // FAN, digits + 1
        return digits

    for most in sorted({tier(s) for s in segments}):
        start = len(segments)
        while start and tier(segments[start - 1]) <= most:
            start -= 1
        sizes = [s.mentioned for s in segments[start:]]
        if len(sizes) >= FAN and max(sizes) < FAN * (sum(sizes) - max(sizes)):
            return slice(start, len(segments))
    return None


class Segments:
    """The segments under a path: folders documents-S, mentioned-S, postings-S, windows-S, vocabulary-S, grams-S, variants-S.

    Postings stand in order of term and window of ids, so that a condition on these reads the row groups that can have
    them; windows-S says how much a term can add to a score in a window.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW):
        self.spark, self.path, self.window = spark, path.rstrip("/"), window
        self.pointer = Pointer(spark, self.path)

    def read(self, kind: str, segment: Segment | str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}-{getattr(segment, 'name', segment)}")

    def _sorted(self, df: DataFrame, kind: str, name: str, *keys: str) -> None:
        """Each file in order of the keys; which rows share a file is what df has them in."""
        df.sortWithinPartitions(*keys).write.parquet(f"{self.path}/{kind}-{name}")

    def write(self, documents: DataFrame | None, postings: DataFrame | None, removed: DataFrame | None = None) -> Segment:
        """A segment that no list names yet. documents: content_id; postings: what they have; removed: further ids that it mentions."""
        name = uuid.uuid4().hex[:12]
        n = m = 0
        if documents is not None:
            self._sorted(documents.select("content_id").repartitionByRange("content_id"), "documents", name, "content_id")
            n = m = self.read("documents", name).count()
        if removed is not None:
            ids = removed.select("content_id")
            ids = ids.unionByName(self.read("documents", name)) if n else ids
            self._sorted(ids.distinct().repartitionByRange("content_id"), "mentioned", name, "content_id")
            m = self.read("mentioned", name).count()
        if n:
            rows = postings.withColumn("window", self._window())
            # Whole windows came together, so that no row of a term and window is elsewhere; nothing else is exchanged.
            self._sorted(rows.select("term", "window", "content_id", "positions", "length"), "postings", name, "term", "window", "content_id")
            impact = F.max(F.sqrt(F.size("positions")) / F.sqrt("length")).alias("impact")
            self._sorted(self.read("postings", name).groupBy("term", "window").agg(impact, F.count(F.lit(1)).alias("documents")), "windows", name, "term", "window")
            self._sorted(self.read("windows", name).groupBy("term").agg(F.sum("documents").alias("documents")), "vocabulary", name, "term")
            self._sorted(grams(self.read("vocabulary", name)), "grams", name, "gram", "term")
            self._sorted(variants(self.read("vocabulary", name)), "variants", name, "variant")
        return Segment(name, n, m)

    def put(self, docs: DataFrame, lexer: Lexer) -> Segment:
        """A segment of documents (content_id, content) of different ids."""
        # Texts are exchanged, a fraction of what their postings would be.
        return self.write(docs, document_terms(docs.select("content_id", "content").repartition(self._window()), lexer, length=True))

    def _window(self) -> Column:
        return F.floor(F.col("content_id") / self.window).cast("long")

    def _mentioned(self, segment: Segment) -> DataFrame:
        """The ids that a segment puts or removes; those of its documents, if there are no more."""
        return self.read("documents" if segment.documents == segment.mentioned else "mentioned", segment)

    def _live(self, kind: str, segments: list[Segment], k: int) -> DataFrame:
        """The rows of segment k whose documents no later segment mentions."""
        rows = self.read(kind, segments[k])
        later = [self._mentioned(s) for s in segments[k + 1 :]]
        for df in later[1:]:
            later[0] = later[0].unionByName(df)
        return rows.join(later[0], "content_id", "left_anti") if later else rows

    def merged(self, run: list[Segment], later: list[Segment]) -> Segment:
        """One segment in place of neighbouring ones; later ones, already there, count too."""
        together = [*run, *later]

        def live(kind: str) -> DataFrame:
            found = [self._live(kind, together, k) for k, s in enumerate(run) if s.documents]
            for df in found[1:]:
                found[0] = found[0].unionByName(df)
            return found[0] if found else None

        ids = self._mentioned(run[0])
        for s in run[1:]:
            ids = ids.unionByName(self._mentioned(s))
        postings = live("postings")
        return self.write(live("documents"), postings.repartition(self._window()) if postings is not None else None, ids)

    def change(self, edit: Callable[[list[Segment]], list[Segment] | None]) -> None:
        """Puts edit(segments) in place of the list, anew if another writer's list came meanwhile; None leaves it."""
        for attempt in range(ATTEMPTS):
            number, version = self.pointer.current()
            new = edit(parse_segments(version))
            if new is None:
                return
            try:
                return self.pointer.set(",".join(map(str, new)), number)
            except Conflict:
                if attempt + 1 == ATTEMPTS:
                    raise

    def append(self, segment: Segment) -> None:
        self.change(lambda old: [*old, segment])

    def merge(self) -> None:
        """Merges while there is what is to be merged. Readers of a list go on with its segments; vacuum() drops them."""
        while True:
            segments = parse_segments(self.pointer.get())
            where = to_merge(segments)
            if where is None:
                return
            run = segments[where]
            one = self.merged(run, segments[where.stop :])

            def instead(old: list[Segment], run=run, one=one) -> list[Segment] | None:
                start = next((i for i in range(len(old)) if old[i : i + len(run)] == run), None)
                return None if start is None else [*old[:start], one, *old[start + len(run) :]]

            self.change(instead)

    def tables(self, version: str | None = None) -> Postings:
        """What the segments of a version, or of the current one, hold together."""
        segments = parse_segments(version if version is not None else self.pointer.get())
        kinds = {
            "documents": "content_id long", "postings": "term string, window long, content_id long, positions array<int>, length int",
            "windows": "term string, window long, impact double, documents long", "vocabulary": "term string, documents long",
            "grams": "gram string, term string", "variants": "variant long, term string",
        }
        found = {}
        for kind, schema in kinds.items():
            parts = []
            for k, s in enumerate(segments):
                if s.documents:
                    rows = self._live(kind, segments, k) if kind in ("documents", "postings") else self.read(kind, s)
                    parts.append(rows.withColumn("segment", F.lit(k)) if kind in ("documents", "postings", "windows") else rows)
            if not parts:
                parts = [self.spark.createDataFrame([], schema + ", segment int" * (kind in ("documents", "postings", "windows")))]
            for df in parts[1:]:
                parts[0] = parts[0].unionByName(df)
            found[kind] = parts[0].groupBy("term").agg(F.sum("documents").alias("documents")) if kind == "vocabulary" and len(parts) > 1 else parts[0]
        return Postings(**found, n_documents=sum(s.documents for s in segments), window=self.window)
