"""Suffix-array dedup: repeated strings found by sorting suffixes, exchanged as front-coded runs and merged by loser trees.

Every string of `length` bytes holds the start of its least GRAM-byte hash (an anchor), and equal strings have it at the
same place. So only suffixes at anchors are sorted: an anchor with what stands around it tells all strings whose anchor
it is. Anchors whose gram stands in one document alone are left out before anything is sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import partitions, table, text_key, written
from tessera.llm.shingles import Powers, mix

GRAM = 20
#: Low bits of a gram's hash that aren't compared; that two grams share the others costs a little work, nothing else.
UNUSED = np.uint64(21)
HASH = ~((np.uint64(1) << UNUSED) - np.uint64(1))
#: Bytes of text in a block of documents, which one task holds at a time.
BLOCK_BYTES = 4 << 20
#: Blocks that a partition of the input can have.
BLOCKS = 2048
#: Bytes hashed at a time.
CHUNK_BYTES = 1 << 19
#: A text of so many bytes goes in pieces of PIECE bytes: places in a longer one don't fit the 24 bits that anchors() has.
LONG, PIECE = 1 << 24, 1 << 23
#: Suffixes that the driver takes the ranges' bounds from.
SAMPLE = 20_000
#: Distinct surroundings of one gram that are compared in memory; more go through an exchange of single strings.
GROUP = 20_000

_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = Powers()


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first, last) of each anchor of the texts that end at ends in data.

    first and last: the starts of the strings whose anchor it is, a range without gaps. An anchor has the least hash
    around it, so that most are small: what goes out is mixed again, and its ranges hold equally many.
    """
    n, span = len(data), length - GRAM + 1
    if n < length:
        return tuple(np.zeros(0, np.int64 if i != 1 else np.uint64) for i in range(4))
    _POWERS.to(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * _POWERS.up[:n], out=total[1:])
    h = mix((total[GRAM:] - total[:-GRAM]) * _POWERS.down[: n - GRAM + 1])
    # The place in the low bits: among equal hashes the leftmost is least.
    low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    starts = np.r_[0, ends[:-1]]
    inside = np.zeros(n + 1, np.int32)
    whole = ends - starts >= length
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(inside[: n - length + 1]))
    if not len(s):
        return tuple(np.zeros(0, np.int64 if i != 1 else np.uint64) for i in range(4))
    at = (low[s] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)])
    return at[new], mix(h[at[new]]) & HASH, s[new], s[np.r_[new[1:] - 1, len(s) - 1]]


def chunks(sizes: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about that size together; a document of that size or more is alone."""
    group, alone = np.cumsum(sizes) // size, np.flatnonzero(sizes >= size)
    cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(group)) + 1, alone, alone + 1, len(sizes)]).tolist()
    return ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def _blocks(size: int):
    """(block, doc_ids, k1, k2, texts) of rows (doc_id, _k1, _k2, text): neighbours of that many bytes in one row, texts compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * BLOCKS
        held: list[pa.RecordBatch] = []
        used = seen = 0

        def block() -> pa.RecordBatch:
            docs = pa.Table.from_batches(held).combine_chunks()
            texts = [x or b"" for x in docs.column(3).cast(pa.binary()).to_pylist()]
            packed = pack(np.array([len(x) for x in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8))
            ids = [pa.array([docs.column(i).to_pylist()], pa.list_(pa.int64())) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array([first + seen], pa.int32()), *ids, pa.array([packed], pa.binary())], ["block", "doc_ids", "k1", "k2", "texts"])

        for batch in batches:
            begin = 0
            for i, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(batch.column(3)), 0).to_pylist()):
                used += n + 64
                if used >= size and seen < BLOCKS - 1:
                    held.append(batch.slice(begin, i + 1 - begin))
                    yield block()
                    held, used, seen, begin = [], 0, seen + 1, i + 1
            if begin < len(batch):
                held.append(batch.slice(begin))
        if held:
            yield block()

    return run


class Block:
    """The documents of a block, in order of doc_id, but for later copies of equal texts."""

    def __init__(self, docs: pa.Table, later: set, length: int, bounds: tuple[int, int, int]):
        if len(docs) != 1:
            raise ValueError(f"block {docs['block'].to_pylist()[:2]} stands on {len(docs)} rows")
        sizes, data = unpack(docs["texts"][0].as_py(), np.int64, np.uint8)
        ends, data = np.cumsum(sizes).tolist(), data.tobytes()
        keys = list(zip(*(docs[c][0].as_py() for c in ("doc_ids", "k1", "k2")), strict=True))
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.keys, self.texts = [keys[i] for i in order], [data[ends[i] - sizes[i] : ends[i]] for i in order]
        self.rows = [i for i, key in enumerate(self.keys) if key not in later]
        self.ids = np.array([self.keys[i][0] for i in self.rows], np.int64)
        self.later, self.length = later, length
        self.chunk, self.long, self.piece = bounds

    def found(self) -> Iterator[tuple]:
        """(data, offset of each text, rows, anchors()) for each chunk."""
        sizes = np.array([len(self.texts[i]) for i in self.rows], np.int64)
        for a, b in chunks(sizes, min(self.chunk, self.long)):
            data = np.frombuffer(b"".join([self.texts[i] for i in self.rows[a:b]]), np.uint8)
            ends = np.cumsum(sizes[a:b])
            if b == a + 1 and len(data) >= self.long:  # one very long text: in overlapping pieces
                yield from self.pieces(data, a)
            else:
                yield data, ends, a, anchors(data, ends, self.length)

    def pieces(self, data: np.ndarray, row: int) -> Iterator[tuple]:
        """A text longer than places can tell: pieces that overlap so that every anchor is in exactly one, with all its strings."""
        for at in range(0, len(data), self.piece):
            begin = max(0, at - self.length)
            piece = data[begin : at + self.piece + 2 * self.length]
            place, h, first, last = anchors(piece, np.array([len(piece)]), self.length)
            ok = (place >= at - begin) & (place < at - begin + self.piece)
            yield data, np.array([len(data)]), row, (place[ok] + begin, h[ok], first[ok] + begin, last[ok] + begin)


def _later(side: pa.Table) -> set:
    dup = side.filter(pa.compute.equal(side["kind"], 0))
    return set(zip(dup["doc_id"].to_pylist(), dup["_k1"].to_pylist(), dup["_k2"].to_pylist(), strict=True))


def around(data: np.ndarray, ends: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """A row for each place: `length` bytes from it, the bytes before it backwards, and how many of both are in the text."""
    back = length - GRAM
    doc = np.searchsorted(ends, place, side="right")
    begin, end = np.r_[0, ends[:-1]][doc], ends[doc]
    reach = np.r_[np.arange(length), -1 - np.arange(back)]
    at = place[:, None] + reach[None]
    inside = (at >= begin[:, None]) & (at < end[:, None])
    out = np.zeros((len(place), length + back + 2), np.uint8)
    out[:, :-2] = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0)
    out[:, -2] = np.minimum(end - place, length) + 1
    out[:, -1] = np.minimum(place - begin, back) + 1
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string."""
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8)
    at = np.r_[0, np.cumsum(sizes)] + 8 * (n + 1)
    return [np.frombuffer(data[a:b], kind) for a, b, kind in zip(at[:-1].tolist(), at[1:].tolist(), kinds, strict=True)]


def coded(hashes: np.ndarray) -> bytes:
    """Sorted distinct hashes by their differences, where these are short."""
    steps = np.diff(hashes >> UNUSED)
    if len(steps) and steps.max() >= 1 << 32:
        return b"r" + hashes.tobytes()
    return b"d" + hashes[:1].tobytes() + steps.astype(np.uint32).tobytes()


def decoded(data: bytes) -> np.ndarray:
    if data[:1] == b"r":
        return np.frombuffer(data, np.uint64, offset=1)
    first, steps = np.frombuffer(data, np.uint64, 1, 1), np.frombuffer(data, np.uint32, offset=9)
    return np.cumsum(np.r_[first >> UNUSED, steps.astype(np.uint64)], dtype=np.uint64) << UNUSED


class Run:
    """A sorted run of front-coded strings; take() gives the next one, and how much of it the one before had."""

    def __init__(self, lcp: np.ndarray, rest: np.ndarray, width: int):
        self.lcp, self.rest, self.width = lcp.tolist(), rest.tobytes(), width
        self.at, self.place, self.text = -1, 0, b""

    def take(self) -> bool:
        self.at += 1
        if self.at >= len(self.lcp):
            return False
        known = self.lcp[self.at]
        end = self.place + self.width - known
        self.text = self.text[:known] + self.rest[self.place : end]
        self.place = end
        return True


class LoserTree:
    """Merges runs. Each head knows how many bytes it has in common with the last winner, and only what follows is compared."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.width = max((r.width for r in runs), default=0)
        # Bytes in common with the last winner; -1 when the run is over.
        self.known = [0 if r.take() else -1 for r in runs]
        n = len(runs)
        self.tree = [-1] * max(1, n)
        self.top = -1
        for i in range(n):
            self.enter(i)

    def enter(self, run: int) -> None:
        """First round: a run waits in the first empty node on its way up."""
        node = (run + len(self.runs)) // 2
        while node:
            if self.tree[node] < 0:
                self.tree[node] = run
                return
            run = self.play(node, run)
            node //= 2
        self.top = run

    def play(self, node: int, run: int) -> int:
        """The winner of the run against the one that waits at node; the loser waits."""
        other, known, runs = self.tree[node], self.known, self.runs
        a, b = known[run], known[other]
        if a == b:
            if a < 0:
                return run
            s, t = runs[run].text, runs[other].text
            x, y = s[a:], t[a:]
            if x == y:
                known[other] = self.width
                return run
            same = a + (8 * len(x) - (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()) // 8
            if x < y:
                known[other] = same
                return run
            known[run] = same
            self.tree[node] = run
            return other
        if a > b:
            return run
        self.tree[node] = run
        return other

    def __iter__(self) -> Iterator[tuple[int, int, bytes, int]]:
        """(run, place in the run, string, bytes in common with the string before)."""
        n, runs, known = len(self.runs), self.runs, self.known
        while self.top >= 0 and known[self.top] >= 0:
            i = self.top
            run = runs[i]
            yield i, run.at, run.text, known[i]
            if run.take():
                known[i] = run.lcp[run.at]
            else:
                known[i] = -1
            node = (i + n) // 2
            while node:
                i = self.play(node, i)
                node //= 2
            self.top = i


def strings_of(entry: bytes, first: int, last: int, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset of the anchor in it, the string written from its anchor on and then backwards) for its strings."""
    return ((o, entry[: length - o] + entry[length : length + o]) for o in range(first, last + 1))


class Removal:
    """dedup over docs; see dedup_suffixes()."""

    def __init__(self, docs: DataFrame, length: int, bounds: tuple[int, int, int] | None = None):
        self.spark, self.length, self.bounds = docs.sparkSession, length, bounds or (CHUNK_BYTES, LONG, PIECE)
        self.n = partitions(self.spark)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")), "text")
        # Texts are dealt to blocks where they stand, and go from step to step compressed.
        blocks = self.docs.where("doc_id is not null").mapInArrow(_blocks(BLOCK_BYTES), "block int, doc_ids array<long>, k1 array<long>, k2 array<long>, texts binary")
        # Not compacted: a task's partition is what makes its blocks' numbers its own.
        self.live = written(blocks, "blocks", "none", False)
        self.blocks = max(1, self.live.count())
        known = self.live.select("block", F.inline(F.arrays_zip("doc_ids", "k1", "k2"))).toDF("block", "doc_id", "_k1", "_k2")
        firsts = known.groupBy("_k1", "_k2").agg(F.min("doc_id").alias("first"))
        later = known.join(firsts, ["_k1", "_k2"]).where("doc_id > first").select("block", "doc_id", "_k1", "_k2").distinct()
        none = [F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("data")]
        self.later = written(later.select("block", F.lit(0).alias("kind"), "doc_id", "_k1", "_k2", *none), "later-copies")
        self.buckets = 1 << max(4, int(np.ceil(np.log2(self.n))))

    def with_side(self, side: DataFrame, run, schema: str) -> DataFrame:
        """run(the row of a block, rows of side) for each block."""
        return self.live.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(run, schema)

    def shared_grams(self) -> tuple[DataFrame, list[bytes]]:
        """Rows (block, bucket, bits): which of the block's gram hashes stand in other documents too; and a sample of suffixes."""
        length, bounds, buckets, each = self.length, self.bounds, self.buckets, max(1, SAMPLE // self.blocks)
        shift = np.uint64(64 - (buckets.bit_length() - 1))

        def run(docs: pa.Table, side: pa.Table) -> pa.Table:
            block = Block(docs, _later(side), length, bounds)
            hashes, owners, samples = [], [], []
            for data, ends, row, (place, h, _, _) in block.found():
                hashes.append(h)
                owners.append(block.ids[row + np.searchsorted(ends, place, side="right")])
                some = place[np.argsort(mix(h ^ np.uint64(99)))[: max(1, each // 4)]]
                samples += [x.tobytes() for x in around(data, ends, some, length)]
            rows = {"bucket": [], "block": [], "data": [], "many": []}
            name = docs["block"][0].as_py()
            if hashes:
                h, owner = np.concatenate(hashes), np.concatenate(owners)
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                if len(h):
                    many = np.maximum.reduceat(owner, new) > np.minimum.reduceat(owner, new)
                    h = h[new]
                    cuts = np.searchsorted(h >> shift, np.arange(buckets + 1, dtype=np.uint64))
                    for b in range(buckets):
                        x, m = h[cuts[b] : cuts[b + 1]], many[cuts[b] : cuts[b + 1]]
                        if len(x):
                            rows["bucket"].append(b)
                            rows["block"].append(name)
                            rows["data"].append(coded(x))
                            rows["many"].append(np.packbits(m).tobytes())
            for s in samples[:each]:
                rows["bucket"].append(-1)
                rows["block"].append(name)
                rows["data"].append(s)
                rows["many"].append(b"")
            return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "block": pa.array(rows["block"], pa.int32()), "data": pa.array(rows["data"], pa.binary()), "many": pa.array(rows["many"], pa.binary())})

        def settle(rows: pa.Table) -> pa.Table:
            names = rows["block"].to_pylist()
            lists = [decoded(x) for x in rows["data"].to_pylist()]
            flags = [np.unpackbits(np.frombuffer(m, np.uint8))[: len(x)] for m, x in zip(rows["many"].to_pylist(), lists, strict=True)]
            h = np.concatenate(lists)
            unique, where, count = np.unique(h, return_inverse=True, return_counts=True)
            shared = count > 1
            shared[where[np.concatenate(flags).astype(bool)]] = True
            bits = [np.packbits(x).tobytes() for x in np.split(shared[where], np.cumsum([len(x) for x in lists])[:-1])]
            return pa.table({"block": pa.array(names, pa.int32()), "kind": pa.array([1] * len(names), pa.int32()), "bucket": pa.array([rows["bucket"][0].as_py()] * len(names), pa.int32()), "data": pa.array(bits, pa.binary())})

        grams = written(self.with_side(self.later, run, "bucket int, block int, data binary, many binary"), "grams", "zstd")
        sample = [bytes(r[0]) for r in grams.where("bucket < 0").select("data").orderBy(F.xxhash64("data")).limit(SAMPLE).collect()]
        bits = grams.where("bucket >= 0").groupBy("bucket").applyInArrow(settle, "block int, kind int, bucket int, data binary")
        return written(bits, "shared-grams"), sorted(sample)

    def removals(self, shared: DataFrame, sample: list[bytes]) -> DataFrame:
        """(block, row, start, end): bytes to remove, of the row-th document of its block."""
        length, sizes, buckets, n = self.length, self.bounds, self.buckets, self.n
        shift = np.uint64(64 - (buckets.bit_length() - 1))
        bounds = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []
        width = 2 * length - GRAM + 2
        cut = {b[:GRAM] for b in bounds}

        def runs(docs: pa.Table, side: pa.Table) -> pa.Table:
            name = docs["block"][0].as_py()
            block = Block(docs, _later(side), length, sizes)
            bits = side.filter(pa.compute.equal(side["kind"], 1))
            shared = {b: np.unpackbits(np.frombuffer(x, np.uint8)) for b, x in zip(bits["bucket"].to_pylist(), bits["data"].to_pylist(), strict=True)}
            kept, hashes = [], []
            for data, ends, row, (place, h, first, last) in block.found():
                hashes.append(h)
                kept.append((data, ends, row, place, first, last, h))
            out = {"part": [], "kind": [], "data": []}
            if hashes and sum(map(len, hashes)):
                unique = np.unique(np.concatenate(hashes))
                cuts = np.searchsorted(unique >> shift, np.arange(buckets + 1, dtype=np.uint64))
                wanted = np.zeros(len(unique), bool)
                for b, x in shared.items():
                    wanted[cuts[b] : cuts[b + 1]] = x[: cuts[b + 1] - cuts[b]]
                unique = unique[wanted]
                parts = []
                for data, ends, row, place, first, last, h in kept:
                    i = np.searchsorted(unique, h)
                    ok = (i < len(unique)) & (unique[np.minimum(i, len(unique) - 1)] == h) if len(unique) else np.zeros(len(h), bool)
                    if ok.any():
                        p = place[ok]
                        doc = np.searchsorted(ends, p, side="right")
                        begin = np.r_[0, ends[:-1]][doc]
                        parts.append((around(data, ends, p, length), row + doc, p - begin, p - last[ok], p - first[ok]))
                del kept
                if parts:
                    text, row, place, near, far = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.argsort(np.ascontiguousarray(text).view(f"S{width}").ravel(), kind="stable")
                    text, row, place, near, far = (x[order] for x in (text, row, place, near, far))
                    differ = text[1:] != text[:-1]
                    new = np.flatnonzero(np.r_[True, differ.any(axis=1)])
                    owner = block.ids[row]
                    least = np.minimum.reduceat(owner, new)
                    group = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(text)]))
                    gone = owner > least[group]
                    # Within the block a smaller document has the same surroundings: nothing else need be known.
                    out["part"].append(name % n)
                    out["kind"].append(1)
                    out["data"].append(pack(row[gone].astype(np.uint32), (place - far)[gone].astype(np.uint32), (place - near + length)[gone].astype(np.uint32)))
                    stay = ~gone
                    members = np.bincount(group[stay], minlength=len(new)).astype(np.uint32)
                    at = np.r_[0, np.cumsum(members)]
                    row, place = row[stay].astype(np.uint32), place[stay].astype(np.uint32)
                    texts, near, far = text[new], near[new].astype(np.uint8), far[new].astype(np.uint8)
                    lcp = np.r_[0, (texts[1:] != texts[:-1]).argmax(axis=1)].astype(np.uint8) if len(texts) > 1 else np.zeros(1, np.uint8)
                    keys = np.ascontiguousarray(texts).view(f"S{width}").ravel()
                    edges = np.r_[0, np.searchsorted(keys, np.array(bounds, f"S{width}"), side="left"), len(keys)] if bounds else np.array([0, len(keys)])
                    for part in range(len(edges) - 1):
                        a, b = int(edges[part]), int(edges[part + 1])
                        if a == b:
                            continue
                        common = lcp[a:b].copy()
                        common[0] = 0
                        rest = texts[a:b][np.arange(width)[None] >= common[:, None]]
                        out["part"].append(part)
                        out["kind"].append(0)
                        out["data"].append(pack(common, rest, least[a:b], members[a:b], row[at[a] : at[b]], place[at[a] : at[b]], near[a:b], far[a:b]))
            return pa.table({"part": pa.array(out["part"], pa.int32()), "kind": pa.array(out["kind"], pa.int32()), "block": pa.array([name] * len(out["part"]), pa.int32()), "data": pa.array(out["data"], pa.binary())})

        result = "block int, row int, start int, end int, owner long, string binary"

        def merge(rows: pa.Table) -> pa.Table:
            done: list[pa.Table] = []

            def emit(block, row, start, end, owner=None, string=None) -> None:
                size = len(row)
                done.append(pa.table({"block": pa.array(np.broadcast_to(np.asarray(block, np.int32), size)), "row": pa.array(np.asarray(row, np.int32)), "start": pa.array(np.asarray(start, np.int32)), "end": pa.array(np.asarray(end, np.int32)), "owner": pa.array(owner, pa.int64()) if owner else pa.nulls(size, pa.int64()), "string": pa.array(string, pa.binary()) if string else pa.nulls(size, pa.binary())}))

            trees, facts = [], []
            for kind, name, data in zip(rows["kind"].to_pylist(), rows["block"].to_pylist(), rows["data"].to_pylist(), strict=True):
                if kind == 1:
                    emit(name, *unpack(data, np.uint32, np.uint32, np.uint32))
                    continue
                lcp, rest, least, members, row, place, near, far = unpack(data, np.uint8, np.uint8, np.int64, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8)
                trees.append(Run(lcp, rest, width))
                facts.append((name, least.tolist(), np.r_[0, np.cumsum(members)].tolist(), row, place, near.tolist(), far.tolist()))
            gone: tuple[list, list, list, list] = ([], [], [], [])
            single: tuple[list, ...] = ([], [], [], [], [], [])

            def remove(run: int, at: int, near: int, far: int) -> None:
                name, _, bounds_of, row, place, _, _ = facts[run]
                for i in range(bounds_of[at], bounds_of[at + 1]):
                    p = int(place[i])
                    for column, x in zip(gone, (name, int(row[i]), p - far, p - near + length), strict=True):
                        column.append(x)

            def alone(texts: list) -> None:
                """Strings of a gram that other partitions, or too many texts, have: they are compared by an exchange."""
                for text, run, at in texts:
                    name, least, bounds_of, row, place, near, far = facts[run]
                    for o, s in strings_of(text, near[at], far[at], length):
                        key = xxhash.xxh3_128_digest(bytes([o]) + s)
                        for i in range(bounds_of[at], bounds_of[at + 1]):
                            start = int(place[i]) - o
                            for column, x in zip(single, (name, int(row[i]), start, start + length, least[at], key), strict=True):
                                column.append(x)

            def settle(texts: list) -> None:
                """Strings that texts of one gram share; each text is (text, run, place) of its smallest document."""
                best: dict = {}
                for text, run, at in texts:
                    _, least, _, _, _, near, far = facts[run]
                    owner = least[at]
                    for key in strings_of(text, near[at], far[at], length):
                        if best.get(key, owner) >= owner:
                            best[key] = owner
                for text, run, at in texts:
                    _, least, _, _, _, near, far = facts[run]
                    owner = least[at]
                    hit = [key[0] for key in strings_of(text, near[at], far[at], length) if best[key] < owner]
                    for i, o in enumerate(hit):
                        if i == 0 or hit[i - 1] != o - 1:
                            begin = o
                        if i + 1 == len(hit) or hit[i + 1] != o + 1:
                            remove(run, at, begin, o)

            texts: list = []  # of the gram at hand: one for each distinct surroundings
            repeats: list = []  # further rows of the doc_id that such surroundings are first in
            spilled = False
            for run, at, text, common in LoserTree(trees):
                if common >= width and texts:  # equal to the one before: the larger document's strings go
                    before = texts[-1]
                    mine, theirs = facts[run][1][at], facts[before[1]][1][before[2]]
                    more, less = ((run, at), before[1:]) if mine > theirs else (before[1:], (run, at))
                    if mine == theirs:  # rows that repeat a doc_id
                        repeats.append((text, run, at))
                        continue
                    texts[-1] = (text, *less)
                    for r, a in [more, *[(r, a) for t, r, a in repeats if t == text and facts[r][1][a] > min(mine, theirs)]]:
                        remove(r, a, facts[r][5][a], facts[r][6][a])
                    repeats = [x for x in repeats if not (x[0] == text and facts[x[1]][1][x[2]] > min(mine, theirs))]
                    continue
                if common < GRAM:
                    finish = alone if spilled or texts and texts[0][0][:GRAM] in cut else settle if len(texts) > 1 else None
                    if finish:
                        finish(texts + repeats)
                    texts, repeats, spilled = [], [], False
                elif len(texts) >= GROUP:
                    # The last one may still have equals to come.
                    alone(texts + repeats)
                    texts, repeats, spilled = [], [], True
                texts.append((text, run, at))
                if len(gone[0]) > 100_000:
                    emit(*gone)
                    for c in gone:
                        c.clear()
                if len(single[0]) > 100_000:
                    emit(*single)
                    for c in single:
                        c.clear()
            if texts:
                finish = alone if spilled or texts[0][0][:GRAM] in cut else settle if len(texts) > 1 else None
                if finish:
                    finish(texts + repeats)
            if gone[0]:
                emit(*gone)
            if single[0]:
                emit(*single)
            if not done:
                emit([], [], [], [])
            return pa.concat_tables(done)

        side = self.later.unionByName(shared.select("block", "kind", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("_k1"), F.lit(None).cast("long").alias("_k2"), "bucket", "data"))
        exchanged = self.with_side(side, runs, "part int, kind int, block int, data binary")
        merged = written(exchanged.groupBy("part").applyInArrow(merge, result), "removals", "zstd")
        strings = merged.where("string is not null")
        first = strings.groupBy("string").agg(F.min("owner").alias("first"))
        more = strings.join(first, "string").where("owner > first")
        columns = ["block", "row", "start", "end"]
        return merged.where("string is null").select(*columns).unionByName(more.select(*columns))

    def apply(self, removals: DataFrame) -> DataFrame:
        length, bounds = self.length, self.bounds
        side = self.later.select("block", "kind", "doc_id", "_k1", "_k2", *[F.lit(None).cast("int").alias(c) for c in ("row", "start", "end")]).unionByName(
            removals.select("block", F.lit(1).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("doc_id", "_k1", "_k2")], "row", "start", "end")
        )

        def run(docs: pa.Table, side: pa.Table) -> pa.Table:
            block = Block(docs, _later(side), length, bounds)
            cuts = side.filter(pa.compute.equal(side["kind"], 1))
            row, start, end = (np.asarray(cuts[c]) for c in ("row", "start", "end"))
            order = np.lexsort((start, row))
            row, start, end = row[order], start[order], end[order]
            spans: dict[int, list[tuple[int, int]]] = {}
            edges = np.r_[np.flatnonzero(np.r_[True, row[1:] != row[:-1]]), len(row)] if len(row) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                s, top = start[a:b], np.maximum.accumulate(end[a:b])
                new = np.flatnonzero(np.r_[True, s[1:] > top[:-1]])
                spans[block.rows[int(row[a])]] = list(zip(s[new].tolist(), top[np.r_[new[1:] - 1, b - a - 1]].tolist(), strict=True))
            found, kept = [], []
            for i, (key, text) in enumerate(zip(block.keys, block.texts, strict=True)):
                mine = ([(0, len(text))] if len(text) >= length else []) if key in block.later else spans.get(i, [])
                found.append([{"start": a, "end": b} for a, b in mine])
                edges = [0, *(x for span in mine for x in span), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            return pa.table({"doc_id": pa.array([k[0] for k in block.keys], pa.int64()), "n_bytes": pa.array([len(t) for t in block.texts], pa.int64()), "spans": pa.array(found, _SPANS), "kept": pa.array(kept, pa.binary())})

        out = self.with_side(side, run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
        text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
        rest = self.docs.where("doc_id is null").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), text.alias("kept"))
        return out.unionByName(rest)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def dedup_suffixes(docs: DataFrame, length: int = 50, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """doc_id, n_bytes, spans array<struct<start, end>>, kept binary: each row of docs (doc_id long, text) without repeats.

    A byte goes if a string of `length` bytes (UTF-8) that covers it also starts in a document with a smaller doc_id, as
    the input stands. spans are the removed runs, in order and apart. A null text is empty. Rows that repeat a doc_id
    don't remove each other's strings; rows with a null doc_id lose nothing and remove nothing. bounds: in place of
    CHUNK_BYTES, LONG and PIECE.
    """
    removal = Removal(docs, length, bounds)
    shared, sample = removal.shared_grams()
    removals = written(removal.removals(shared, sample), "cuts")
    return removal.apply(removals)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_suffixes(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    return out.select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(rows: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple[int, int, int, str]]:
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} for distinct doc_ids, in plain Python, for tests."""
    first: dict[bytes, int] = {}
    texts = sorted((doc, (text or "").encode()) for doc, text in rows)
    for doc, text in texts:
        for i in range(len(text) - length + 1):
            first.setdefault(text[i : i + length], doc)
    out = {}
    for doc, text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if first[text[i : i + length]] < doc:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out[doc] = len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out
