"""Near duplicates: an exact Jaccard self-join of word shingles over size-banded tiles with bitmap signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import KEY, lean, partitions, small, small_batches, table, text_key, written
from tessera.llm.components import components
from tessera.llm.shingles import mix, shingle_sets

#: Buckets of the counts that order shingles, rarest first; their table has this size whatever the input. A slice of it
#: is summed at a time.
BUCKETS, SLICE = 1 << 22, 1 << 16
#: Sets that a chunk of the first linking pass holds.
CHUNK = 256
#: Sets of a block, and shingles of all of them together, on average at most. A tile is two blocks, or one with itself.
BANDED, WEIGHT = 100, 1 << 17


def _counts(words: int):
    """(salt, slice, counts): how often each bucket occurs in a task's texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint32)
        salt = None
        for batch in batches:
            for at in range(0, len(batch), 512):
                sets = list(shingle_sets(batch.column(0).slice(at, 512), words))
                s = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                if salt is None and len(s):
                    salt = int(s[0]) % SALTS
                seen = np.sort((s & np.uint64(BUCKETS - 1)).astype(np.int64))
                if len(seen):
                    new = np.flatnonzero(np.r_[True, seen[1:] != seen[:-1]])
                    counts[seen[new]] += np.diff(np.r_[new, len(seen)]).astype(np.uint32)
        if salt is not None:
            parts = [zstandard.ZstdCompressor(level=1).compress(counts[i : i + SLICE].tobytes()) for i in range(0, BUCKETS, SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array([salt] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["salt", "slice", "counts"])

    return run


#: Groups in which tasks' counts are summed first, so that no task gets the counts of all.
SALTS = 64


def _sum_counts(rows: pa.Table) -> pa.Table:
    total = np.zeros(SLICE, np.uint64)
    for data in rows["counts"].to_pylist():
        data = zstandard.ZstdDecompressor().decompress(data)
        total += np.frombuffer(data, np.uint32 if len(data) == 4 * SLICE else np.uint64)
    data = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
    return pa.table({"salt": pa.array([0], pa.int32()), "slice": pa.array([rows["slice"][0].as_py()], pa.int32()), "counts": pa.array([data], pa.binary())})


def signature_bits(longest: int) -> int:
    """Bits of the signatures of sets of up to that many shingles: a power of two, so that few shingles share a bit."""
    return min(1 << 16, max(512, 1 << int(4 * longest - 1).bit_length())) if longest else 512


def signature(s: np.ndarray, bits: int) -> np.ndarray:
    """As many bits, as words of 64: one for each shingle's hash."""
    out = np.zeros(bits, np.uint8)
    out[((s >> np.uint64(40)) % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def most_common(n: int, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bounds from above of what a set of n shingles has in common with sets of m, by signatures x and y.

    Each differing bit is a shingle that only one of the two has.
    """
    differ = np.bitwise_count(x ^ y).sum(axis=-1).astype(np.int64)
    return (n + m - np.maximum(differ, np.abs(n - m))) // 2


def prefix_length(n: int, percent: int) -> int:
    """Sets of at least that similarity share one of so many first shingles in any common order."""
    return n - (percent * n + 99) // 100 + 1


def posted_length(n: int, percent: int) -> int:
    """First shingles that are posted: half as many again, so that similar sets share several; see shared_least()."""
    p = prefix_length(n, percent)
    return min(n, p + (p + 1) // 2)


def shared_least(n: str, percent: int) -> Column:
    """How many posted shingles a set of n, a column, shares at least with any similar set.

    Of two similar sets, take the one whose posted shingles end first in the global order: all but n - ceil(percent n) of
    these are in the other set, and posted there. The bound doesn't fall with n, and a similar set has ceil(percent n)
    shingles at least.
    """
    m = f"(({percent} * {n} + 99) div 100)"
    p = f"({m} - ({percent} * {m} + 99) div 100 + 1)"
    return F.expr(f"least({m}, {p} + ({p} + 1) div 2) - {p} + 1")


_SEEDS = [np.uint64(x) for x in (0x1234567, 0x89ABCDEF1, 0xFEDCBA987, 0x13579BDF3)]


def _describe(words: int, percent: int, counts: np.ndarray):
    names = ["doc_id", "n", "class", "least", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 512
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                n, cls, least, prefix = [], [], [], []
                for s in shingle_sets(part.column(1), words):
                    n.append(len(s))
                    cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                    least.append([int(mix(s ^ seed).min().view(np.int64)) for seed in _SEEDS] if len(s) else [])
                    order = np.lexsort((s, counts[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]))
                    prefix.append(s[order[: posted_length(len(s), percent)]].view(np.int64) if len(s) else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(least, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))],
                    names,
                )

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact, on sorted arrays."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = np.intersect1d(x, y, assume_unique=True).size
    return 100 * common >= percent * (len(x) + len(y) - common)


def _neighbours(percent: int):
    """Links between rows (key, chunk, n, node, shingles) that stand next to each other, and to the row before that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in batches:
            links = []
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for key, node, shingles in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                s = np.frombuffer(shingles, np.uint64)
                if last and last[0][0] != key:
                    last = []
                links += [(before[1], node) for before in last if before[1] != node and linked(before[2], s, percent)]
                last = [*last[-1:], (key, node, s)]
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def tile_links(n: np.ndarray, node: np.ndarray, component: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what the similar pairs of a tile connect and the components don't yet: a spanning forest.

    Rows of one side are compared with those of the other, or with each other if there is but one side. Sizes and the
    bits of signatures bound what a pair has in common from above; what passes is intersected as sorted arrays.
    """
    label = np.unique(component, return_inverse=True)[1]
    bits = signature_bits(int(n.max()))
    signatures = np.stack([signature(s, bits) for s in sets])
    whole, found = bool(side.min() == side.max()), []
    for i in range(len(n)):
        if not whole and side[i] != side.min():
            break
        ok = (label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        ok &= np.arange(len(n)) > i if whole else side != side[i]
        others = np.flatnonzero(ok)
        if not len(others):
            continue
        most = most_common(n[i], signatures[i], n[others], signatures[others])
        keep = 100 * most >= percent * (n[i] + n[others] - most)
        others = others[keep][np.argsort(-most[keep], kind="stable")]
        # The likeliest first: what a link connects needs no second one.
        for k in range(0, len(others), 16):
            some = others[k : k + 16]
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            flat = np.concatenate([sets[j] for j in some])
            at = np.minimum(np.searchsorted(sets[i], flat), n[i] - 1)
            common = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.r_[0, np.cumsum(n[some])[:-1]])
            for j in some[100 * common >= percent * (n[i] + n[some] - common)]:
                if label[j] != label[i]:
                    found.append((int(node[i]), int(node[j])))
                    label[label == label[j]] = label[i]
    return found


def _tiles(percent: int):
    """Links (a, b) of each tile, rows (tile, side, n, node, component, shingles) sorted by tile and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list[tuple]) -> list[tuple[int, int]]:
            side, n, node, component = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3, 4))
            return tile_links(n, node, component, side, [np.frombuffer(r[5], np.uint64) for r in rows], percent)

        held: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    found += links(held)
                    held = []
                held.append(row)
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if held:
            a, b = zip(*found, strict=True) if (found := links(held)) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


class Join:
    """The steps of the join over docs (doc_id, text) of distinct doc_ids; percent: the similarity, words: those of a shingle."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.words, self.percent = words, percent
        self.n = partitions(docs.sparkSession)

    def describe(self) -> DataFrame:
        counted = self.docs.select("text").mapInArrow(lean(_counts(self.words)), "salt int, slice int, counts binary")
        for key in (["salt", "slice"], ["slice"]):
            counted = counted.groupBy(*key).applyInArrow(_sum_counts, "salt int, slice int, counts binary")
        total = np.zeros(BUCKETS)
        for row in counted.collect():  # BUCKETS counts, whatever the input
            total[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["counts"]), np.uint64)
        # Steps of a fiftieth tell rare from common; within a step the hash decides.
        counts = np.minimum(np.log1p(total) * 50, 65535).astype(np.uint16)
        schema = "doc_id long, n long, class binary, least array<long>, prefix array<long>"
        return written(self.docs.mapInArrow(lean(_describe(self.words, self.percent, counts)), schema), "sets")

    def shingles(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of the nodes: their sorted sets, read from their texts again."""
        words = self.words
        texts = self.docs.join(small(nodes), self.docs["doc_id"] == nodes["node"]).select("node", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part = batch.slice(at, 256)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), words)], pa.binary())], ["node", "shingles"])

        return texts.mapInArrow(lean(run), "node long, shingles binary")

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) for every row of docs with a doc_id."""
        percent = self.percent
        sets = self.describe()
        classes = written(sets.groupBy("class").agg(F.min("doc_id").alias("node")), "classes")
        nodes = sets.where("n > 0").join(classes, "class").where("doc_id = node")
        # Posted shingles of one node alone take part in no pair. Ranges of (key, node): a very common key has several.
        posted = nodes.select("node", "n", F.explode("prefix").alias("key")).repartitionByRange(self.n, "key", "node").sortWithinPartitions("key", "node")
        shared = written(posted.mapInArrow(lean(_shared_keys), "node long, n long, key long"), "shared-keys")
        counted = shared.groupBy("node", "n").agg(F.count(F.lit(1)).alias("m"))
        members = written(counted.where(F.col("m") >= shared_least("n", percent)).select("node"), "members")
        few = written(nodes.select("node", "n", "least").join(small(members), "node", "left_semi"), "nodes")
        shingles = written(self.shingles(members), "shingles")

        # First, links between neighbours in order of size, among nodes of the same least hash.
        links = labels = None
        for k in range(len(_SEEDS)):
            rows = few.select("node", "n", F.element_at("least", k + 1).alias("key"))
            if links is not None:
                rows = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
                many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
            else:
                many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
            rows = rows.join(many, "key").withColumn("chunk", F.pmod(F.xxhash64(F.lit(k), "node"), F.ceil(F.col("m") / CHUNK)).cast("int"))
            rows = written(rows.select("node", "n", "key", "chunk"), "neighbours")
            ordered = shingles.join(small(rows), "node").select("key", "chunk", "n", "node", "shingles")
            ordered = ordered.repartition(self.n, "key", "chunk").sortWithinPartitions("key", "chunk", "n", "node")
            found = written(ordered.mapInArrow(lean(_neighbours(percent)), "a long, b long"), "links")
            links = found if links is None else links.unionByName(found)
            labels = written(components(links), "components")

        # Then every pair of nodes that share a prefix shingle and aren't connected yet.
        links = links.unionByName(written(self.tiled(shared, few, labels, shingles), "links"))
        labels = written(components(links), "components")
        return (
            sets.select("doc_id", "n", "class").join(classes, "class").join(labels, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "node")).alias("component_id"))
        )

    def blocks(self, rows: DataFrame) -> DataFrame:
        """(node, n, component, block<cluster, band, own, component, part>) of rows (key, m, node, n, component).

        A node's cluster is the most common of its keys, so that nodes of many keys in common stand together. A cluster of
        more than BANDED nodes is dealt out by bands of size: similar sets stand in one band or in two that touch. A
        component that fills a block has blocks of its own in each band.
        """
        nodes = rows.groupBy("node", "n", "component").agg(F.max(F.struct("m", "key"))["key"].alias("cluster"))
        width = float(np.log(100 / self.percent)) * 1.0001
        nodes = nodes.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int"))
        nodes = written(nodes, "clusters")
        sizes = nodes.groupBy("cluster", "band", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
        sizes = written(sizes.withColumn("own", F.col("c") >= BANDED), "cluster-sizes")
        home = F.when(F.col("own"), F.col("component"))
        bands = sizes.groupBy("cluster", "band", "own", home.alias("home")).agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
        whole = sizes.groupBy("cluster").agg(F.sum("c").alias("all_c"), F.sum("s").alias("all_s")).where((F.col("all_c") > BANDED) | (F.col("all_s") > WEIGHT))
        bands = bands.join(whole, "cluster").withColumn("parts", F.greatest(F.ceil(F.col("c") / BANDED), F.ceil(F.col("s") / WEIGHT)))
        bands = bands.select("cluster", "band", "own", F.col("home").alias("of"), "parts")
        dealt = nodes.join(sizes.select("cluster", "band", "component", "own"), ["cluster", "band", "component"]).withColumn("home", home)
        dealt = dealt.join(bands.withColumnsRenamed({"cluster": "c2", "band": "b2", "own": "o2"}), F.expr("cluster = c2 AND band = b2 AND own = o2 AND home <=> of"), "left")
        part = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("parts")).cast("int")
        many = F.struct("cluster", "band", "own", F.col("home").alias("component"), part.alias("part"))
        one = F.struct("cluster", F.lit(0).alias("band"), F.lit(False).alias("own"), F.lit(None).cast("long").alias("component"), F.lit(0).alias("part"))
        return written(dealt.select("node", "n", "component", F.when(F.col("parts").isNull(), one).otherwise(many).alias("block")), "blocks")

    def tiled(self, shared: DataFrame, few: DataFrame, labels: DataFrame, shingles: DataFrame) -> DataFrame:
        """Links (a, b) that join what similar nodes with a prefix shingle in common leave unconnected.

        A pair stands in one tile at most, that of its two blocks. Tiles within a cluster are all those that sizes and
        components allow; those of two clusters the ones in which nodes with a key in common stand.
        """
        percent = self.percent
        known = few.select("node", "n").join(labels, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
        rows = shared.select("key", "node").join(known, "node")
        for _ in range(3):  # what leaves in one round may leave other keys with one component
            mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi")
            rows = written(rows.select("key", "node", "n", "component").join(mixed.select("key", "m"), "key"), "mixed-keys")
            enough = rows.groupBy("node", "n").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= shared_least("n", percent))
            rows = rows.join(enough.select("node"), "node", "left_semi")
        rows = written(rows, "mixed-nodes")
        homes = self.blocks(rows)

        def summed(df: DataFrame, *by: str) -> DataFrame:
            return df.groupBy(*by).agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("component").alias("c0"), F.max("component").alias("c1"))

        def paired(df: DataFrame, by: str, order: str) -> DataFrame:
            a, b = (df.select(F.col(by).alias(f"{x}_by"), *[F.col(c).alias(f"{x}_{c}") for c in ("block", "n0", "n1", "c0", "c1")]) for x in "ab")
            apart = F.expr("least(a_c0, b_c0) < greatest(a_c1, b_c1)")
            near = F.expr(f"100 * a_n1 >= {percent} * b_n0 AND 100 * b_n1 >= {percent} * a_n0")
            return a.join(b, F.expr(f"a_by = b_by AND {order}") & apart & near).select(F.col("a_block").alias("a"), F.col("b_block").alias("b"), F.least("a_n0", "b_n0").alias("n"))

        inside = summed(homes, "block").withColumn("cluster", F.col("block.cluster"))
        across = summed(rows.select("key", "node").join(homes, "node"), "key", "block")
        several = across.groupBy("key").agg(F.min("block.cluster").alias("lo"), F.max("block.cluster").alias("hi")).where("lo < hi").select("key")
        across = written(across.join(several, "key"), "key-blocks")
        # Similar nodes share several keys, and so do their blocks.
        met = paired(across, "key", "a_block.cluster < b_block.cluster").groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("n"))
        tiles = paired(inside, "cluster", "a_block <= b_block").drop("n").unionByName(met.where(F.col("m") >= shared_least("n", percent)).drop("m", "n"))
        tiles = written(tiles.withColumn("tile", F.monotonically_increasing_id()), "tiles")
        ends = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")))).otherwise(
            F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")), F.struct(F.lit(1).alias("side"), F.col("b").alias("block")))
        )
        dealt = written(tiles.select("tile", F.inline(ends)).join(homes, "block").select("tile", "side", "n", "node", "component"), "tile-nodes")
        full = shingles.join(small(dealt), "node").select("tile", "side", "n", "node", "component", "shingles")
        full = full.repartition(self.n, "tile").sortWithinPartitions("tile", "side", "n", "node")
        return full.mapInArrow(lean(_tiles(percent)), "a long, b long")


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, n, key) sorted by key, those whose key the row before or after has too.

    The key of a partition's first or last row may go on in another partition: such rows stay.
    """
    held: pa.RecordBatch | None = None
    carried = None
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            key = np.asarray(held.column(2))
            yield held.filter(pa.array(_alike(key, key[0] if carried is None else carried, batch.column(2)[0].as_py())))
            carried = key[-1]
        held = batch
    if held is not None:
        key = np.asarray(held.column(2))
        yield held.filter(pa.array(_alike(key, key[0] if carried is None else carried, key[-1])))


def _alike(key: np.ndarray, before: int, after: int) -> np.ndarray:
    same = key[1:] == key[:-1]
    out = np.zeros(len(key), bool)
    out[1:] |= same
    out[:-1] |= same
    out[0] |= key[0] == before
    out[-1] |= key[-1] == after
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id long, text).

    A document's set holds its distinct runs of that many words (white space apart, A-Z as a-z); with fewer words, the
    whole sequence. Documents link when 100 x common >= percent x all; component_id is the smallest doc_id that links
    reach. Null, empty and blank texts have an empty set and link with nothing, copies of one set link. If a doc_id
    stands on several rows, each row has the result of its own text. A row with a null doc_id links with nothing and has
    a null component_id. An empty table gives no row; other columns play no part.

    The join is exact: similar sets share one of the first shingles in a global order, rarest first. Documents of equal
    sets are one node. Nodes are first linked along chains, so that a large group of near copies is connected before the
    exact pass, which compares only what isn't connected: in tiles of two blocks of nodes, where each pair is bounded by
    signatures, then intersected, and a spanning forest of the links goes out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known, unknown = docs.where("doc_id is not null"), docs.where("doc_id is null").select("text")
    repeated = known.groupBy("doc_id").count().where("count > 1").limit(1).count()
    with small_batches(docs.sparkSession):
        found = _of_rows(known, words, percent) if repeated else Join(known, words, percent).run()
    sized = unknown.mapInArrow(_sizes(words), "n_shingles long")
    none = F.lit(None).cast("long")
    return found.unionByName(sized.select(none.alias("doc_id"), "n_shingles", none.alias("component_id")))


def _sizes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingle_sets(batch.column(0), words)], pa.int64())], ["n_shingles"])

    return run


def _of_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """near_duplicates() where doc_ids stand on several rows: each distinct (doc_id, text) joins under a number of its own."""
    rows = written(docs.select("doc_id", *text_key(F.col("text")), "text").withColumn("row", F.monotonically_increasing_id()), "rows")
    keys = written(rows.groupBy(*KEY).agg(F.min("row").alias("first")), "keys")
    more = rows.join(keys, KEY).where("row > first").select("row")
    distinct = written(rows.join(small(written(more, "repeats")), "row", "left_anti").select(F.col("row").alias("doc_id"), "text"), "distinct")
    found = written(Join(distinct, words, percent).run().toDF("first", "n_shingles", "component"), "found").join(keys, "first")
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    result = found.join(least, "component").select(*KEY, "n_shingles", "component_id")
    return rows.select(*KEY).join(result, KEY).select("doc_id", "n_shingles", "component_id")


def op5_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4, 85)
