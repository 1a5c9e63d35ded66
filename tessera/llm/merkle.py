"""Merkle manifest of a table: a tree for each language and one over their roots; proofs by fractal traversal of blocks.

Nodes are numbered along their tree by ranges, and cut into aligned blocks of ARITY ** (2 * HEIGHT). A first pass folds
every block to its root and keeps the block's upper subtree; the roots are the nodes of the next, far smaller tree. A
second pass goes through each block in order and gives the authentication path of one node after another: it holds the
block's upper subtree, the lower subtree whose paths it gives (the existing one), and the one after that (the desired
one), which grows by a node for each path given. What stands above a block's root was proved before in the same manner,
and comes to the block's task as one row. So no task holds more than two lower subtrees and one upper, however many rows.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import partitions, table, written

#: Consecutive nodes that become one; the last ones of a level may be fewer.
ARITY = 8
#: Levels of a subtree; a block is two subtrees high.
HEIGHT = 2
#: Rows that offsets of partitions may have to be broadcast.
BROADCAST_ROWS = 100_000
#: Paths that a batch of results has.
BATCH_PATHS = 2000

PATH = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("siblings", T.StringType())]))


def node(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def field(value: Column) -> Column:
    """How a leaf writes a value: `-` if null, else its UTF-8 bytes' count, `:` and itself; integers in decimal."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def levels_above(n: int) -> int:
    """Levels over n nodes, until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Subtree:
    """Up to ARITY ** levels nodes and what they become, built node by node."""

    def __init__(self, levels: int):
        self.levels = levels
        self.nodes: list[list[str]] = [[] for _ in range(levels + 1)]
        self.given = 0

    def add(self, digest: str, level: int = 0) -> None:
        row = self.nodes[level]
        row.append(digest)
        if level < self.levels and len(row) % ARITY == 0:
            self.add(node(row[-ARITY:]), level + 1)

    def close(self) -> None:
        """The last run of each level may be short."""
        for level in range(self.levels):
            if rest := len(self.nodes[level]) % ARITY:
                self.add(node(self.nodes[level][-rest:]), level + 1)

    def full(self) -> bool:
        return len(self.nodes[0]) == ARITY**self.levels

    def path(self, i: int) -> list[tuple[int, str]]:
        """For each level the place of node i's ancestor in its run, and the others of the run, left to right."""
        found = []
        for level in range(self.levels):
            start, place = i // ARITY * ARITY, i % ARITY
            run = self.nodes[level][start : start + ARITY]
            found.append((place, "".join(run[:place] + run[place + 1 :])))
            i //= ARITY
        return found

    def next_path(self) -> list[tuple[int, str]] | None:
        if self.given == len(self.nodes[0]):
            return None
        self.given += 1
        return self.path(self.given - 1)


class Traversal:
    """The paths of a block's nodes, in order. top: the nodes HEIGHT levels up, from the first pass; above: the path of the root."""

    def __init__(self, levels: int, height: int, top: list[str], above: list[tuple[int, str]]):
        self.low, self.above = min(levels, height), above
        self.top = Subtree(levels - self.low)
        for digest in top:
            self.top.add(digest)
        self.top.close()
        self.existing, self.desired = Subtree(self.low), Subtree(self.low)
        self.upper: list[tuple[int, str]] = []

    def _advance(self) -> None:
        """The desired subtree takes the place of the existing one, whose paths are all given."""
        self.desired.close()
        number = self.top.given
        self.upper = [*(self.top.next_path() or []), *self.above]
        if self.desired.nodes[-1] != self.top.nodes[0][number : number + 1]:
            raise ValueError("the nodes aren't those of the first pass")
        self.existing, self.desired = self.desired, Subtree(self.low)

    def add(self, digest: str) -> list | None:
        """Takes a node and gives the next path of the existing subtree, if it has one."""
        path = self.existing.next_path()
        self.desired.add(digest)
        found = None if path is None else path + self.upper
        if self.desired.full():
            self._advance()
        return found

    def rest(self) -> Iterator[list]:
        while (path := self.existing.next_path()) is not None:
            yield path + self.upper
        if self.desired.nodes[0]:
            self._advance()
            yield from self.rest()


def _block_levels(n: int, height: int) -> int:
    """Levels in a block of a tree of n nodes: all of them if it has a single block."""
    return min(2 * height, levels_above(n))


def _fold(height: int, schema: pa.Schema) -> Callable:
    """First pass over sorted nodes: for each block its root, and the nodes of the level where the upper subtree starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, tree, low, top = None, 0, Subtree(0), Subtree(0), []
        rows: list[tuple] = []

        def end_low() -> None:
            nonlocal low
            if low.nodes[0]:
                low.close()
                top.append(low.nodes[-1][0])
                tree.add(top[-1])
                low = Subtree(low.levels)

        def end_block() -> None:
            if at is not None:
                end_low()
                tree.close()
                rows.append((*at, n, tree.nodes[-1][0], "".join(top)))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for name, block, size, digest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (name, block) != at:
                    end_block()
                    at, n, top = (name, block), size, []
                    levels = _block_levels(n, height)
                    low, tree = Subtree(min(levels, height)), Subtree(max(0, levels - height))
                low.add(digest)
                if low.full():
                    end_low()
            if len(rows) >= BATCH_PATHS:
                yield flush()
        end_block()
        if rows:
            yield flush()

    return run


def _traverse(height: int, payload: list[str], schema: pa.Schema) -> Callable:
    """Second pass: each block is a header row, with index -1, and the sorted nodes; the payload of these, root and proof."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk: Traversal | None = None
        heads: tuple = ()
        found: list[tuple] = []
        waiting: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            nonlocal waiting
            held = pa.Table.from_batches(waiting)
            out = held.slice(0, len(found)).combine_chunks()
            waiting = held.slice(len(found)).to_batches()
            paths = [p for _, p in found]
            steps = [s for p in paths for s in p]
            offsets = [0]
            for p in paths:
                offsets.append(offsets[-1] + len(p))
            kind = schema.field("proof").type
            values = pa.StructArray.from_arrays([pa.array([s[0] for s in steps], pa.int32()), pa.array([s[1] for s in steps], pa.string())], fields=list(kind.value_type))
            proof = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=kind)
            tops = [pa.array([h[k] for h, _ in found], pa.string()) for k in (0, 1)]
            found.clear()
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.columns]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            return pa.RecordBatch.from_arrays([*columns, *tops, proof], schema=schema)

        for batch in batches:
            index = batch.column("_index").to_pylist()
            digest, size, top, above = (batch.column(c).to_pylist() for c in ("_digest", "_n", "_top", "_above"))
            subroot, root = batch.column("subroot").to_pylist(), batch.column("root").to_pylist()
            kept = batch.filter(pa.compute.greater_equal(batch.column("_index"), 0)).select(payload)
            if len(kept):
                waiting.append(kept)
            for k, i in enumerate(index):
                if i < 0:
                    if walk:
                        found += [(heads, p) for p in walk.rest()]
                    heads = (subroot[k], root[k])
                    tops = [top[k][j : j + 64] for j in range(0, len(top[k]), 64)]
                    walk = Traversal(_block_levels(size[k], height), height, tops, [(a["place"], a["siblings"]) for a in above[k]])
                elif (path := walk.add(digest[k])) is not None:
                    found.append((heads, path))
                if len(found) >= BATCH_PATHS:
                    yield flush()
        if walk:
            found += [(heads, p) for p in walk.rest()]
        if found:
            yield flush()

    return run


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df, with columns _tree and _digest, plus _index, the place in its tree in the given order, and _n, the tree's nodes.

    Ranges of the order are sorted, each in a task; rows that tie stand in any order, and are spread as well.
    """
    spark = df.sparkSession
    keys = ["_tree", *order, "_digest"]
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.LongType()), T.StructField("_place", T.LongType())])
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, next_place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for name in batch.column("_tree").to_pylist():
                if name != tree:
                    tree, next_place = name, 0
                places.append(next_place)
                next_place += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int64()), pa.array(places, pa.int64())], schema=arrow)

    ranges = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *keys, "_tie")
    placed = written(ranges.sortWithinPartitions(*keys, "_tie").drop("_tie").mapInArrow(count, schema), "placed", few_files=False)
    counts = placed.groupBy("_tree", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_tree").orderBy("_part")
    # A row for each range and one more for each tree at most: no rows of the table.
    offsets = written(
        counts.select("_tree", "_part", (F.sum("_rows").over(before) - F.col("_rows")).alias("_first"), F.sum("_rows").over(Window.partitionBy("_tree")).alias("_n")), "offsets"
    )
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return placed.join(offsets, ["_tree", "_part"]).withColumn("_index", F.col("_first") + F.col("_place")).drop("_part", "_place", "_first")


def prove(nodes: DataFrame, finish: Callable[[DataFrame], DataFrame], height: int = HEIGHT) -> DataFrame:
    """The rows of nodes (_tree, _index, _n, _digest and more) with subroot, root and proof.

    finish gets the root of each tree (_tree, _digest) and returns _tree, subroot, root and proof, that root's own path.
    """
    size = ARITY ** (2 * height)
    block = F.floor(F.col("_index") / size).cast("long")
    nodes = nodes.withColumn("_block", block)
    payload = [c for c in nodes.columns if c not in ("_index", "_n", "_digest", "_block")]
    folded = T.StructType([*[nodes.schema[c] for c in ("_tree", "_block", "_n", "_digest")], T.StructField("_top", T.StringType())])
    folded = T.StructType([T.StructField(f.name, f.dataType) for f in folded])
    in_order = ["_tree", "_block", "_index"]
    slim = nodes.select("_tree", "_block", "_n", "_digest", "_index").repartition("_tree", "_block").sortWithinPartitions(*in_order)
    blocks = written(slim.select("_tree", "_block", "_n", "_digest").mapInArrow(_fold(height, to_arrow_schema(folded)), folded), "blocks")
    if blocks.where(F.col("_block") > 0).isEmpty():
        above = finish(blocks.select("_tree", "_digest")).withColumn("_block", F.lit(0).cast("long"))
        head = blocks.drop("_digest").join(above, ["_tree", "_block"])
    else:
        roots = blocks.select("_tree", F.col("_block").alias("_index"), F.ceil(F.col("_n") / size).alias("_n"), "_digest", F.col("_block").alias("_of"), F.col("_top").alias("_of_top"), F.col("_n").alias("_of_n"))
        proved = written(prove(roots, finish, height), "upper-proofs")
        head = proved.select("_tree", F.col("_of").alias("_block"), F.col("_of_n").alias("_n"), F.col("_of_top").alias("_top"), "subroot", "root", "proof")
    head = head.withColumn("_index", F.lit(-1).cast("long")).withColumnRenamed("proof", "_above")
    mixed = nodes.unionByName(head, allowMissingColumns=True).repartition("_tree", "_block").sortWithinPartitions(*in_order).drop("_block")
    schema = T.StructType([*[T.StructField(c, nodes.schema[c].dataType) for c in payload], T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()), T.StructField("proof", PATH)])
    return mixed.mapInArrow(_traverse(height, payload, to_arrow_schema(schema)), schema)


def _no_path() -> Column:
    return F.from_json(F.lit("[]"), PATH)


def manifest(docs: DataFrame, leaf: Column, tree: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """One row a document: order's column, leaf, subroot, root, proof array<struct<place int, siblings string>>, and carry's.

    A tree's leaves stand by order, nulls first, ties by their digests; the trees' roots by tree, nulls first, bytewise.
    fold() gives the root again from a leaf and a proof. Only columns that leaf, tree, order or carry name are read, so
    others may have any names. Null values are written as such. An empty table has no root and gives no row.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    leaves = docs.select(F.col(order).alias("_order"), name.alias("_tree"), leaf.alias("_digest"), *[c.alias(f"_carry_{k}") for k, c in (carry or {}).items()])
    leaves = leaves.withColumn("_leaf", F.col("_digest"))

    def top(roots: DataFrame) -> DataFrame:
        """The tree over the roots: its nodes stand by the names of theirs."""
        roots = roots.select(F.lit("").alias("_tree"), F.col("_tree").alias("_name"), "_digest", F.col("_digest").alias("_sub"))
        whole = prove(written(numbered(roots, ["_name"]), "roots"), lambda r: r.select("_tree", F.col("_digest").alias("subroot"), F.col("_digest").alias("root"), _no_path().alias("proof")), height)
        return written(whole.select(F.col("_name").alias("_tree"), F.col("_sub").alias("subroot"), "root", "proof"), "top")

    proved = prove(numbered(leaves, ["_order"]), top, height)
    return proved.select(F.col("_order").alias(order), F.col("_leaf").alias("leaf"), "subroot", "root", "proof", *[F.col(f"_carry_{k}").alias(k) for k in carry or {}])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""

    def step(digest: Column, level: Column) -> Column:
        left = level["place"] * 64
        return F.sha2(F.concat(F.substring(level["siblings"], F.lit(1), left), digest, F.substring(level["siblings"], left + 1, F.length(level["siblings"]))), 256)

    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda level: level["siblings"]), ""), 256)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")

    def leaf(text: Column) -> Column:
        return leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    tampered = leaf(F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    proved = manifest(docs, leaf(F.col("text")), carry={"tampered": F.when(chosen, tampered)})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_sql(levels: int = 7) -> str:
    """levels: of every tree, which so may have up to ARITY ** levels nodes in this check; the operator has no such bound."""

    def tree(name: str, by: str) -> list[str]:
        """Levels of the trees in {name}0 (t, i, n, h), and in {name}s0, {name}s1 and so on each node's siblings."""
        out = []
        for k in range(levels):
            run = f"PARTITION BY t, i // {ARITY} ORDER BY i ROWS BETWEEN"
            out.append(f"""{name}s{k} AS (SELECT t, i, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})""")
            out.append(f"""{name}{k + 1} AS (SELECT t, i // {ARITY} AS i, (any_value(n) + {ARITY - 1}) // {ARITY} AS n,
  CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY t, i // {ARITY})""")
        return out

    def climb(name: str, source: str, out: str) -> list[str]:
        """From source (t, i, f, p, ...), f folded and p the siblings so far, to out."""
        steps = []
        for k in range(levels):
            steps.append(f"""{out if k == levels - 1 else f'{out}{k}'} AS (SELECT c.* EXCLUDE (f, p, i), c.i // {ARITY} AS i, CASE WHEN s.n = 1 THEN f ELSE sha256(s.l || f || s.r) END AS f,
  CASE WHEN s.n = 1 THEN p ELSE p || s.l || s.r END AS p FROM {source if k == 0 else f'{out}{k - 1}'} c JOIN {name}s{k} s ON c.t = s.t AND c.i = s.i)""")
        return steps

    def value(column: str) -> str:
        return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: {bit})"
    crc = f"xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), lambda c, b: {byte}), 4294967295)"
    parts = [
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS t, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS f FROM documents)",
        "e AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d)",
        "a0 AS (SELECT t, i, n, leaf AS h FROM e)",
        *tree("a", "t"),
        f"b0 AS (SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n, h, t AS u FROM a{levels})",
        *tree("b", "t"),
        "c AS (SELECT doc_id, t, i, leaf, f, '' AS p FROM e)",
        *climb("a", "c", "low"),
        "m AS (SELECT low.doc_id, low.leaf, low.f, low.p, b0.h AS subroot, '' AS t, b0.i FROM low JOIN b0 ON low.t = b0.u)",
        *climb("b", "m", "high"),
    ]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, (SELECT h FROM b{levels}) AS root, sha256(p) AS proof_sha256, f AS folded_root, f = (SELECT h FROM b{levels}) AS verified FROM high"""
