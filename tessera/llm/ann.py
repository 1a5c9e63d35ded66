"""Approximate nearest neighbours: balanced posting lists, boundary vectors in several of them, centroids in a graph."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import table, written

#: Vectors that centroids and the pruning ratio are fitted on at most: those of the smallest hashes of vec_id.
MAX_SAMPLE = 20_000
#: Lists, as a share of the root of the number of vectors, and at most (centroids stay in memory). So a query opens lists
#: in proportion to the root of the table's size, and the number of results to merge grows no faster.
LISTS_TO_ROOT, MAX_LISTS = 0.5, 4096
#: A vector also goes to lists whose centroid is at most (1 + BOUNDARY) times as far as the nearest one, to REPLICAS at most.
BOUNDARY, REPLICAS = 0.15, 8
#: Share of the sample's true neighbours that the ratio must find.
TARGET = 0.975
#: Vectors, and queries, that are scored together; longer lists are split.
BLOCK = 20_000
#: Scores that are in memory at a time.
SCORES = 4_000_000


def usable(vector: Column, size: int) -> Column:
    """Neither null nor of another length; all components finite, not all zero."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(x) == size) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares may overflow or vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 10, weight: float = 0.02, seed: int = 7) -> np.ndarray:
    """Spherical k-means in which a crowded cluster costs its members similarity, so that clusters even out."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    load = np.ones(k)
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 4096] @ c.T - weight * load, axis=1) for i in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=k)
        load = 0.5 * load + 0.5 * size * k / len(x)
        order = np.argsort(near, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        c[near[order][starts]] = np.add.reduceat(x[order], starts)
        for empty in np.flatnonzero(size == 0):
            c[empty] = x[rng.integers(len(x))]
        c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
    return c


@dataclass
class Graph:
    """Centroids, and for each the nearest others and a few far ones to start from."""

    centroids: np.ndarray
    edges: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, degree: int = 24, far: int = 4, seed: int = 7) -> Graph:
        k = len(centroids)
        near = np.argsort(-(centroids @ centroids.T), axis=1)[:, 1 : degree + 1]
        back = np.random.default_rng(seed).integers(0, k, (k, far))
        # A ring makes the graph connected.
        return cls(centroids, np.concatenate([near, back, (np.arange(k)[:, None] + 1) % k], axis=1))

    def search(self, q: np.ndarray, ratio: float, margin: float = 0.0, sizes: np.ndarray | None = None, least: int = 0, width: int = 16) -> np.ndarray:
        """Lists whose centroid is at most ratio times, or margin more than, as far as the nearest: best first, and width
        more steps from the best. Where their sizes together are below least, the nearest of all that reach it.
        """
        seen = np.zeros(len(self.centroids), bool)
        start = np.arange(0, len(seen), max(1, len(seen) // 8))
        seen[start] = True
        dist = np.full(len(seen), np.inf)
        dist[start] = np.sqrt(np.maximum(0, 2 - 2 * (self.centroids[start] @ q)))
        heap = [(dist[i], i) for i in start]
        heapq.heapify(heap)
        best = dist[start].min()
        steps = 0
        while heap:
            d, i = heapq.heappop(heap)
            if d > max(best * ratio, best + margin) and steps >= width:
                break
            steps += 1
            new = self.edges[i]
            new = np.unique(new[~seen[new]])
            if len(new):
                seen[new] = True
                dist[new] = np.sqrt(np.maximum(0, 2 - 2 * (self.centroids[new] @ q)))
                best = min(best, dist[new].min())
                for j in new:
                    heapq.heappush(heap, (dist[j], j))
        found = np.flatnonzero(dist <= max(best * ratio, best + margin, 1e-9))
        if sizes is not None and sizes[found].sum() < least:
            order = np.argsort(2 - 2 * (self.centroids @ q), kind="stable")
            enough = int(np.searchsorted(np.cumsum(sizes[order]), least)) + 1
            found = np.union1d(found, order[:enough])
        return found


def nearest_lists(x: np.ndarray, centroids: np.ndarray, boundary: float, replicas: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: each row's nearest list, and further ones within the boundary."""
    rows, lists = [], []
    for i in range(0, len(x), 4096):
        d = np.sqrt(np.maximum(0, 2 - 2 * (x[i : i + 4096] @ centroids.T)))
        m = min(replicas, d.shape[1])
        near = np.argpartition(d, m - 1, axis=1)[:, :m]
        dd = np.take_along_axis(d, near, 1)
        r, k = np.nonzero(dd <= dd.min(axis=1, keepdims=True) * (1 + boundary) + 1e-12)
        rows.append(r + i)
        lists.append(near[r, k])
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *lists])


def calibrate(sample: np.ndarray, graph: Graph, k: int = 5, queries: int = 200, target: float = TARGET) -> float:
    """The least ratio, in steps of 0.02, with which the lists hold the target share of the sample's k nearest."""
    rows, lists = nearest_lists(sample, graph.centroids, BOUNDARY, REPLICAS)
    member = np.zeros((len(sample), len(graph.centroids)), bool)
    member[rows, lists] = True
    step = max(1, len(sample) // queries)
    truths, probes = [], np.arange(0, len(sample), step)
    for q in probes:
        s = sample @ sample[q]
        s[q] = -2
        truths.append(np.argsort(-s, kind="stable")[: min(k, len(sample) - 1)])
    found = [np.sqrt(np.maximum(0, 2 - 2 * (graph.centroids @ sample[q]))) for q in probes]
    for ratio in np.arange(1.0, 2.0, 0.02):
        hit = total = 0
        for d, t in zip(found, truths, strict=True):
            open_lists = d <= d.min() * ratio
            hit += member[t][:, open_lists].any(axis=1).sum()
            total += len(t)
        if hit >= target * total:
            return float(ratio)
    return 2.0


@dataclass
class Index:
    postings: DataFrame
    graph: Graph
    ratio: float
    size: int
    #: What a list's centroid may always be farther than the nearest one, which may be at no distance.
    margin: float = 0.0


_POSTING = "list int, vec_id long, vector array<double>"


def build(vectors: DataFrame) -> Index | None:
    """Posting lists of every usable row of vectors (vec_id, embedding); None if there are none.

    Left out are null vectors, zero ones, those that hold null or non-finite components, those of another length than
    most of the sample, and rows with a null vec_id. Rows that repeat a vec_id and its vector count once. Centroids and
    the ratio come from MAX_SAMPLE rows at most; the lists hold all rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where("vec_id is not null and size(vector) > 0")
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return None
    size = sizes[0]["n"]
    rows = rows.where(usable(F.col("vector"), size))
    total = rows.count()
    if not total:
        return None
    sample = unit(_matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MAX_SAMPLE).select("vector").toArrow()["vector"].combine_chunks()))
    k = int(np.clip(round(LISTS_TO_ROOT * total**0.5), 1, min(MAX_LISTS, len(sample))))
    graph = Graph.of(balanced_centroids(sample, k))
    ratio = calibrate(sample, graph)
    centroids = graph.centroids
    near = np.concatenate([(sample[i : i + 4096] @ centroids.T).max(axis=1) for i in range(0, len(sample), 4096)])
    apart = np.sqrt(np.maximum(0, 2 - 2 * near))
    margin = float((ratio - 1) * np.median(apart[apart > 1e-6])) if (apart > 1e-6).any() else 0.0

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, lists = nearest_lists(unit(_matrix(batch.column(1))), centroids, BOUNDARY, REPLICAS)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), batch.column(0).take(take), batch.column(1).take(take)], ["list", "vec_id", "vector"])

    postings = rows.mapInArrow(assign, _POSTING)
    return Index(written(postings, "postings"), graph, ratio, size, margin)


def search(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by cosine among the lists it opens, but for its own vec_id.

    queries has query_id and vector. Ties go to the smaller vec_id. Fewer than k only where there are no more: a query
    opens lists of k + 1 vectors at least, and all lists if it still has too few, as where a vec_id has many vectors.
    """
    graph, ratio, margin = index.graph, index.ratio, index.margin
    # One row for each list. A vector is in REPLICAS lists at most.
    counts = index.postings.groupBy("list").agg(F.count_distinct("vec_id").alias("n")).collect()
    sizes = np.zeros(len(graph.centroids), np.int64)
    sizes[[r["list"] for r in counts]] = [r["n"] for r in counts]
    least = REPLICAS * (k + 1)

    def opened(find):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [find(q) for q in unit(_matrix(batch.column(1)))]
                take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                lists = pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int32())
                yield pa.RecordBatch.from_arrays([lists, batch.column(0).take(take), batch.column(1).take(take)], ["list", "query_id", "query"])

        return run

    def probed(some: DataFrame, find) -> DataFrame:
        return written(some.mapInArrow(opened(find), "list int, query_id long, query array<double>"), "probes")

    queries = queries.select("query_id", "vector")
    got = written(_scored(index, probed(queries, lambda q: graph.search(q, ratio, margin, sizes, least)), k), "nearest")
    full = got.where(F.col("rank") == k).select("query_id")
    short = written(queries.join(full, "query_id", "left_anti").select("query_id", "vector"), "short")
    if not short.limit(1).count():
        return got
    every = np.flatnonzero(sizes)
    more = _scored(index, probed(short, lambda q: every), k)
    return got.join(full, "query_id", "left_semi").select(*more.columns).unionByName(more)


def _scored(index: Index, probes: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query in the lists that probes (list, query_id, query) names.

    Each list is scored in blocks of a bounded size, so a vector that fills a list, being repeated, fills blocks of their own.
    """

    def in_blocks(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
        # One row for each list: a broadcast of MAX_LISTS rows at most.
        blocks = df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(f"{name}s"))
        return df.join(F.broadcast(blocks), "list").withColumn(name, F.pmod(F.xxhash64(key), F.col(f"{name}s")).cast("int")).drop(f"{name}s"), blocks

    lists, list_blocks = in_blocks(index.postings, "vec_id", "block")
    asked, asked_blocks = in_blocks(probes, "query_id", "ask")

    def every(df: DataFrame, blocks: DataFrame, name: str) -> DataFrame:
        return df.join(F.broadcast(blocks), "list").withColumn(name, F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1))).drop(f"{name}s")

    lists, asked = every(lists, asked_blocks, "ask"), every(asked, list_blocks, "block")

    def top(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            ids, names = np.asarray(right["vec_id"]), np.asarray(left["query_id"])
            raw, asked = _matrix(right["vector"].combine_chunks()), _matrix(left["query"].combine_chunks())
            if len(np.unique(ids)) < len(ids):  # rows that repeat a vec_id and its vector stand in one block
                once = np.unique(np.column_stack([ids.view(np.float64), raw]).view(np.int64), axis=0, return_index=True)[1]
                ids, raw = ids[once], raw[once]
            x = unit(raw)
            n = min(k + 1, len(ids))
            step = max(1, SCORES // len(ids))
            for at in range(0, len(names), step):
                q, name = asked[at : at + step], names[at : at + step]
                s = unit(q) @ x.T
                s[name[:, None] == ids[None]] = -3
                least = np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n]
                r, c = np.nonzero(s >= np.maximum(least, -2)[:, None] - 1e-9)
                exact = cosine(raw[c], q[r])
                order = np.lexsort((ids[c], -exact, r))
                r, c, exact = r[order], c[order], exact[order]
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
                rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
                best = rank < k
                out.append((name[r[best]], ids[c[best]], exact[best]))
        q, v, s = (np.concatenate(column) for column in zip(*out, strict=True))
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    key = ["list", "block", "ask"]
    found = asked.groupBy(*key).cogroup(lists.groupBy(*key)).applyInArrow(top, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, summed component by component, so that equal vectors have equal scores wherever they stand."""
    dot, norm, own = (np.zeros(len(x)) for _ in range(3))
    for j in range(x.shape[1]):
        dot += x[:, j] * q[:, j]
        norm += x[:, j] * x[:, j]
        own += q[:, j] * q[:, j]
    return dot / (np.sqrt(norm) * np.sqrt(own))


def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = build(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return search(index, queries.where(usable(F.col("vector"), index.size)), 5)
