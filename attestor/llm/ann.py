"""Approximate nearest neighbours: a navigable small-world graph per shard.

Rows are dealt to shards by a hash of their id.  Every shard builds a
hierarchical graph over its distinct directions, stored as flat arrays of
neighbours, and answers the queries block by block; the shards' answers are
merged.  Vectors of one direction are one node of the graph with all its rows, so
a hot vector costs no more than another.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component take no part, nor do rows without an id.  Rows of one id count once
(the first vector in byte order).  Vectors of different dimension are never
compared.  Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import kernels

#: Least and most rows of a shard, in expectation; between them a table has SHARDS shards.  Most bytes of its vectors.
SHARD_ROWS, MOST_ROWS, SHARDS, SHARD_BYTES = 4096, 1 << 16, 256, 64 << 20
#: Queries of a block, in expectation, and blocks that one copy of a graph serves.
QUERY_ROWS, BLOCKS = 512, 256
LINKS, BREADTH_BUILD, BREADTH_SEARCH = 12, 80, 96


class Graph:
    """The graph over unit vectors x; links[level] is (nodes, width), -1 for none."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        height = (-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(LINKS)).astype(int)
        self.links = [np.full((n, LINKS * (2 if level == 0 else 1)), -1, np.int32) for level in range(int(height.max(initial=0)) + 1)]
        self.seen = np.zeros(n, np.int64)
        self.stamp = 0
        self.entry, self.top = 0, int(height[0]) if n else 0
        for node in range(1, n):
            self._insert(node, int(height[node]))

    @classmethod
    def restored(cls, x: np.ndarray, links: list[np.ndarray], entry: int, top: int) -> Graph:
        graph = cls(x[:0])
        graph.x, graph.links, graph.entry, graph.top, graph.seen = x, links, entry, top, np.zeros(len(x), np.int64)
        return graph

    def _search(self, q: np.ndarray, entries: list[tuple[float, int]], breadth: int, level: int) -> list[tuple[float, int]]:
        """The nearest nodes found on a level, as (likeness, node), best first."""
        self.stamp += 1
        stamp, seen, x, links = self.stamp, self.seen, self.x, self.links[level]
        best = list(entries)
        heapq.heapify(best)
        todo = [(-s, i) for s, i in entries]
        heapq.heapify(todo)
        for _, i in entries:
            seen[i] = stamp
        while todo:
            like, node = heapq.heappop(todo)
            if -like < best[0][0] and len(best) >= breadth:
                break
            near = links[node]
            near = near[near >= 0]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            likes = x[near] @ q
            if len(best) >= breadth:
                good = likes > best[0][0]
                near, likes = near[good], likes[good]
            for s, i in zip(likes.tolist(), near.tolist(), strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (s, i))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, i))
                else:
                    continue
                heapq.heappush(todo, (-s, i))
        return sorted(best, reverse=True)

    def _choose(self, nodes: np.ndarray, likes: np.ndarray, count: int) -> np.ndarray:
        """Neighbours that are closer to the node than to one another, then the rest by likeness."""
        if len(nodes) <= count:
            return nodes
        between = self.x[nodes] @ self.x[nodes].T
        taken, left = [], []
        worst = np.full(len(nodes), -np.inf)
        for i in range(len(nodes)):
            if likes[i] > worst[i]:
                taken.append(i)
                np.maximum(worst, between[i], out=worst)
                if len(taken) == count:
                    break
            else:
                left.append(i)
        return nodes[(taken + left)[:count]]

    def _descend(self, q: np.ndarray, level: int) -> list[tuple[float, int]]:
        at = [(float(self.x[self.entry] @ q), self.entry)]
        for above in range(self.top, level, -1):
            at = self._search(q, at, 1, above)[:1]
        return at

    def _insert(self, node: int, height: int) -> None:
        q = self.x[node]
        at = self._descend(q, min(height, self.top))
        for level in range(min(height, self.top), -1, -1):
            at = self._search(q, at, BREADTH_BUILD, level)
            nodes, likes = np.array([i for _, i in at]), np.array([s for s, _ in at])
            table = self.links[level]
            chosen = self._choose(nodes, likes, LINKS)
            table[node, : len(chosen)] = chosen
            for other in chosen.tolist():
                row = table[other]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                else:
                    group = np.append(row, node)
                    likes = self.x[group] @ self.x[other]
                    order = np.argsort(-likes, kind="stable")
                    table[other] = self._choose(group[order], likes[order], len(row))
        if height > self.top:
            self.entry, self.top = node, height

    def nearest(self, q: np.ndarray, breadth: int = BREADTH_SEARCH) -> list[int]:
        return [i for _, i in self._search(q, self._descend(q, 0), breadth, 0)] if len(self.x) else []


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, one row for each id, in order of the ids."""
    ids = table.column("vec_id").combine_chunks().to_numpy()
    values = table.column("vector").combine_chunks()
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], x[i].tobytes())) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    ids, x = ids[order], x[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    return ids[first], x[first]


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def build(rows: pa.Table) -> bytes:
    """A shard's rows and its graph, as flat arrays.

    Vectors of one direction, to the precision of the graph, are one node.
    """
    ids, x = _matrix(rows)
    units, node = np.unique((x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32), axis=0, return_inverse=True)
    place = np.random.default_rng(3).permutation(len(units))  # nodes enter the graph in random order
    graph = Graph(units[place])
    order = np.argsort(np.argsort(place)[node.ravel()], kind="stable")
    begin = np.searchsorted(np.argsort(place)[node.ravel()][order], np.arange(len(units) + 1))
    links = {f"links{level}": part for level, part in enumerate(graph.links)}
    return _packed(ids=ids, x=x, order=order, begin=begin, units=graph.x, entry=graph.entry, top=graph.top, **links)


def opened(shard: bytes) -> tuple[Graph, dict[str, np.ndarray]]:
    """The graph of a built shard, and its rows with their norms."""
    with np.load(io.BytesIO(shard)) as part:
        stored = dict(part)
    links = [stored[f"links{level}"] for level in range(sum(c.startswith("links") for c in stored))]
    graph = Graph.restored(stored["units"], links, int(stored["entry"]), int(stored["top"]))
    return graph, stored | {"norm": np.sqrt((stored["x"] * stored["x"]).sum(axis=1))}


def answer(shard: tuple[Graph, dict[str, np.ndarray]], block: bytes, k: int) -> list[tuple[int, int, float]]:
    """(query, row, cosine) of the best k rows of an opened shard for each query of
    a block, by exact cosine of all rows of the nodes found."""
    graph, stored = shard
    with np.load(io.BytesIO(block)) as asked:
        queries, q = asked["ids"], asked["x"]
    ids, x, order, begin, norm = (stored[c] for c in ("ids", "x", "order", "begin", "norm"))
    norm_q = np.sqrt((q * q).sum(axis=1))
    out: list[tuple[int, int, float]] = []
    for i in range(len(queries)):
        rows = np.concatenate([order[begin[g] : begin[g + 1]] for g in graph.nearest((q[i] / norm_q[i]).astype(np.float32))])
        rows = rows[ids[rows] != queries[i]]
        likes = (x[rows] * q[i]).sum(axis=1) / (norm[rows] * norm_q[i])
        out += [(int(queries[i]), int(ids[rows[j]]), float(likes[j])) for j in np.lexsort((ids[rows], -likes))[:k].tolist()]
    return out


def served(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Answers of a stream in which each graph (not asked) comes before its blocks of queries."""
    shard = None
    for batch in batches:
        for asked, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not asked:
                shard = opened(payload.as_py())
                continue
            found = answer(shard, payload.as_py(), k)
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, vector and dim of the rows that take part."""
    v = F.col(vector)
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & good).select(F.col("vec_id").cast("long"), F.col(vector).cast("array<double>").alias("vector"), F.size(vector).alias("dim"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query.

    Every graph is built once and stored in the checkpoint folder; then blocks
    of queries are sent to the shards.  A task opens a graph once and answers the
    blocks that stream past it, BLOCKS at most, which bounds its time; so a graph is
    copied once for that many blocks.
    """
    seen = usable(vectors).agg(F.count("*"), F.max("dim")).first()
    rows, number, dim = seen[0], queries.count(), seen[1] or 1
    shard_rows = shard_rows or max(1, min(MOST_ROWS, max(SHARD_ROWS, rows // SHARDS), SHARD_BYTES // (12 * dim)))
    shards, blocks = max(1, -(-rows // shard_rows)), max(1, -(-number // QUERY_ROWS))
    copies = -(-blocks // BLOCKS)

    @kernels.tidied
    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from served(batches, k)

    def built(key: tuple, part: pa.Table) -> pa.Table:
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([build(part)], pa.binary())], names=["dim", "shard", "graph"])

    def gathered(key: tuple, part: pa.Table) -> pa.Table:
        ids, x = _matrix(part)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([_packed(ids=ids, x=x)], pa.binary())], names=["dim", "block", "queries"])

    dealt = usable(vectors).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    # a number of its own keeps this exchange from being coalesced: a shard's build is long for its size
    graphs = dealt.repartition(4 * shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(built, "dim int, shard int, graph binary").checkpoint()
    asked = usable(queries).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = asked.groupBy("dim", "block").applyInArrow(gathered, "dim int, block int, queries binary").checkpoint()
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    held = graphs.select("dim", "shard", every(copies).alias("copy"), F.lit(0).alias("asked"), F.lit(-1).alias("block"), F.col("graph").alias("payload"))
    sent = asked.select("dim", every(shards).alias("shard"), (F.col("block") % copies).alias("copy"), F.lit(1).alias("asked"), "block", F.col("queries").alias("payload"))
    # blocks go where a graph of their dimension is
    sent = sent.join(graphs.select("dim", "shard").checkpoint(), ["dim", "shard"], "left_semi").select(*held.columns)
    stream = held.unionByName(sent).repartition(4 * shards * copies, "dim", "shard", "copy").sortWithinPartitions("dim", "shard", "copy", "asked", "block")
    found = stream.select("asked", "payload").mapInArrow(answered, "query_id long, vec_id long, score double")
    return found.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_to_every_fiftieth(vectors: DataFrame) -> DataFrame:
    """op9: the 5 nearest rows to each row whose id is divisible by 50."""
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
