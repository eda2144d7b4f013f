"""Exact inner-product top-k: a ball tree per shard, searched by branch and bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF = 64
NONE = np.iinfo(np.int64).max


class BallTree:
    """Balls (centre, radius) over vectors; a node's children are 2i + 1 and 2i + 2, all leaves are on one level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / LEAF))))
        order = np.arange(len(ids))
        parts = [order]
        levels = [parts]
        for _ in range(self.depth):
            split = []
            for part in parts:
                own = vectors[part]
                if len(part) > 1:
                    far = own[np.argmax(((own - own[0]) ** 2).sum(axis=1))]
                    other = own[np.argmax(((own - far) ** 2).sum(axis=1))]
                    part = part[np.argsort(own @ (far - other), kind="stable")]
                split += [part[: len(part) // 2], part[len(part) // 2 :]]
            parts = split
            levels.append(parts)
        nodes = [p for level in levels for p in level]
        self.centres = np.stack([vectors[p].mean(axis=0) if len(p) else np.zeros(vectors.shape[1]) for p in nodes])
        self.radii = np.array([np.sqrt(((vectors[p] - c) ** 2).sum(axis=1).max()) if len(p) else 0.0 for p, c in zip(nodes, self.centres)])
        self.first_leaf = len(nodes) - len(parts)
        self.leaves = [(ids[p], vectors[p]) for p in parts]

    def leaf_bounds(self, queries: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, upper bound) of the leaves that no ancestor's bound rules out, by query, highest bound first."""
        norms = np.sqrt((queries**2).sum(axis=1))
        q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        for level in range(self.depth + 1):
            bound = np.empty(len(q))
            for x in np.unique(node):  # the queries that reach a node, together
                at = np.flatnonzero(node == x)
                bound[at] = queries[q[at]] @ self.centres[x] + norms[q[at]] * self.radii[x]
            bound += 1e-6 * (1 + np.abs(bound))  # rounding must not rule out a tie
            keep = bound >= kth[q]
            q, node, bound = q[keep], node[keep], bound[keep]
            if level < self.depth:
                q, node = np.repeat(q, 2), np.stack([2 * node + 1, 2 * node + 2], axis=1).ravel()
        order = np.lexsort((-bound, q))
        return q[order], node[order] - self.first_leaf, bound[order]


class Best:
    """The k best of each query so far, by score, then id; floor holds what is known of the kth score elsewhere."""

    def __init__(self, query_ids: np.ndarray, k: int, floor: np.ndarray):
        self.query_ids, self.k = query_ids, k
        self.scores = np.full((len(query_ids), k), -np.inf)
        self.ids = np.full((len(query_ids), k), NONE)
        self.floor = floor.copy()

    @property
    def kth(self) -> np.ndarray:
        return np.maximum(self.floor, self.scores[:, -1])

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(ids == self.query_ids[rows][:, None], -np.inf, scores)
        some = (scores >= self.kth[rows][:, None]).any(axis=1)
        rows, scores = rows[some], scores[some]
        all_scores = np.concatenate([self.scores[rows], scores], axis=1)
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        top = np.lexsort((all_ids, -all_scores), axis=-1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)

    def search(self, tree: BallTree, queries: np.ndarray) -> None:
        """Each query visits its leaves from the highest bound down, till a bound is below its kth score."""
        q, leaf, bound = tree.leaf_bounds(queries, self.kth)
        if not len(q):
            return
        turn = np.arange(len(q)) - np.searchsorted(q, q)
        for t in range(int(turn.max()) + 1):
            now = np.flatnonzero(turn == t)
            now = now[bound[now] >= self.kth[q[now]]]
            if not len(now):
                break
            now = now[np.argsort(leaf[now], kind="stable")]
            for own in np.split(now, np.flatnonzero(np.diff(leaf[now])) + 1):
                ids, vectors = tree.leaves[leaf[own[0]]]
                if len(ids):
                    self.add(q[own], queries[q[own]] @ vectors.T, ids)


def arrays(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by dimension."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))
    return {int(d): (ids[sizes == d], np.stack([flat[starts[i] : starts[i] + d] for i in np.flatnonzero(sizes == d)])) for d in np.unique(sizes)}


def search_shard(batches: Iterator[pa.RecordBatch], queries: dict, k: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The k best of a shard for each query; trees of at most about rows vectors share the scores found so far."""
    best = {d: Best(ids, k, floor) for d, (ids, _, floor) in queries.items()}
    held: dict[int, list] = {}

    def flush(d: int) -> None:
        parts = held.pop(d)
        best[d].search(BallTree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])), queries[d][1])

    for batch in batches:
        for d, own in arrays(batch).items():
            if d in best:
                held.setdefault(d, []).append(own)
                if sum(len(p[0]) for p in held[d]) >= rows:
                    flush(d)
    for d in [*held]:
        flush(d)
    for b in best.values():
        q, at = np.nonzero((b.ids != NONE) & (b.scores >= b.floor[:, None]) & np.isfinite(b.scores))
        yield pa.RecordBatch.from_arrays([pa.array(b.query_ids[q]), pa.array(b.ids[q, at]), pa.array(b.scores[q, at].astype(np.int64))], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = 4096, seeds: int = 4096, tree_rows: int = 32768) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, ties to the smaller vec_id; fewer if there are fewer.

    Both have vec_id and embedding, an array of whole numbers as doubles
    (products and sums below 2^53 are exact). Each shard (partition) of vectors
    builds ball trees and searches them by branch and bound; the kth scores
    found in a first search over seeds rows are shared with all shards as lower
    bounds. Queries go out in blocks of query_block, each a pass over vectors.
    A query meets vectors of its own dimension and of another vec_id. Null,
    empty or non-finite vectors and null ids take no part; of queries that
    repeat a vec_id the least vector asks; repeated candidates each count.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0").where(whole)

    rows, asked = usable(vectors), usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n = asked.count()
    blocks = max(1, -(-n // query_block))
    found = []

    def run(df: DataFrame, own: dict) -> DataFrame:
        shared = spark.sparkContext.broadcast(own)
        return df.mapInArrow(lambda batches: search_shard(batches, shared.value, k, tree_rows), "query_id long, vec_id long, score long")

    def ranked(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    seed_rows = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(seeds)
    for block in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        by_dim = {}
        for batch in got.combine_chunks().to_batches():
            by_dim |= {d: (ids, x, np.full(len(ids), -np.inf)) for d, (ids, x) in arrays(batch).items()}
        first = ranked(run(seed_rows, by_dim)).where(F.col("rank") == k).select("query_id", "score").toArrow()
        known = dict(zip(first.column(0).to_pylist(), first.column(1).to_pylist()))
        by_dim = {d: (ids, x, np.array([known.get(i, -np.inf) for i in ids.tolist()], dtype=float)) for d, (ids, x, _) in by_dim.items()}
        found.append(run(rows, by_dim))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return ranked(out).select("query_id", "rank", "vec_id", "score")
