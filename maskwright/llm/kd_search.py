"""Exact top-k search by integer inner product, with a KD-tree for each shard.

Vectors are dealt to shards by row, so that shards are even whatever is common among them. A shard's tree splits at the
median of its widest side and keeps a tight bounding box for every node. The largest inner product of a query with any point
of a box is the sum over dimensions of the larger of its products with the two sides; nodes are visited best bound first and
the search stops when no bound reaches the kth score found.

Each query is first searched in the shard that holds it. Its kth score goes along to all other shards, where whole trees are
then passed over if the bound of their root is below it, and only rows that can still count come back. A task reads a shard's
vectors, builds its tree once, and lets the stated queries stream past it in batches: memory follows the shard, not the
queries. Nothing goes through the driver but two counts.

Defined results: scores are equal to brute force, ties go to the smaller id (null last). Vectors that are null or hold a null or
non-finite component take no part; a vector without components scores 0 with others of its kind; vectors of different dimension
are not compared; components are taken as floor(scale * x). Sums are taken in doubles where these are exact, else in whole
numbers of any size; a score beyond 64 bits is the nearest that fits. Repeated rows are candidates (and queries) each; other
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import materialize

K, SCALE, LEAF, SHARD_ROWS, QUERIES_AT_ONCE = 5, 256, 32, 16384, 512
#: Whole numbers up to here are exact in doubles; scores have 64 bits.
EXACT, LOWEST, HIGHEST = float(1 << 53), -(1 << 63), (1 << 63) - 1
POINT = "shard int, kind int, row long, id long, dim int, v binary, kth long"
FOUND = "shard int, row long, id long, dim int, v binary, ids array<long>, scores array<long>"


class Tree:
    """KD-tree over integer vectors (held as doubles). Null ids are where ``none`` is true."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, none: np.ndarray | None = None, leaf: int = LEAF):
        none = np.zeros(len(ids), bool) if none is None else none
        self.most = float(np.abs(points).max(initial=0.0))
        order = np.arange(len(points))
        low, high, span, kids = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            i, j, parent = todo.pop()
            own = points[order[i:j]]
            lo, hi = own.min(0), own.max(0)
            k = len(span)
            if parent >= 0:
                kids[parent].append(k)
            low.append(lo), high.append(hi), span.append((i, j)), kids.append([])
            side = int((hi / 2 - lo / 2).argmax()) if len(lo) else -1
            if j - i > leaf and side >= 0 and hi[side] > lo[side]:
                mid = (j - i) // 2
                order[i:j] = order[i:j][np.argpartition(own[:, side], mid)]
                todo += [(i, i + mid, k), (i + mid, j, k)]
        self.low, self.high, self.span, self.kids = np.array(low), np.array(high), span, kids
        self.points, self.ids, self.rows, self.none = points[order], ids[order], rows[order], none[order]

    def exact(self, query: np.ndarray) -> bool:
        """Whether all sums of products with the query are exact in doubles."""
        return float(np.abs(query).max(initial=0.0)) * self.most * max(1, len(query)) < EXACT

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most a point of each node's box can score with each query; where sums round, with room for that."""
        with np.errstate(over="ignore", invalid="ignore"):
            out = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
            rough = [k for k, q in enumerate(queries) if not self.exact(q)]
            if rough:
                size = np.abs(queries[rough]) @ np.maximum(np.abs(self.low), np.abs(self.high)).T
                out[rough] = np.nan_to_num(out[rough] + size * (4 * len(queries[0]) + 4) * 2.0**-52, nan=np.inf, posinf=np.inf)
        return out

    def _scores(self, i: int, j: int, query: np.ndarray, whole: list[int] | None) -> np.ndarray:
        if whole is None:
            return (self.points[i:j] @ query).astype(np.int64)
        sums = (sum(int(a) * b for a, b in zip(p, whole)) for p in self.points[i:j].tolist())
        return np.array([min(max(s, LOWEST), HIGHEST) for s in sums], np.int64)

    def search(self, query: np.ndarray, bounds: np.ndarray, row: int, k: int, least: int | None) -> tuple[list[int | None], list[int]]:
        """Ids and scores of the best k points other than the query's row, of those that reach ``least``."""
        whole = None if self.exact(query) else [int(x) for x in query.tolist()]
        least = LOWEST if least is None else least
        at, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = lambda: np.lexsort((self.ids[at], self.none[at], -scores.astype(object) if whole else -scores))
        heap = [(-bounds[0], 0)]
        while heap and min(-heap[0][0], HIGHEST) >= least:
            node = heapq.heappop(heap)[1]
            if self.kids[node]:
                for c in self.kids[node]:
                    if min(bounds[c], HIGHEST) >= least:
                        heapq.heappush(heap, (-bounds[c], c))
                continue
            i, j = self.span[node]
            s = self._scores(i, j, query, whole)
            on = np.flatnonzero((s >= least) & (self.rows[i:j] != row))
            if len(on):
                at, scores = np.concatenate([at, on + i]), np.concatenate([scores, s[on]])
                if len(at) > k:
                    best = order()[:k]
                    at, scores = at[best], scores[best]
                if len(at) == k:
                    least = max(least, int(scores.min()))
        best = order()
        return [None if self.none[p] else int(self.ids[p]) for p in at[best]], scores[best].tolist()


def vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Usable rows as row, id, dim, v (whole components as little-endian 32-bit integers, or doubles where they do not fit), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, dims, out = [], [], []
            for k, x in enumerate(b.column("x")):
                if not x.is_valid or x.values.null_count:
                    continue
                a = x.values.to_numpy(zero_copy_only=False).astype(float)
                if np.isfinite(a).all():
                    with np.errstate(over="ignore"):
                        a = np.nan_to_num(np.floor(a * scale))  # the largest double at most
                    keep.append(k), dims.append(len(a)), out.append(a.astype("<i4" if np.abs(a).max(initial=0.0) < 1 << 31 else "<f8").tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row").take(at), b.column("id").take(at), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["row", "id", "dim", "v"])

    read = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    return materialize(read.filter("x is not null").mapInArrow(run, "row long, id long, dim int, v binary"), "vectors")


def _matrix(v: list[bytes], dim: int) -> np.ndarray:
    return np.array([np.frombuffer(x, "<i4" if len(x) == 4 * dim else "<f8") for x in v], float).reshape(len(v), dim)


def _trees(parts: list[pa.RecordBatch]) -> dict[int, Tree]:
    """A tree for each dimension of a shard's vectors."""
    t = pa.Table.from_batches(parts)
    dims = np.asarray(t.column("dim"))
    out = {}
    for dim in np.unique(dims).tolist():
        own = t.filter(pa.array(dims == dim))
        ids = own.column("id").combine_chunks()
        out[dim] = Tree(_matrix(own.column("v").to_pylist(), dim), np.asarray(ids.fill_null(0)), np.asarray(own.column("row")), np.asarray(ids.is_null()))
    return out


def _search(k: int, with_vectors: bool):
    """Batches in order of shard, vectors (kind 0) before queries (kind 1): the best of each query in its shard."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def found(trees: dict[int, Tree], b: pa.RecordBatch) -> pa.RecordBatch:
        rows, out = b.to_pylist(), []
        for dim in {r["dim"] for r in rows} & set(trees):
            own, tree = [r for r in rows if r["dim"] == dim], trees[dim]
            x = _matrix([r["v"] for r in own], dim)
            bounds = tree.bounds(x)
            for q, b_, r in zip(x, bounds, own):
                ids, scores = tree.search(q, b_, r["row"], k, r["kth"])
                if ids or with_vectors:
                    out.append((r["shard"], r["row"], r["id"], dim, r["v"] if with_vectors else None, ids, scores))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [()] * len(names), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, trees = None, [], {}
        for b in batches:
            place = np.asarray(b.column("shard")).astype(np.int64) * 2 + np.asarray(b.column("kind"))
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if place[i] // 2 != shard:
                    shard, parts, trees = place[i] // 2, [], {}
                if place[i] % 2 == 0:
                    parts.append(b.slice(i, j - i))
                    continue
                if parts:
                    trees, parts = _trees(parts), []
                for at in range(i, j, QUERIES_AT_ONCE):
                    yield found(trees, b.slice(at, min(QUERIES_AT_ONCE, j - at)))

    return run


def _searched(points: DataFrame, queries: DataFrame, shards: int, k: int, with_vectors: bool) -> DataFrame:
    cols = [x.split()[0] for x in POINT.split(", ")]
    both = points.withColumns({"kind": F.lit(0), "kth": F.lit(None).cast("long")}).select(cols).unionByName(queries.withColumn("kind", F.lit(1)).select(cols))
    return both.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_search(k, with_vectors), FOUND)


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k best rows for each query row: query_id, rank (from 1), vec_id, score. ``is_query`` is a condition on ``id``."""
    all_ = vectors(df, id_col, vector_col, scale)
    n = all_.count()
    shards = max(1, -(-n // shard_rows), min(32, n // 128))
    dealt = all_.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    home = materialize(_searched(dealt, dealt.filter(is_query).withColumn("kth", F.lit(None).cast("long")), shards, k, True), "home")
    kth = F.when(F.size("scores") >= k, F.array_min("scores"))
    others = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    away = home.select("row", "id", "dim", "v", F.col("shard").alias("home"), kth.alias("kth"), others.alias("shard")).filter("shard <> home")
    hits = home.select("row", "id", "ids", "scores").unionByName(_searched(dealt, away, shards, k, False).select("row", "id", "ids", "scores"))
    flat = hits.select("row", F.col("id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("row", "query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return flat.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
"""
