"""Operator 3: exact top-k inner products by ball-tree branch and bound in shards that share the kth score."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, prepare

LEAF, SHARD_ROWS, QUERY_ROWS = 64, 4096, 4096
#: Balls, and numbers in all their centres, that go to every task; vectors that the centres are chosen from.
MOST_BALLS, MOST_NUMBERS, SAMPLE = 4096, 1 << 21, 8192
#: Balls of the greatest bounds that a query is sent to before the others.
NEAR = 8
_LOW = np.iinfo(np.int64).min


@dataclass
class Node:
    """A ball about `centre` that holds rows [lo, hi) of the tree's order."""

    centre: np.ndarray
    radius: float
    lo: int
    hi: int
    children: tuple[Node, ...] = ()


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Node]:
    """(row order, root): rows split by nearness to the two ends of about the longest chord, halves if all are one point."""
    order = np.arange(len(points))

    def ball(lo: int, hi: int) -> Node:
        rows = points[order[lo:hi]]
        centre = rows.mean(0)
        far = np.sqrt(((rows - centre) ** 2).sum(1))
        node = Node(centre, float(far.max()), lo, hi)
        if hi - lo > leaf:
            a = rows[far.argmax()]
            to_a = ((rows - a) ** 2).sum(1)
            b = rows[to_a.argmax()]
            lean = to_a - ((rows - b) ** 2).sum(1)
            cut_at = (hi - lo) // 2
            by = np.argpartition(lean, cut_at)
            order[lo:hi] = order[lo:hi][by]
            node.children = (ball(lo, lo + cut_at), ball(lo + cut_at, hi))
        return node

    return order, ball(0, len(points))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products a b^T; results beyond 64 bits are the nearest 64-bit integer."""
    top = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, _LOW + 1, np.iinfo(np.int64).max).astype(np.int64)


class TopK:
    """The k best (score, id) of each query so far; equal scores go to smaller ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.score, self.id, self.floor = np.full((n, k), _LOW), np.full((n, k), np.iinfo(np.int64).max), floor
        self.products = 0  # evaluated

    @property
    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        useful = (scores >= self.kth[rows, None]).any(1)
        rows, scores = rows[useful], scores[useful]
        if not len(rows):
            return
        k = self.score.shape[1]
        s = np.concatenate([self.score[rows], scores], 1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, scores.shape)], 1)
        best = np.lexsort((i, ~s), axis=-1)[:, :k]  # ~s orders as -s does, the least integer included
        self.score[rows], self.id[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def search(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> TopK:
    """Each query's k best points with score >= floor, not those of its own id.

    All queries go down the tree together; a node keeps those whose bound q.centre + |q| radius reaches their kth
    score so far, and the child of the greater bounds goes first.
    """
    top = TopK(len(queries), k, floor)
    if not len(points) or not len(queries):
        return top
    floats, q = points.astype(np.float64), queries.astype(np.float64)
    order, root = build(floats)
    norm = np.sqrt((q**2).sum(1))
    points, ids = points[order], ids[order]

    def bound(node: Node, rows: np.ndarray) -> np.ndarray:
        b = q[rows] @ node.centre + norm[rows] * node.radius
        return b + 1e-9 * (np.abs(b) + norm[rows] * (np.sqrt((node.centre**2).sum()) + node.radius)) + 1

    stack = [(root, np.arange(len(q)), bound(root, np.arange(len(q))))]
    while stack:
        node, rows, reach = stack.pop()
        rows = rows[reach >= top.kth[rows]]
        if not len(rows):
            continue
        if not node.children:
            s = products(queries[rows], points[node.lo : node.hi])
            top.products += s.size
            s[own[rows, None] == ids[node.lo : node.hi]] = _LOW
            top.add(rows, s, ids[node.lo : node.hi])
            continue
        next_ = [(c, rows, bound(c, rows)) for c in node.children]
        stack += sorted(next_, key=lambda x: float(x[2].sum()))
    return top


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, vec): floor(scale * x) of every component as 64-bit integers; the other vectors are left out."""
    prepare(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            flat = column.flatten()
            size = np.diff(np.asarray(column.offsets))
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
            of = np.repeat(np.arange(len(size)), size)
            good = np.bincount(of[~np.isfinite(x)], minlength=len(size)) == 0
            x = np.floor(x[good[of]] * scale)
            x = np.where(x >= 2.0**63, np.iinfo(np.int64).max, np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(size[good])]) * 8
            vec = pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(good.sum()), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), vec.cast(pa.binary())], ["vec_id", "vec"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(run, "vec_id long, vec binary")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Vectors as rows, shorter ones padded with 0."""
    raw, offsets = as_bytes(column)
    size = np.diff(offsets) // 8
    width = max(width, int(size.max(initial=0)))
    flat = np.ascontiguousarray(raw).view(np.int64)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def centres_of(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """At most n centres of a sample in order: evenly spaced members, moved to the means of what is nearest."""
    n = min(n, len(sample))
    centres = sample[np.arange(n) * len(sample) // max(n, 1)].copy()
    for _ in range(rounds if n > 1 else 0):
        own = ((centres**2).sum(1) - 2 * sample @ centres.T).argmin(1)
        count = np.bincount(own, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


@dataclass
class Balls:
    """Centres with the greatest distance of their vectors, and how many shards those are cut into (0: none)."""

    centres: np.ndarray
    radius: np.ndarray
    shards: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """What no inner product of a query with a vector of each ball exceeds."""
        norm = np.sqrt((q**2).sum(1))[:, None]
        b = q @ self.centres.T + norm * self.radius
        b += 1e-9 * (np.abs(b) + norm * (np.sqrt((self.centres**2).sum(1)) + self.radius)) + 1
        b[:, self.shards == 0] = -np.inf
        return b

    def targets(self, q: np.ndarray, ids: np.ndarray, floor: np.ndarray, stage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, ball, shard) of a stage: one shard of the ball of the greatest bound; the rest of it and of the NEAR
        best; all others. Of the later stages only balls whose bound reaches the query's floor."""
        b = self.bounds(q)
        first = b.argmax(1)
        shard = ids % np.maximum(self.shards[first], 1)
        if stage == 0:
            return np.arange(len(q)), first, shard
        near = np.zeros(b.shape, bool)
        np.put_along_axis(near, np.argsort(-b, 1, kind="stable")[:, :NEAR], True, 1)
        query, ball = np.nonzero((b >= floor[:, None]) & (near if stage == 1 else ~near) & (self.shards > 0))
        n = self.shards[ball]
        query, ball = np.repeat(query, n), np.repeat(ball, n)
        part = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
        new = (ball != first[query]) | (part != shard[query])
        return query[new], ball[new], part[new]


def _place(handle) -> Callable:  # noqa: ANN001
    """Vectors with the nearest centre and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = handle.value
        for batch in batches:
            x = _matrix(batch.column("vec"), centres.shape[1]).astype(np.float64)
            own = np.concatenate([np.zeros(0, np.int64), *(((centres**2).sum(1) - 2 * part @ centres.T).argmin(1) for part in np.array_split(x, max(1, len(x) // 256)))])
            far = np.sqrt(((x - centres[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(far)], ["vec_id", "vec", "ball", "far"])

    return run


def _send(handle, stage: int) -> Callable:  # noqa: ANN001
    """Queries once for each shard of a stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = handle.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                q = _matrix(part.column("vec"), balls.centres.shape[1]).astype(np.float64)
                query, ball, shard = balls.targets(q, np.asarray(part.column("vec_id")), np.asarray(part.column("floor")), stage)
                rows = part.take(pa.array(query))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("vec_id", "vec", "home", "block", "floor")), pa.array(ball, pa.int32()), pa.array(shard, pa.int32())], ["vec_id", "vec", "home", "block", "floor", "ball", "shard"])

    return run


def _searcher(k: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("kind"))
        c, q = (table.filter(pa.array(kind == x)) for x in (0, 1))
        both = _matrix(pa.chunked_array([*c.column("vec").chunks, *q.column("vec").chunks], pa.binary()))
        cid, qid, floor = np.asarray(c.column("vec_id")), np.asarray(q.column("vec_id")), np.asarray(q.column("floor"))
        top = search(both[: len(cid)], cid, both[len(cid) :], qid, k, floor)
        real = top.id != np.iinfo(np.int64).max
        real &= top.score > _LOW
        at = np.nonzero(real)
        return pa.table([pa.array(qid[at[0]]), pa.array(top.id[at]), pa.array(top.score[at])], ["query_id", "vec_id", "score"])

    return run


def top_products(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for each that `queries` (on vec_id) selects.

    Vectors lie in balls about centres of a sample, a crowded ball in several shards. A query is searched in one shard of
    the ball of its greatest bound first; its kth score so far is the floor below which no other ball is looked at, in
    the next best NEAR balls and then in the rest. Queries of one ball go together, in blocks: a shard's vectors are
    sent to the blocks that still ask for it, and a task searches the shard's ball tree for one block.

    Vectors that are null or hold a null or non-finite component, and rows with a null id, take no part. Shorter
    vectors count as padded with 0. Rows of the query's own id aren't its candidates. Repeated rows each count, and
    a query that is repeated is searched once (as its first row in order of the components' bytes). Equal scores go by
    id. Only the id and the vector are read: other columns may have any names. No vectors or no queries: no rows.
    """
    spark = vectors.sparkSession
    rows = cut(quantised(vectors, id_col, vector_col, scale))
    has = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("vec")).alias("bytes")).first()
    wide = max(1, (has["bytes"] or 0) // 8)
    most = max(1, min(MOST_BALLS, MOST_NUMBERS // wide, -(-has.n // shard_rows)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(most, min(SAMPLE, 4 * MOST_NUMBERS // wide))).select("vec").collect() if most > 1 else []
    points = _matrix(pa.array([r["vec"] for r in sample], pa.binary()), wide).astype(np.float64) if sample else np.zeros((1, wide))
    centres = centres_of(points, most)
    placed = cut(rows.mapInArrow(_place(spark.sparkContext.broadcast(centres)), "vec_id long, vec binary, ball int, far double"))
    balls = Balls(centres, np.zeros(len(centres)), np.zeros(len(centres), np.int64))
    asking = np.ones(len(centres), np.int64)
    for r in placed.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.count_if(queries).alias("m")).collect():
        balls.radius[r.ball], balls.shards[r.ball], asking[r.ball] = r.far, -(-r.n // shard_rows), max(1, -(-r.m // QUERY_ROWS))
    parts = F.broadcast(spark.createDataFrame(list(zip(range(len(centres)), balls.shards.tolist(), asking.tolist(), strict=True)), "ball int, shards long, blocks long"))
    candidates = placed.join(parts, "ball").select("vec_id", "vec", "ball", F.pmod(F.xxhash64("vec_id", "vec"), F.col("shards")).cast("int").alias("shard"))
    asked = placed.where(queries).groupBy("vec_id").agg(F.min(F.struct("vec", "ball")).alias("v")).select("vec_id", "v.vec", "v.ball").join(parts, "ball")
    asked = cut(asked.select("vec_id", "vec", F.col("ball").alias("home"), F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block")))
    handle = spark.sparkContext.broadcast(balls)

    def search_stage(stage: int, asking: DataFrame) -> DataFrame:
        sent = asking.mapInArrow(_send(handle, stage), "vec_id long, vec binary, home int, block int, floor long, ball int, shard int")
        sent = cut(sent)
        wanted = sent.select("ball", "shard", "home", "block").distinct()
        left = candidates.join(wanted, ["ball", "shard"]).select("ball", "shard", "home", "block", F.lit(0).alias("kind"), "vec_id", "vec", F.lit(_LOW).alias("floor"))
        right = sent.select("ball", "shard", "home", "block", F.lit(1).alias("kind"), "vec_id", "vec", "floor")
        return cut(left.union(right).groupBy("ball", "shard", "home", "block").applyInArrow(_searcher(k), "query_id long, vec_id long, score long"))

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    found, asking_now = None, asked.withColumn("floor", F.lit(_LOW))
    for stage in range(3 if len(centres) > 1 or balls.shards.max(initial=0) > 1 else 1):
        if found is not None:
            floors = ranked(found).groupBy("query_id").agg(F.when(F.count("score") >= k, F.min("score")).otherwise(F.lit(_LOW)).alias("floor"))
            asking_now = asked.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "vec", "home", "block", F.coalesce("floor", F.lit(_LOW)).alias("floor"))
        more = search_stage(stage, asking_now)
        found = more if found is None else found.union(more)
    return ranked(found).select("query_id", "rank", "vec_id", "score")


QUERY = {"op3_ball_tree_topk": lambda spark, sf_dir: top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)}
ORACLE = {
    "op3_ball_tree_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5
"""
}
