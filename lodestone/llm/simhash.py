"""Operator 2: SimHash near-dedup. Fingerprints of word shingles, linked within a few bits by vantage-point trees in shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import ordered, unordered
from .common import SEPARATOR, cut, mix64, prepare, shuffle_partitions, weighted_join, words_by_block

SEED = 42
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_ONES = np.uint64(0x0101010101010101)


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of spans of a buffer: those under 32 bytes all at once a length, the others one by one."""
    buf = np.concatenate([buf, np.zeros(8, np.uint8)])
    u64 = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    u32 = np.ndarray((len(buf) - 3,), "<u4", buf, strides=(1,))
    out = np.empty(len(starts), np.uint64)
    length = np.minimum(ends - starts, 32).astype(np.uint8)
    order = np.argsort(length, kind="stable")
    edges = np.searchsorted(length[order], np.arange(33))
    for n in range(32):
        rows = order[edges[n] : edges[n + 1]]
        if not len(rows):
            continue
        at = starts[rows]
        h = np.full(len(rows), np.uint64((seed + int(_P5) + n) & ((1 << 64) - 1)))
        for k in range(n >> 3):
            h ^= _rotl(u64[at + 8 * k] * _P2, 31) * _P1
            h = _rotl(h, 27) * _P1 + _P4
        k = n & ~7
        if n & 4:
            h ^= u32[at + k].astype(np.uint64) * _P1
            h = _rotl(h, 23) * _P2 + _P3
            k += 4
        for j in range(k, n):
            h ^= buf[at + j].astype(np.uint64) * _P5
            h = _rotl(h, 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
        out[rows] = h
    raw = memoryview(buf)
    for i in order[edges[32] :].tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]], seed)
    return out


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit words with the bits that more than half of each group's hashes have; groups adjoin, none may be empty.

    Eight counters share a word, each in a byte, over at most 255 hashes; those sums are then widened.
    """
    first = np.cumsum(sizes) - sizes
    parts = -(-sizes // 255)
    part_first = np.cumsum(parts) - parts
    at = np.repeat(first, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(part_first, parts))
    fingerprint = np.zeros(len(sizes), np.uint64)
    for j in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(j)) & _ONES, at)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), part_first)
        bits = 2 * counts > sizes[:, None]
        for i in range(8):
            fingerprint |= bits[:, i].astype(np.uint64) << np.uint64(8 * i + j)
    return fingerprint


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """The fingerprint of every text; 0 where there is no word."""
    out = np.zeros(len(column), np.uint64)
    for lo, hi, part, starts, ends, first in words_by_block(column, lower=True):
        words = np.diff(first)
        if not len(starts):
            continue
        sizes = ends - starts
        stop = np.cumsum(sizes + 1)
        joined = np.full(int(stop[-1]), 32, np.uint8)
        own = np.ones(len(joined), bool)
        own[stop - 1] = False
        joined[own] = part[~SEPARATOR[part]]
        begin, end = stop - sizes - 1, stop - 1
        # a shingle starts at every word but a document's last, or at its only one
        lead = np.ones(len(starts), bool)
        lead[first[1:][words > 1] - 1] = False
        i = np.flatnonzero(lead)
        single = np.zeros(len(starts), bool)
        single[first[:-1][words == 1]] = True
        hashes = xxh64(joined, begin[i], end[np.where(single[i], i, np.minimum(i + 1, len(end) - 1))])
        some = np.flatnonzero(words)
        out[lo + some] = majority(hashes, np.where(words[some] > 1, words[some] - 1, 1))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp), the fingerprint as a signed 64-bit integer."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(batch.column(1)).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- pairs within a distance

RADIUS = 6
#: Points that are compared with each other without a tree; points of one shard that one task compares; points up to
#: which one tree holds all.
LEAF, SHARD, WHOLE = 128, 32_768, 16_384
#: Edges up to which one task connects all.
EDGES = 1_000_000


def layout(n: int) -> tuple[int, int]:
    """(blocks, of which so many agree in any linked pair) for n fingerprints: a shard holds about 2048 of them if bits
    are even. A few fingerprints are one shard."""
    if n <= WHOLE:
        return 1, 0
    for blocks in range(RADIUS + 1, 2 * RADIUS):
        agree = blocks - RADIUS
        if n >> (64 * agree // blocks) <= 2048:
            return blocks, agree
    return 2 * RADIUS, RADIUS


def block_masks(blocks: int) -> np.ndarray:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return np.array([((1 << b) - (1 << a)) for a, b in zip(edges[:-1], edges[1:], strict=True)], np.uint64)


def tables(blocks: int, agree: int) -> list[tuple[int, ...]]:
    return list(combinations(range(blocks), agree))


def keys_of(x: np.ndarray, masks: np.ndarray, combo: tuple[int, ...]) -> np.ndarray:
    return x & (np.bitwise_or.reduce(masks[list(combo)]) if combo else np.uint64(0))


class Links:
    """Partners and connected rows of a set of fingerprints x, of which row i stands for n[i] documents.

    Pairs come in blocks and are reduced at once: kept are a count and a label a row. `apart` are masks of blocks; a
    pair that agrees in one of those is counted elsewhere.
    """

    def __init__(self, x: np.ndarray, n: np.ndarray, apart: np.ndarray | Sequence[np.uint64] = ()):
        self.x, self.n, self.apart = x, n.astype(np.float64), apart
        self.near, self.label = np.zeros(len(x)), np.arange(len(x))
        self.compared = 0

    def block(self, a: np.ndarray, b: np.ndarray, same: bool = False) -> None:
        for s in range(0, len(a), 1024):
            for t in range(s if same else 0, len(b), 1024):
                self._tile(a[s : s + 1024], b[t : t + 1024], same and s == t)

    def _tile(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        self.compared += len(a) * len(b)
        z = self.x[a][:, None] ^ self.x[b][None, :]
        near = np.bitwise_count(z) <= RADIUS
        if same:
            near = np.triu(near, 1)
        found = np.count_nonzero(near)
        if not found:
            return
        if found * 16 <= near.size:
            i, j = np.nonzero(near)
            own = np.ones(len(i), bool)
            for m in self.apart:
                own &= (z[i, j] & m) != 0
            np.add.at(self.near, a[i[own]], self.n[b[j[own]]])
            np.add.at(self.near, b[j[own]], self.n[a[i[own]]])
        else:
            own = near.copy()
            for m in self.apart:
                own &= (z & m) != 0
            own = own.astype(np.float64)
            self.near[a] += own @ self.n[b]
            self.near[b] += self.n[a] @ own
            i, j = np.nonzero(near & (self.label[a][:, None] != self.label[b][None, :]))
        self._connect(a[i], b[j])

    def _connect(self, i: np.ndarray, j: np.ndarray) -> None:
        self.label = connect(self.label, i, j)


def connect(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels of rows, each the least row that it is connected with, after rows i are linked with rows j."""
    while True:
        p, q = label[i], label[j]
        differ = p != q
        if not differ.any():
            return label
        i, j, p, q = i[differ], j[differ], p[differ], q[differ]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(label, up := label[label]):
            label = up


def search_tree(links: Links, a: np.ndarray, b: np.ndarray | None = None) -> None:
    """Compares all pairs of rows of a (or of one of a and one of b) that a vantage-point tree can't tell apart.

    A set is split at the median distance from its first point. A pair whose distances from that point differ by
    more than RADIUS is apart by the triangle inequality, so of the two sides only the points near the boundary
    meet, and they are split again in the same way.
    """
    x = links.x
    stack: list[tuple[np.ndarray, np.ndarray | None]] = [(a, b)]
    while stack:
        a, b = stack.pop()
        if b is None:
            if len(a) <= LEAF:
                links.block(a, a, True)
                continue
            d = np.bitwise_count(x[a] ^ x[a[0]]).astype(np.int64)
            mid = int(np.median(d))
            inner = d <= mid
            if inner.all():
                inner = d < mid
            if not inner.any():  # all at one distance from it
                links.block(a, a, True)
                continue
            top, low = int(d[inner].max()), int(d[~inner].min())
            stack += [(a[inner], None), (a[~inner], None), (a[inner & (d >= low - RADIUS)], a[~inner & (d <= top + RADIUS)])]
            continue
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) <= 4 * LEAF * LEAF:
            links.block(a, b)
            continue
        da, db = (np.bitwise_count(x[s] ^ x[a[0]]).astype(np.int64) for s in (a, b))
        mid = int(np.median(da))
        ia, ib = da <= mid, db <= mid
        if ia.all() or not ia.any():
            links.block(a[(da >= db.min() - RADIUS) & (da <= db.max() + RADIUS)], b[(db >= da.min() - RADIUS) & (db <= da.max() + RADIUS)])
            continue
        stack += [(a[ia], b[ib]), (a[~ia], b[~ib]), (a[ia & (da > mid - RADIUS)], b[~ib & (db <= mid + RADIUS)]), (a[~ia & (da <= mid + RADIUS)], b[ib & (db > mid - RADIUS)])]


def _counts(blocks: int, agree: int) -> Callable:
    """(table, key, points) of a task."""
    masks, combos = block_masks(blocks), tables(blocks, agree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(parts)
            for t, combo in enumerate(combos):
                key, n = np.unique(keys_of(x, masks, combo), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key.view(np.int64)), pa.array(n)], ["t", "key", "n"])

        for batch in batches:
            parts.append(np.asarray(batch.column("fp")).view(np.uint64))
            size += len(parts[-1])
            if size >= 1 << 20:
                yield from flush()
                parts, size = [], 0
        if parts:
            yield from flush()

    return run


def hot_shards(classes: DataFrame, blocks: int, agree: int, points: int, shard: int = SHARD) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], int]:
    """(table -> its keys with too many points for one task, and how many slices each is cut into; the most points a slice).

    No more than a million keys can have so many: that bounds what comes to the driver and goes to all tasks.
    """
    most = max(shard, points * len(tables(blocks, agree)) // 1_000_000)
    found: dict[int, list[tuple[int, int]]] = {}
    if points > most:
        counted = classes.mapInArrow(_counts(blocks, agree), "t int, key long, n long").groupBy("t", "key").agg(F.sum("n").alias("n"))
        for r in counted.where(F.col("n") > most).collect():
            found.setdefault(r.t, []).append((r.key, -(-r.n // most)))
    out = {}
    for t, rows in found.items():
        key, slices = np.array(rows, np.int64).T
        order = np.argsort(key.view(np.uint64))
        out[t] = np.ascontiguousarray(key.view(np.uint64)[order]), slices[order]
    return out, most


def _slice(x: np.ndarray, slices: np.ndarray | int) -> np.ndarray:
    return (mix64(x ^ np.uint64(0x5DEECE66D)) % np.asarray(slices).astype(np.uint64)).astype(np.int64)


def _spread(blocks: int, agree: int, buckets: int, handle) -> Callable:  # noqa: ANN001
    """Points by bucket. A shard with too many is cut into slices by hash, and each pair of slices is a shard."""
    masks, combos = block_masks(blocks), tables(blocks, agree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = handle.value
        rows: list[tuple[int, bytes]] = []

        def put(t: int, low: int, high: int, slices: int, key: np.ndarray, x: np.ndarray, n: np.ndarray) -> None:
            salt = np.uint64((t * 1_000_003 + low * 8191 + high) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            bucket = (mix64(key ^ salt) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                i = order[s:e]
                rows.append((int(bucket[i[0]]), np.concatenate([np.array([t, low, high, slices, len(i)], np.uint64), x[i], n[i]]).tobytes()))

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary()), strict=True)], ["bucket", "blob"])

        for batch in batches:
            x, n = np.asarray(batch.column("fp")).view(np.uint64), np.asarray(batch.column("n")).astype(np.uint64)
            for t, combo in enumerate(combos):
                key = keys_of(x, masks, combo)
                cold = np.ones(len(x), bool)
                if t in hot:
                    known, slices = hot[t]
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    cold = known[at] != key
                    for many in np.unique(slices[at[~cold]]).tolist():
                        i = np.flatnonzero(~cold & (slices[at] == many))
                        own = _slice(x[i], many)
                        for low in range(many):
                            for high in range(low, many):
                                j = i[(own == low) | (own == high)]
                                if len(j):
                                    put(t, low, high, many, key[j], x[j], n[j])
                i = np.flatnonzero(cold)
                put(t, 0, 0, 1, key[i], x[i], n[i])
                if len(rows) > 20_000:
                    yield batch_of()
                    rows.clear()
        if rows:
            yield batch_of()

    return run


def _meet(blocks: int, agree: int) -> Callable:
    """A bucket's links: (fp, partners counted with their copies, a connected fingerprint or null).

    A pair meets in several shards; it counts in that of the first blocks in which it agrees.
    """
    masks, combos = block_masks(blocks), tables(blocks, agree)

    def run(table: pa.Table) -> pa.Table:
        parts: dict[tuple[int, ...], list[np.ndarray]] = {}
        for b in table.column("blob").to_pylist():
            a = np.frombuffer(b, np.uint64)
            parts.setdefault(tuple(a[:4].tolist()), []).append(a[5:].reshape(2, int(a[4])))
        fps, counts, peers = [], [], []
        for (t, low, high, slices), p in parts.items():
            x, n = np.concatenate(p, 1)
            key = keys_of(x, masks, combos[t])
            order = np.lexsort((x, key))
            x, n, key = x[order], n[order].astype(np.int64), key[order]
            own = _slice(x, slices) if low != high else None
            apart = [masks[s] for s in range(max(combos[t], default=0)) if s not in combos[t]]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            for s, e in zip(first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True):
                if e - s < 2:
                    continue
                links = Links(x[s:e], n[s:e], apart)
                rows = np.arange(e - s)
                if own is None:
                    search_tree(links, rows)
                else:
                    search_tree(links, rows[own[s:e] == low], rows[own[s:e] == high])
                some, moved = np.flatnonzero(links.near), np.flatnonzero(links.label != rows)
                if len(some) or len(moved):
                    fps += [x[s + some], x[s + moved]]
                    counts += [links.near[some].astype(np.int64), np.zeros(len(moved), np.int64)]
                    peers += [np.ma.masked_all(len(some), np.int64), np.ma.array(x[s + links.label[moved]].view(np.int64), mask=False)]
        if not fps:
            return pa.table([pa.array([], pa.int64())] * 3, ["fp", "near", "peer"])
        peer = np.ma.concatenate(peers)
        return pa.table([pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(counts)), pa.array(peer.data, pa.int64(), mask=np.ma.getmaskarray(peer))], ["fp", "near", "peer"])

    return run


def near_points(classes: DataFrame, points: int, blocks: int, agree: int, shard: int = SHARD) -> DataFrame:
    """(fp, near, peer) of classes (fp, n): counts of other documents linked, and edges of a spanning forest."""
    spark = classes.sparkSession
    hot, _ = hot_shards(classes.select("fp", "n"), blocks, agree, points, shard)
    buckets = max(shuffle_partitions(spark), points * len(tables(blocks, agree)) // 500_000)
    met = classes.select("fp", "n").mapInArrow(_spread(blocks, agree, buckets, spark.sparkContext.broadcast(hot)), "bucket int, blob binary")
    return met.groupBy("bucket").applyInArrow(_meet(blocks, agree), "fp long, near long, peer long")


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, root) of every node but the roots, of all edges (u, v)."""
    parts = [np.stack([np.asarray(b.column("u")), np.asarray(b.column("v"))]) for b in batches]
    nodes, at = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *parts], 1), return_inverse=True)
    i, j = at.reshape(2, -1)
    label = connect(np.arange(len(nodes)), i, j)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["u", "root"])


def components(edges: DataFrame, whole: int = EDGES) -> DataFrame:
    """(u, root) of every node of edges (u, v) but the roots: the least connected node.

    Up to `whole` edges go to one task: rounds are some ten jobs each, whose plans and threads fill the driver however
    few the edges. More are connected by rounds of large and small stars: a large star links a node's greater neighbours
    to its least one, a small star the others to it; both keep the components. Every round is written to the shared
    folder; it ends when a round changes nothing.
    """
    if edges.count() <= whole:
        return cut(edges.coalesce(1).mapInArrow(_connected, "u long, root long"))

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w"))

    def to_least(e: DataFrame) -> DataFrame:
        return weighted_join(e, least(e), "u", "w", e.count())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while (now := mark(e)) != seen and now[0]:
        seen = now
        both = cut(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = cut(to_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct())
        small = to_least(large)
        e = cut(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
    return e.select("u", F.col("v").alias("root"))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """(fingerprints of the documents, classes of equal ones, their links, their components' roots, number of classes)."""
    rows = cut(fingerprints(docs, id_col, text_col))
    classes = cut(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")))
    points = classes.count()
    blocks, agree = layout(points)
    met = cut(near_points(classes, points, blocks, agree))
    return rows, classes, met, components(met.where("peer IS NOT NULL").select(F.col("fp").alias("u"), F.col("peer").alias("v"))), points


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, n_near, component_id of every document.

    Documents with one fingerprint are one point from here on; up to WHOLE points are one vantage-point tree. A pair
    within RADIUS bits differs in at most that many of the blocks that the bits are cut into, so it agrees in the
    rest: more points are sharded by each choice of so many blocks, and a linked pair meets in a shard, in a
    vantage-point tree. Shards with very many points are cut into slices of which each pair is a task. Shards give
    counts and spanning trees, never all pairs; components follow from those.

    Texts are taken whole, a block of documents at a time and a longer one by itself. Only the id and the text are
    read: other columns may have any names. Null text, and text without a word, has fingerprint zero and is linked like any other. Rows that repeat an id
    are documents of their own. A null id gives no component its name; a component of null ids alone has null.
    No rows: none.
    """
    rows, classes, met, tree, points = linked(docs, id_col, text_col)
    near = met.groupBy("fp").agg(F.sum("near").alias("near"))
    placed = classes.join(near, "fp", "left").join(tree, F.col("fp") == F.col("u"), "left")
    placed = cut(placed.select("fp", "n", "first", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("root", "fp").alias("root")))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("w"))
    placed = cut(weighted_join(placed, named, "root", "w", points).select("fp", "n", (F.col("near") + F.col("n") - 1).alias("n_near"), "component_id"))
    out = weighted_join(rows, placed, "fp", "n", rows.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """docs with the first document of each component only: the one of the least id, or of rows that share an id or
    have none the first in order of (id, text), null ids last."""
    rows = ordered(docs, keep=[c for c in docs.columns if c not in ("doc_id", "text")])
    _, classes, _, tree, _ = linked(rows, "uid")
    first = classes.join(tree, F.col("fp") == F.col("u"), "left").groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("__id")).select("__id")
    return unordered(rows.join(first, F.col("uid") == F.col("__id"), "left_semi"), docs)


QUERY = {"op2_simhash_near_dups": lambda spark, sf_dir: near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
ORACLE: dict[str, str] = {}
