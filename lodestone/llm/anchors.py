"""Windows that repeat anywhere in a corpus, found without comparing documents pair by pair.

A document is a sequence of units (bytes or words) and a window is a fixed number of them. The anchor of a window
is the unit n-gram in it with the least hash, the first of equals: it depends on the window's content alone, so
equal windows have equal anchors at equal places. Neighbouring windows mostly share an anchor; the run that does
is a segment. Then

1. segments are sent to buckets by anchor, hashes only, and one per content from each task. Of equal segments the
   first stays; each window of the others starts earlier too;
2. only where one anchor has segments that differ are their units fetched, and a kernel (a suffix array for bytes,
   seed extension for words) finds the equal windows among them;
3. the covered units come back to their documents.

An anchor with very many different segments is split by the place of the anchor in the window and by what such
windows must share. Where that is shared by very many too, as around a footer, windows are sent by their own content,
one of each from a task, so that no group of near copies comes to one task. An anchor that a task alone sees in very
many segments is not sent to its bucket at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK, Spans, as_bytes, blocks, byte_values, cut, lookup_join, mix64, plan_bytes, prepare, word_hashes, word_spans

PLACE = np.uint64((1 << 24) - 1)
#: Different segments of one anchor beyond which they are split further.
HOT = 512
#: Parts with one key beyond which each window goes by its own content.
CROWD = 4096
#: Text bytes after which a task sends what it has gathered.
FLUSH = 16 << 20
#: Text bytes that are hashed at a time: their hashes stay in a core's cache.
CACHED = 1 << 16
_CODEC = pa.Codec("zstd", 1)


@dataclass(frozen=True)
class Windows:
    """length: units in a window; gram: units in an anchor; words: units are words, else bytes; within: an earlier
    start in the same document counts as earlier."""

    length: int
    gram: int
    words: bool
    within: bool

    @property
    def places(self) -> int:
        return self.length - self.gram + 1


def segments(values: np.ndarray, bounds: np.ndarray, w: Windows) -> tuple[np.ndarray, ...]:
    """Of the segments of adjoining sequences: (first window, number of windows, anchor, anchor hash, content hash,
    left hash, right hash).

    The last two are of the anchor with half as many units as a window has besides, before it and after it; 0 where
    no window of the segment has so many. Every window has them on one side, so only segments that share an
    anchor and one of these hashes can have a window in common.
    """
    n = len(values)
    if n < w.length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 4
    spans = Spans(values)
    grams = spans.grams(w.gram)
    least = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= w.places:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w.places:
        rest = w.places - span
        least = np.minimum(least[:-rest], least[rest:])
    place = (least & PLACE).astype(np.int64)
    valid = np.ones(len(place), bool)
    for b in bounds[1:-1].tolist() if len(bounds) < 64 else ():
        valid[max(0, b - w.length + 1) : b] = False
    if len(bounds) >= 64:
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, np.maximum(bounds[1:-1] - w.length + 1, 0), 1)
        np.add.at(step, bounds[1:-1], -1)
        valid = np.cumsum(step[: len(place)]) == 0
    change = np.empty(len(place), bool)
    change[0] = True
    change[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(place)))
    keep = valid[first]
    first, count = first[keep], count[keep]
    anchor = place[first]
    half, stop, none = w.places // 2, anchor + w.gram, np.uint64(0)
    left = np.where(anchor - half >= first, spans.spans(np.maximum(anchor - half, 0), stop) | np.uint64(1 << 32), none)
    right = np.where(stop + half <= first + count + w.length - 1, spans.spans(anchor, np.minimum(stop + half, n)) | np.uint64(1 << 32), none)
    return first, count, anchor, grams[anchor], spans.spans(first, first + count + w.length - 1), left >> np.uint64(32), right >> np.uint64(32)


def _units(column: pa.Array, w: Windows) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end document, unit values, bounds of the documents in them) block by block."""
    buf, offsets = as_bytes(column)
    for lo, hi in blocks(offsets, CACHED):
        part, off = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if w.words:
            starts, ends, first = word_spans(part, off)
            yield lo, hi, word_hashes(part, starts, ends), first
        else:
            yield lo, hi, byte_values(part), off


def _document_segments(column: pa.Array, w: Windows) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first window in it, windows, hashes of anchor, content, left and right); a long document is taken in pieces."""
    for lo, hi, values, bounds in _units(column, w):
        if len(values) <= 2 * BLOCK:
            first, count, _, *hashes = segments(values, bounds, w)
            doc = np.searchsorted(bounds, first, "right") - 1
            yield doc + lo, first - bounds[doc], count, *hashes
            continue
        for d in range(lo, hi):
            own = values[bounds[d - lo] : bounds[d - lo + 1]]
            for at in range(0, max(1, len(own) - w.length + 1), BLOCK):
                part = own[at : at + BLOCK + w.length - 1]
                first, count, _, *hashes = segments(part, np.array([0, len(part)]), w)
                yield np.full(len(first), d), first + at, count, *hashes


def _classes(uid: np.ndarray, at: np.ndarray, h: np.ndarray, seg: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in order of (anchor, content, place), and which of those start no earlier than their equals."""
    order = np.lexsort((at, uid, seg, h))
    same = np.zeros(len(order), bool)
    if len(order):
        a, b = order[1:], order[:-1]
        same[1:] = (h[a] == h[b]) & (seg[a] == seg[b])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    first = uid[order] == uid[order[head]]
    if w.within:
        first &= at[order] == at[order[head]]
    return order, first


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(raw: np.ndarray, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def _pack(uid: np.ndarray, at: np.ndarray, n: np.ndarray, hashes: Sequence[np.ndarray] = ()) -> bytes:
    """Rows in order of their place. 48 bits of the anchor's hash will do: more only costs comparisons."""
    order = np.lexsort((at, uid))
    uid, at = uid[order], at[order]
    step = np.diff(uid.astype(np.uint64), prepend=np.uint64(0))
    body = _planes(step) + _planes(at.astype(np.uint64)) + n[order].astype(np.uint16).tobytes()
    if hashes:
        h, seg, left, right = (x[order] for x in hashes)
        body += _planes(h >> np.uint64(16))[: 6 * len(uid)] + seg.tobytes() + left.astype(np.uint32).tobytes() + right.astype(np.uint32).tobytes()
    return len(uid).to_bytes(8, "little") + len(body).to_bytes(8, "little") + _CODEC.compress(body, asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    raw = np.frombuffer(_CODEC.decompress(blob[16:], size, asbytes=True), np.uint8)
    cuts = np.cumsum([0, 8 * n, 8 * n, 2 * n, 6 * n, 8 * n, 4 * n, 4 * n])
    a = [raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    place = np.cumsum(_unplanes(a[0], n, np.uint64)).astype(np.int64), _unplanes(a[1], n, np.uint64).astype(np.int64), a[2].view(np.uint16).astype(np.int64)
    if len(raw) <= cuts[3]:
        return place
    h = np.concatenate([a[3], np.zeros(2 * n, np.uint8)])
    return *place, _unplanes(h, n, np.uint64), a[4].view(np.uint64), a[5].view(np.uint32), a[6].view(np.uint32)


def _scan(w: Windows, buckets: int) -> Callable:
    """Map side, by bucket: the segments of a task, one of each content (kind 0); spans that are repeats (1); segments
    of anchors that have too many here (2), and those anchors (3)."""

    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        uid, at, n, h, *more = (np.concatenate(p) for p in zip(*parts, strict=True))
        order, first = _classes(uid, at, h, more[0], w)
        stay, gone = order[first], order[~first]
        new = np.ones(len(stay), bool)
        new[1:] = h[stay[1:]] != h[stay[:-1]]
        of = np.cumsum(new) - 1
        many = np.bincount(of)[of] > HOT if len(stay) else new
        place = mix64(uid.astype(np.uint64))
        rows: list[tuple[int, int, bytes]] = []
        anchors = h[stay[new & many]]
        for b in np.unique(anchors % np.uint64(buckets)):
            rows.append((int(b), 3, (anchors[anchors % np.uint64(buckets) == b] >> np.uint64(16)).tobytes()))
        for which, key, kind in ((stay[~many], h, 0), (gone, place, 1), (stay[many], place, 2)):
            bucket = (key[which] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            which, bucket = which[by], bucket[by]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                i = which[s:e]
                rows.append((int(bucket[s]), kind, _pack(uid[i], at[i], n[i], () if kind == 1 else [x[i] for x in (h, *more)])))
        if rows:
            b, k, x = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], ["bucket", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            uid = np.asarray(batch.column("uid"))
            for doc, *rest in _document_segments(batch.column("text"), w):
                parts.append((uid[doc], *rest))
            size += batch.column("text").nbytes
            if size >= FLUSH:
                yield from flush(parts)
                parts, size = [], 0
        if parts:
            yield from flush(parts)

    return run


def _spans(uid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of units by document, those that touch or overlap merged."""
    if not len(uid):
        return uid, lo, hi
    order = np.lexsort((hi, lo, uid))
    uid, lo, hi = uid[order], lo[order], hi[order]
    _, doc = np.unique(uid, return_inverse=True)
    lift = doc.astype(np.int64) * (int(hi.max()) + 1)
    top = np.maximum.accumulate(hi + lift)
    start = np.ones(len(uid), bool)
    start[1:] = (lo[1:] + lift[1:] > top[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(start)
    last = np.append(first[1:], len(uid)) - 1
    return uid[first], lo[first], top[last] - lift[last]


_FOUND = "uid long, lo long, hi long, anchor long, hot boolean"


def _found(uid, lo, hi, anchor=None, hot=None) -> pa.Table:  # noqa: ANN001
    n = len(uid)
    none = pa.nulls(n, pa.int64()) if anchor is None else pa.array(anchor.view(np.int64))
    return pa.table([pa.array(uid), pa.array(lo), pa.array(hi), none, pa.nulls(n, pa.bool_()) if hot is None else pa.array(hot)], ["uid", "lo", "hi", "anchor", "hot"])


def _reduce(w: Windows) -> Callable:
    """Bucket side: spans of repeated segments (anchor null), and the segments whose anchor has others."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_pylist()
        blobs = table.column("blob").to_pylist()
        gone = [_unpack(b) for b, k in zip(blobs, kind, strict=True) if k == 1]
        out: list[pa.Table] = []
        here, crowded = ([_unpack(b) for b, k in zip(blobs, kind, strict=True) if k == which] for which in (0, 2))
        marked = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(b, np.uint64) for b, k in zip(blobs, kind, strict=True) if k == 3)])
        for uid, at, n, h, *_ in crowded:
            out.append(_found(uid, at, at + n, h, np.ones(len(uid), bool)))
        if here:
            uid, at, n, h, seg, left, right = (np.concatenate(p) for p in zip(*here, strict=True))
            order, first = _classes(uid, at, h, seg, w)
            rest, order = order[~first], order[first]
            gone.append((uid[rest], at[rest], n[rest]))
            ho, so = h[order], seg[order]
            new = np.ones(len(order), bool)
            new[1:] = ho[1:] != ho[:-1]
            other = new.copy()
            other[1:] |= so[1:] != so[:-1]
            content = np.cumsum(other) - 1
            keep = np.zeros(len(order), bool)
            for side in (left[order], right[order]):  # different contents that share the anchor and this side
                by = np.lexsort((content, side, ho))
                edge = np.ones(len(by) + 1, bool)
                edge[1:-1] = (ho[by[1:]] != ho[by[:-1]]) | (side[by[1:]] != side[by[:-1]])
                fresh = edge[:-1].copy()
                fresh[1:] |= content[by[1:]] != content[by[:-1]]
                at_edge = np.flatnonzero(edge)
                kinds = np.add.reduceat(fresh.astype(np.int64), at_edge[:-1]) if len(by) else np.zeros(0, np.int64)
                keep[by] |= (np.repeat(kinds, np.diff(at_edge)) > 1) & (side[by] != 0)
            wide = np.isin(ho, marked)
            keep |= wide
            group = (np.cumsum(new) - 1)[keep]
            i = order[keep]
            out.append(_found(uid[i], at[i], at[i] + n[i], h[i], (np.bincount(group)[group] > HOT) | wide[keep] if len(i) else np.zeros(0, bool)))
        if gone:
            uid, at, n = (np.concatenate(p) for p in zip(*gone, strict=True))
            out.append(_found(*_spans(uid, at, at + n + w.length - 1)))
        return pa.concat_tables(out) if out else _found(*(np.zeros(0, np.int64),) * 3)

    return run


_FETCHED = "bucket int, anchor long, uid long, at long, n int, units binary"
_FETCHED_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())


def _fetched(*columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _FETCHED_KINDS, strict=True)], ["bucket", "anchor", "uid", "at", "n", "units"])


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of ranges of these sizes, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _fetch(w: Windows, buckets: int) -> Callable:
    """Candidate segments with their units: (bucket, anchor, uid, first window, windows, bytes of the units)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            ok = np.flatnonzero(~np.asarray(wanted.is_null()))
            if not len(ok):
                continue
            batch = batch.take(pa.array(ok))
            wanted, uid = batch.column("wanted"), np.asarray(batch.column("uid"))
            buf, offsets = as_bytes(batch.column("text"))
            edges = np.asarray(wanted.offsets)
            doc = np.repeat(np.arange(len(uid)), np.diff(edges))
            lo, hi, key, hot = (np.asarray(wanted.values.field(k))[edges[0] : edges[-1]] for k in ("lo", "hi", "anchor", "hot"))
            if w.words:
                starts, ends, first = word_spans(buf, offsets)
                values = word_hashes(buf, starts, ends) if hot.any() else None
            else:
                starts, ends, first, values = None, None, offsets, None
            raw = memoryview(np.ascontiguousarray(buf))
            for a in range(0, len(lo), 4096):
                rows = np.arange(a, min(a + 4096, len(lo)))
                cold, warm = rows[~hot[rows]], rows[hot[rows]]
                of, x, y, k = cold, lo[cold], hi[cold], key[cold]
                if len(warm):
                    at = _ranges(first[doc[warm]] + lo[warm], hi[warm] - lo[warm] + w.length - 1)
                    row, px, py, pk = _split(w, values[at] if w.words else byte_values(buf[at]), hi[warm] - lo[warm], key[warm])
                    of, x, y, k = (np.concatenate(c) for c in ((of, warm[row]), (x, lo[warm[row]] + px), (y, lo[warm[row]] + py), (k, pk)))
                begin, end = first[doc[of]] + x, first[doc[of]] + y + w.length - 2
                s, e = (starts[begin], ends[end]) if w.words else (begin, end + 1)
                units = [bytes(raw[i:j]) for i, j in zip(s.tolist(), e.tolist(), strict=True)]
                yield _fetched(np.mod(k, buckets), k, uid[doc[of]], x, y - x, units)

    return run


def _split(w: Windows, values: np.ndarray, n: np.ndarray, anchor: np.ndarray, width: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first window, end window, key) of parts of segments of n windows, whose units adjoin in `values`: windows
    whose anchor is at about the same place, keyed by the units that all those share.

    Equal windows have the anchor at the same place, so they fall in the same range of places, and share the rest.
    """
    size = n + w.length - 1
    base = np.cumsum(size) - size
    spans = Spans(values)
    grams = spans.grams(w.gram)
    # the anchor lies in all windows of its segment: the least hash among the places that do, the first of equals
    room = w.places - n + 1
    local = _ranges(n - 1, room)
    least = np.minimum.reduceat((grams[_ranges(base + n - 1, room)] & ~PLACE) | local.astype(np.uint64), np.cumsum(room) - room)
    p = (least & PLACE).astype(np.int64)  # the anchor's distance from the first window
    # it falls by one a window: a range of places is [floor, floor + width)
    head = p % width + 1
    parts = 1 + -(-np.maximum(n - head, 0) // width)
    row = np.repeat(np.arange(len(n)), parts)
    k = _ranges(np.zeros(len(n), np.int64), parts)
    x = np.where(k > 0, head[row] + (k - 1) * width, 0)
    y = np.minimum(n[row], head[row] + k * width)
    floor = (p[row] - x) // width * width
    # windows of a range all hold the units from the latest start to the earliest end
    s, e = np.maximum(p[row] - floor, 0), np.minimum(p[row] - floor - width + 1 + w.length, size[row])
    shared = spans.spans(base[row] + s, base[row] + e)
    key = mix64(anchor[row].astype(np.uint64) * np.uint64(31) + floor.astype(np.uint64) * np.uint64(1_000_003) + shared)
    return row, x, y, (key >> np.uint64(1)).astype(np.int64)


def _singles(w: Windows, buckets: int) -> Callable:
    """Parts as single windows by their content, one of each from a task; the others as spans (units null)."""

    def flush(parts: list[tuple[np.ndarray, ...]], units: list[bytes]) -> Iterator[pa.RecordBatch]:
        uid, at, key, row, s, e = (np.concatenate(p) for p in zip(*parts, strict=True))
        order, first = _classes(uid, at, key, key, w)
        for some in np.array_split(order[first], max(1, len(order) >> 12)):
            if len(some):
                cells = [units[r][a:b] for r, a, b in zip(row[some].tolist(), s[some].tolist(), e[some].tolist(), strict=True)]
                k = key[some]
                yield _fetched((k % np.uint64(buckets)).astype(np.int64), (k >> np.uint64(1)).astype(np.int64), uid[some], at[some], np.ones(len(some), np.int32), cells)
        gone = order[~first]
        if len(gone):
            doc, lo, hi = _spans(uid[gone], at[gone], at[gone] + w.length)
            bucket = (mix64(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            yield _fetched(bucket, np.zeros(len(doc), np.int64), doc, lo, hi - lo, [None] * len(doc))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        units: list[bytes] = []
        size = 0
        for batch in batches:
            own = batch.column("units").to_pylist()
            uid, at, n = (np.asarray(batch.column(c)).astype(np.int64) for c in ("uid", "at", "n"))
            buf = np.frombuffer(b"".join(own), np.uint8)
            bounds = np.concatenate([[0], np.cumsum([len(u) for u in own])])
            if w.words:
                starts, ends, first = word_spans(buf, bounds)
                values = word_hashes(buf, starts, ends)
            else:
                starts, first, values = np.arange(len(buf)), bounds, byte_values(buf)
                ends = starts + 1
            row = np.repeat(np.arange(len(own)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            x = first[row] + step
            key = Spans(values).grams(w.length)[x]
            parts.append((uid[row], at[row] + step, key, row + len(units), starts[x] - bounds[row], ends[x + w.length - 1] - bounds[row]))
            units += own
            size += len(buf)
            if size >= FLUSH:
                yield from flush(parts, units)
                parts, units, size = [], [], 0
        if parts:
            yield from flush(parts, units)

    return run


Kernel = Callable[[Windows, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def ordered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """uid, text and row (a struct of the id as doc_id and of the columns `keep`); uid orders documents as ids do.

    Where ids are unique and not null, they are the uid. Otherwise rows are documents of their own in order of
    (id, text), null ids last, and numbered so.
    """
    docs = docs.select(F.col(text_col).alias("text"), F.struct(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).alias(f"_{c}") for c in keep]).alias("row"))
    ids = docs.groupBy(F.col("row.doc_id").alias("id")).count()
    if ids.where("id IS NULL OR count > 1").isEmpty():
        return docs.select(F.col("row.doc_id").alias("uid"), "text", "row")
    return cut(docs.orderBy(F.col("row.doc_id").asc_nulls_last(), "text").select(F.monotonically_increasing_id().alias("uid"), "text", "row"))


def unordered(rows: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: Column) -> DataFrame:
    """Rows of `ordered` (with all other columns of docs kept) as rows like those of docs; `columns` replace some."""
    own = {c: F.col("text") if c == text_col else F.col("row.doc_id") if c == id_col else F.col(f"row._{c}") for c in docs.columns}
    return rows.select(*[columns.get(c, own[c]).alias(c) for c in docs.columns])


def candidates(docs: DataFrame, w: Windows) -> tuple[DataFrame, DataFrame]:
    """(units of segments that may have windows in common, by bucket; spans that are repeats already)."""
    size = plan_bytes(docs)
    buckets = max(64, -(-size // (16 << 20)))
    found = docs.select("uid", "text").mapInArrow(_scan(w, buckets), "bucket int, kind int, blob binary")
    found = cut(found.groupBy("bucket").applyInArrow(_reduce(w), _FOUND))
    wanted = found.where("anchor IS NOT NULL")
    units = wanted.agg(F.sum(F.col("hi") - F.col("lo") + w.length)).first()[0] or 0
    shards = max(16, -(-units * (8 if w.words else 1) // (1 << 20)))
    wanted = wanted.groupBy(F.col("uid").alias("__uid")).agg(F.collect_list(F.struct("lo", "hi", "anchor", "hot")).alias("wanted"))
    fetched = docs.join(wanted.hint("shuffle_hash"), F.col("uid") == F.col("__uid"), "left").drop("__uid").mapInArrow(_fetch(w, shards), _FETCHED)
    fetched = cut(fetched)
    crowded = cut(fetched.groupBy("anchor").agg(F.count(F.lit(1)).alias("parts")).where(F.col("parts") > CROWD))
    if not crowded.isEmpty():
        marked = lookup_join(fetched, crowded, ["anchor"], F.xxhash64("uid", "at"))
        names = fetched.columns
        fetched = marked.where("parts IS NULL").select(*names).union(marked.where("parts IS NOT NULL").select(*names).mapInArrow(_singles(w, shards), _FETCHED))
    return fetched, found.where("anchor IS NULL").select("uid", "lo", "hi")


def repeats(docs: DataFrame, w: Windows, kernel: Kernel) -> DataFrame:
    """What `ordered` gave with `spans`, an array of (lo, hi): the units that repeated windows cover.

    The documents are sent by uid once: both joins with them take the same exchange of them, whole rows in both.
    """
    prepare(docs.sparkSession)
    fetched, spans = candidates(docs, w)

    def run(table: pa.Table) -> pa.Table:
        done = table.filter(table.column("units").is_null())
        table = table.filter(table.column("units").is_valid())
        lo = np.asarray(done.column("at"))
        spans = [(np.asarray(done.column("uid")), lo, lo + np.asarray(done.column("n")))]
        if len(table):
            spans.append(kernel(w, *(np.asarray(table.column(c)) for c in ("anchor", "uid", "at", "n")), table.column("units").to_pylist()))
        return _found(*_spans(*(np.concatenate(x) for x in zip(*spans, strict=True))))

    spans = spans.union(fetched.groupBy("bucket").applyInArrow(run, _FOUND).select("uid", "lo", "hi"))
    spans = spans.groupBy(F.col("uid").alias("__uid")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return docs.join(spans.hint("shuffle_hash"), F.col("uid") == F.col("__uid"), "left").drop("__uid")


def covered(units: int, bounds: np.ndarray, spans: pa.Array) -> np.ndarray:
    """Which of the units of adjoining documents the documents' spans cover."""
    step = np.zeros(units + 1, np.int32)
    edges = np.asarray(spans.offsets)
    if edges[-1] > edges[0]:
        inner = spans.values
        doc = np.repeat(np.arange(len(spans)), np.diff(edges))
        pick = slice(edges[0], edges[-1])
        np.add.at(step, bounds[doc] + np.asarray(inner.field("lo"))[pick], 1)
        np.add.at(step, bounds[doc] + np.asarray(inner.field("hi"))[pick], -1)
    return np.cumsum(step[:-1]) > 0


def kept_text(w: Windows, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end document, kept bytes, their bounds, units, removed and removed runs a document) block by block."""
    buf, offsets = as_bytes(batch.column("text"))
    spans = batch.column("spans").fill_null(pa.scalar([], batch.column("spans").type)) if batch.column("spans").null_count else batch.column("spans")
    for lo, hi in blocks(offsets):
        part, off = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if w.words:
            starts, ends, bounds = word_spans(part, off)
        else:
            bounds = off
        gone = covered(int(bounds[-1]), bounds, spans.slice(lo, hi - lo))
        run = gone.copy()
        run[1:] &= ~gone[:-1]
        inner = bounds[(bounds > 0) & (bounds < len(gone))]
        run[inner] = gone[inner]
        sums = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (gone, run)]
        removed, runs = (np.diff(s[bounds]) for s in sums)
        if w.words:
            stay = np.flatnonzero(~gone)
            doc = np.searchsorted(bounds, stay, "right") - 1
            last = np.ones(len(stay), bool)
            last[:-1] = doc[1:] != doc[:-1]
            part = part.copy()
            mask = np.zeros(len(part) + 2, np.int32)
            np.add.at(mask, starts[stay], 1)
            np.add.at(mask, ends[stay] + ~last, -1)
            part[ends[stay][~last]] = 32
            keep = np.cumsum(mask[: len(part)]) > 0
        else:
            keep = ~gone
        kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[off]
        yield lo, hi, part[keep], kept, np.diff(bounds), removed, runs


def digests(w: Windows, rows: DataFrame) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept_sha256 of what repeats() returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, kept, bound, units, removed, runs in kept_text(w, batch):
                raw, b = memoryview(np.ascontiguousarray(kept)), bound.tolist()
                sha = [hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(b[:-1], b[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row").field("doc_id").slice(lo, hi - lo), pa.array(units), pa.array(removed), pa.array(runs), pa.array(sha, pa.string())], ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string")


def texts(w: Windows, rows: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What repeats() returned as rows like those of docs: each text without its repeats, n_chars renewed.

    A character that lost a byte goes whole. Documents that nothing is left of are dropped, empty ones stay.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, kept, bound, _, removed, _ in kept_text(w, batch):
                raw, b = kept.tobytes(), bound.tolist()
                null = np.asarray(batch.column("text").is_null())[lo:hi]
                out = [None if z else raw[s:e].decode("utf-8", "ignore") for s, e, z in zip(b[:-1], b[1:], null, strict=True)]
                stay = pa.array([not r or bool(t) for t, r in zip(out, removed.tolist(), strict=True)])
                row = batch.column("row").slice(lo, hi - lo)
                chars = pa.array([None if t is None else len(t) for t in out], pa.int64())
                columns = [pa.array(out, pa.string()) if c == text_col else chars if c == "n_chars" else row.field("doc_id" if c == id_col else f"_{c}") for c in names]
                yield pa.RecordBatch.from_arrays(columns, names).filter(stay)

    schema = T.StructType([T.StructField(f.name, T.LongType() if f.name in (id_col, "n_chars") else f.dataType) for f in docs.schema.fields])
    return rows.mapInArrow(run, schema)
