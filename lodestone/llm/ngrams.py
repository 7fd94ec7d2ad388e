"""Operator 6: language-model scoring with an n-gram trie of Elias-Fano levels in memory-mapped files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import _planes, _unplanes
from .common import plan_bytes, prepare, shared_dir, word_hashes, words_by_block
from .eliasfano import Bundles, EliasFano, bundle_count, bundle_files, write_arrays

ORDER, MIN_COUNT, DISCOUNT, ADD = 3, 1, 0.75, 0.1
#: Bytes of input for each shard of a model, and tokens that a task gathers before it sends their counts.
SHARD_BYTES, GATHER = 8 << 20, 2_000_000
#: The end of a text and the place before it, as word hashes (63 bits).
END, START = 0x1F0E_0D0C_0B0A_0908, 0x2E3D_4C5B_6A79_8897
_CODEC = pa.Codec("zstd", 1)
_STEP = 2048.0


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities, a 2048th of a decade apart, down to 1e-30: below any share of a count."""
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-30)) * _STEP), 0, 65535).astype(np.uint16)


_VALUES = 10.0 ** (-np.arange(65536) / _STEP)


def local_path(path: str) -> str:
    u = urlparse(path)
    if u.scheme not in ("", "file"):
        raise ValueError("memory-mapped models need a shared folder that is mounted (file:)")
    return u.path


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    body = _planes(np.diff(keys, prepend=np.uint64(0))) + _planes(counts.astype(np.uint64))
    return len(keys).to_bytes(8, "little") + _CODEC.compress(body, asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(_CODEC.decompress(blob[8:], 16 * n, asbytes=True), np.uint8)
    return np.cumsum(_unplanes(raw[: 8 * n], n, np.uint64), dtype=np.uint64), _unplanes(raw[8 * n :], n, np.uint64).astype(np.int64)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end document, word hashes, first place of each document): START, the words, END of each, by block."""
    for lo, hi, part, starts, ends, first in words_by_block(column, lower=True):
        h = (word_hashes(part, starts, ends) >> np.uint64(1)).astype(np.int64)
        bounds = first + 2 * np.arange(hi - lo + 1)
        out = np.empty(len(h) + 2 * (hi - lo), np.int64)
        own = np.ones(len(out), bool)
        own[bounds[:-1]] = own[bounds[1:] - 1] = False
        out[own] = h
        out[bounds[:-1]], out[bounds[1:] - 1] = START, END
        yield lo, hi, out, bounds


def places(bounds: np.ndarray) -> np.ndarray:
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))


class Level:
    """Successors of every context: pointers, ids made monotone by the last value before each context's range."""

    def __init__(self, arrays: list[np.ndarray]):
        self.pointers, self.ids = EliasFano(arrays[:5]), EliasFano(arrays[5:10])
        self.codes, self.back = arrays[10], arrays[11]

    @staticmethod
    def arrays(contexts: int, context: np.ndarray, word: np.ndarray, count: np.ndarray, keep: np.ndarray, discount: float) -> list[np.ndarray]:
        total = np.bincount(context, count, contexts)
        own = context[keep]
        alpha = (count[keep] - discount) / total[own]
        left = total - np.bincount(own, count[keep] - discount, contexts)  # of whole counts: 1 less the shares would lose the least
        back = np.where(total > 0, np.clip(left / np.maximum(total, 1), 0, 1), 1.0)
        size = np.bincount(own, minlength=contexts)
        pointers = np.concatenate([[0], np.cumsum(size)])
        ids = word[keep]
        filled = np.flatnonzero(size)
        width = ids[pointers[filled + 1] - 1] + 1
        lift = np.zeros(contexts, np.int64)
        lift[filled] = np.cumsum(width) - width
        return [*EliasFano.arrays(pointers), *EliasFano.arrays(ids + lift[own]), quantise(alpha), quantise(back)]

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Entry of each (context, word), contexts ascending, -1 if none: the successor of the word among those of its
        context. A context's range is looked up once."""
        first = np.flatnonzero(np.diff(context, prepend=-1))
        one = context[first]
        lo, hi = self.pointers.get(one), self.pointers.get(one + 1)
        lift = np.zeros(len(one), np.int64)
        inner = np.flatnonzero((lo > 0) & (lo < hi))
        lift[inner] = self.ids.get(lo[inner] - 1) + 1
        of = np.repeat(np.arange(len(one)), np.diff(np.append(first, len(context))))
        rows = np.flatnonzero((lo < hi)[of] & (word >= 0))
        of = of[rows]
        i = self.ids.index(lift[of] + word[rows])
        ok = (i >= lo[of]) & (i < hi[of])
        out = np.full(len(context), -1, np.int64)
        out[rows[ok]] = i[ok]
        return out


@dataclass(frozen=True)
class Model:
    """Where a model lies and its totals. Shard s of level 1 has the words whose hash begins with s; those of the other
    levels have equal ranges of contexts, so that what follows a frequent word is spread over many."""

    path: str
    bits: int
    order: int
    words: int
    tokens: int
    #: Global numbers of the first word of each shard, and for each level of its first entry.
    offsets: tuple[np.ndarray, ...]

    @property
    def size(self) -> int:
        """Numbers of words, START's among them."""
        return int(self.offsets[0][-1])

    def bounds(self, level: int) -> np.ndarray:
        """Where the contexts of each shard of a level begin: entries of the level before, by number."""
        shards = 1 << self.bits
        return np.array([int(self.offsets[level - 2][-1]) * s // shards for s in range(shards + 1)], np.int64)


class Reader:
    """The mapped bundles of a model; a shard's arrays are looked at when they are first needed."""

    def __init__(self, model: Model, levels: int):
        self.model = model
        self.bundles = {k: Bundles(f"{model.path}/level{k}", model.bits) for k in range(1, levels + 1)}
        self.bounds = {k: model.bounds(k) for k in range(2, levels + 1)}
        self.held: dict[tuple[int, int], object] = {}

    def shard(self, level: int, s: int):  # noqa: ANN201
        """(vocabulary, counts) of level 1, a Level of the others, None where there is nothing."""
        if (level, s) not in self.held:
            a = self.bundles[level].arrays(s)
            self.held[level, s] = None if a is None else (EliasFano(a[:5]), a[5]) if level == 1 else Level(a)
        return self.held[level, s]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word number or -1, count) of ascending hashes."""
        out, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shift = 63 - self.model.bits
        edges = np.append(np.searchsorted(hashes, np.arange(1 << self.model.bits) << shift), len(hashes))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[s], edges[s + 1]
            if (found := self.shard(1, s)) is None:
                continue
            v, counts = found
            i = v.index(hashes[a:b] - (s << shift))
            hit = np.flatnonzero(i >= 0)
            out[a + hit] = i[hit] + self.model.offsets[0][s]
            count[a + hit] = counts[i[hit]]
        return out, count

    def step(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry or -1, its discounted share, weight of the shorter context) for ascending contexts >= 0."""
        out, alpha, back = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.ones(len(context))
        bounds = self.bounds[level]
        edges = np.searchsorted(context, bounds)
        for s in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[s], edges[s + 1]
            if (table := self.shard(level, s)) is None:
                continue
            local = context[a:b] - bounds[s]
            i = table.find(local, word[a:b])
            hit = np.flatnonzero(i >= 0)
            alpha[a + hit] = _VALUES[table.codes[i[hit]]]
            back[a:b] = _VALUES[table.back[local]]
            out[a + hit] = i[hit] + (self.model.offsets[level - 1][s] if len(self.model.offsets) >= level else 0)
        return out, alpha, back


_readers: dict[tuple[str, int], Reader] = {}


def reader(model: Model, levels: int) -> Reader:
    key = (model.path, levels)
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(model, levels)
    return _readers[key]


def numbers(r: Reader, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number or -1, count) of hashes in any order."""
    found, back = np.unique(hashes, return_inverse=True)
    number, count = r.look_up(found)
    return number[back], count[back]


def contexts(r: Reader, level: int, entry: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a context at this level, its number): the entry of the level before one token earlier."""
    context = np.concatenate([[-1], entry[:-1]])
    rows = np.flatnonzero((place >= level - 1) & (context >= 0))
    return rows, context[rows]


def joint_keys(r: Reader, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    wide = r.model.size + 1
    if len(context) and (int(context.max()) + 1) * wide >= 1 << 64:
        raise ValueError("the model is too large for 64-bit n-gram keys: raise min_count")
    return context.astype(np.uint64) * np.uint64(wide) + (word + 1).astype(np.uint64)


def descend(r: Reader, level: int, entry: np.ndarray, word: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a context, their shares and weights, entries of all rows at this level)."""
    rows, context = contexts(r, level, entry, place)
    keys, back = np.unique(joint_keys(r, context, word[rows]), return_inverse=True)
    wide = np.uint64(r.model.size + 1)
    of = keys // wide
    e, a, b = r.step(level, of.astype(np.int64), (keys - of * wide).astype(np.int64) - 1)
    out = np.full(len(word), -1, np.int64)
    out[rows] = e[back]
    return rows, a[back], b[back], out


def _count_words(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            n = np.where(h == START, 0, n)
            shard = h >> (63 - bits)
            edges = np.searchsorted(shard, np.arange((1 << bits) + 1))
            some = np.flatnonzero(np.diff(edges))
            blobs = [_pack(h[edges[s] : edges[s + 1]].astype(np.uint64), n[edges[s] : edges[s + 1]]) for s in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

        for batch in batches:
            for _, _, h, _ in tokens(batch.column("text")):
                parts.append(h)
                size += len(h)
                if size >= GATHER:
                    yield flush()
                    parts, size = [], 0
        if parts:
            yield flush()

    return run


def _write_words(path: str, bits: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        h, n = _merge(*(np.concatenate(x) for x in zip(*(_unpack(b) for b in table.column("blob").to_pylist()), strict=True)))
        write_arrays(f"{path}/level1-{shard:06d}", [*EliasFano.arrays(h - np.uint64(shard << (63 - bits))), n.astype(np.uint32 if n.max() < 1 << 32 else np.int64)])
        return pa.table([pa.array([shard], pa.int32()), pa.array([len(h)]), pa.array([int(n.sum())])], ["shard", "entries", "tokens"])

    return run


def _count_grams(model: Model, level: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reader(model, level - 1)
        wide = np.uint64(model.size + 1)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            word, _ = numbers(r, h)
            entry = word
            for k in range(2, level):
                *_, entry = descend(r, k, entry, word, place)
            rows, context = contexts(r, level, entry, place)
            keys, n = np.unique(joint_keys(r, context, word[rows]), return_counts=True)
            bounds = model.bounds(level)
            edges = np.searchsorted((keys // wide).astype(np.int64), bounds)
            some = np.flatnonzero(np.diff(edges))
            blobs = [_pack(keys[edges[s] : edges[s + 1]] - np.uint64(bounds[s]) * wide, n[edges[s] : edges[s + 1]]) for s in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

        for batch in batches:
            for _, _, h, bounds in tokens(batch.column("text")):
                parts.append((h, places(bounds)))
                size += len(h)
                if size >= GATHER:
                    yield flush()
                    parts, size = [], 0
        if parts:
            yield flush()

    return run


def _write_grams(model: Model, level: int, min_count: int, discount: float) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, n = _merge(*(np.concatenate(x) for x in zip(*(_unpack(b) for b in table.column("blob").to_pylist()), strict=True)))
        wide = np.uint64(model.size + 1)
        of = keys // wide
        context, word = of.astype(np.int64), (keys - of * wide).astype(np.int64) - 1
        bounds = model.bounds(level)
        keep = np.flatnonzero(n >= min_count)
        write_arrays(f"{model.path}/level{level}-{shard:06d}", Level.arrays(int(bounds[shard + 1] - bounds[shard]), context, word, n, keep, discount))
        return pa.table([pa.array([shard], pa.int32()), pa.array([len(keep)]), pa.array([int(n.sum())])], ["shard", "entries", "tokens"])

    return run


_WRITTEN = "shard int, entries long, tokens long"


def _offsets(written: DataFrame, shards: int) -> tuple[np.ndarray, int]:
    """Running entries of the shards (one row each) and all tokens."""
    rows = written.collect()
    sizes = np.zeros(shards, np.int64)
    for x in rows:
        sizes[x["shard"]] = x["entries"]
    return np.concatenate([[0], np.cumsum(sizes)]), sum(x["tokens"] for x in rows)


def _bundle(texts: DataFrame, path: str, level: int, bits: int) -> None:
    """Put a level's shards into at most MOST_BUNDLES files, in parallel."""
    spark = texts.sparkSession
    n = bundle_count(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                bundle_files(f"{path}/level{level}", bits, b)
            yield batch

    spark.range(0, n, 1, min(n, 256)).mapInArrow(run, "id long").agg(F.count(F.lit(1))).collect()


def train(texts: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, discount: float = DISCOUNT, shard_bytes: int = SHARD_BYTES) -> Model:
    """Count n-grams of column `text` (null: empty) level by level and write the model's shards to the shared folder.

    Level 1 has every word. Level n has the n-grams seen at least `min_count` times whose context is in level n - 1,
    with absolutely discounted shares; what the discount and the rare ones leave goes to the shorter context.
    Counts are combined in each task and sent to the shard of their context. Words are told apart by 63-bit hashes.
    Files appear whole or not at all, so that tasks may run again. The driver holds a number for each shard and level.
    """
    spark = texts.sparkSession
    prepare(spark)
    path = local_path(shared_dir(spark))
    os.makedirs(path, exist_ok=True)
    bits = max(4, (max(1, plan_bytes(texts) // shard_bytes)).bit_length())
    counted = texts.select("text").mapInArrow(_count_words(bits), "shard int, blob binary")
    offsets, n = _offsets(counted.groupBy("shard").applyInArrow(_write_words(path, bits), _WRITTEN), 1 << bits)
    _bundle(texts, path, 1, bits)
    model = Model(path, bits, order, max(0, int(offsets[-1]) - 1), n, (offsets,))
    for level in range(2, order + 1):
        counted = texts.select("text").mapInArrow(_count_grams(model, level), "shard int, blob binary")
        offsets, _ = _offsets(counted.groupBy("shard").applyInArrow(_write_grams(model, level, min_count, discount), _WRITTEN), 1 << bits)
        _bundle(texts, path, level, bits)
        model = Model(path, bits, order, model.words, n, (*model.offsets, offsets))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every text.

    base_score adds log10((c + 0.1) / (N + 0.1 (V + 1))) over the words and the end. score interpolates: the
    probability by the longer context is its discounted share plus its weight times that by the shorter one, from
    the base's up; a context that the model doesn't have changes nothing. Null text is empty: the end alone. Null
    and repeated ids are kept, a row each. A model of no texts gives every token the base's one probability.
    """
    prepare(docs.sparkSession)
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.value
        r = reader(model, model.order)
        rest = model.tokens + ADD * (model.words + 1)
        ids: list[pa.Array] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h = np.concatenate([p[0] for p in parts])
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
            place = places(bounds)
            word, count = numbers(r, h)
            base = (count + ADD) / rest
            p, entry = base.copy(), word
            for level in range(2, model.order + 1):
                rows, share, weight, entry = descend(r, level, entry, word, place)
                p[rows] = share + weight * p[rows]
            real = place > 0
            logs = [np.add.reduceat(np.where(real, np.log10(x), 0.0), bounds[:-1]) for x in (base, np.minimum(p, 1.0))]
            known = np.add.reduceat((real & (count > 0)).astype(np.int64), bounds[:-1])
            n = len(bounds) - 1
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(np.diff(bounds) - 1), pa.array(known), pa.array(np.full(n, model.tokens)), pa.array(logs[0]), pa.array(logs[1])], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for batch in batches:
            for lo, hi, h, bounds in tokens(batch.column("text")):
                ids.append(batch.column("doc_id").slice(lo, hi - lo))
                parts.append((h, bounds))
                if sum(len(p[0]) for p in parts) >= GATHER // 2:
                    yield flush()
                    ids, parts = [], []
        if parts:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(id_col: str = "doc_id", folds: int = 10) -> Column:
    """Whether crc32 of the id as text leaves 0; a null id is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == 0, F.lit(False))


def score_documents(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Train on the documents that aren't held out and score all: what score() gives, and held_out.

    Texts are read whole, a block of documents at a time and a longer one by itself; null and empty ones are the end
    alone. Null ids are learned from and not held out; rows that repeat an id count each. Other columns may have any
    names. No rows: none. Without any training text every token has the base's one probability.
    """
    scored = score(docs, train(docs.where(~held_out()).select("text"), min_count=min_count))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERY = {"op6_lm_score": lambda spark, sf_dir: score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
ORACLE: dict[str, str] = {}
