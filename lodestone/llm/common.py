"""Shared pieces of the training-data operators: shared-folder tables, checked lookups, Arrow text buffers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels hold expanded at one time; one longer document is held whole.
BLOCK = 1 << 20
#: Rows up to which a lookup table is sent to every executor.
BROADCAST_ROWS = 20_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_K1, _K2, _K3 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def prepare(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes as well, so that very long texts don't fill a worker; workers find this package."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "4096"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    here, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (here, known)))


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir).

    Where the setting is absent, a local session gets a temporary folder of its own; a cluster is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: ends the lineage and outlives any executor."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that df is made from (for a scan: its files); 16 MB a partition if it has none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < 1 << 60 else shuffle_partitions(df.sparkSession) << 24


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], salt: Column, how: str = "left", salts: int = 32) -> DataFrame:
    """left ⋈ right, where right has one row a key and left may have a hot key.

    A right side of at most BROADCAST_ROWS rows, by count, is broadcast; a larger one is repeated for each of
    `salts` salts, so that no key of left goes to one task. Null keys match null keys.
    """
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    if other.count() <= BROADCAST_ROWS:
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        joined = left.join(F.broadcast(other), on, how)
    else:
        other = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        left = left.withColumn("__s", F.pmod(salt, F.lit(salts)).cast("int"))
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__s") == F.col("__salt")]
        joined = left.join(other, on, how).drop("__s", "__salt")
    return joined.drop(*[f"__{k}" for k in keys])


# --- Arrow text as byte arrays


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary()) if column.null_count == 0 else column.fill_null("").cast(pa.large_binary())
    else:
        column = column.fill_null(b"").cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most `limit` bytes together; a longer document comes by itself."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every document, and the index of the first word of each (one more at the end)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SEPARATOR[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs: a bijection of b for any a, and of a for any b, that is no polynomial of either."""
    x = a * _K1
    x ^= x >> np.uint64(29)
    x += b
    x *= _K2
    x ^= x >> np.uint64(32)
    return x


class Spans:
    """Hashes of any spans of a sequence of 64-bit values.

    Those of spans of 1, 2, 4, ... values are joined from halves; a span is known by the two of them that cover it
    from its ends, and its length. Unlike sums of powers these have no structured texts that collide.
    """

    def __init__(self, values: np.ndarray):
        self.levels = [values.astype(np.uint64)]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(_join(last[:-half], last[half:]) if len(last) > half else last[:0])
        return self.levels[k]

    def grams(self, n: int) -> np.ndarray:
        """Of all spans of n values."""
        k = n.bit_length() - 1
        level, over = self._level(k), n - (1 << k)
        return mix64(_join(level[: len(level) - over], level[over:]) + np.uint64(n * int(_K3) & (1 << 64) - 1))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the spans from starts to ends; 0 for empty ones."""
        size = ends - starts
        out = np.zeros(len(size), np.uint64)
        kind = np.frexp(np.maximum(size, 0))[1] - 1
        for k in range(int(kind.max(initial=-1)) + 1):
            rows = np.flatnonzero((kind == k) & (size > 0))
            if len(rows):
                level = self._level(k)
                out[rows] = mix64(_join(level[starts[rows]], level[ends[rows] - (1 << k)]) + size[rows].astype(np.uint64) * _K3)
        return out


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a buffer by their bytes, eight at a time; spans of over 32 bytes have their XXH64."""
    size = ends - starts
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = size.astype(np.uint64) * _K3
    rows, at, left = np.arange(len(size)), starts, size
    for k in range(4):
        if k:
            more = np.flatnonzero(left > 8)
            if not len(more):
                break
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
        out[rows] = _join(out[rows], words[at] & _MASKS[np.minimum(left, 8)])
    long = np.flatnonzero(size > 32)
    if len(long):
        raw = memoryview(np.ascontiguousarray(buf))
        for i in long.tolist():
            out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    return mix64(out)


def words_by_block(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, end document, bytes, starts, ends, first word of each document) block by block."""
    buf, offsets = as_bytes(column)
    for lo, hi in blocks(offsets):
        part = buf[offsets[lo] : offsets[hi]]
        if lower:
            part = ASCII_LOWER[part]
        starts, ends, first = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
        yield lo, hi, part, starts, ends, first


def lower_az(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def weighted_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """left ⋈ right on `key`; `weight` is how many of left's `total` rows have right's key.

    Keys of over a thousandth of the rows, of which there are under 1000, are joined by broadcast; no other key is
    large enough to fill a task.
    """
    bound = max(1000, total // 1000)
    hot, rest = right.where(F.col(weight) > bound), right.where(F.col(weight) <= bound)
    keys = hot.select(F.col(key).alias("__hot"))
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(keys), F.col(key) == F.col("__hot"), "left_anti").join(rest, key))
