"""Elias-Fano sequences in memory-mapped files, searched for many keys at once."""

from __future__ import annotations

import contextlib
import os
import shutil
import struct
import uuid
from collections.abc import Sequence

import numpy as np

_MAGIC = b"EFT1"
_U = np.uint64
_BYTES, _HIGH = _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of the k-th set bit of each byte.
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _on = [i for i in range(8) if _b >> i & 1]
    _SELECT[_b, : len(_on)] = _on


def write_arrays(path: str, arrays: Sequence[np.ndarray]) -> None:
    """Write arrays one after the other, 8-byte aligned; the file appears whole or not at all."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        heads = [(a.dtype.str.encode().ljust(8), len(a)) for a in arrays]
        f.write(_MAGIC + struct.pack("<I", len(arrays)) + b"".join(struct.pack("<8sQ", *h) for h in heads))
        for a in arrays:
            raw = np.ascontiguousarray(a).tobytes()
            f.write(raw + b"\0" * (-len(raw) % 8))
    os.replace(temporary, path)


#: Files of a level, each of the arrays of a range of shards.
MOST_BUNDLES = 64


def bundle_count(bits: int) -> int:
    return min(MOST_BUNDLES, 1 << bits)


def _shards(bits: int, bundle: int) -> range:
    each = (1 << bits) // bundle_count(bits)
    return range(bundle * each, (bundle + 1) * each)


def bundle_files(name: str, bits: int, bundle: int) -> None:
    """Put the files `name`-shard of a bundle's shards into one, behind a table of where each begins; then remove them.

    Whoever finds the bundle made by an earlier attempt only removes what is left.
    """
    target = f"{name}-bundle{bundle:03d}"
    shards = _shards(bits, bundle)
    own = [f"{name}-{s:06d}" for s in shards]
    if not os.path.exists(target):
        temporary = f"{target}.{uuid.uuid4().hex}"
        with open(temporary, "wb") as f:
            sizes = [os.path.getsize(p) if os.path.exists(p) else 0 for p in own]
            starts = np.cumsum([8 * (len(own) + 1), *sizes]).astype("<i8")
            f.write(starts.tobytes())
            for p, n in zip(own, sizes, strict=True):
                if n:
                    with open(p, "rb") as part:
                        shutil.copyfileobj(part, f, 1 << 20)
        with contextlib.suppress(FileExistsError):  # an attempt that removes parts has made the bundle
            os.link(temporary, target)
        os.remove(temporary)
    for p in own:
        with contextlib.suppress(FileNotFoundError):
            os.remove(p)


class Bundles:
    """The arrays of a level's shards in its mapped bundles."""

    def __init__(self, name: str, bits: int):
        self.name, self.bits, self.each = name, bits, (1 << bits) // bundle_count(bits)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def arrays(self, shard: int) -> list[np.ndarray] | None:
        b = shard // self.each
        if b not in self.open:
            raw = np.memmap(f"{self.name}-bundle{b:03d}", np.uint8, "r")
            self.open[b] = raw, raw[: 8 * (self.each + 1)].view("<i8")
        raw, starts = self.open[b]
        lo, hi = (int(starts[shard % self.each + k]) for k in (0, 1))
        return map_arrays(raw[lo:hi]) if hi > lo else None


def map_arrays(raw: np.ndarray) -> list[np.ndarray]:
    if raw[:4].tobytes() != _MAGIC:
        raise ValueError("these are no arrays")
    (n,) = struct.unpack("<I", raw[4:8].tobytes())
    at, out = 8 + 16 * n, []
    for k in range(n):
        kind, size = struct.unpack("<8sQ", raw[8 + 16 * k : 24 + 16 * k].tobytes())
        dtype = np.dtype(kind.strip().decode())
        out.append(raw[at : at + size * dtype.itemsize].view(dtype))
        at += -(-size * dtype.itemsize // 8) * 8
    return out


def _bits(places: np.ndarray, size: int) -> np.ndarray:
    """64-bit words with the bits at ascending places set."""
    words = np.zeros(size // 64 + 1, _U)
    if len(places):
        w = places >> 6
        first = np.flatnonzero(np.diff(w, prepend=-1))
        words[w[first]] = np.bitwise_or.reduceat(_U(1) << (places & 63).astype(_U), first)
    return words


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, zeros: bool) -> np.ndarray:
    """Place of the k-th (from 0) set or unset bit, given how many lie before each word."""
    at = np.searchsorted(before, k.astype(before.dtype), "right") - 1  # of one type, else all of `before` is copied
    w = words[at]
    if zeros:
        w = ~w
    rest = k.astype(_U) - before[at].astype(_U)
    # in each byte of `upto` the bits set up to it; bytes whose sums are at most `rest` come before the one that is sought
    upto = w - ((w >> _U(1)) & _U(0x5555555555555555))
    upto = (upto & _U(0x3333333333333333)) + ((upto >> _U(2)) & _U(0x3333333333333333))
    upto = ((upto + (upto >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _BYTES
    which = np.bitwise_count(((rest * _BYTES | _HIGH) - upto) & _HIGH).astype(_U) << _U(3)
    rest -= ((upto << _U(8)) >> which) & _U(255)
    return at * 64 + which.astype(np.int64) + _SELECT[((w >> which) & _U(255)).astype(np.int64), rest.astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence below 2**63: low bits packed, high parts in unary with counts before every word."""

    PARTS = 5

    def __init__(self, arrays: Sequence[np.ndarray]):
        self.head, self.low, self.high, self.ones, self.zeros = arrays
        self.n, self.bits = int(self.head[0]), int(self.head[1])
        self.top = int(self.head[2])

    @staticmethod
    def arrays(values: np.ndarray) -> list[np.ndarray]:
        values = values.astype(_U)
        n = len(values)
        last = int(values[-1]) if n else 0
        bits = max(0, (last // n).bit_length() - 1) if n else 0
        low = np.zeros(n * bits // 64 + 2, _U)
        if bits and n:
            part = values & _U((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(_U)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[first]] |= np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero((at & 63) + bits > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - shift[over]))
        top = last >> bits
        high = _bits((values >> _U(bits)).astype(np.int64) + np.arange(n), n + top + 1)
        per = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(per)])
        zeros = np.arange(len(high) + 1) * 64 - ones
        small = np.uint32 if max(n, int(zeros[-1])) < 1 << 32 else _U
        return [np.array([n, bits, top], _U), low, high, ones[:-1].astype(small), zeros[:-1].astype(small)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(_U)
        x = self.low[word] >> shift
        x |= np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return x & _U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        if not len(i):
            return np.zeros(0, np.int64)
        high = _select(self.high, self.ones, i, False) - i
        return (high << self.bits) | self._low(i).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key would be inserted before its equals: the index of its successor (n if none)."""
        out = np.full(len(keys), self.n, np.int64)
        rows = np.flatnonzero((keys >> self.bits) <= self.top) if self.n else np.zeros(0, np.int64)
        if not len(rows):
            return out
        keys = keys[rows]
        h = keys >> self.bits
        hi = _select(self.high, self.zeros, h, True) - h
        lo = np.where(h > 0, _select(self.high, self.zeros, np.maximum(h - 1, 0), True) - (h - 1), 0)
        low = (keys & ((1 << self.bits) - 1)).astype(_U)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < low[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        out[rows] = lo
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 where it is not in the sequence."""
        i = self.find(keys)
        ok = np.flatnonzero(i < self.n)
        hit = self.get(i[ok]) == keys[ok]
        out = np.full(len(keys), -1, np.int64)
        out[ok[hit]] = i[ok[hit]]
        return out
