"""Operator 4: media columns. GIF codec (LZW streams, palettes, transparency, disposal, timing) and frame features."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

GREY = bytes(v for i in range(256) for v in (i, i, i))
#: 256 different colours: three bits of red and green, two of blue. A sample is the index of its colour.
COLOURS = np.array([((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85) for i in range(256)], np.uint8)
#: The index that repeats what the canvas shows, where the samples leave it free; no text in UTF-8 has this byte.
CLEAR = 255
WIDTH, ROWS = 64, 1024
_RED, _GREEN, _BLUE = (np.zeros(256, np.uint8) for _ in range(3))
for _i, (_r, _g, _b) in enumerate(COLOURS):
    _RED[_r], _GREEN[_g], _BLUE[_b] = _i & 0xE0, _i & 0x1C, _i & 3


class GifError(ValueError):
    """The bytes are no GIF that can be decoded."""


@dataclass
class Frame:
    """One image of a stream: its place, palette indices, and how and how long it shows."""

    left: int
    top: int
    indices: np.ndarray
    palette: np.ndarray
    delay_ms: int = 0
    disposal: int = 0
    transparent: int | None = None
    rgb: np.ndarray | None = field(default=None, repr=False)
    alpha: np.ndarray | None = field(default=None, repr=False)


def _widths(codes: int, low: int) -> np.ndarray:
    """Bits of the 1st, 2nd, ... code after a clear code, which is not counted."""
    size = (1 << low) + 1 + np.arange(codes)  # entries when the code is read
    return np.minimum(12, np.maximum(low + 1, np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) + 1))


_FULL = 4096


def lzw_encode(data: bytes, low: int = 8) -> bytes:
    """LZW code stream of samples below 2**low, least significant bit first, cleared whenever the table is full."""
    clear, stop = 1 << low, (1 << low) + 1
    runs: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    nxt, at = stop + 1, 0
    if data:
        w = data[0]
        it = iter(data)
        next(it)
        for b in it:
            key = w << 8 | b
            c = table.get(key)
            if c is not None:
                w = c
                continue
            codes.append(w)
            w = b
            table[key] = nxt
            nxt += 1
            if nxt == _FULL:
                codes.append(clear)
                runs.append(codes)
                codes, table, nxt = [], {}, stop + 1
        codes.append(w)
    codes.append(stop)
    runs.append(codes)
    values = np.concatenate([[clear], *runs]).astype(np.uint64)
    bits = np.concatenate([[low + 1], *(_widths(len(r), low) for r in runs)]).astype(np.int64)
    ends = np.cumsum(bits)
    starts = ends - bits
    out = np.zeros((int(ends[-1]) + 7) // 8 + 4, np.uint32)
    shifted = values << (starts & 7).astype(np.uint64)
    at = starts >> 3
    for k in range(3):
        np.add.at(out, at + k, ((shifted >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint32))
    return out[: (int(ends[-1]) + 7) // 8].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, low: int, size: int) -> bytes:
    """The first `size` samples of a code stream; GifError if it ends or errs before. Any width and clear policy.

    The places of codes are known up to the next clear code; those of one table are read at a time, and past a full
    table as many again, so that time stays in proportion to the stream.
    """
    clear, stop = 1 << low, (1 << low) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total = len(stream) * 8
    base = [bytes((i,)) for i in range(clear)] + [b"", b""]
    filling = np.cumsum(_widths(_FULL + 2, low))
    beyond = 12 * np.arange(1, _FULL + 1)
    out: list[bytes] = []
    done, bit = 0, 0
    table, prev, read = base.copy(), b"", 0
    full = _FULL - len(table)
    while done < size:
        ends = beyond if read else filling
        n = int(np.searchsorted(ends, total - bit, "right"))
        if n == 0:
            raise GifError("the code stream ends early")
        local = ends[:n]
        wide = np.diff(local, prepend=0)
        start = bit + local - wide
        at = start >> 3
        word = raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16
        found = (word >> (start & 7).astype(np.uint32)) & ((1 << wide) - 1).astype(np.uint32)
        end = np.flatnonzero((found == clear) | (found == stop))
        upto = int(end[0]) if len(end) else n
        push, emit = table.append, out.append
        for k, c in enumerate(found[:upto].tolist(), read):
            if c < len(table):
                entry = table[c]
            elif prev and c == len(table) and k <= full:
                entry = prev + prev[:1]
            else:
                raise GifError("a code before its entry")
            if prev and k <= full:
                push(prev + entry[:1])
            emit(entry)
            done += len(entry)
            prev = entry
        if done >= size:
            break
        if upto < n:
            if found[upto] == stop:
                raise GifError("the code stream ends early")
            table, prev, read = base.copy(), b"", 0
            bit += int(local[upto])
        else:
            read += n
            bit += int(local[-1])
    return b"".join(out)[:size]


def encode(frames: Sequence[np.ndarray], palette: bytes = GREY, delays_ms: Sequence[int] | None = None, disposal: int = 1, transparent: int | None = None) -> bytes:
    """A GIF89a stream of 8-bit index images (rows x columns), each at the canvas's corner."""
    height = max((f.shape[0] for f in frames), default=1)
    width = max((f.shape[1] for f in frames), default=1)
    colours = len(palette) // 3
    low = max(2, (colours - 1).bit_length())
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | (low - 1), 0, 0), palette.ljust(3 << low, b"\0")]
    if len(frames) > 1:
        parts.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
    for k, f in enumerate(frames):
        delay = (delays_ms[k] if delays_ms else 0) // 10
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0")
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, f.shape[1], f.shape[0], 0) + bytes((low,)))
        stream = lzw_encode(np.ascontiguousarray(f, np.uint8).tobytes(), low)
        parts.extend(bytes((len(c),)) + c for c in (stream[i : i + 255] for i in range(0, len(stream), 255)))
        parts.append(b"\0")
    parts.append(b"\x3b")
    return b"".join(parts)


def _chain(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("sub-blocks end early")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1


def parse(data: bytes) -> tuple[int, int, int, list[Frame]]:
    """Canvas width and height, background index and the frames as stored, decoded but not composed."""
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise GifError("no GIF signature")
        width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
        at, shared = 13, None
        if flags & 0x80:
            n = 3 << ((flags & 7) + 1)
            shared = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
            at += n
        frames: list[Frame] = []
        delay, disposal, transparent = 0, 0, None
        while data[at] != 0x3B:
            if data[at] == 0x21:
                label = data[at + 1]
                body, at = _chain(data, at + 2)
                if label == 0xF9:
                    packed, hundredths, index = struct.unpack_from("<BHB", body)
                    delay, disposal, transparent = hundredths * 10, packed >> 2 & 7, index if packed & 1 else None
                continue
            if data[at] != 0x2C:
                raise GifError("unknown block")
            left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if local & 0x80:
                n = 3 << ((local & 7) + 1)
                palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
                at += n
            if palette is None:
                raise GifError("no palette")
            low = data[at]
            if not 1 <= low <= 11:
                raise GifError("bad code size")
            stream, at = _chain(data, at + 1)
            indices = np.frombuffer(lzw_decode(stream, low, w * h), np.uint8).reshape(h, w)
            if local & 0x40:
                order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                plain = np.empty_like(indices)
                plain[order] = indices
                indices = plain
            frames.append(Frame(left, top, indices, palette, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
    except (IndexError, struct.error, ValueError) as e:
        raise e if isinstance(e, GifError) else GifError(str(e)) from e
    return width, height, background, frames


def decode(data: bytes) -> list[Frame]:
    """The frames with what the canvas shows (rgb, alpha) while each is up."""
    width, height, _, frames = parse(data)
    rgb, alpha = np.zeros((height, width, 3), np.uint8), np.zeros((height, width), bool)
    for f in frames:
        h, w = f.indices.shape
        if f.top + h > height or f.left + w > width:
            raise GifError("a frame leaves the canvas")
        if f.indices.size and int(f.indices.max()) >= len(f.palette) and len(f.palette) < 256:
            raise GifError("an index beyond the palette")
        before = (rgb.copy(), alpha.copy()) if f.disposal == 3 else None
        place = np.s_[f.top : f.top + h, f.left : f.left + w]
        shown = np.ones((h, w), bool) if f.transparent is None else f.indices != f.transparent
        if shown.all():
            rgb[place], alpha[place] = f.palette[f.indices], True
        else:
            rgb[place][shown], alpha[place][shown] = f.palette[f.indices[shown]], True
        f.rgb, f.alpha = rgb.copy(), alpha.copy()
        if f.disposal == 2:
            rgb[place], alpha[place] = 0, False
        elif before:
            rgb, alpha = before
    return frames


def pack(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay_ms: int = 100) -> bytes:
    """A payload of a positive multiple of `width` bytes as a colour animation, `rows` rows a frame.

    A frame of which half or more is what the canvas shows leaves that transparent, if the payload has no CLEAR.
    """
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    frames = [image[i : i + rows] for i in range(0, len(image), rows)]
    transparent = CLEAR if len(frames) > 1 and not (image == CLEAR).any() else None
    if transparent is not None:
        for k in range(len(frames) - 1, 0, -1):
            same = frames[k] == frames[k - 1][: len(frames[k])]
            if 2 * np.count_nonzero(same) >= same.size:
                frames[k] = np.where(same, np.uint8(CLEAR), frames[k])
    return encode(frames, COLOURS.tobytes(), [delay_ms] * len(frames), 1, transparent)


def samples(frame: Frame) -> np.ndarray:
    """The samples of pack() that the canvas shows at the frame's place."""
    h, w = frame.indices.shape
    px = frame.rgb[frame.top : frame.top + h, frame.left : frame.left + w]
    return _RED[px[..., 0]] | _GREEN[px[..., 1]] | _BLUE[px[..., 2]]


def unpack(media: bytes) -> tuple[bytes, list[Frame]]:
    """The payload of pack(), read from the colours that the canvas shows, and the frames."""
    frames = decode(media)
    return b"".join(samples(f).tobytes() for f in frames), frames


def histogram(frame: Frame, levels: int = 4) -> np.ndarray:
    """Counts of the visible pixels at the frame's place by colour: `levels` levels of red, of green and of blue."""
    h, w = frame.indices.shape
    place = np.s_[frame.top : frame.top + h, frame.left : frame.left + w]
    level = (np.arange(256) * levels >> 8).astype(np.int64)
    px = frame.rgb[place]
    of = level[px[..., 0]] * (levels * levels) + level[px[..., 1]] * levels + level[px[..., 2]]
    return np.bincount(of[frame.alpha[place]], minlength=levels**3)


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (64 - len(text) if not text else -len(text) % 64)


def _digest(text: bytes) -> tuple:
    media = pack(payload_of(text))
    payload, frames = unpack(media)
    bins = sum(histogram(f) for f in frames)
    feature = f"frames={len(frames)};ms={sum(f.delay_ms for f in frames)};rgb=" + ",".join(map(str, bins.tolist()))
    return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored as a GIF, read back and digested, in one pass without a shuffle.

    The feature has the number of frames, how long they show and the colour histogram of all. Null text is empty text,
    whose payload is 64 zero bytes. Equal texts give equal values. Null and repeated ids are kept, a row each; other
    columns may have any names. One document's frames are held at a time, about 10 times its bytes. No rows: none.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = [_digest((t or "").encode()) for t in (x.as_py() for x in batch.column(1))]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _DIGEST)


def encode_column(docs: DataFrame, column: str, out: str = "media") -> DataFrame:
    """docs with a binary column: the text or bytes of `column` as a GIF (null stays null)."""
    prepare(docs.sparkSession)

    @F.pandas_udf("binary")
    def to_gif(values):  # noqa: ANN001, ANN202
        return values.map(lambda v: None if v is None else pack(payload_of(v if isinstance(v, bytes) else v.encode())))

    return docs.withColumn(out, to_gif(F.col(column)))


def explode_frames(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row a frame: id, frame (from 0), start_ms, delay_ms, width, height, pixels (RGB), histogram (64 colours), error.

    Null media give no row; media that can't be decoded one row with `error` and nulls.
    """
    prepare(media.sparkSession)
    kind = next(f for f in media.schema.fields if f.name == id_col).dataType.simpleString()
    schema = f"id {kind}, frame int, start_ms long, delay_ms long, width int, height int, pixels binary, histogram array<long>, error string"

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            rows = []
            for i, m in zip(pdf["id"], pdf["media"], strict=True):
                if m is None:
                    continue
                try:
                    at = 0
                    for k, f in enumerate(decode(bytes(m))):
                        rows.append((i, k, at, f.delay_ms, f.rgb.shape[1], f.rgb.shape[0], f.rgb.tobytes(), histogram(f).tolist(), None))
                        at += f.delay_ms
                except GifError as e:
                    rows.append((i, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["id", "frame", "start_ms", "delay_ms", "width", "height", "pixels", "histogram", "error"])

    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInPandas(run, schema)


QUERY = {"op4_gif_media": lambda spark, sf_dir: media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
ORACLE: dict[str, str] = {}
