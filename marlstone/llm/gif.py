"""GIF as a media column: byte payloads stored as the pixels of timed frames, and frames read back.

The decoder follows the format: LZW code streams with growing code widths and clear codes, local and
global palettes, interlacing, transparency, and the disposal rules between frames.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType


#: Pixels of a row of a stored frame, rows of a frame at most, and hundredths of a second that it is shown.
WIDTH, ROWS, DELAY = 576, 64, 4

#: The stored palette: colour k has 3 bits of red, 3 of green, 2 of blue.
_K = np.arange(256)
PALETTE = np.stack([(_K >> 5) * 255 // 7, (_K >> 2 & 7) * 255 // 7, (_K & 3) * 85], axis=1).astype(np.uint8)

#: Data codes between two clear codes: the code table is then full.
_RUN = 4096 - 258 - 1


def _widths(first: int, n: int, start: int = 9) -> np.ndarray:
    """Bits of the codes first .. first + n - 1 after a clear code, for codes that start with this many bits."""
    size = (1 << (start - 1)) + 1 + np.maximum(np.arange(first, first + n), 1)
    return np.clip(np.floor(np.log2(size)).astype(np.int64) + 1, start, 12)


_RUN_WIDTHS = _widths(0, _RUN + 1)


def lzw_encode(pixels: bytes) -> bytes:
    """The code stream of 8-bit pixels: a clear code, then runs of codes parted by clear codes, then the end code."""
    codes, table, free, bounds = [256], {}, 258, [1]
    put, get = codes.append, table.get
    rest = iter(pixels)
    current = next(rest, None)
    for byte in rest:
        key = (current, byte)
        known = get(key)
        if known is None:
            put(current)
            table[key] = free
            free += 1
            current = byte
            if free == 4095:
                put(256)
                bounds.append(len(codes))
                table.clear()
                free = 258
        else:
            current = known
    if current is not None:
        put(current)
    put(257)
    size = np.concatenate([[9], *(_RUN_WIDTHS[:n] for n in np.diff([*bounds, len(codes)]))])
    at = np.cumsum(size) - size
    value, place, n = np.array(codes) << (at & 7), at >> 3, int(at[-1] + size[-1] + 7) // 8
    out = sum(np.bincount(place + k, value >> (8 * k) & 255, minlength=n + 2) for k in range(3))
    return out[:n].astype(np.uint8).tobytes()


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """The pixels of one run of codes.

    The entry that code k made is what code k and one pixel more put out; so each pixel of a later
    code that names the entry is a copy of an earlier pixel, and following copies of copies, twice
    as far each time, ends at pixels that codes gave themselves.
    """
    entry = codes.astype(np.int64) - clear - 2
    literal = entry < 0
    order = np.arange(len(codes))
    if (entry >= np.maximum(order, 1)).any():
        raise ValueError("a code names an entry that isn't made yet")
    back = np.where(literal, order, entry)
    more, hop = np.where(literal, 0, 1), back.copy()
    while (hop != hop[hop]).any():
        more, hop = more + more[hop], hop[hop]
    length = 1 + more
    start = np.cumsum(length) - length
    source = np.arange(int(length.sum())) - np.repeat(start - start[back], length)
    while (source != (further := source[source])).any():
        source = further
    pixel = np.zeros(len(source), np.uint8)
    pixel[start[literal]] = codes[literal]
    return pixel[source]


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """At most `most` pixels of a code stream whose pixels have this many bits."""
    stream = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    clear, end, total = 1 << bits, (1 << bits) + 1, len(data) * 8
    parts, held, made, at, count = [], [], 0, 0, 0
    while at < total and made < most:
        size = _RUN_WIDTHS if bits == 8 and not count else _widths(count, 4096, bits + 1)
        ends = at + np.cumsum(size)
        size, ends = size[ends <= total], ends[ends <= total]
        if not len(ends):
            break
        begin = ends - size
        place = begin >> 3
        codes = (stream[place] | stream[place + 1] << 8 | stream[place + 2] << 16) >> (begin & 7) & (1 << size) - 1
        stops = np.flatnonzero((codes == clear) | (codes == end))
        held.append(codes[: stops[0]] if len(stops) else codes)
        at, count = int(ends[stops[0] if len(stops) else -1]), count + len(codes)
        if len(stops):
            parts.append(_expand(np.concatenate(held), clear))
            made, held, count = made + len(parts[-1]), [], 0
            if codes[stops[0]] == end:
                break
    if held:
        parts.append(_expand(np.concatenate(held), clear))
    return np.concatenate([np.zeros(0, np.uint8), *parts])[:most].tobytes()


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[k : k + 255] for k in range(0, len(data), 255))) + b"\0"


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames hold the payload, of a positive multiple of width, as pixels in reading order."""
    height = min(rows, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), PALETTE.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for at in range(0, len(payload), width * rows):
        frame = payload[at : at + width * rows]
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(frame) // width, 0), b"\x08", _blocks(lzw_encode(frame))]
    return b"".join([*out, b";"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    pixels: np.ndarray  # palette indices, (height, width)
    canvas: np.ndarray  # RGB after this frame is drawn, (screen height, screen width, 3), its own copy


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF in order. A ValueError tells of what isn't one, or is cut off."""
    try:
        yield from _frames(data)
    except (IndexError, struct.error) as error:
        raise ValueError("a GIF is cut off") from error


def _frames(data: bytes) -> Iterator[Frame]:
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    screen_width, screen_height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None

    def colours(at: int, flags: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        n = 2 << (flags & 7)
        table = np.zeros((256, 3), np.uint8)
        if at + 3 * n > len(data):
            raise ValueError("a palette is cut off")
        table[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        return table, at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        found = []
        while n := data[at]:
            if at + 1 + n > len(data):
                raise ValueError("a block is cut off")
            found.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(found), at + 1

    shared, at = colours(at, flags)
    canvas = np.zeros((screen_height, screen_width, 3), np.uint8)
    disposal, delay, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("not a block of a GIF")
        left, top, width, height, flags = struct.unpack_from("<HHHHB", data, at + 1)
        local, at = colours(at + 10, flags)
        bits = data[at]
        body, at = blocks(at + 1)
        drawn = lzw_decode(body, bits, width * height)
        if len(drawn) < width * height:
            raise ValueError("a frame lacks pixels")
        pixels = np.frombuffer(drawn, np.uint8).reshape(height, width)
        if flags & 0x40:  # rows come in four passes
            order = np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            pixels = pixels[np.argsort(order)]
        before = canvas.copy() if disposal == 3 else None
        table = local if local is not None else shared if shared is not None else PALETTE
        part = canvas[top : top + height, left : left + width]
        drawn = table[pixels[: part.shape[0], : part.shape[1]]]
        if transparent is None:
            part[:] = drawn
        else:
            shown = pixels[: part.shape[0], : part.shape[1]] != transparent
            part[shown] = drawn[shown]
        yield Frame(left, top, width, height, delay, disposal, transparent, pixels, canvas.copy())
        if disposal == 2:
            part[:] = 0
        elif disposal == 3:
            canvas = before
        disposal, delay, transparent = 0, 0, None
    if at >= len(data):
        raise ValueError("a GIF has no end")


def histogram(canvas: np.ndarray) -> list[int]:
    """Pixels of a canvas by 8 reds, 8 greens and 4 blues: 20 counts."""
    pixel = canvas.reshape(-1, 3).astype(np.int64)
    bins = np.bincount((pixel[:, 0] >> 5) << 5 | (pixel[:, 1] >> 5) << 2 | pixel[:, 2] >> 6, minlength=256).reshape(8, 8, 4)
    return [*bins.sum(axis=(1, 2)).tolist(), *bins.sum(axis=(0, 2)).tolist(), *bins.sum(axis=(0, 1)).tolist()]


_FRAME = StructType().add("width", "integer").add("height", "integer").add("delay", "integer").add("disposal", "integer").add("histogram", ArrayType(IntegerType()))
_FRAMES = StructType().add("payload", "binary").add("frames", ArrayType(_FRAME))


@partial(F.arrow_udf, returnType=StructType().add("n_bytes", "long").add("media", "binary"))
def _to_gif(texts: pa.Array) -> pa.Array:
    sizes, media = [], []
    for text in pc.fill_null(texts, "").to_pylist():
        data = text.encode()
        sizes.append(len(data))
        media.append(encode(data + b"\xff" * (-len(data) % WIDTH if data else WIDTH)))
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["n_bytes", "media"])


def _frames_type() -> pa.DataType:
    frame = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("delay", pa.int32()), ("disposal", pa.int32()), ("histogram", pa.list_(pa.int32()))])
    return pa.struct([("payload", pa.binary()), ("frames", pa.list_(frame))])


@partial(F.arrow_udf, returnType=_FRAMES)
def _from_gif(media: pa.Array) -> pa.Array:
    out = []
    for item in media:
        if not item.is_valid:
            out.append(None)
            continue
        payload, frames = [], []
        for f in decode(item.as_py()):
            payload.append(f.pixels.tobytes())
            frames.append({"width": f.width, "height": f.height, "delay": f.delay, "disposal": f.disposal, "histogram": histogram(f.canvas)})
        out.append({"payload": b"".join(payload), "frames": frames})
    return pa.array(out, _frames_type())


def encoded(text: Column) -> Column:
    """struct(n_bytes, media): UTF-8 of a text (null: empty), filled up with bytes 255 to a positive multiple of WIDTH, as a GIF."""
    return _to_gif(text)


def decoded(media: Column) -> Column:
    """struct(payload, frames) of a GIF: all pixels' indices in order, and each frame's size, delay, disposal and the
    colour histogram of the screen once it is drawn. Null for null; what isn't a GIF fails the query."""
    return _from_gif(media)


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of each row; repeated rows stay, ids may be null, other columns are not looked at.

    A null or empty text is one row of bytes 255. A very long text is many frames, made one after another. An empty table gives no rows.
    """
    return docs.select(F.col(id_column).alias("doc_id"), encoded(F.col(text_column)).alias("gif")).select("doc_id", "gif.n_bytes", "gif.media")


def features(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, payload, frames) of stored media, read back; null media are null. An empty table gives no rows."""
    return stored.withColumn("read", decoded(F.col("media"))).select("doc_id", "n_bytes", "media", "read.payload", "read.frames")
