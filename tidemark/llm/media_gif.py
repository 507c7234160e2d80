"""GIF columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

A payload goes into a GIF as palette indices, one byte a pixel, rows of WIDTH pixels, FRAME_ROWS rows a frame. The
decoder takes any GIF87a/89a: global and local palettes, interlacing, graphic controls, disposal 0 to 3.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 192
FRAME_ROWS = 256
DELAY_CS = 10

GIF_SCHEMA = "doc_id long, n_bytes long, gif binary"
FRAME_SCHEMA = "doc_id long, frame int, start_ms long, delay_ms long, x int, y int, width int, height int, indices binary, histogram array<long>, status string"
#: Pixels of a canvas or a frame that the decoder accepts; a header may ask for four thousand million.
MOST_PIXELS = 1 << 25
#: Frames that a task holds at once.
FRAMES_TOGETHER = 16


# --- LZW ---------------------------------------------------------------------------------------------------------
def _widths(first_free: int, n: int) -> np.ndarray:
    """Bits of the n codes after a clear code: the reader's table has grown by one entry for each code but the first."""
    sizes = np.arange(n, dtype=np.int64) + first_free - 1
    return np.clip(np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64) + 1, first_free.bit_length(), 12)


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """GIF's variable-width LZW, least significant bit first; the table is cleared when it is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    free, last = end + 1, 4096 << 8
    runs: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}  # prefix code << 8 | byte: code << 8
    put, w, nxt = codes.append, -1, free << 8
    for b in data:
        if w < 0:
            w = b << 8
            continue
        key = w | b
        if key in table:
            w = table[key]
            continue
        put(w)
        if nxt == last:
            put(clear << 8)
            runs.append(codes)
            codes, nxt = [], free << 8
            put = codes.append
            table.clear()
        else:
            table[key] = nxt
            nxt += 256
        w = b << 8
    if w >= 0:
        put(w)
    put(end << 8)
    runs.append(codes)
    bit = np.arange(12, dtype=np.uint16)
    spread = [(np.uint16(clear) >> bit[: bits + 1]) & 1]
    for run in runs:
        values, at = (np.array(run, np.int64) >> 8).astype(np.uint16), 0
        for width in range(bits + 1, 13):  # codes that follow one another with the same width
            upto = len(values) if width == 12 else min(len(values), (1 << width) - free + 1)
            spread.append(((values[at:upto, None] >> bit[:width]) & 1).ravel())
            at = max(at, upto)
    return np.packbits(np.concatenate(spread).astype(np.uint8), bitorder="little").tobytes()


def _expand(codes: np.ndarray, free: int, before: np.ndarray, room: int) -> np.ndarray:
    """Bytes of the codes that follow a clear code, all at once, and no code that begins after `room` bytes.

    Entry free + k is what code k stands for and the byte after it, so it can be read from the output where code k
    begins. Every byte points back to the one it repeats; pointers are doubled until all end at literal bytes."""
    n = len(codes)
    back = np.where(codes >= free, codes - free, -1)
    if (back >= np.arange(n)).any():
        raise ValueError("an LZW code comes before its entry")
    size, jump = np.ones(n, np.int64), back.copy()
    live = np.flatnonzero(jump >= 0)
    while len(live):  # a code is as long as the chain of codes behind it
        size[live] += size[jump[live]]
        jump[live] = jump[jump[live]]
        live = live[jump[live] >= 0]
    ends = np.cumsum(size)
    n = min(n, int(np.searchsorted(ends, room)) + 1)
    codes, size, back, start = codes[:n], size[:n], back[:n], (ends - size)[:n]
    total = int(size.sum())
    of = np.repeat(np.arange(n), size)
    place = np.arange(total)
    source = np.where(back[of] >= 0, start[back[of]] + place - start[of], place)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return before[codes[of[source]]]
        source = further


def lzw_decode(stream: bytes, bits: int = 8, most: int | None = None) -> bytes:
    """Codes are unpacked a table at a time, up to the next clear code, and expanded together. Decoding stops when `most`
    bytes are there: a few codes can stand for thousands of times their size. Raises ValueError on code sizes but 1 to 8."""
    if not 1 <= bits <= 8:
        raise ValueError(f"a code size of {bits}")
    clear, end = 1 << bits, (1 << bits) + 1
    free = end + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    literal = np.minimum(np.arange(free), 255).astype(np.uint8)
    schedule = _widths(free, 4096 - free + 2)
    ends = np.cumsum(schedule)
    starts, masks, total = ends - schedule, (1 << schedule) - 1, len(stream) * 8
    out, block = [], []
    at, left = 0, 1 << 62 if most is None else most
    while at + bits < total and left > 0:
        if block:  # the table is full and no clear code came: 12 bits each, and no new entries
            n = min(4096, (total - at) // 12)
            where, mask, stops = at + 12 * np.arange(n), 4095, at + 12 * np.arange(1, n + 1)
        else:
            n = int(np.searchsorted(ends, total - at, side="right"))
            where, mask, stops = at + starts[:n], masks[:n], at + ends[:n]
        if not n:
            break
        byte = where >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (where & 7).astype(np.uint32) & mask).astype(np.int64)
        marks = np.flatnonzero((codes == clear) | (codes == end))
        upto = int(marks[0]) if len(marks) else n
        block.append(codes[:upto])
        at = int(stops[upto if len(marks) else -1])
        if len(marks):
            out.append(_expand(np.concatenate(block), free, literal, left))
            block, left = [], left - len(out[-1])
            if codes[upto] == end:
                break
    if block and left > 0:
        out.append(_expand(np.concatenate(block), free, literal, left))
    return b"".join(x.tobytes() for x in out)[:most]


# --- container ---------------------------------------------------------------------------------------------------
def encode_gif(payload: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, palette: bytes | None = None, delay: int = DELAY_CS) -> bytes:
    """payload (a positive multiple of width) as frames of at most `rows` rows over a grey palette of 256 entries."""
    height = len(payload) // width
    palette = palette or bytes(v for i in range(256) for v in (i, i, i))
    parts = [b"GIF89a", struct.pack("<HHBBB", width, min(height, rows), 0xF7, 0, 0), palette]
    for top in range(0, height, rows):
        pixels = payload[top * width : (top + rows) * width]
        parts += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, delay, 0, 0), struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(pixels) // width, 0, 8)]
        code = lzw_encode(pixels)
        parts += [bytes([len(code[i : i + 255])]) + code[i : i + 255] for i in range(0, len(code), 255)]
        parts.append(b"\0")
    return b"".join([*parts, b"\x3b"])


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    box: tuple[int, int, int, int]  # x, y, width, height
    indices: bytes
    canvas: np.ndarray  # height x width x 4, as shown while the frame lasts


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := data[at]:
        if at + 1 + size > len(data):
            raise IndexError("a block is cut")
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def decode_gif(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """Frames in order, one at a time. Raises ValueError on anything that isn't a whole GIF, after the frames before, and on more pixels than most_pixels."""
    try:
        yield from _frames(data, most_pixels)
    except (IndexError, struct.error) as e:
        raise ValueError("the GIF is cut short") from e


def _frames(data: bytes, most_pixels: int) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    wide, high, flags = struct.unpack_from("<HHB", data, 6)
    shared, at = _palette(data, 13, flags)
    if wide * high > most_pixels:
        raise ValueError(f"a canvas of {wide} x {high}")
    canvas = np.zeros((high, wide, 4), np.uint8)
    control, clock = (0, 0, None), 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = _blocks(data, at + 2)
            if data[at + 1] == 0xF9:
                bits, delay, clear = struct.unpack_from("<BHB", body)
                control = (bits >> 2 & 7, delay * 10, clear if bits & 1 else None)
            at = after
            continue
        if data[at] != 0x2C:
            raise ValueError(f"unknown block {data[at]:#x}")
        x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        if w * h > most_pixels:
            raise ValueError(f"a frame of {w} x {h}")
        own, at = _palette(data, at + 10, flags)
        code, after = _blocks(data, at + 1)
        flat = lzw_decode(code, data[at], w * h)
        at = after
        pixels = np.frombuffer(flat.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if flags & 0x40:  # interlaced: rows come in four passes
            rows = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
            pixels = pixels[np.argsort(rows)]
        disposal, delay, clear = control
        colours = own if own is not None else shared
        if colours is None:
            raise ValueError("a frame has no palette")
        before = canvas.copy() if disposal == 3 else None
        table = np.zeros((256, 4), np.uint8)
        table[: len(colours), :3], table[: len(colours), 3] = colours, 255
        area = canvas[y : y + h, x : x + w]
        part = pixels[: area.shape[0], : area.shape[1]]
        area[...] = table[part] if clear is None else np.where((part == clear)[..., None], area, table[part])
        yield Frame(clock, delay, (x, y, w, h), pixels.tobytes(), canvas.copy())
        clock += delay
        if disposal == 2:
            area[...] = 0
        elif before is not None:
            canvas = before
        control = (0, 0, None)


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Shown pixels by colour, two bits of red, green and blue each: 64 counts."""
    seen = canvas[canvas[..., 3] > 0] >> 6
    return np.bincount(seen[:, 0] << 4 | seen[:, 1] << 2 | seen[:, 2], minlength=64)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b" ")


# --- Spark -------------------------------------------------------------------------------------------------------
def texts_to_gif(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_bytes, gif) for each row. A null text is an empty one: a single row of spaces.

    Map-only; other columns of docs are left out, repeated rows stay repeated, null ids stay null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [padded(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": [n for n, _ in rows], "gif": [encode_gif(p) for _, p in rows]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, GIF_SCHEMA)


def gif_frames(gifs: DataFrame, gif_col: str = "gif", id_col: str = "doc_id") -> DataFrame:
    """One row for each frame: its time span, rectangle, palette indices and the colour histogram of the canvas it shows.

    status is "ok". A null GIF gives one row without a frame and the status "null", and one that isn't whole, or too large, a
    row with what is wrong after the frames before it."""
    names = [c.split()[0] for c in FRAME_SCHEMA.split(", ")]

    def rows_of(doc, data: bytes | None):
        if data is None:
            yield (doc, *[None] * (len(names) - 2), "null")
            return
        try:
            for i, f in enumerate(decode_gif(data)):
                yield doc, i, f.start_ms, f.delay_ms, *f.box, f.indices, histogram(f.canvas).tolist(), "ok"
        except ValueError as e:
            yield (doc, *[None] * (len(names) - 2), str(e))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, data in zip(pdf["doc_id"].astype("Int64"), pdf["gif"], strict=True):
                rows = rows_of(doc, None if data is None else bytes(data))
                while some := list(itertools.islice(rows, FRAMES_TOGETHER)):
                    yield pd.DataFrame(some, columns=names).astype({c: "Int64" for c in ("doc_id", "frame", "start_ms", "delay_ms", "x", "y", "width", "height")})

    return gifs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(gif_col).alias("gif")).mapInPandas(run, FRAME_SCHEMA)


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, duration_ms long, feature string"


def gif_digest(gifs: DataFrame) -> DataFrame:
    """Digests of what texts_to_gif stored, from the bytes that decoding its frames gives back.

    feature: mean grey level, then the share of each of the four grey bins in thousandths, over all frames. A GIF that is
    null or isn't whole has null digests."""

    def one(data: bytes | None) -> tuple:
        try:
            return (None,) * 8 if data is None else told(bytes(data))
        except ValueError:
            return (None,) * 8

    def told(data: bytes) -> tuple:
        frames, counts, took, level = [], np.zeros(64, np.int64), 0, 0
        for f in decode_gif(data):
            frames.append(f.indices)
            counts += histogram(f.canvas[: f.box[3]])
            level += int(f.canvas[: f.box[3], :, 0].sum(dtype=np.int64))
            took += f.delay_ms
        payload = b"".join(frames)
        grey = counts[[0, 21, 42, 63]] * 1000 // max(1, counts.sum())
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), len(frames), took, f"{level / max(1, len(payload)):.3f}:" + ",".join(map(str, grey))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = pd.DataFrame([one(x) for x in pdf["gif"]], columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "duration_ms", "feature"])
            made = made.astype({c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes", "n_frames", "duration_ms")})
            yield pd.concat([pdf[["doc_id", "n_bytes"]].astype("Int64").reset_index(drop=True), made], axis=1)

    return gifs.mapInPandas(run, DIGEST_SCHEMA)
