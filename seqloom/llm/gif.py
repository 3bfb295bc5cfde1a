"""Media columns: GIF files as columns, decoded and encoded without any image library.

decode() reads any GIF: LZW code streams, local and global palettes, interlacing, transparency and disposal. encode()
stores indexed frames. A payload of bytes is stored as frames of 64 samples a row under a grey palette whose entry i is i,
so a frame's composed red channel is the payload again.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GREY = bytes(x for i in range(256) for x in (i, i, i))
ROW, ROWS, DELAY_CS = 64, 1024, 4


class Frame(NamedTuple):
    left: int
    top: int
    indexes: np.ndarray  # rows x columns
    palette: np.ndarray  # entries x 3
    delay_ms: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray | None  # the composed picture, rows x columns x 4


@functools.cache
def _widths(least: int) -> np.ndarray:
    """Bits of the i-th code after a clear code: an entry is known from the second code on."""
    free = (1 << least) + 2 + np.maximum(np.arange(4100 - (1 << least)) - 1, 0)
    return np.minimum(12, np.floor(np.log2(free)).astype(np.int64) + 1)


def lzw_encode(data: bytes, least: int = 8) -> bytes:
    """The LZW stream of symbols under 2**least; a clear code is sent when the table is full."""
    clear, end = 1 << least, (1 << least) + 1
    out, table, free = [clear], {}, end + 1
    known, add = table.get, out.append
    if data:
        it = iter(data)
        at = next(it)
        for c in it:
            if (k := known(key := at << 8 | c)) is not None:
                at = k
                continue
            add(at)
            if free < 4096:
                table[key] = free
                free += 1
            else:
                add(clear)
                table.clear()
                free = end + 1
            at = c
        add(at)
    add(end)
    codes = np.array(out, np.uint16)
    starts = np.flatnonzero(codes == clear)
    since = np.arange(-1, len(codes) - 1) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    table_widths = _widths(least)
    widths = table_widths[np.maximum(since, 0)]
    widths[starts] = np.append(least + 1, table_widths[np.minimum(np.diff(starts) - 1, len(table_widths) - 1)])
    bits = (codes[:, None] >> np.arange(12, dtype=np.uint16)) & 1
    return np.packbits(bits.astype(np.uint8)[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, least: int, most: int) -> bytes:
    """The symbols of an LZW stream, at most `most`; a stream that breaks off or is corrupt gives what came before."""
    clear, end = 1 << least, (1 << least) + 1
    raw = np.frombuffer(stream + b"\0" * 8, np.uint8)
    lanes = np.ndarray((len(raw) - 3,), "<u4", raw, strides=(1,))
    widths = _widths(least)
    edges = np.concatenate([[0], np.cumsum(widths)])
    first = [bytes((i,)) for i in range(clear)] + [b"", b""]
    out, size, bit, bits = [], 0, 0, 8 * len(stream)
    while bit < bits and size < most:
        n = int(np.searchsorted(edges, bits - bit, "right")) - 1  # whole codes that are left, up to a full table
        if n < 1:
            break
        pos = bit + edges[:n]
        codes = (lanes[pos >> 3] >> (pos & 7).astype(np.uint32)) & ((1 << widths[:n]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        cut = int(stops[0]) if len(stops) else n
        block = codes[:cut].tolist()
        if block:
            if block[0] >= clear:
                break
            table, last = first.copy(), first[block[0]]
            add, keep = table.append, out.append
            keep(last)
            had, free, ok = len(out) - 1, end + 1, True
            for c in block[1:]:
                if c < free:
                    e = table[c]
                elif c == free and free < 4096:
                    e = last + last[:1]
                else:
                    ok = False
                    break
                if free < 4096:
                    add(last + e[:1])
                    free += 1
                keep(e)
                last = e
            size += sum(map(len, out[had:]))
            if not ok:
                break
        if not len(stops) and cut == len(widths):  # a full table that goes on without a clear code
            tail = _tail(lanes, bit + int(edges[n]), bits, table, last, clear, end)
            out += tail[0]
            size += sum(map(len, tail[0]))
            bit = tail[1]
            if bit < 0:
                break
            continue
        if not len(stops) or codes[cut] == end:
            break
        bit += int(edges[cut + 1])
    return b"".join(out)[:most]


def _tail(lanes, bit: int, bits: int, table: list, last: bytes, clear: int, end: int) -> tuple[list, int]:
    """Phrases of the 12-bit codes after a full table, and the bit after the clear code (-1: the stream ends)."""
    out = []
    while bit + 12 <= bits:
        c = (int(lanes[bit >> 3]) >> (bit & 7)) & 4095
        bit += 12
        if c == clear:
            return out, bit
        if c == end or c >= len(table):
            break
        out.append(table[c])
    return out, -1


def _blocks(data: bytes) -> bytes:
    """Data in sub-blocks of 255 bytes, with the empty one at the end."""
    full = len(data) // 255
    body = np.empty((full, 256), np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
    rest = data[full * 255 :]
    return body.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(frames: list[tuple], width: int, height: int, palette: bytes = GREY) -> bytes:
    """A GIF of (left, top, indexes, delay in hundredths of a second, disposal, transparent index or None)."""
    depth = max(1, (len(palette) // 3 - 1).bit_length())
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 0x70 | depth - 1, 0, 0), palette.ljust(3 << depth, b"\0")]
    for left, top, px, delay, disposal, clear in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, left, top, px.shape[1], px.shape[0], 0) + bytes([max(2, depth)]))
        out.append(_blocks(lzw_encode(px.tobytes(), max(2, depth))))
    return b"".join([*out, b";"])


def decode(data: bytes, compose: bool = True) -> tuple[int, int, list[Frame]]:
    """(width, height, frames) of a GIF; raises ValueError if it has no header. Frames before a break are kept."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at = 13
    common = None
    if flags & 0x80:
        common = np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3)
        at += 3 << (flags & 7) + 1
    frames: list[Frame] = []
    canvas = np.zeros((height, width, 4), np.uint8) if compose else None
    delay = disposal = 0
    clear = None

    def blocks(at: int) -> tuple[bytes, int]:
        got = []
        while at < len(data) and data[at]:
            got.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(got), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1] if at + 1 < len(data) else 0
            body, at = blocks(at + 2)
            if kind == 0xF9 and len(body) >= 4:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = bits >> 2 & 7, index if bits & 1 else None
            continue
        if data[at] != 0x2C or at + 11 > len(data):
            break
        left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if bits & 0x80:
            palette = np.frombuffer(data, np.uint8, 3 << (bits & 7) + 1, at).reshape(-1, 3)
            at += 3 << (bits & 7) + 1
        least = data[at]
        body, at = blocks(at + 1)
        px = np.frombuffer(lzw_decode(body, least, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if bits & 0x40:  # interlaced: four passes
            rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            px = px[np.argsort(rows)]
        palette = palette if palette is not None else np.frombuffer(GREY, np.uint8).reshape(-1, 3)
        shown = None
        if canvas is not None:
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            part = px[: area.shape[0], : area.shape[1]]
            full = np.zeros((256, 4), np.uint8)
            full[: len(palette), :3], full[:, 3] = palette, 255
            if clear is None:
                area[:] = full[part]
            else:
                opaque = part != clear
                area[opaque] = full[part[opaque]]
            shown = canvas.copy()
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = before
        frames.append(Frame(left, top, px, palette, 10 * delay, disposal, clear, shown))
        delay, disposal, clear = 0, 0, None
    return width, height, frames


def store(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as a GIF: frames of up to ROWS rows of ROW samples."""
    px = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    parts = [px[i : i + ROWS] for i in range(0, len(px), ROWS)]
    return encode([(0, 0, x, DELAY_CS, 1, None) for x in parts], ROW, min(len(px), ROWS))


def load(media: bytes) -> tuple[bytes, list[Frame]]:
    """The payload of store() and the frames."""
    _, _, frames = decode(media)
    return b"".join(f.canvas[f.top : f.top + f.indexes.shape[0], f.left : f.left + f.indexes.shape[1], 0].tobytes() for f in frames), frames


def histogram(canvas: np.ndarray, bins: int = 4) -> np.ndarray:
    """Opaque pixels by colour: bins**3 counts, red the slowest."""
    px = canvas[canvas[..., 3] > 0].astype(np.int64) * bins >> 8
    return np.bincount(px[:, 0] * bins * bins + px[:, 1] * bins + px[:, 2], minlength=bins**3)


FRAMES = "frame int, at_ms long, delay_ms int, width int, height int, disposal int, transparent int, rgba binary, colours array<long>"


def gif_frames(df: DataFrame, key: str, content: str, bins: int = 4) -> DataFrame:
    """A row for each composed frame of each GIF in the binary column `content`: its time, picture and colour histogram.

    A null or unreadable file gives one row with nulls, so no key is lost. One file is decoded in one task.
    """
    names = ["_key", *(x.split()[0] for x in FRAMES.split(", "))]
    schema = pa.schema([("_key", pa.string()), ("frame", pa.int32()), ("at_ms", pa.int64()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.int32()), ("rgba", pa.binary()), ("colours", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows, t = [], 0
                try:
                    w, h, frames = decode(data.as_py() or b"")
                except ValueError:
                    w, h, frames = None, None, []
                for i, f in enumerate(frames):
                    rows.append((k, i, t, f.delay_ms, w, h, f.disposal, f.transparent, f.canvas.tobytes(), histogram(f.canvas, bins).tolist()))
                    t += f.delay_ms
                rows = rows or [(k, *[None] * (len(names) - 1))]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    out = df.select(F.col(key).cast("string").alias("_key"), F.col(content).cast("binary").alias("_content")).mapInArrow(run, f"_key string, {FRAMES}")
    return out.withColumnRenamed("_key", key)


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long"


def text_media(docs: DataFrame) -> DataFrame:
    """Stores every whole text as a GIF, reads the file back and describes what was read.

    docs: doc_id and text. The payload is the UTF-8 text (null: empty) and bytes 0 up to a positive multiple of 64.
    feature: counts of the read samples in 16 grey classes. Equal texts give equal values; a null doc_id stays null.
    """
    names = [x.split()[0] for x in STORED.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for x in b.column("text"):
                data = (x.as_py() or "").encode()
                media = store(data + b"\0" * (-len(data) % 64 or 64 * (not data)))
                back, frames = load(media)
                grey = np.bincount(np.frombuffer(back, np.uint8) >> 4, minlength=16)
                rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, grey.tolist())), len(frames), sum(f.delay_ms for f in frames)))
            cols = list(zip(*rows)) or [[] for _ in names[1:]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
            yield pa.record_batch([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, STORED)
