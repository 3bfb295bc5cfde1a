"""What the operators of this package share: written tables, Arrow columns, word boundaries and hashes."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

from seqloom.storage import folder, written

__all__ = ["BROADCAST_BYTES", "chunks", "folder", "mixed", "packed5", "release", "text_buffer", "unpacked5", "word_hashes", "words", "written"]

#: Most bytes that an operator sends to the driver or broadcasts; each operator checks its own against it.
BROADCAST_BYTES = 64 << 20


def release() -> None:
    """Gives memory that this process has freed back to the system, where the C library can do so; it keeps it else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text.

    The bytes are padded by eight zeros, so that eight bytes can be read at any offset.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(pa.scalar(b"" if "binary" in str(column.type) else "", column.type))
    _, offs, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(8, np.uint8)]), offs - offs[0]


def chunks(offs: np.ndarray, most: int = 1 << 20):
    """(first, last) row ranges of about `most` bytes each; a longer text is a range of its own."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the total) of words `[^\\x20\\x09-\\x0D]+` in texts that follow each other."""
    n = int(offs[-1])
    ink = ~_SPACE[buf[:n]]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, ink[:-1]
        after[-1], after[:-1] = False, ink[1:]
        inner = offs[:-1]
        before[inner[inner < n]] = False
        ends = offs[1:]
        after[ends[ends > 0] - 1] = False
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; buf has eight spare bytes."""
    lanes = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    size = ends - starts
    h = mixed(size.astype(np.uint64) + _M1)
    done, idx = 0, None
    while idx is None or len(idx):
        at, left = (starts, size) if idx is None else (starts[idx] + done, size[idx] - done)
        v = lanes[at] & _MASKS[np.minimum(left, 8)]
        if idx is None:
            h = mixed((h ^ v) * _M1 + _M3)
            idx = np.flatnonzero(size > 8)
        else:
            h[idx] = mixed((h[idx] ^ v) * _M1 + _M3)
            idx = idx[left > 8]
        done += 8
    return h


def packed5(x: np.ndarray) -> bytes:
    """The lower five bytes of each."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked5(raw: bytes, n: int) -> np.ndarray:
    """The n numbers of packed5()."""
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(n, 5)
    return out.view(np.uint64).ravel()
