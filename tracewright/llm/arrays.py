"""Arrays in rows: packing for the wire, and the words of many texts hashed at once."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

from tracewright.llm.common import mixed


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def opened(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=kind)


def _plane_bytes(x: np.ndarray) -> bytes:
    """Values byte by byte: all first bytes, all second bytes, and so on, so that unused bytes vanish."""
    raw = np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8).T
    used = max((k + 1 for k in range(8) if raw[k].any()), default=0)
    return bytes([used]) + packed(raw[:used])


def _of_planes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    if raw[0] and n:
        out[:, : raw[0]] = opened(raw[1:], np.uint8).reshape(raw[0], n).T
    return out.view("<u8").ravel()


def planes(*columns: np.ndarray) -> bytes:
    """Columns of unsigned 64-bit values of one length."""
    parts = [_plane_bytes(c) for c in columns]
    return struct.pack(f"<{1 + len(parts)}I", len(columns[0]), *map(len, parts)) + b"".join(parts)


def of_planes(raw: bytes, columns: int) -> list[np.ndarray]:
    n, *sizes = struct.unpack_from(f"<{1 + columns}I", raw)
    at, out = 4 * (1 + columns), []
    for size in sizes:
        out.append(_of_planes(raw[at : at + size], n))
        at += size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted values; the first against zero."""
    return np.diff(x, prepend=np.uint64(0)) if len(x) else x


def of_steps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint64)


def ramps(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for every n, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


# --- words -----------------------------------------------------------------------------------------

_A = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_VALUE = np.where(_SPACE, np.uint64(0), mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(1 << 12, _A)
_GIANT = _powers(1 << 16, pow(_A, 1 << 12, 1 << 64))


def words_at(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of every word of all texts, its place in the texts written one after another with a
    line feed after each, and the number of words of every text."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"".join(x for t in texts for x in (t, b"\n")), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    counts = np.diff(np.searchsorted(starts, np.r_[0, np.cumsum(sizes)]))
    if not len(starts):
        return np.zeros(0, np.uint64), starts, counts
    head = starts[0]
    inside = np.arange(head, len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
    power = _POWERS[inside & 4095]
    if len(inside) > 4095 and inside.max() > 4095:
        power = power * _GIANT[(inside >> 12) & 65535]
    return mixed(np.add.reduceat(_VALUE[raw[head:]] * power, starts - head)), starts, counts


def word_values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of all texts, and the number of words of every text."""
    h, _, counts = words_at(texts)
    return h, counts


def majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For every run ``bounds[k]..bounds[k + 1]`` of hashes the 64-bit number whose bits are those set in over half of them."""
    sizes = np.diff(bounds)
    ones = np.zeros((len(sizes), 64), dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        end = min(len(h), at + (1 << 16))
        bits = np.unpackbits(np.ascontiguousarray(h[at:end], dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(bounds, at, side="right") - 1, np.searchsorted(bounds, end, side="left")
        own = np.arange(first, last)[sizes[first:last] > 0]
        if len(own):
            ones[own] += np.add.reduceat(bits, np.maximum(bounds[own] - at, 0), axis=0, dtype=np.int64)
    return ((2 * ones > sizes[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
