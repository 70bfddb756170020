"""Array kernels over the bytes of an Arrow text column, used inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
_SEED = np.random.default_rng(20240229)
BYTE_CODES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = []


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text or binary column end to end, and where each row begins (one more offset than rows)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 4096)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (_BASE, _BACK)]
    return _POWERS[0][:n], _POWERS[1][:n]


def give_back() -> None:
    """Freed memory goes back to the system: a worker that waits would keep it while its executor needs it."""
    if _POWERS and len(_POWERS[0]) > PIECE + 4096:
        _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def giving_back(rows: Iterator) -> Iterator:
    yield from rows
    give_back()


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums: ``(out[e] - out[s]) * back[s]`` is a hash of the codes from s to e."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def _cuts(data: np.ndarray, is_start: np.ndarray) -> list[int]:
    """Ends of pieces of about PIECE bytes that part no word."""
    cuts, at = [], 0
    while at < len(data):
        at = min(at + PIECE, len(data))
        while at < len(data):
            ahead = slice(at, min(at + 4096, len(data)))
            free = np.flatnonzero(IS_SPACE[data[ahead]] | is_start[ahead])
            if len(free):
                at += int(free[0])
                break
            at = min(at + 4096, len(data))
        cuts.append(at)
    return cuts


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    fill = np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, fill]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, A-Z in lower case if ``fold``, and the number of words before each text (one more than texts).

    Words are runs of bytes other than ASCII white space and end with their text. Long texts are hashed in pieces.
    """
    is_start = np.zeros(len(data) + 1, bool)
    is_start[offsets] = True
    hashes, starts, at = [], [], 0
    for end in _cuts(data, is_start):
        piece = data[at:end]
        solid = ~IS_SPACE[piece]
        first = solid.copy()
        first[1:] &= ~solid[:-1] | is_start[at + 1 : end]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | is_start[at + 1 : end]
        begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = prefix_hash(BYTE_CODES[LOWER[piece] if fold else piece])
        hashes.append(mix((sums[stop] - sums[begin]) * powers(len(piece))[1][begin] + (stop - begin).astype(np.uint64)))
        starts.append(begin + at)
        at = end
    begin = np.concatenate(starts) if starts else np.empty(0, np.int64)
    words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return words, np.searchsorted(begin, offsets)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, end to end, and their bounds.

    A text with fewer words than a shingle has one shingle, its whole sequence; without words it has none.
    """
    mult = [np.uint64(pow(0xD1342543DE82EF95, j + 1, 2**64)) for j in range(size)]
    n = max(len(words) - size + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for j in range(size):
        rolled += words[j : j + n] * mult[j]
    rolled = mix(rolled)
    out, ends = [], [0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(rolled[a : b - size + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            few = words[a:b] * np.array(mult[: b - a], np.uint64)
            own = mix(few.sum(keepdims=True) + np.uint64(b - a))
        else:
            own = rolled[:0]
        out.append(own)
        ends.append(ends[-1] + len(own))
    return (np.concatenate(out) if out else rolled[:0]), np.array(ends, np.int64)


def text_batches(data: np.ndarray, offsets: np.ndarray, limit: int):
    """Row ranges (from, to) of about ``limit`` bytes; a longer text stands alone."""
    at = 0
    while at < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = max(to, at + 1)
        yield at, to
        at = to


def binaries(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value per row from fixed-width numbers end to end."""
    width = flat.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())
