"""Periodic runs of words, located by block convolution."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels
from corpusloom.llm.common import own_names, text_or_empty

TIMES = 4  # periods a run holds at least
SHORTEST = 6  # words a run holds at least
PRIME = 2013265921  # 15 * 2**27 + 1: products of residues fit 64 bits, transforms go up to 2**27 points
ROOT = 31  # a generator modulo PRIME
SPAN = 1 << 20  # longest stretch of a block that is transformed at once
POINTS = 1 << 20  # points of the transforms held at once
_GROUP = 1 << 20
_P = np.uint64(PRIME)
_TWIDDLES: dict[tuple[int, bool], np.ndarray] = {}


def _twiddles(n: int, inverse: bool) -> np.ndarray:
    """Powers 0..n/2-1 of a root of order n."""
    if (n, inverse) not in _TWIDDLES:
        root = pow(ROOT, (PRIME - 1) // n, PRIME)
        root = pow(root, -1, PRIME) if inverse else root
        out = np.ones(1, np.uint64)
        while len(out) < n // 2:
            out = np.concatenate([out, out * np.uint64(pow(root, len(out), PRIME)) % _P])
        _TWIDDLES[n, inverse] = out
    return _TWIDDLES[n, inverse]


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every row, in bit-reversed order."""
    rows, n = x.shape
    size = n
    while size > 1:
        half = size // 2
        parts = x.reshape(rows, n // size, 2, half)
        a, b = parts[:, :, 0], parts[:, :, 1]
        x = np.stack([(a + b) % _P, (a + _P - b) % _P * _twiddles(size, False) % _P], axis=2).reshape(rows, n)
        size = half
    return x


def restored(x: np.ndarray) -> np.ndarray:
    """Inverse of ``transform``."""
    rows, n = x.shape
    size = 2
    while size <= n:
        half = size // 2
        parts = x.reshape(rows, n // size, 2, half)
        a, b = parts[:, :, 0], parts[:, :, 1] * _twiddles(size, True) % _P
        x = np.stack([(a + b) % _P, (a + _P - b) % _P], axis=2).reshape(rows, n)
        size *= 2
    return x * np.uint64(pow(n, -1, PRIME)) % _P


def _correlation(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """``out[r, t] = sum_i blocks[r, i] * windows[r, i + t]`` modulo PRIME for t below the width of a block (windows are twice as wide)."""
    width = windows.shape[1]
    turned = np.zeros_like(windows)
    turned[:, 0] = blocks[:, 0]
    turned[:, width - blocks.shape[1] + 1 :] = blocks[:, :0:-1]
    return restored(transform(turned) * transform(windows) % _P)[:, : blocks.shape[1]]


def squared_differences(x: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """``sum_i (x[a + i] - x[a + d + i])**2`` modulo PRIME over blocks of ``width`` from places ``at``, for d in [width, 2 * width).

    ``x`` holds residues, ``width`` words beyond the last that a window reaches. Blocks longer than SPAN are summed from parts.
    """
    out = np.zeros((len(at), width), np.uint64)
    part = min(width, SPAN)
    for begin in range(0, width, part):
        block = x[(at + begin)[:, None] + np.arange(part)]
        own = (block * block % _P).sum(axis=1) % _P
        for shift in range(width, 2 * width, part):
            window = x[(at + begin + shift)[:, None] + np.arange(2 * part)]
            squares = np.cumsum(window * window % _P, axis=1)
            squares = squares[:, part - 1 : -1] - np.concatenate([np.zeros((len(at), 1), np.uint64), squares[:, : part - 1]], axis=1)
            cross = _correlation(block, window)
            out[:, shift - width : shift - width + part] += (own[:, None] + squares + (_P - cross) * np.uint64(2)) % _P
    return out % _P


class Extension:
    """How far equality at a distance goes on, by binary search over running hashes."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.codes = kernels.mix(x.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
        self.sums = kernels.prefix_hash(self.codes)
        self.back = kernels.powers(len(x) + 1)[1]

    def _same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.back[a] == (self.sums[b + n] - self.sums[b]) * self.back[b]

    def spread(self, at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) place i around ``at`` with x[i] = x[i + d] throughout."""
        ends = []
        for most, probe in ((len(self.x) - at - d, lambda n: self._same(at, at + d, n)), (at, lambda n: self._same(at - n, at - n + d, n))):
            low, high = np.zeros(len(at), np.int64), most.copy()
            while (low < high).any():
                middle = (low + high + 1) // 2
                same = probe(middle)
                low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
            ends.append(low)
        return at - ends[1], at + ends[0]

    def checked(self, a: int, b: int, d: int, at: int) -> tuple[int, int]:
        """The same stretch by the words themselves, should hashes have met by chance."""
        if np.array_equal(self.x[a:b], self.x[a + d : b + d]):
            return a, b
        differ = np.flatnonzero(self.x[:-d] != self.x[d:])
        i = int(np.searchsorted(differ, at))
        return int(differ[i - 1]) + 1 if i else 0, int(differ[i]) if i < len(differ) else len(self.x) - d


def runs_of(x: np.ndarray, longest: int, times: int = TIMES, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Maximal runs (start, length, smallest period) of a sequence of numbers, ``times`` periods and ``shortest`` long at least.

    ``longest`` bounds the length of a run. At each scale B = 1, 2, 4, ... blocks of B words stand side by side. A run of
    period p, B <= p < 2B, holds a whole block whose next occurrence is p ahead, as long as ``times`` is 3 or more: the squared
    differences of the block and the window after it are zero there. These distances are the seeds; each is extended to both sides. Blocks
    with a word that does not return in time have no occurrence, and those inside a known run of a shorter period add none.
    """
    if times < 3:
        raise ValueError("times has to be 3 at least")
    n = len(x)
    order = np.argsort(x, kind="stable")
    ahead = np.full(n, np.iinfo(np.int64).max)
    same = x[order[1:]] == x[order[:-1]]
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    held: dict[tuple[int, int], int] = {}
    extension = None
    residues = None
    inside = np.zeros(n, np.int64)  # one past the last word of the known run around a place
    width = 1
    while times * width <= longest:
        blocks = n // width
        slowest = ahead[: blocks * width].reshape(blocks, width).max(axis=1, initial=0)
        at = np.flatnonzero(slowest < 2 * width) * width
        at = at[inside[at] < np.minimum(at + 3 * width, n)]
        if len(at) and residues is None:
            residues = (kernels.mix(x.astype(np.uint64)) % _P).astype(np.uint64)
            extension = Extension(x)
        step = max(POINTS // (2 * min(width, SPAN)), 1)
        padded = np.concatenate([residues, np.arange(4 * width, dtype=np.uint64)]) if len(at) else None
        fresh = []
        for k in range(0, len(at), step):
            some = at[k : k + step]
            row, t = np.nonzero(squared_differences(padded, some, width) == 0)
            place, d = some[row], t + width
            real = place + width + d <= n
            place, d = place[real], d[real]
            a, b = extension.spread(place, d)
            long = b - a + d >= np.maximum(times * d, shortest)
            for a_, b_, d_, i in zip(*[v[long].tolist() for v in (a, b, d, place)], strict=True):
                if held.get((a_, b_ + d_), n) <= d_:
                    continue
                a_, b_ = extension.checked(a_, b_, d_, i)
                if b_ - a_ + d_ >= max(times * d_, shortest) and held.get((a_, b_ + d_), n) > d_:
                    held[a_, b_ + d_] = d_
                    fresh.append((a_, b_ + d_))
        for a, b in fresh:
            inside[a:b] = np.maximum(inside[a:b], b)
        width *= 2
    return sorted((a, b - a, d) for (a, b), d in held.items())


def _found(batches: Iterator[pa.RecordBatch], times: int, shortest: int, outputs: Sequence[str]) -> Iterator[pa.RecordBatch]:
    triple = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        data, offsets = kernels.text_bytes(batch.column(batch.num_columns - 1))
        counts, runs, left, digests = [], [], [], []
        for first, to in kernels.text_batches(data, offsets, _GROUP):
            texts = [data[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(first, to)]
            known: dict[bytes, int] = {}
            # A number of its own after each text: no run reaches from one text into the next.
            numbers = [j for i, words in enumerate(texts) for j in (*[known.setdefault(w, len(known)) for w in words], -1 - i)]
            bounds = np.cumsum([0, *[len(w) + 1 for w in texts]])
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for start, length, period in runs_of(np.array(numbers, np.int64), max(map(len, texts)), times, shortest):
                i = int(np.searchsorted(bounds, start, "right")) - 1
                found[i].append((start - int(bounds[i]), length, period))
            for words, own in zip(texts, found, strict=True):
                kept = words
                if own:
                    gone = np.zeros(len(words), bool)
                    for start, length, period in own:
                        gone[start + period : start + length] = True
                    kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                joined = b" ".join(kept)
                left.append(joined.decode() if "kept" in outputs else None)
                digests.append(hashlib.sha256(joined).hexdigest() if "kept_sha256" in outputs else None)
        made = [pa.array(counts, pa.int64()), pa.array(runs, triple), pa.array(left, pa.string()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "n", "r", "k", "s"])


OUTPUTS = ("runs", "kept")


def find_runs(
    docs: DataFrame, text_col: str = "text", times: int = TIMES, shortest: int = SHORTEST, outputs: Sequence[str] = OUTPUTS,
) -> DataFrame:
    """Every row of the input with a struct ``periodic``: ``n_words`` (long) and, as ``outputs`` ask, ``runs`` (start, length, period in
    words, by start and period), ``kept`` (the text without the later rounds of its runs, joined by one space) and ``kept_sha256`` (its digest).

    Words are stretches of other characters than ASCII white space. A run is a stretch of words with smallest period q, ``times * q``
    and ``shortest`` words long at least, that cannot be extended. A word goes if a run holds it after its first q words.

    Rows are worked on one by one, whatever their ids: no shuffle. A null or blank text has no words and no runs; runs may overlap; repeated rows
    get the same result; other columns, nulls included, stay as they are, but one called ``periodic`` is replaced.
    """
    others = [c for c in docs.columns if c != "periodic"]
    row, text = own_names(docs, "row", "text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias(row), F.encode(text_or_empty(text_col), "UTF-8").alias(text))
    kind = rows.schema[row].dataType.simpleString()
    made = "n long, r array<struct<start:bigint,length:bigint,period:bigint>>, k string, s string"
    found = rows.mapInArrow(lambda it: _found(it, times, shortest, outputs), f"`{row}` {kind}, {made}")
    shown = {"runs": F.col("r"), "kept": F.col("k"), "kept_sha256": F.col("s")}
    return found.select(
        *[F.col(f"`{row}`").getField(c).alias(c) for c in others], F.struct(F.col("n").alias("n_words"), *[shown[o].alias(o) for o in outputs]).alias("periodic"))
