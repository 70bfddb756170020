"""Language-model scores by online logistic context mixing over hashed-context bit predictors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels
from corpusloom.llm.common import discard, text_or_empty, written

PREDICTORS = 3  # contexts: last four bytes, the word so far, the two words before and the word so far
SPARE_BITS = 7  # hash bits beyond one context a byte and predictor: fewer than one context in a hundred shares its hash
PART_BYTES = 1 << 23  # training and scored bytes whose contexts one part of the model holds
SLOT_BITS, BUCKET_BITS, CONTEXTS, BLOCK_BITS = 22, 23, 1 << 18, 12  # of the model that one process holds (``choose``)
NODES = 256
HEAVY_WORDS = 1 << 18  # most frequent words whose counts go to every task; all others are joined
LOGIT_STEP = 16.0  # stored logits are whole sixteenths within a byte
START = (0.35, 0.40, 0.40)  # mixing weights a document begins with
RATE = 2.0
FIRST_BLOCK, LAST_BLOCK = 256, 4096  # bytes between refinements of the weights: doubling from the first to the last
END = 10  # byte that ends a text; white space never occurs inside words
_PAD = 4
_GROUP = 1 << 20
STEM = 4  # bytes of a word whose contexts are asked for one by one; the rest of it is asked for as a word behind its stem
_ASKED = 3 << 20  # bytes of texts that ask for their contexts together
HELD_WORDS = 1 << 21  # different words a task of the first pass holds before it gives them out
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20  # texts that reach the first pass at once
END_WORD = np.uint64(0x1234567ABCDEF01)
_GRID = 128


@dataclass
class Code:
    """Binary decomposition of bytes: the path of each through a Huffman tree of the training bytes."""

    length: np.ndarray
    nodes: np.ndarray  # depth, byte
    signs: np.ndarray  # depth, byte: +1 or -1

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Code:
        heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        made = NODES
        while len(heap) > 1:
            (c0, t0, n0), (c1, t1, n1) = heapq.heappop(heap), heapq.heappop(heap)
            parent[n0], parent[n1] = (made, -1), (made, 1)
            heapq.heappush(heap, (c0 + c1, min(t0, t1), made))
            made += 1
        paths = []
        for b in range(NODES):
            path, at = [], b
            while at in parent:
                at, sign = parent[at]
                path.append((made - 1 - at, sign))  # the root is node 0 and frequent nodes lie close together
            paths.append(path[::-1])
        deep = max(map(len, paths))
        nodes, signs = np.zeros((deep, NODES), np.int32), np.ones((deep, NODES), np.float32)
        for b, path in enumerate(paths):
            for d, (node, sign) in enumerate(path):
                nodes[d, b], signs[d, b] = node, sign
        return cls(np.array([len(p) for p in paths], np.int32), nodes, signs)


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as the model reads them: pads, words in lower case each followed by a space, the end byte."""
    is_start = np.zeros(len(data) + 1, bool)
    is_start[offsets] = True
    solid = ~kernels.IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1] | is_start[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | is_start[1:-1]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    before = np.searchsorted(begin, offsets)  # words before each text
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    lengths = stop - begin
    to = np.cumsum(lengths + 1) - (lengths + 1) + text_of * (_PAD + 1) + _PAD
    total = np.concatenate([[0], np.cumsum(lengths + 1)])
    bounds = total[before] + np.arange(len(offsets)) * (_PAD + 1)
    out = np.full(int(bounds[-1]), 32, np.uint8)
    out[(bounds[:-1, None] + np.arange(_PAD)).ravel()] = END
    out[bounds[1:] - 1] = END
    out[np.flatnonzero(solid) + np.repeat(to - begin, lengths)] = kernels.LOWER[data[solid]]
    return out, bounds


def canonical_group(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``canonical`` of a group, some texts at a time."""
    outs, bounds, at = [], [np.zeros(1, np.int64)], 0
    for a, b in kernels.text_batches(data, offsets, _GROUP):
        out, ends = canonical(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        outs.append(out)
        bounds.append(ends[1:] + at)
        at += len(out)
    return np.concatenate(outs), np.concatenate(bounds)


def last_four(out: np.ndarray) -> np.ndarray:
    """The four bytes before every byte."""
    wide = out.astype(np.uint32)
    b1, b2 = np.concatenate([[np.uint32(END)], wide[:-1]]), np.concatenate([np.full(2, END, np.uint32), wide[:-2]])
    pair = b1 | (b2 << np.uint32(8))
    return pair | (np.concatenate([np.full(2, END, np.uint32), pair[:-2]]) << np.uint32(16))


def _spread(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)


def _four_hash(four: np.ndarray) -> np.ndarray:
    return kernels.mix(four.astype(np.uint64) ^ np.uint64(0x3C6EF372FE94F82B))


def context_hashes(out: np.ndarray) -> Iterator[np.ndarray]:
    """64-bit hash of the context of every byte, for each predictor in turn."""
    # Where the word so far begins, the word before it, and the one before that; pads stand before a text.
    gap = (out == 32) | (out == END)
    begins = np.where(np.concatenate([[True], gap[:-1]]), np.arange(len(out), dtype=np.int32), np.int32(0))
    np.maximum.accumulate(begins, out=begins)
    before = begins[np.maximum(begins - 1, 0)]
    before = begins[np.maximum(before - 1, 0)]
    sums = kernels.prefix_hash(kernels.BYTE_CODES[out])
    back = kernels.powers(len(out))[1]
    yield _four_hash(last_four(out))
    yield _spread((sums[:-1] - sums[begins]) * back[begins])
    yield _spread((sums[:-1] - sums[before]) * back[before] ^ np.uint64(0x5851F42D))


def contexts(out: np.ndarray) -> list[np.ndarray]:
    """Context of every byte in BUCKET_BITS bits, for each predictor."""
    return [(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) for h in context_hashes(out)]


def slots(buckets: list[np.ndarray], chosen: list[np.ndarray]) -> list[np.ndarray]:
    """First slot of each context; contexts that were not chosen share a range of empty slots past the end."""
    return [np.where(own[b], b >> (BUCKET_BITS - SLOT_BITS), _EMPTY) for b, own in zip(buckets, chosen, strict=True)]


def choose(counts: np.ndarray) -> np.ndarray:
    """The buckets whose contexts are modelled: the lowest threshold that leaves at most CONTEXTS; more if all of them tie."""
    sizes = np.bincount(counts.astype(np.int64))
    above = np.cumsum(sizes[::-1])[::-1]  # buckets with at least this count
    fits = np.flatnonzero(above[1:] <= CONTEXTS)
    return counts >= max(int(fits[0]) + 1 if len(fits) else len(above) - 1, 2)


_SLOTS = (1 << SLOT_BITS) + (1 << BLOCK_BITS)  # room for the nodes of the last contexts
_EMPTY = _SLOTS  # a context's nodes lie in the NODES slots from its first one


def _live(out: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    live = np.ones(len(out), bool)
    live[(bounds[:-1, None] + np.arange(_PAD)).ravel()] = False
    return np.flatnonzero(live)


def count_contexts(out: np.ndarray, bounds: np.ndarray, counts: list[np.ndarray]) -> None:
    at = _live(out, bounds)
    for own, bucket in zip(counts, contexts(out), strict=True):
        np.add.at(own, bucket[at], np.uint32(1))


def count_bits(out: np.ndarray, bounds: np.ndarray, code: Code, chosen: list[np.ndarray], counts: list[np.ndarray]) -> None:
    """Add the bits of the texts to ``counts``: two counters a slot, zeros and ones."""
    at = _live(out, bounds)
    for own, total, bucket in zip(chosen, counts, contexts(out), strict=True):
        known = at[own[bucket[at]]]
        symbols, base, keys = out[known], bucket[known] >> (BUCKET_BITS - SLOT_BITS), []
        lengths, depth = code.length[symbols], 0
        while len(symbols):
            keys.append(2 * base + (2 * code.nodes[depth] + (code.signs[depth] > 0))[symbols])
            depth += 1
            more = np.flatnonzero(lengths > depth)
            symbols, lengths, base = symbols[more], lengths[more], base[more]
        if keys:
            np.add.at(total, np.concatenate(keys), np.uint32(1))


class Mixer:
    """Frozen predictors, and weights that every document refines for itself."""

    margins = False  # whether the tables hold logits of the bit that came rather than of a one

    def __init__(self, code: Code, chosen: list[np.ndarray], tables: list[np.ndarray]):
        self._prepare(code)
        self.chosen = chosen
        self.tables = [np.concatenate([t, np.zeros(NODES, np.int8)]) for t in tables]

    def _prepare(self, code: Code) -> None:
        self.code = code
        margin = np.arange(-12 * _GRID, 12 * _GRID + 1) / _GRID
        self.cost = (np.logaddexp(0, -margin) / np.log(2)).astype(np.float32)
        self.error = (1 / (1 + np.exp(margin))).astype(np.float32)
        self.start = np.array(START, np.float32) / np.float32(LOGIT_STEP)

    def bits(self, out: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self._bits(out, bounds, slots(contexts(out), self.chosen))

    def _place(self, base: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
        return base + node

    def _bits(self, out: np.ndarray, bounds: np.ndarray, bases: list[np.ndarray]) -> np.ndarray:
        """Bits of every text. Weights hold a set for each depth of the tree; a block is scored, then learned from."""
        n = len(bounds) - 1
        total = np.zeros(n)
        weights = np.repeat(self.start[None, :, None], len(self.code.nodes), 0).repeat(n, 2)
        begin, stop, size = bounds[:-1] + _PAD, bounds[1:], FIRST_BLOCK
        active = np.arange(n)
        while len(active):
            end = np.minimum(begin[active] + size, stop[active])
            held = end - begin[active]
            owner = np.repeat(np.arange(len(active)), held)
            at = np.arange(int(held.sum())) + np.repeat(begin[active] - (np.cumsum(held) - held), held)
            self._block(out[at], [b[at] for b in bases], owner, active, weights, total)
            begin[active] = end
            active = active[end < stop[active]]
            size = min(size * 2, LAST_BLOCK)
        return total

    def _block(self, symbols, bases, owner, active, weights, total) -> None:
        lengths, depth = self.code.length[symbols], 0
        while len(symbols):
            node, sign = (None, None) if self.margins else (self.code.nodes[depth][symbols], self.code.signs[depth][symbols])
            firsts = np.flatnonzero(owner[1:] != owner[:-1])
            firsts = np.concatenate([[0], firsts + 1])
            docs = active[owner[firsts]]
            runs = np.diff(np.append(firsts, len(owner)))
            margin, inputs = None, []
            for k, (table, base) in enumerate(zip(self.tables, bases, strict=True)):
                x = table.take(self._place(base, node, depth)).astype(np.float32)
                if not self.margins:
                    x *= sign
                part = np.repeat(weights[depth, k, docs], runs)
                part *= x
                margin = part if margin is None else np.add(margin, part, out=margin)
                inputs.append(x)
            np.clip(margin, -12, 12, out=margin)
            margin *= _GRID
            np.rint(margin, out=margin)
            margin += 12 * _GRID
            cell = margin.astype(np.intp)
            total[docs] += np.add.reduceat(self.cost.take(cell), firsts)
            error = self.error.take(cell)
            step = np.float32(RATE / LOGIT_STEP**2) / (runs + 32).astype(np.float32)
            for k, x in enumerate(inputs):
                x *= error
                weights[depth, k, docs] += step * np.add.reduceat(x, firsts)
            depth += 1
            more = lengths > depth
            if not more.all():
                more = np.flatnonzero(more)
                symbols, lengths, owner, bases = symbols[more], lengths[more], owner[more], [b[more] for b in bases]


class PathMixer(Mixer):
    """Mixes logits that were looked up beforehand: those of a context and byte lie in the order of the byte's path."""

    def __init__(self, code: Code):
        self._prepare(code)

    def path_bits(self, out: np.ndarray, bounds: np.ndarray, firsts: list[np.ndarray], held: np.ndarray) -> np.ndarray:
        """Bits of every text; ``firsts`` says for each predictor and byte where in ``held`` its path begins."""
        self.tables = [held] * PREDICTORS
        return self._bits(out, bounds, firsts)

    def _place(self, base: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
        return base + depth


class MarginMixer(PathMixer):
    """Mixes logits of the bits that came."""

    margins = True


def logits(counts: np.ndarray) -> np.ndarray:
    """Stored logit of each slot from its zeros and ones: more evidence, further from zero; none gives none."""
    pairs = counts.reshape(-1, 2).astype(np.float64)
    value = np.log((pairs[:, 1] + 0.2) / (pairs[:, 0] + 0.2))
    return np.clip(np.rint(value * LOGIT_STEP), -127, 127).astype(np.int8)


def _groups(column: pa.Array, limit: int = _GROUP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = kernels.text_bytes(column)
    for a, b in kernels.text_batches(data, offsets, limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows id, text, train as groups of about _ASKED bytes: a row each, with a number of its own and compressed texts."""
    made = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = kernels.text_bytes(batch.column(1))
        for a, b in kernels.text_batches(data, offsets, _ASKED):
            one = pa.array([0, b - a], pa.int32())
            ids, train = (pa.ListArray.from_arrays(one, batch.column(c).slice(a, b - a)) for c in (0, 2))
            texts = zstandard.ZstdCompressor(level=6).compress(data[offsets[a] : offsets[b]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([made], pa.int64()), ids, pa.array([texts], pa.binary()), pa.array([_pressed(np.diff(offsets[a : b + 1]))], pa.binary()), train],
                names=["g", "ids", "texts", "sizes", "train"])
            made += 1


def _group(texts: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts of a group, and where each begins."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8), np.concatenate([[0], np.cumsum(_opened(sizes, np.int64))])


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (kind 0) and of bytes of the canonical texts (1) over the training rows."""
    bytes_seen = np.zeros(NODES, np.int64)

    def rows(kind, keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(counts.astype(np.int64))], names=["kind", "h", "c"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for a, b, data, offsets in _groups(batch.column(0)):
            words = kernels.word_hashes(data, offsets)[0]
            held.append(np.unique(np.concatenate([words, np.full(b - a, END_WORD, np.uint64)]).view(np.int64), return_counts=True))
            out, bounds = canonical(data, offsets)
            bytes_seen += np.bincount(out[_live(out, bounds)], minlength=NODES)
            if sum(len(h[0]) for h in held) > HELD_WORDS:
                held = [_added(held)]
                if len(held[0][0]) > HELD_WORDS // 2:
                    yield rows(0, *held.pop())
    if held:
        yield rows(0, *_added(held))
    if bytes_seen.any():
        yield rows(1, np.arange(NODES, dtype=np.int64), bytes_seen)


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Words and their sums."""
    words, which = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    return words, np.bincount(which, np.concatenate([h[1] for h in held]), len(words)).astype(np.int64)


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1]]))


def _pressed(numbers: np.ndarray, level: int = 1) -> bytes:
    """Numbers byte by byte, the lowest of all first, compressed."""
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes())


def _opened(packed: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


@dataclass
class Units:
    """The words of canonical texts, each with the space behind it, and the ends: what the predictors ask for."""

    at: np.ndarray  # places that are scored
    begin: np.ndarray  # of every unit
    sizes: np.ndarray
    word: np.ndarray  # of every unit, by number
    shown: np.ndarray  # a unit for each different word
    near: np.ndarray  # different contexts and bytes of the first predictor
    nearby: np.ndarray  # which of these each place has
    own: np.ndarray  # those of the second, byte by byte for the stem of each different word
    stems: np.ndarray  # bytes of these stems
    pairs: np.ndarray  # hash of the two units before, or of a stem, and number of the word: different ones in order
    words: np.ndarray
    entry: np.ndarray  # which of these each unit is
    rest: np.ndarray  # and which each different word is behind its stem, if it goes on

    def tell(self, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different contexts and bytes with the number of training bytes, and training units of each pair and word."""
        learned = self.nearby[np.repeat(trained, self.sizes)]
        counted = np.bincount(self.word, weights=trained, minlength=len(self.shown)).astype(np.int64)
        keys = np.concatenate([self.near, self.own])
        counts = np.concatenate([np.bincount(learned, minlength=len(self.near)), np.repeat(counted, self.stems)])
        order = np.argsort(keys)
        keys, first = keys[order], _heads(keys[order])
        followed = np.bincount(self.entry, weights=trained, minlength=len(self.pairs))
        long = self.rest >= 0
        followed += np.bincount(self.rest[long], weights=counted[long], minlength=len(self.pairs))
        return keys[first], np.add.reduceat(counts[order], first), followed.astype(np.int64)

    def followed_bits(self, out: np.ndarray, code: Code) -> np.ndarray:
        """Bits of the word of each pair and word."""
        begin, sizes = self.begin[self.shown], self.sizes[self.shown]
        return np.add.reduceat(code.length[out[_spans(begin, sizes)]], np.cumsum(sizes) - sizes, dtype=np.int64)[self.words]


def _spans(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, end to end."""
    total = int(sizes.sum())
    kind = np.int32 if total + int(begin.max(initial=0)) < 1 << 31 else np.int64
    places = np.repeat((begin - (np.cumsum(sizes) - sizes)).astype(kind), sizes)
    places += np.arange(total, dtype=kind)
    return places


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, and which of them each key is: places of a table are taken by turns, one key a place and turn."""
    table, like = np.empty(1 << 20, np.int32), np.empty(len(keys), np.int32)
    left, own, multiplier = np.arange(len(keys), dtype=np.int32), keys, 0x9E3779B97F4A7C15
    while len(left):
        place = (own * np.uint64(multiplier) >> np.uint64(44)).astype(np.intp)
        table[place] = left
        found = table[place]
        hit = keys[found] == own
        if hit.all():
            like[left] = found
            break
        like[left[hit]] = found[hit]
        left, own = left[~hit], own[~hit]
        multiplier = (multiplier * multiplier + 2) % (1 << 64)
    shown = np.flatnonzero(like == np.arange(len(keys), dtype=np.int32))
    number = np.empty(len(keys), np.int32)
    number[shown] = np.arange(len(shown), dtype=np.int32)
    return keys[shown], number[like]


def _nearby(out: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different last four bytes with the byte behind them, and which of these each place has; worked out in pieces."""
    keys, number, found = [], [], 0
    for a in range(0, len(out), _GROUP):
        first = max(a - _PAD, 0)  # no place is nearer than that to the begin
        piece, own = out[first : a + _GROUP], slice(*np.searchsorted(at, [a, a + _GROUP]))
        different, like = _different((last_four(piece).astype(np.uint64) << np.uint64(8) | piece)[at[own] - first])
        keys.append(different)
        number.append(like + np.int32(found))
        found += len(different)
    near, like = _different(np.concatenate(keys))
    return near, like[np.concatenate(number)]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of every word of ``data``, each with the byte that ends it; the different ones in order, end to end, and where each ends."""
    ends = np.flatnonzero((data == 32) | (data == END)) + 1
    offsets = np.concatenate([[0], ends])
    found = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    order = pc.array_sort_indices(found.dictionary)
    held, stops = kernels.text_bytes(found.dictionary.take(order))
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[found.indices.to_numpy()], held, stops[1:]


def _in_order(pairs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (pair, word) in order, and which of them each one is."""
    least, width = (pairs.min(), int(words.max()).bit_length()) if len(pairs) else (np.uint64(0), 0)
    if len(pairs) and int(pairs.max() - least).bit_length() + width <= 64:  # both in one number
        order = np.argsort((pairs - least) << np.uint64(width) | words.astype(np.uint64))
    else:
        order = np.lexsort((words, pairs))
    pairs, words = pairs[order], words[order]
    new = np.ones(len(order), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (words[1:] != words[:-1])
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return pairs[new], words[new], entry


def units(out: np.ndarray, bounds: np.ndarray, bits: int) -> Units:
    number, data, stop = _words(out)
    start, length = np.concatenate([[0], stop[:-1]]), np.diff(stop, prepend=0)
    sums = kernels.prefix_hash(kernels.BYTE_CODES[data])
    back = kernels.powers(len(data))[1]
    hashes = kernels.mix((sums[stop] - sums[start]) * back[start] + length.astype(np.uint64))
    stems = np.minimum(length, STEM)
    places, first = _spans(start, stems), np.repeat(start, stems)
    own = _spread((sums[places] - sums[first]) * back[first])
    own = (own >> np.uint64(64 - bits) << np.uint64(8)) | data[places]
    long = np.flatnonzero(length > STEM)
    first = start[long]
    stem = kernels.mix((sums[first + STEM] - sums[first]) * back[first] ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - bits)
    del sums, places, first
    sizes = length[number]
    begin = np.cumsum(sizes) - sizes
    live = np.ones(len(begin), bool)
    live[(np.searchsorted(begin, bounds[:-1])[:, None] + np.arange(_PAD)).ravel()] = False  # a pad is a unit
    live = np.flatnonzero(live)
    begin, sizes, word = begin[live], sizes[live], number[live]
    pairs = kernels.mix(hashes[number[live - 2]] * np.uint64(0x9FB21C651E98DF25) + kernels.mix(hashes)[number[live - 1]]) >> np.uint64(64 - bits)
    shown = np.empty(len(length), np.int64)
    shown[word] = np.arange(len(word))
    at = _spans(begin, sizes)
    near, nearby = _nearby(out, at)
    near = (_four_hash(near >> np.uint64(8)) >> np.uint64(64 - bits) << np.uint64(8)) | (near & np.uint64(255))
    pairs, words, entry = _in_order(np.concatenate([pairs, stem]), np.concatenate([word, long]))
    rest = np.full(len(shown), -1)
    rest[long] = entry[len(word) :]
    return Units(at, begin, sizes, word, shown, near, nearby, own, stems, pairs, words, entry[: len(word)], rest)


def _ask(batches: Iterator[pa.RecordBatch], bits: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows g, texts, sizes, train: what a group asks for in order, with counts in training rows, part by part.

    The first ``parts`` parts hold contexts and bytes of the first two predictors; the others pairs of words, or stems, and the
    words that follow, as numbers in a list of words that comes along.
    """
    edges = (np.arange(1, parts, dtype=object) * (1 << bits) // parts).astype(np.uint64)

    def cut(hashes):
        cuts = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
        return [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]

    for batch in batches:
        for g, texts, sizes, train in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out, bounds = canonical_group(*_group(texts, sizes))
            asked = units(out, bounds, bits)
            of = np.searchsorted(bounds, asked.begin, "right") - 1
            keys, counts, followed = asked.tell(np.array(train, bool)[of])
            rows = []
            for p, a, b in cut(keys >> np.uint64(8)):
                rows.append((p, g, _pressed(np.diff(keys[a:b] >> np.uint64(8), prepend=np.uint64(0))), _pressed(keys[a:b].astype(np.uint8)),
                             _pressed(counts[a:b].astype(np.uint32)), None))
            for p, a, b in cut(asked.pairs):
                held, number = np.unique(asked.words[a:b], return_inverse=True)
                shown = asked.shown[held]
                words = zstandard.ZstdCompressor(level=3).compress(out[_spans(asked.begin[shown], asked.sizes[shown])].tobytes())
                rows.append((parts + p, g, _pressed(np.diff(asked.pairs[a:b], prepend=np.uint64(0))), _pressed(number.astype(np.uint32)),
                             _pressed(followed[a:b].astype(np.uint32)), words))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["part", "g", "contexts", "symbols", "counts", "words"])


def _margin(same: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Stored logit of a bit that came, from how often it and the other one were seen."""
    return np.clip(np.rint(np.log((same + 0.2) / (other + 0.2)) * LOGIT_STEP), -127, 127).astype(np.int8)


def _shared_bits(data: np.ndarray, a: np.ndarray, b: np.ndarray, bit: np.ndarray, code: Code) -> np.ndarray:
    """Bits that the different words beginning at ``a`` and at ``b`` have in common; ``bit`` counts bits before each byte."""
    up = code.signs > 0
    found, ask, step = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(ask):
        x, y = data[a[ask] + step], data[b[ask] + step]
        parted = np.flatnonzero(x != y)
        if len(parted):
            own, x, y = a[ask[parted]], x[parted], y[parted]
            # Paths end in leaves of their own, so they part before the shorter one ends.
            found[ask[parted]] = bit[own + step] - bit[own] + (up[:, x] != up[:, y]).argmax(0)
            ask = np.delete(ask, parted)
        step += 1
    return found


def follower_counts(pairs: np.ndarray, begin: np.ndarray, counts: np.ndarray, data: np.ndarray, bit: np.ndarray, code: Code):
    """How often each word's pair was seen, how many turns its path has, their bits and how often the path was followed on.

    Rows are different (pair, word), pair by pair and words in the order of their bits, so all words that share a pair and
    first bits lie together: the counts of a node of the tree are sums over such runs. Turns are the bits at which other words
    that were seen leave the path, word by word and in order.
    """
    common = np.full(len(pairs) + 1, -1, np.int64)  # bits shared with the row before; -1 for another pair
    same = np.flatnonzero(pairs[1:] == pairs[:-1]) + 1
    common[same] = _shared_bits(data, begin[same - 1], begin[same], bit, code)
    rows = np.flatnonzero((common[:-1] >= 0) | (common[1:] >= 0))
    totals, depth, turns = counts.copy(), 0, []
    while len(rows):
        before, after = common[rows], common[rows + 1]
        start = np.flatnonzero(before < depth)
        total = np.repeat(np.add.reduceat(counts[rows], start), np.diff(np.append(start, len(rows))))
        if not depth:
            totals[rows] = total
        parts = int(np.where(before >= depth, before, np.iinfo(np.int64).max).min())  # the next bit at which any run splits
        start = np.flatnonzero(before <= parts)
        kept = np.repeat(np.add.reduceat(counts[rows], start), np.diff(np.append(start, len(rows))))
        left = np.flatnonzero(kept != total)
        turns.append((rows[left].astype(np.int32), parts, kept[left].astype(np.uint32)))
        depth = parts + 1
        rows = rows[(before >= depth) | (after >= depth)]
    many = np.zeros(len(pairs), np.int64)
    for rows, _, _ in turns:
        many[rows] += 1
    bits, kept = np.empty(int(many.sum()), np.int32), np.empty(int(many.sum()), np.uint32)
    place = np.cumsum(many) - many
    for rows, parts, count in turns:
        bits[place[rows]], kept[place[rows]] = parts, count
        place[rows] += 1
    return totals, many, bits, kept


def _alike(pairs: np.ndarray, turns: np.ndarray, first: np.ndarray, gaps: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """How many first turns each word shares with the word before it, if that has the same pair; ``first``: where its turns begin."""
    alike, ask, step = np.zeros(len(pairs), np.int64), np.flatnonzero(pairs[1:] == pairs[:-1]) + 1, 0
    while len(ask):
        ask = ask[(turns[ask] > step) & (turns[ask - 1] > step)]
        a, b = first[ask] + step, first[ask - 1] + step
        ask = ask[(gaps[a] == gaps[b]) & (kept[a] == kept[b])]
        step += 1
        alike[ask] = step
    return alike


def _again(alike: np.ndarray, turns: np.ndarray, sent: np.ndarray) -> np.ndarray:
    """For every turn its place among those sent: the turns that a word shares with the word before it are not sent again."""
    first, begin = np.cumsum(turns) - turns, np.cumsum(turns - alike) - turns
    place = np.arange(int(turns.sum())) + np.repeat(begin - first, turns)
    rows, step = np.flatnonzero(turns > 0), 0
    while len(rows):
        at = first[rows] + step
        new = alike[rows] <= step
        place[at] = place[at][np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        step += 1
        rows = rows[turns[rows] > step]
    return sent[place]


def _unrolled(turns: bytes, counts: bytes, gaps: bytes, nbits: np.ndarray) -> np.ndarray:
    """Margins of all bits of words of ``nbits`` bits, end to end, from their counts and turns (``_turns``)."""
    turns, alike = _opened(turns, np.uint32).astype(np.int64).reshape(2, -1)
    n, last = len(turns), np.cumsum(turns + 1) - 1
    first = last - turns
    counts = _opened(counts, np.uint32)
    inner = np.ones(n + int(turns.sum()), bool)
    inner[first] = False
    turned = np.flatnonzero(inner)
    seen = np.empty(len(inner), np.int64)
    places = _again(alike, turns, np.arange(len(counts) - n))
    seen[first], seen[turned] = counts[:n], counts[n:][places]
    # By turns the bit of a turn, none for the first, and the bits from there to the next one.
    lengths = np.zeros((len(inner), 2), np.int64)
    lengths[turned, 0] = 1
    lengths[turned - 1, 1] = _opened(gaps, np.uint32)[places]
    lengths[last, 1] = nbits - np.add.reduceat(lengths.sum(1), first)
    margins = np.zeros((len(inner), 2), np.int8)
    margins[:, 1] = _margin(seen, 0)
    margins[turned, 0] = _margin(seen[turned], seen[turned - 1] - seen[turned])
    return np.repeat(margins.ravel(), lengths.ravel())


def _turns(asked: pa.Table, code: Code) -> Iterator[tuple[bytes, bytes, bytes, np.ndarray]]:
    """The rows of a part of pairs: counts of all groups together, and of the words each group asks for the numbers of turns, the
    counts before any and behind each, the bits before each since the last one; and the bits of the words.

    The first turns that a word has in common with the word before it come with that one only.
    """
    pairs, numbers, counts, data, shift = [], [], [], [], 0
    for hashes, number, count, words in zip(*(asked.column(c).to_pylist() for c in ("contexts", "symbols", "counts", "words")), strict=True):
        pairs.append(np.cumsum(_opened(hashes, np.uint64), dtype=np.uint64))
        data.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(words), np.uint8))
        numbers.append(_opened(number, np.uint32).astype(np.int64) + shift)
        shift += int(((data[-1] == 32) | (data[-1] == END)).sum())
        counts.append(_opened(count, np.uint32).astype(np.int64))
    sizes = [len(p) for p in pairs]
    pairs, numbers, counts, data = (np.concatenate(x) for x in (pairs, numbers, counts, data))
    word, data, ends = _words(data)
    begin = np.concatenate([[0], ends[:-1]])
    leaf = np.empty(NODES, np.uint8)  # bytes in the order of their paths
    leaf[np.lexsort((code.signs > 0)[::-1])] = np.arange(NODES)
    spelt = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(leaf[data])])
    order = pc.array_sort_indices(spelt).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    begin, ends = begin[order], ends[order]
    bit = np.concatenate([[0], np.cumsum(code.length[data], dtype=np.int64)])
    pairs, number, entry = _in_order(pairs, rank[word[numbers]])
    counts = np.bincount(entry, counts, len(pairs)).astype(np.int64)
    nbits = (bit[ends] - bit[begin])[number]
    totals, turns, at, kept = follower_counts(pairs, begin[number], counts, data, bit, code)
    begins, done = np.cumsum(turns) - turns, 0
    gaps = np.diff(at, prepend=0) - 1  # from the turn before
    more = begins[turns > 0]
    gaps[more] = at[more]
    del at, more, counts, number
    for size in sizes:
        own = entry[done : done + size]
        many, first = turns[own], begins[own]
        alike = _alike(pairs[own], many, first, gaps, kept)
        places = _spans(first + alike, many - alike)
        yield (_pressed(np.concatenate([many, alike]).astype(np.uint32)), _pressed(np.concatenate([totals[own], kept[places]]).astype(np.uint32), 3),
               _pressed(gaps[places].astype(np.uint32)), nbits[own])
        done += size


def _answer_turns(asked: pa.Table, code: Code) -> pa.Table:
    turns, counts, gaps = (pa.array(x, pa.binary()) for x in zip(*(t[:3] for t in _turns(asked, code)), strict=True))
    return pa.table({"g": asked.column("g"), "part": asked.column("part"), "held": counts, "turns": turns, "gaps": gaps})


def _answer_pairs(asked: pa.Table, code: Code) -> pa.Table:
    """The margins that ``_held`` makes of the turns."""
    held = [_pressed(_unrolled(*t)) for t in _turns(asked, code)]
    return pa.table({"g": asked.column("g"), "part": asked.column("part"), "held": pa.array(held, pa.binary())})


def node_counts(keys: np.ndarray, counts: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context, node) in order and their zeros and ones, from distinct keys (context, byte) and their counts."""
    symbols = (keys & np.uint64(255)).astype(np.int64)
    base, number, depth = keys - symbols.astype(np.uint64), counts.astype(np.int64), 0
    lengths, made, zeros, ones = code.length[symbols], [], [], []
    while len(symbols):
        up = code.signs[depth][symbols] > 0
        places = base | code.nodes[depth][symbols].astype(np.uint64)
        order = np.argsort(places, kind="stable")
        first = _heads(places[order])
        made.append(places[order][first])
        zeros.append(np.add.reduceat(np.where(up, 0, number)[order], first))
        ones.append(np.add.reduceat(np.where(up, number, 0)[order], first))
        depth += 1
        more = np.flatnonzero(lengths > depth)
        symbols, lengths, base, number = symbols[more], lengths[more], base[more], number[more]
    if not made:
        return keys[:0], np.zeros((0, 2), np.int64)
    # A node has one depth, so no key comes twice.
    flat = np.concatenate(made)
    order = np.argsort(flat)
    return flat[order], np.stack([np.concatenate(zeros)[order], np.concatenate(ones)[order]], 1)


def path_logits(asked: np.ndarray, nodes: np.ndarray, held: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Logits along the byte's path for each key (context, byte) asked for, end to end, and where each path begins."""
    symbols = (asked & np.uint64(255)).astype(np.int64)
    base, lengths = asked - symbols.astype(np.uint64), code.length[symbols]
    first = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    flat, at, depth = np.zeros(int(first[-1]), np.int8), first[:-1], 0
    nodes, held = np.append(nodes, np.uint64(2**64 - 1)), np.append(held, np.int8(0))
    while len(symbols):
        places = base | code.nodes[depth][symbols].astype(np.uint64)
        found = np.searchsorted(nodes, places)
        flat[at + depth] = np.where(nodes[found] == places, held[found], 0)
        depth += 1
        more = np.flatnonzero(lengths > depth)
        symbols, lengths, base, at = symbols[more], lengths[more], base[more], at[more]
    return flat, first


def _answer(asked: pa.Table, code: Code) -> pa.Table:
    """The rows of a part: sum its counters over all groups and give each group the logits it asks for."""
    keys, counts = [], []
    for contexts_, symbols, number in zip(*(asked.column(c).to_pylist() for c in ("contexts", "symbols", "counts")), strict=True):
        keys.append(np.cumsum(_opened(contexts_, np.uint64), dtype=np.uint64) << np.uint64(8) | _opened(symbols, np.uint8))
        counts.append(_opened(number, np.uint32))
    flat, number = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(flat)
    flat = flat[order]
    first = _heads(flat)
    sums, distinct = np.add.reduceat(number[order].astype(np.int64), first), flat[first]
    del flat, number, order
    learned = sums > 0
    nodes, held = node_counts(distinct[learned], sums[learned], code)
    found, begins = path_logits(distinct, nodes, logits(held), code)
    out = []
    for own in keys:
        at = np.searchsorted(distinct, own)
        lengths = code.length[(own & np.uint64(255)).astype(np.int64)].astype(np.int64)
        ends = np.cumsum(lengths)
        out.append(_pressed(found[np.repeat(begins[at] - (ends - lengths), lengths) + np.arange(int(ends[-1]))]))
    none = pa.nulls(len(out), pa.binary())
    return pa.table({"g": asked.column("g"), "part": asked.column("part"), "held": pa.array(out, pa.binary()), "turns": none, "gaps": none})


def _firsts(out: np.ndarray, asked: Units, code: Code) -> tuple[list[np.ndarray], np.ndarray, int]:
    """For each predictor and byte where its path begins in the answers to the texts' group, zero for pads.

    The answers are those for contexts and bytes, then those for pairs. Also the signs of the paths of the former.
    """
    keys = np.sort(np.concatenate([asked.near, asked.own]))
    keys = keys[_heads(keys)]
    symbols = (keys & np.uint64(255)).astype(np.int64)
    lengths = code.length[symbols].astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    kind = np.int32 if int(lengths.sum()) + code.length[out].sum(dtype=np.int64) + asked.followed_bits(out, code).sum() < 1 << 31 else np.int64
    total, signs, depth = int(lengths.sum()), np.ones(int(lengths.sum()), np.int8), 0
    left = np.arange(len(keys))
    while len(left):
        signs[begins[left] + depth] = code.signs[depth][symbols[left]]
        depth += 1
        left = left[lengths[left] > depth]
    bit = np.zeros(len(out) + 1, kind)
    np.cumsum(code.length[out], out=bit[1:])
    nbits = asked.followed_bits(out, code)
    firsts = np.zeros((PREDICTORS, len(out)), kind)
    firsts[0, asked.at] = begins.astype(kind)[np.searchsorted(keys, asked.near)][asked.nearby]
    start = (total + np.cumsum(nbits) - nbits).astype(kind)
    firsts[2, asked.at] = bit[asked.at] + np.repeat(start[asked.entry] - bit[asked.begin], asked.sizes)
    # The second predictor, byte by byte for each different word: stems from the contexts, the rest from the words behind them.
    sizes, begin = asked.sizes[asked.shown], asked.begin[asked.shown]
    places = _spans(begin, sizes)
    of = bit[places] + np.repeat(start[asked.rest] - bit[begin], sizes)
    of[_spans(np.cumsum(sizes) - sizes, asked.stems)] = begins[np.searchsorted(keys, asked.own)]
    firsts[1, asked.at] = of[_spans((np.cumsum(sizes) - sizes)[asked.word], asked.sizes)]
    return list(firsts), signs, total


def _held(answered: pa.Table, signs: np.ndarray, nbits: np.ndarray) -> np.ndarray:
    """All answers to a group end to end, as margins of the bits that came."""
    found, at = [], 0
    answered = answered.sort_by("part")
    for held, turns, gaps in zip(*(answered.column(c).to_pylist() for c in ("held", "turns", "gaps")), strict=True):
        if turns is None:
            found.append(_opened(held, np.int8))
        else:
            n = len(_opened(turns, np.uint32)) // 2
            found.append(_unrolled(turns, held, gaps, nbits[at : at + n]))
            at += n
    flat = np.concatenate(found)
    flat[: len(signs)] *= signs
    return flat


@dataclass
class Model:
    code: Code
    counts: DataFrame  # h, c: every training token
    tokens: int
    types: int
    heavy: tuple[np.ndarray, np.ndarray]  # hashes in order, counts


def _heavy(counts: DataFrame) -> DataFrame:
    """Words above the lowest threshold on a fixed scale of counts that at most HEAVY_WORDS reach."""
    grade = F.floor(F.log2("c") * 64).cast("int")
    grades = sorted(((r.g, r.n) for r in counts.groupBy(grade.alias("g")).agg(F.count("*").alias("n")).collect()), reverse=True)
    left, least = HEAVY_WORDS, 1 << 20
    for g, n in grades:  # 64 steps a doubling: a few thousand rows at any size
        left -= n
        if left < 0:
            break
        least = g
    return counts.where(grade >= least)


class Heavy:
    """Counts of the most frequent words: their hashes in order, and where each leading part of a hash begins."""

    LEAD = 20

    def __init__(self, keys: np.ndarray, gain: np.ndarray):
        self.keys = np.concatenate([keys, np.zeros(1, np.int64)])
        self.gain = np.concatenate([gain, np.zeros(1)])
        lead = self._lead(keys)
        self.begin = np.searchsorted(lead, np.arange((1 << self.LEAD) + 1)).astype(np.int32)
        self.steps = int(np.diff(self.begin).max(initial=0))

    def _lead(self, words: np.ndarray) -> np.ndarray:
        return (words >> (64 - self.LEAD)) + (1 << (self.LEAD - 1))

    def find(self, words: np.ndarray) -> np.ndarray:
        """Place of each word, -1 if it is not here."""
        at = np.full(len(words), -1, np.int64)
        lead = self._lead(words)
        ask, place, end = np.arange(len(words)), self.begin[lead], self.begin[lead + 1]
        for _ in range(self.steps):
            more = np.flatnonzero(place < end)
            ask, place, end = ask[more], place[more], end[more]
            hit = self.keys[place] == words[ask]
            at[ask[hit]] = place[hit]
            place = place + 1
        return at


def train(texts: DataFrame) -> Model:
    """Learn code and token counts from a table with one column ``text``."""
    spark = texts.sparkSession
    before = spark.conf.get(BATCH_LIMIT, None)
    spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    try:
        partial = written(texts.mapInArrow(lambda it: kernels.giving_back(_first_pass(it)), "kind int, h long, c long"))
    finally:
        if before is None:
            spark.conf.unset(BATCH_LIMIT)
        else:
            spark.conf.set(BATCH_LIMIT, before)
    seen = np.zeros(NODES, np.int64)
    for r in partial.where("kind = 1").groupBy("h").agg(F.sum("c").alias("c")).collect():  # one row a byte value
        seen[r.h] = r.c
    counts = written(partial.where("kind = 0").groupBy("h").agg(F.sum("c").alias("c")))
    discard(partial)
    size = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = _heavy(counts).toPandas().sort_values("h")
    return Model(Code.from_counts(seen), counts, size.n or 0, size.v or 0, (top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64)))


def score(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte`` of every whole text.

    The model reads words in lower case (A-Z), a space after each and an end byte. A byte is a path through a Huffman
    tree; at every node the logits that three hashed contexts hold from the training bits of the whole corpus are mixed
    by gated weights (a set for each depth), which each document refines after every block it has paid for, so the
    probabilities of all texts sum to one. ``score`` is the log10 probability, ``bits_per_byte`` the same per byte read.
    ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens, the end included.

    Counters are summed over all rows for which ``train_on`` is true. Every context of every text is counted and looked
    up, in tables that grow with the corpus and are cut into parts by hash: (context, byte) for the last four bytes and for
    the word so far, (two words before, word) for the third. A group of texts sends each part its distinct keys with their
    training counts, and gets the logits of those keys back. Only token counts of
    the most frequent words are broadcast; all others are joined. Null texts are empty: one token, the end. Repeated
    rows and null ids are scored one by one. Without training rows everything is unknown.
    """
    text, spark = text_or_empty(text_col), docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t"), F.coalesce(train_on, F.lit(False)).alias("_train"))
    kind = rows.schema["_id"].dataType.simpleString()
    groups = written(rows.mapInArrow(lambda it: kernels.giving_back(_grouped(it)), f"g long, ids array<{kind}>, texts binary, sizes binary, train array<boolean>"))
    model = train(docs.where(train_on).select(text.alias("text")))
    size = rows.agg(F.sum(F.octet_length("_t") + 2)).first()[0] or 1
    bits, parts = min(max(int(size * PREDICTORS).bit_length() + SPARE_BITS, 32), 55), -(-int(size) // PART_BYTES)
    shared = spark.sparkContext.broadcast((model.code, model.heavy))
    scale = model.tokens + 0.5 * (model.types + 1)
    asked = groups.select("g", "texts", "sizes", "train").mapInArrow(
        lambda it: kernels.giving_back(_ask(it, bits, parts)), "part int, g long, contexts binary, symbols binary, counts binary, words binary")

    def answer(own: pa.Table) -> pa.Table:
        found = (_answer if own.column("part")[0].as_py() < parts else _answer_turns)(own, shared.value[0])
        kernels.give_back()
        return found

    answers = written(asked.groupBy("part").applyInArrow(answer, "g long, part int, held binary, turns binary, gaps binary"))

    def run(own: pa.Table, answered: pa.Table) -> pa.Table:
        found = mixed(own, answered)
        kernels.give_back()
        return found

    def mixed(own: pa.Table, answered: pa.Table) -> pa.Table:
        code, (keys, freq) = shared.value
        mixer, heavy = MarginMixer(code), Heavy(keys, np.log10((freq + 0.5) / scale))
        data, offsets = _group(own.column("texts")[0].as_py(), own.column("sizes")[0].as_py())
        ids = own.column("ids").combine_chunks()
        ids = ids.values.slice(ids.offsets[0].as_py(), len(offsets) - 1)
        out, starts = canonical_group(data, offsets)
        asked = units(out, starts, bits)
        firsts, signs, _ = _firsts(out, asked, code)
        held = _held(answered, signs, asked.followed_bits(out, code))
        del asked
        made = []
        for a, b in kernels.text_batches(data, offsets, _GROUP):
            part, own_offsets = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            words, bounds = kernels.word_hashes(part, own_offsets)
            words = np.insert(words, bounds[1:], END_WORD).view(np.int64)
            bounds = bounds + np.arange(len(bounds))
            at = heavy.find(words)
            known = at >= 0
            base = np.add.reduceat(heavy.gain[at], bounds[:-1])
            n_known = np.add.reduceat(known.astype(np.int64), bounds[:-1])
            rest = words[~known]
            rest_bounds = np.concatenate([[0], np.cumsum(np.add.reduceat((~known).astype(np.int64), bounds[:-1]))])
            done, ends = slice(starts[a], starts[b]), starts[a : b + 1] - starts[a]
            score_bits = mixer.path_bits(out[done], ends, [f[done] for f in firsts], held)
            made.append(pa.table([
                ids.slice(a, b - a), pa.array(np.diff(bounds)), pa.array(n_known), pa.array(base), pa.array(score_bits),
                pa.array(np.diff(ends) - _PAD), pa.ListArray.from_arrays(pa.array(rest_bounds.astype(np.int32)), pa.array(rest)),
            ], names=["_id", "n_tokens", "n_known", "base", "bits", "n_bytes", "rest"]))
        return pa.concat_tables(made)

    scored = written(
        groups.select("g", "ids", "texts", "sizes").groupBy("g").cogroup(answers.groupBy("g"))
        .applyInArrow(run, f"_id {kind}, n_tokens long, n_known long, base double, bits double, n_bytes long, rest array<long>")
        .withColumn("_row", F.monotonically_increasing_id()))
    discard(groups, answers)
    rare = scored.where("size(rest) > 0").select("_row", F.explode("rest").alias("h"))
    rare = rare.join(model.counts, "h", "left").groupBy("_row").agg(
        F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(scale)))).alias("_more"), F.count("c").alias("_found"))
    both = scored.drop("rest").join(rare, "_row", "left")
    return both.select(
        F.col("_id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("_found", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"),
        (F.col("bits") * -float(np.log10(2))).alias("score"), "n_bytes", (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
