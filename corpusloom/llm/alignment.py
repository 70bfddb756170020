"""Alignment of the tokens of two vocabularies, with document counts of linked pairs under a minimal perfect hash."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels
from corpusloom.llm.common import discard, text_or_empty, written

BATCH_BYTES = 1 << 20  # texts encoded and aligned at once; a longer text stands alone
LINKS = 1 << 20  # links of different ids spelled out at once
WIDE = 1 << 12  # links of a group above which equal ids of the group are taken together
HELD_PAIRS = 1 << 19  # counted pairs a task holds before it gives them out
MEMO_BYTES = 12 << 20  # stretches of text and their ids a worker keeps before it starts afresh
LONG_STRETCH = 64  # characters of a stretch above which it isn't kept
SHARD_KEYS = 1 << 16  # pairs a shard of the hash has on average
FAN_IN = 16  # count vectors added at once
TABLE_BYTES = 64 << 20  # shards looked up in one reading of the documents; they go to every worker
_SHIFT = np.uint64(32)
LOT_BYTES = 1 << 12  # stretches an encoder gets as one text
APART = 8  # stretches among which one isn't spelled back that are encoded one by one
_BETWEEN = re.compile(r" (?<=[^\s\u2581] )(?=[^\s\u2581])")
_EDGE = re.compile(r"\A[\s\u2581]|[\s\u2581]\Z|\A\Z")
_VOCABULARIES: dict = {}


class Vocabulary:
    """Batch encoder of one vocabulary file and the bytes of its tokens.

    ``.json`` files are read by *tokenizers* (byte-level entries), ``.model`` files by *sentencepiece*, which puts a space
    before a text by itself. Special tokens are not added and their strings inside a text are plain text.

    ``apart`` tells that no token reaches across a single space between two other characters: the byte-level pattern begins a
    piece at such a space whatever stands around it, and no entry of a piece vocabulary holds a space behind another character.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core already
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            entries = [_piece_bytes(p) for p in pieces]
            plain = "  \u00e9\ufb01  x \u2126 "  # comes back with its spaces and characters only if nothing is normalised
            self.apart = model.normalize(plain) == ("\u2581" + plain.replace(" ", "\u2581")) and not any("\u2581" in p.lstrip("\u2581") for p in pieces)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            model.encode_special_tokens = True
            self.encode = lambda texts: [x.ids for x in model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
            alphabet = _byte_alphabet()
            named = {i: t for t, i in model.get_vocab(with_added_tokens=True).items()}
            with open(path, encoding="utf-8") as file:
                spec = json.load(file)
            added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
            entries = [added[i] if i in added else bytes(alphabet[c] for c in named.get(i, "")) for i in range(max(named) + 1)]
            cut = spec.get("pre_tokenizer") or {}
            self.apart = (
                spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
                and all(t.get("special") for t in spec.get("added_tokens", [])))
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        digits = [str(i).encode() for i in range(len(entries))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_sizes = np.array([len(d) for d in digits], np.int64)
        self.digit_starts = np.cumsum(self.digit_sizes) - self.digit_sizes

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        return self.flat[np.arange(sizes.sum()) + np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes)]


@dataclass
class Measured:
    """What is known of stretches laid end to end: ids under both vocabularies, spelled groups (the sign behind each included), and so on."""

    ids: list[np.ndarray]
    tokens: list[np.ndarray]  # of every stretch, by side
    shown: np.ndarray
    sizes: np.ndarray  # of the spelled groups
    groups: np.ndarray
    links: np.ndarray
    whole: np.ndarray  # whether both sides spell the stretch back

    def __add__(self, other: Measured) -> Measured:
        both = lambda x, y: np.concatenate([x, y])
        return Measured(
            [both(x, y) for x, y in zip(self.ids, other.ids, strict=True)], [both(x, y) for x, y in zip(self.tokens, other.tokens, strict=True)],
            *[both(getattr(self, n), getattr(other, n)) for n in ("shown", "sizes", "groups", "links", "whole")])

    def take(self, which: np.ndarray) -> Measured:
        spans = [_spans((np.cumsum(n, dtype=np.int64) - n)[which], n[which].astype(np.int64)) for n in (*self.tokens, self.sizes)]
        return Measured(
            [x[at] for x, at in zip(self.ids, spans, strict=False)], [t[which] for t in self.tokens],
            self.shown[spans[2]], *[x[which] for x in (self.sizes, self.groups, self.links, self.whole)])

    def head(self, n: int) -> Measured:
        return Measured(
            [x[: t[:n].sum(dtype=np.int64)] for x, t in zip(self.ids, self.tokens, strict=True)], [t[:n] for t in self.tokens],
            self.shown[: self.sizes[:n].sum(dtype=np.int64)], *[x[:n] for x in (self.sizes, self.groups, self.links, self.whole)])


class Encoder:
    """Ids and groups of texts under two vocabularies.

    Where both allow it, texts are cut at single spaces and every different stretch is encoded and aligned once: tokens of both end
    where a stretch does, so the groups of a text are those of its stretches.
    """

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.sides = (a, b)
        self.memo: dict[str, int] = {}  # in the order of ``known``
        self.known = self._fresh([], [])
        self.used = np.zeros(0, np.int64)  # how often since the last thinning
        self.text = self.held = 0

    def _measured(self, stretches: list[str]) -> list[tuple[bytes, bytes]]:
        found = [[np.array(ids, _width(v)).tobytes() for ids in v.encode(stretches)] for v in self.sides]
        return list(zip(*found, strict=True))

    def _together(self, stretches: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Ids and their numbers by side, from the stretches as one text; none if that isn't spelled back."""
        target, ends = _raw(stretches)
        # Lots of a few kilobytes: an encoder's work on a text grows a little faster than the text.
        lots = np.flatnonzero(np.diff(ends // LOT_BYTES, prepend=-1)).tolist()
        texts, out = [" ".join(stretches[x:y]) for x, y in zip(lots, [*lots[1:], len(stretches)], strict=True)], []
        for v in self.sides:
            ids = np.fromiter(itertools.chain.from_iterable(v.encode(texts)), _width(v))
            reached = np.cumsum(v.sizes[ids])
            cut = np.searchsorted(reached, ends, "right")
            if not np.array_equal(reached[cut - 1], ends) or len(reached) != cut[-1] or not np.array_equal(v.bytes_of(ids), target):
                return None
            out.append((ids, np.diff(cut, prepend=0)))
        return out

    def _ids(self, stretches: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and their numbers by side."""
        if len(stretches) > 1 and (found := self._together(stretches)) is not None:
            return found
        if len(stretches) > APART:
            # Some of them is not spelled back: the others are still taken together.
            half = len(stretches) // 2
            parts = [self._ids(stretches[:half]), self._ids(stretches[half:])]
            return [tuple(np.concatenate(x) for x in zip(*own, strict=True)) for own in zip(*parts, strict=True)]
        found = list(zip(*self._measured(stretches), strict=True)) if stretches else [(), ()]
        kinds = [_width(v) for v in self.sides]
        return [(np.frombuffer(b"".join(own), k), np.array([len(x) // np.dtype(k).itemsize for x in own], np.int64)) for own, k in zip(found, kinds, strict=True)]

    def _fresh(self, stretches: list[str], edged: list[str]) -> Measured:
        """Stretches, then those that begin or end with white space: these stand alone, the others meet at single spaces as in a text."""
        parts = [self._ids(stretches), *[self._ids([s]) for s in edged]]
        stretches = stretches + edged
        raw, ends = _raw(stretches)
        ids, tokens, whole = [], [], np.ones(len(stretches), bool)
        for v, own in zip(self.sides, zip(*parts, strict=True), strict=True):
            flat, n = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own]).astype(np.int64)
            reached = np.concatenate([[0], np.cumsum(v.sizes[flat])])[np.cumsum(n)]
            if not np.array_equal(reached, ends) or not np.array_equal(v.bytes_of(flat), raw):
                for i, (x, y) in enumerate(zip(np.cumsum(n) - n, np.cumsum(n), strict=True)):
                    whole[i] &= v.bytes_of(flat[x:y]).tobytes() == raw[ends[i - 1] if i else 0 : ends[i]].tobytes()
            ids.append(flat)
            tokens.append(n)
        good = [(flat[np.repeat(whole, n)], np.where(whole, n, 0)) for flat, n in zip(ids, tokens, strict=True)]
        own = Groups.laid([x[0].astype(np.int64) for x in good], good[0][1], *self.sides)
        shown, cut = own.written()
        return Measured(
            ids, [n.astype(np.int32) for n in tokens], shown, np.diff(cut).astype(np.int32), own.per_document(np.ones(len(own.ends), np.int64)),
            own.per_document(own.sizes[0] * own.sizes[1]), whole)

    def _look(self, texts: list[str]) -> tuple[Measured, np.ndarray, np.ndarray]:
        """Stretches at hand, which of them the texts consist of, and how many come before each text."""
        if self.held > MEMO_BYTES:
            self._thin()
        cut = [_stretches(t) if t else [] for t in texts]
        flat = list(itertools.chain.from_iterable(cut))
        new = set(flat).difference(self.memo)
        edged = new.intersection(s for own in cut if own for s in (own[0], own[-1]) if _EDGE.search(s))
        plain = new - edged
        short = [s for s in plain if len(s) <= LONG_STRETCH]
        rest = [*(s for s in plain if len(s) > LONG_STRETCH), *edged]
        table, at = self.known, len(self.memo)
        if new:
            table = self.known + self._fresh(short + rest[: len(rest) - len(edged)], rest[len(rest) - len(edged) :])
            self.memo.update(zip(short + rest, range(at, at + len(new)), strict=True))
        which = np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat))
        if new:
            for s in rest:
                del self.memo[s]
            self.known = table.head(at + len(short))
            self.used = np.concatenate([self.used, np.zeros(len(short), np.int64)])
            self.text += sum(map(len, short))
            self.held = self.text + sum(x.nbytes for x in (*self.known.ids, self.known.shown))
        self.used += np.bincount(which, minlength=len(table.whole))[: len(self.used)]
        return table, which, np.cumsum([0, *map(len, cut)])

    def _thin(self) -> None:
        """Keep the stretches that came again, the most frequent ones of them if these alone fill half the room."""
        order = np.argsort(-self.used, kind="stable")
        order = order[: np.searchsorted(-self.used[order], -1)]
        weight = np.cumsum(self.held / len(self.used) * np.ones(len(order)))
        keep = np.sort(order[: np.searchsorted(weight, MEMO_BYTES // 2)])
        names = list(self.memo)
        self.memo = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.known, self.used = self.known.take(keep), np.zeros(len(keep), np.int64)
        self.text = sum(map(len, self.memo))
        self.held = self.text + sum(x.nbytes for x in (*self.known.ids, self.known.shown))

    def _laid(self, texts: list[str]) -> tuple[Measured, np.ndarray, np.ndarray, list[list[np.ndarray]]]:
        """The stretches of the texts, and the ids of every text by side: none for texts that are not spelled back."""
        table, which, bounds = self._look(texts)
        found = []
        for ids, n in zip(table.ids, table.tokens, strict=True):
            own = n[which].astype(np.int64)
            flat, ends = ids[_spans((np.cumsum(n, dtype=np.int64) - n)[which], own)], np.concatenate([[0], np.cumsum(own)])[bounds].tolist()
            found.append([flat[x:y] for x, y in zip(ends, ends[1:], strict=False)])
        # A stretch that isn't spelled back: the whole text decides.
        for i in np.unique(np.searchsorted(bounds, np.flatnonzero(~table.whole[which]), "right") - 1).tolist():
            if not self._spelled_back(texts[i], [f[i] for f in found]):
                found[0][i], found[1][i] = found[0][i][:0], found[1][i][:0]
        return table, which, bounds, found

    def _spelled_back(self, text: str, ids: list[np.ndarray]) -> bool:
        raw = (" " + text).encode()
        return bool(text) and all(v.sizes[x].sum() == len(raw) and v.bytes_of(x).tobytes() == raw for v, x in zip(self.sides, ids, strict=True))

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of every text; none for texts that either vocabulary does not spell back as space and text."""
        if all(v.apart for v in self.sides):
            found = [[x.astype(np.int64) for x in own] for own in self._laid(texts)[3]]
        else:
            coded = self._measured(texts) if texts else []
            found = [[np.frombuffer(c[side], _width(self.sides[side])).astype(np.int64) for c in coded] for side in (0, 1)]
            for i, text in enumerate(texts):
                if not self._spelled_back(text, [f[i] for f in found]):
                    found[0][i] = found[1][i] = np.empty(0, np.int64)
        return found[0], found[1]

    def aligned(self, texts: list[str]) -> tuple[list[list[np.ndarray]], np.ndarray, np.ndarray, list[str]]:
        """Ids of every text by side, numbers of its groups and links, and the digest of its groups."""
        if not all(v.apart for v in self.sides):
            found = self(texts)
            own = Groups(*found, *self.sides)
            return [*found], own.per_document(np.ones(len(own.ends), np.int64)), own.per_document(own.sizes[0] * own.sizes[1]), [_digest(s) for s in own.spelled()]
        table, which, bounds, found = self._laid(texts)
        add = lambda x: np.concatenate([[0], np.cumsum(x[which], dtype=np.int64)])[bounds]
        groups, links = np.diff(add(table.groups)), np.diff(add(table.links))
        begin = np.cumsum(table.sizes, dtype=np.int64) - table.sizes
        shown, cut = table.shown[_spans(begin[which], table.sizes[which].astype(np.int64))], add(table.sizes).tolist()
        digests = [_digest(shown[x : max(y - 1, x)].tobytes()) for x, y in zip(cut, cut[1:], strict=False)]
        for i in np.unique(np.searchsorted(bounds, np.flatnonzero(~table.whole[which]), "right") - 1).tolist():
            own = Groups([found[0][i].astype(np.int64)], [found[1][i].astype(np.int64)], *self.sides)
            groups[i], links[i], digests[i] = len(own.ends), int((own.sizes[0] * own.sizes[1]).sum()), _digest(own.spelled()[0])
        return found, groups, links, digests


def _raw(stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the stretches, a space before each, and where each ends."""
    data = [s.encode() for s in stretches]
    joined = b" ".join([b"", *data])
    return np.frombuffer(joined, np.uint8), np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1)


def _digest(shown: bytes) -> str:
    return hashlib.sha256(shown).hexdigest() if shown else ""


def _spans(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of spans end to end."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - sizes), sizes)


def _stretches(text: str) -> list[str]:
    """The text cut at its single spaces between two characters that are no white space (nor the sign that stands for a space in pieces)."""
    return _BETWEEN.split(text)


def _piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def _byte_alphabet() -> dict[str, int]:
    """Byte-level spelling: printable characters stand for themselves, the other bytes for the characters from 256 up, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a worker process, kept between tasks."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encoder(a_path: str, b_path: str) -> Encoder:
    """One encoder a worker process, kept between tasks."""
    if (a_path, b_path) not in _VOCABULARIES:
        _VOCABULARIES[a_path, b_path] = Encoder(vocabulary(a_path), vocabulary(b_path))
    return _VOCABULARIES[a_path, b_path]


class Groups:
    """Tokens of documents laid end to end, cut into groups wherever tokens of both vocabularies end."""

    def __init__(self, a_ids: list[np.ndarray], b_ids: list[np.ndarray], a: Vocabulary, b: Vocabulary):
        empty = [np.empty(0, np.int64)]
        self._cut([np.concatenate(x or empty) for x in (a_ids, b_ids)], np.array([len(x) for x in a_ids], np.int64), a, b)

    @classmethod
    def laid(cls, ids: list[np.ndarray], tokens: np.ndarray, a: Vocabulary, b: Vocabulary) -> Groups:
        """From ids end to end and how many of the first vocabulary each document has."""
        own = cls.__new__(cls)
        own._cut(ids, tokens, a, b)
        return own

    def _cut(self, ids: list[np.ndarray], tokens: np.ndarray, a: Vocabulary, b: Vocabulary) -> None:
        self.ids = ids
        ends = [np.cumsum(v.sizes[ids]) for v, ids in zip((a, b), self.ids, strict=True)]
        at = np.searchsorted(ends[1], ends[0])
        self.ends = ends[0][at < len(ends[1])]
        self.ends = self.ends[ends[1][at[: len(self.ends)]] == self.ends]
        self.group = [np.searchsorted(self.ends, e) for e in ends]  # of every token
        self.sizes = [np.bincount(g, minlength=len(self.ends)) for g in self.group]
        bytes_ = np.concatenate([[0], ends[0]])[np.cumsum(tokens)]
        self.doc = np.searchsorted(bytes_, self.ends)  # of every group
        self.docs = len(tokens)

        self.sides = (a, b)

    def per_document(self, values: np.ndarray) -> np.ndarray:
        return _sums(self.doc, values, self.docs)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Links (document, pair, how many) by document, about LINKS at a time; equal ids of a wide group are taken together."""
        wide = self.sizes[0] * self.sizes[1] > WIDE
        sides = []
        for ids, group in zip(self.ids, self.group, strict=True):
            times = np.ones(len(ids), np.int64)
            if wide.any():
                many = wide[group]
                key, n = np.unique(group[many] * (1 << 32) + ids[many], return_counts=True)
                ids, group = np.concatenate([ids[~many], key & 0xFFFFFFFF]), np.concatenate([group[~many], key >> 32])
                times = np.concatenate([times[~many], n])
                order = np.argsort(group, kind="stable")
                ids, group, times = ids[order], group[order], times[order]
            sides.append((group, ids, times))
        (ga, ia, na), (gb, ib, nb) = sides
        have = np.bincount(gb, minlength=len(self.ends))
        first, fan = (np.cumsum(have) - have)[ga], have[ga]  # partners of every token
        total = np.cumsum(fan)
        at = 0
        while at < len(ga):
            to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + LINKS, "right")), at + 1)
            f = fan[at:to]
            own = np.repeat(np.arange(at, to), f)
            other = np.arange(len(own)) + np.repeat(first[at:to] - (np.cumsum(f) - f), f)
            yield self.doc[ga[own]], (ia[own] << 32) | ib[other], na[own] * nb[other]
            at = to

    def spelled(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every document: decimal ids of its groups in order."""
        out, cut = self.written()
        cut = cut.tolist()
        return [out[x : max(y - 1, x)].tobytes() for x, y in zip(cut, cut[1:], strict=False)]

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """The same end to end, with the sign behind each document's last group, and where each document begins."""
        a, b = self.sides
        before = [np.cumsum(s) - s for s in self.sizes]
        # Place of every token when groups stand one after the other, first side first, and the sign behind it.
        places = (np.arange(len(self.ids[0])) + before[1][self.group[0]], np.arange(len(self.ids[1])) + (before[0] + self.sizes[0])[self.group[1]])
        count = len(self.ids[0]) + len(self.ids[1])
        size, source = np.empty(count, np.int64), np.empty(count, np.int64)
        for place, v, ids, base in ((places[0], a, self.ids[0], 0), (places[1], b, self.ids[1], len(a.digits))):
            size[place], source[place] = v.digit_sizes[ids] + 1, v.digit_starts[ids] + base
        sign = np.full(count, ord(","), np.uint8)
        for side, mark in ((0, "|"), (1, ";")):
            sign[places[side][before[side] + self.sizes[side] - 1]] = ord(mark)
        stop = np.cumsum(size)
        table = np.concatenate([a.digits, b.digits, np.zeros(1, np.uint8)])
        out = table[np.arange(stop[-1] if count else 0) + np.repeat(source - (stop - size), size)]
        out[stop - 1] = sign
        tokens = _sums(self.doc, self.sizes[0] + self.sizes[1], self.docs)
        return out, np.concatenate([[0], np.concatenate([[0], stop])[np.cumsum(tokens)]])


def _sums(doc: np.ndarray, values: np.ndarray, docs: int) -> np.ndarray:
    """Sum of the values of each document; documents in order."""
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    cut = np.searchsorted(doc, np.arange(docs + 1))
    return running[cut[1:]] - running[cut[:-1]]


class MinimalHash:
    """Minimal perfect hash of different 64-bit keys: levels of bits, a key in the first level where no other open key meets it.

    A key's number is the rank of its bit. ``index`` gives -1 to most keys outside the set, but only the stored key settles it.
    """

    ROOM = 2  # bits of a level for each key still open

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.sizes = [len(x) for x in levels]
        bits = np.concatenate([*levels, np.zeros(0, bool)])
        self.rank = np.cumsum(bits) - bits
        self.starts = np.cumsum([0, *self.sizes])
        self.keys_held = int(bits.sum())

    @classmethod
    def of(cls, keys: np.ndarray) -> MinimalHash:
        levels, open_ = [], keys.astype(np.uint64)
        while len(open_):
            room = cls.ROOM * len(open_)
            at = cls._place(open_, len(levels), room)
            alone = np.bincount(at, minlength=room) == 1
            levels.append(alone)
            open_ = open_[~alone[at]]
        return cls(levels)

    @staticmethod
    def _place(keys: np.ndarray, level: int, room: int) -> np.ndarray:
        seed = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % 2**64)
        return (kernels.mix(kernels.mix(keys + seed) * (seed | np.uint64(1)) + seed) % np.uint64(room)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        keys = keys.astype(np.uint64)
        for level, (bits, size) in enumerate(zip(self.levels, self.sizes, strict=True)):
            at = self._place(keys[open_], level, size)
            found = bits[at]
            out[open_[found]] = self.rank[self.starts[level] + at[found]]
            open_ = open_[~found]
        return out

    def packed(self) -> tuple[list[int], bytes]:
        return self.sizes, np.packbits(np.concatenate([*self.levels, np.zeros(0, bool)])).tobytes()

    @classmethod
    def opened(cls, sizes: list[int], bits: bytes) -> MinimalHash:
        flat = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sum(sizes))).astype(bool)
        return cls(np.split(flat, np.cumsum(sizes)[:-1]) if sizes else [])


def _shard(pairs: np.ndarray, shards: int) -> np.ndarray:
    """All pairs of one id of the first vocabulary share a shard."""
    return (kernels.mix((pairs.astype(np.uint64) >> _SHIFT) + np.uint64(77)) % np.uint64(shards)).astype(np.int32)


def _width(v: Vocabulary) -> type:
    return np.uint16 if len(v.sizes) <= 1 << 16 else np.uint32


def _aligned(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """Counts of every text, its ids under both vocabularies, and the digest of its groups."""
    a, b, encode = vocabulary(a_path), vocabulary(b_path), encoder(a_path, b_path)
    for batch in batches:
        data, offsets = kernels.text_bytes(batch.column(1))
        for x, y in kernels.text_batches(data, offsets, BATCH_BYTES):
            (a_ids, b_ids), groups, links, digests = encode.aligned([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(x, y)])
            counts = [[len(i) for i in a_ids], [len(i) for i in b_ids], groups, links]
            ids = [pa.array([i.astype(_width(v)).tobytes() for i in found], pa.binary()) for v, found in ((a, a_ids), (b, b_ids))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), *ids], names=["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b"])


def _regrouped(batch: pa.RecordBatch, at: int, a: Vocabulary, b: Vocabulary) -> Iterator[tuple[int, int, Groups]]:
    """Stored ids aligned again, some documents at a time."""
    held, offsets = kernels.text_bytes(batch.column(at))
    others, ends = kernels.text_bytes(batch.column(at + 1))
    for x, y in kernels.text_batches(held, offsets, BATCH_BYTES):
        sides = [[d[o[i] : o[i + 1]].view(_width(v)).astype(np.int64) for i in range(x, y)] for d, o, v in ((held, offsets, a), (others, ends, b))]
        yield x, y, Groups(*sides, a, b)


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and their sums."""
    pairs, which = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    return pairs, np.bincount(which, np.concatenate([h[1] for h in held]), len(pairs)).astype(np.int64)


def _document_counts(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """How many documents of this task hold each pair linked."""
    a, b = vocabulary(a_path), vocabulary(b_path)
    task = TaskContext.get().partitionId()
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        pairs, n = _added(held)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n), pa.array(np.full(len(pairs), task, np.int32))], names=["pair", "n", "task"])

    for batch in batches:
        for _, _, groups in _regrouped(batch, 0, a, b):
            # A document's links may come in several slices: its pairs are made distinct over all of them.
            for lot in _by_document(groups):
                pairs, n = np.unique(lot, return_counts=True)
                held.append((pairs, n))
                if sum(len(h[0]) for h in held) > HELD_PAIRS:
                    held[:] = [_added(held)]
                    if len(held[0][0]) > HELD_PAIRS // 2:
                        yield out()
                        held.clear()
    if held:
        yield out()


def _by_document(groups: Groups) -> Iterator[np.ndarray]:
    """Pairs of documents, each once a document."""
    wide = np.int64(len(groups.sides[1].sizes))
    codes = np.int64(len(groups.sides[0].sizes)) * wide
    held = np.empty(0, np.int64)
    for doc, pair, _ in groups.pairs():
        held = np.sort(np.concatenate([held, doc * codes + (pair >> 32) * wide + (pair & 0xFFFFFFFF)]))
        held = held[np.concatenate([[True], held[1:] != held[:-1]])]
        done = int(np.searchsorted(held, doc[-1] * codes))  # the last document may go on in the next slice
        yield _pair_of(held[:done] % codes, wide)
        held = held[done:]
    yield _pair_of(held % codes, wide)


def _pair_of(code: np.ndarray, wide: np.int64) -> np.ndarray:
    first = code // wide
    return (first << 32) | (code - first * wide)


def _hashed(key: tuple, rows: pa.Table) -> pa.Table:
    """The hash of a shard's pairs, and the pairs in its order."""
    keys = rows.column("pair").to_numpy()
    own = MinimalHash.of(keys)
    placed = np.empty(len(keys), np.int64)
    placed[own.index(keys)] = keys
    sizes, bits = own.packed()
    return pa.table({"shard": [rows.column("shard")[0]], "sizes": pa.array([sizes], pa.list_(pa.int32())), "bits": pa.array([bits], pa.binary()), "keys": pa.array([placed.tobytes()], pa.binary())})


def _looked_up(own: MinimalHash, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = own.index(wanted)
    if (at < 0).any() or not np.array_equal(keys[at], wanted):
        raise ValueError("a pair is not in the table it was counted for")
    return at


def _vector(key: tuple, rows: pa.Table, tables: pa.Table) -> pa.Table:
    """Dense count vector of one leaf, indexed by the hash of its shard."""
    keys = np.frombuffer(tables.column("keys")[0].as_py(), np.int64)
    out = np.zeros(len(keys), np.int64)
    if rows.num_rows:
        own = MinimalHash.opened(tables.column("sizes")[0].as_py(), tables.column("bits")[0].as_py())
        np.add.at(out, _looked_up(own, keys, rows.column("pair").to_numpy()), rows.column("n").to_numpy())
    return pa.table({"shard": tables.column("shard"), "leaf": tables.column("leaf"), "counts": pa.array([out.tobytes()], pa.binary())})


def _summed(key: tuple, rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.int64) for c in rows.column("counts").to_pylist())
    return pa.table({"shard": [rows.column("shard")[0]], "leaf": [rows.column("leaf")[0]], "counts": pa.array([total.tobytes()], pa.binary())})


def pair_table(counted: DataFrame, shard_keys: int = SHARD_KEYS, fan_in: int = FAN_IN) -> tuple[DataFrame, int]:
    """Shards of the table of counts of ``pair, n, task`` rows, and how many: ``shard, sizes, bits, keys, counts``.

    The different pairs of a shard get a minimal perfect hash. Rows are then added into dense vectors indexed by it: as many
    leaves a shard as make a vector about as long as its rows, added up as a tree, ``fan_in`` vectors at a time.
    """
    pairs = written(counted.groupBy("pair").agg(F.count("*").alias("rows")))
    size, rows = pairs.agg(F.count("*"), F.sum("rows")).first()
    shards, leaves = -(-size // shard_keys), max((rows or 0) // max(size, 1), 1)

    def shard(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.append_column("shard", pa.array(_shard(batch.column(0).to_numpy(), shards)))

    if not shards:
        shards = 1
    hashes = written(
        pairs.select("pair").mapInArrow(shard, "pair long, shard int").groupBy("shard")
        .applyInArrow(_hashed, "shard int, sizes array<int>, bits binary, keys binary"))
    leaf = F.pmod("task", F.lit(leaves))
    rows_ = counted.mapInArrow(shard, "pair long, n long, task int, shard int").select("shard", leaf.alias("leaf"), "pair", "n")
    tables = hashes.withColumn("leaf", F.explode(F.sequence(F.lit(0), F.lit(leaves - 1))))
    shape = "shard int, leaf int, counts binary"
    vectors = rows_.groupBy("shard", "leaf").cogroup(tables.groupBy("shard", "leaf")).applyInArrow(_vector, shape)
    while leaves > 1:
        vectors = vectors.withColumn("leaf", F.floor(F.col("leaf") / fan_in).cast("int")).groupBy("shard", "leaf").applyInArrow(_summed, shape)
        leaves = -(-leaves // fan_in)
    table = written(hashes.join(vectors.drop("leaf"), "shard"))
    discard(pairs, hashes)
    return table, shards


class PairTable:
    """Some shards of the table, for lookups in a worker."""

    def __init__(self, shards: int, rows: list[tuple]):
        self.shards = shards
        self.held = {}
        for shard, sizes, bits, keys, counts in rows:
            keys, counts = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
            first, which = np.unique(keys >> 32, return_inverse=True)
            highest = np.zeros(len(first), np.int64)
            np.maximum.at(highest, which, counts)
            self.held[shard] = (MinimalHash.opened(sizes, bits), keys, counts, counts == highest[which])

    def read(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of every pair and whether it is the highest of its first id; zero for pairs of shards not held."""
        counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        shard = _shard(pairs, self.shards)
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
            if int(shard[order[x]]) in self.held:
                own, keys, n, top = self.held[int(shard[order[x]])]
                at = _looked_up(own, keys, pairs[order[x:y]])
                counts[order[x:y]], best[order[x:y]] = n[at], top[at]
        return counts, best


def _scored(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, held: Callable[[], PairTable]) -> Iterator[pa.RecordBatch]:
    """Adds what the shards at hand tell about the links of every document."""
    a, b, table = vocabulary(a_path), vocabulary(b_path), held()
    for batch in batches:
        best, total = (batch.column(i).to_numpy().copy() for i in (0, 1))
        for x, y, groups in _regrouped(batch, 2, a, b):
            for doc, pair, times in groups.pairs():
                different, which = np.unique(pair, return_inverse=True)
                counts, top = table.read(different)
                best[x:y] += _sums(doc, np.where(top[which], times, 0), y - x)
                total[x:y] += _sums(doc, counts[which] * times, y - x)
        yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(total), *batch.columns[2:]], names=batch.schema.names)


def _lots(sizes: list[tuple[int, int]], limit: int) -> Iterator[list[int]]:
    lot, held = [], 0
    for shard, size in sizes:
        if lot and held + size > limit:
            yield lot
            lot, held = [], 0
        lot.append(shard)
        held += size
    if lot:
        yield lot


def align(
    docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", columns: Sequence[str] | None = None, shard_keys: int = SHARD_KEYS,
    fan_in: int = FAN_IN, table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """Every row of the input, in its ``columns`` (all, if None), with a struct ``aligned``: ``n_a, n_b, n_groups, n_links, n_best, count_sum`` (long), ``groups_sha256``, and the
    token ids ``a`` and ``b`` (little-endian numbers of two bytes, four where the vocabulary has more than 65,536 entries).

    Texts are encoded by the vocabulary files ``a_path`` and ``b_path`` (paths on the workers), a space before each. Byte places
    where tokens of both end cut them into groups; a link is a pair of token occurrences of one group. The count of a pair
    of ids is the number of rows that hold it linked; ``n_best`` counts the links whose count is the highest of their first id.

    First reading: align every text, count pairs, and build a table of the different ones under a minimal perfect hash.
    Second reading: align the stored ids again and look the counts up. The table goes to the workers in lots of
    ``table_bytes``, however large it is as a whole: each lot is one more reading of the ids, and adds up what it knows.

    A null or empty text, or one whose tokens do not spell it back, has no tokens: zeros, an empty digest and no ids.
    Repeated rows and ids are rows of their own; ids are not used; other columns stay as they are, but ``aligned`` is replaced.
    """
    spark = docs.sparkSession
    others = [c for c in (docs.columns if columns is None else columns) if c != "aligned"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.encode(text_or_empty(text_col), "UTF-8").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    shape = f"row {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary"
    aligned = written(rows.mapInArrow(lambda it: _aligned(it, a_path, b_path), shape))
    counted = written(aligned.select("a", "b").mapInArrow(lambda it: _document_counts(it, a_path, b_path), "pair long, n long, task int"))
    table, shards = pair_table(counted, shard_keys, fan_in)
    discard(counted)

    zero = F.lit(0).cast("long")
    names = ["a", "b", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    done = aligned.select(zero.alias("n_best"), zero.alias("count_sum"), *names)
    sizes = sorted((r[0], r[1]) for r in table.select("shard", F.octet_length("keys") * 2 + F.octet_length("bits")).collect())
    for i, lot in enumerate(_lots(sizes, table_bytes)):
        done = written(done) if i else done
        held = spark.sparkContext.broadcast([tuple(r) for r in table.where(F.col("shard").isin(lot)).collect()])
        done = done.mapInArrow(_lookup(a_path, b_path, shards, held), done.schema)
    fields = [*names[3:7], "n_best", "count_sum", "groups_sha256", "a", "b"]
    return done.select(*[F.col("row").getField(c).alias(c) for c in others], F.struct(*fields).alias("aligned"))


def _lookup(a_path: str, b_path: str, shards: int, held) -> Callable:
    return lambda it: _scored(it, a_path, b_path, lambda: PairTable(shards, held.value))
