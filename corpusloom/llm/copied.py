"""Removal of word sequences copied from earlier documents by relative Lempel-Ziv parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpusloom.llm import kernels
from corpusloom.llm.common import discard, text_or_empty, written

WINDOW = 13  # words of the shortest factor that counts as copied
GRAM = 5  # words of an anchor
CROWD = 4096  # different segments of one anchor above which they are cut into single windows
BLOCK_WORDS = 1 << 18  # words of a reference block
_GROUP = 1 << 19
_PLACE = np.uint64((1 << 26) - 1)
_MULT = [np.uint64(pow(0xD1342543DE82EF95, j + 1, 2**64)) for j in range(64)]


class Parts:
    """Segments of texts of ``window`` words or more, laid end to end.

    Every window chooses one gram inside it, the one of least digest (the leftmost of equals): its anchor. Windows of equal
    words choose the same one, so they meet wherever they occur. A segment is a stretch of windows with the same anchor.
    """

    def __init__(self, texts: list[bytes], window: int, gram: int):
        lines = [b" ".join(t.split()) for t in texts]
        offsets = np.cumsum([0, *[len(x) + 1 for x in lines]])
        self.data = b"\n".join(lines) + b"\n"
        flat = np.frombuffer(self.data, np.uint8)
        words, self.bounds = kernels.word_hashes(flat, offsets, fold=False)
        solid = np.concatenate([[False], (flat != 32) & (flat != 10)])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        self.begin, self.stop = edges[::2], edges[1::2]
        n = max(len(words) - gram + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for j in range(gram):
            rolled += words[j : j + n] * _MULT[j]
        rolled = kernels.mix(rolled)
        chosen = (kernels.sliding_min((rolled & ~_PLACE) | np.arange(n, dtype=np.uint64), window - gram + 1) & _PLACE).astype(np.int64)
        owner = np.searchsorted(self.bounds, np.arange(len(chosen)), "right") - 1
        inside = np.arange(len(chosen)) + window <= self.bounds[owner + 1]
        step = np.ones(len(chosen) + 1, bool)
        step[1:-1] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
        edges = np.flatnonzero(step)
        real = inside[edges[:-1]] if len(chosen) else np.empty(0, bool)
        self.first, self.last = edges[:-1][real], edges[1:][real] - 1 + window  # words, the last exclusive
        self.owner = owner[self.first]
        self.anchor = rolled[chosen[self.first]].view(np.int64)
        self.place = self.first - self.bounds[self.owner]

    def words(self, i: int) -> bytes:
        return self.data[self.begin[self.first[i]] : self.stop[self.last[i] - 1]]


def _groups(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, list[bytes]]]:
    data, offsets = kernels.text_bytes(batch.column(at))
    for a, b in kernels.text_batches(data, offsets, _GROUP):
        yield a, b, [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]


def _anchors(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u = batch.column(0).to_numpy()
        for a, b, texts in _groups(batch, 1):
            found = Parts(texts, window, gram)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found.anchor, u[a:b][found.owner], found.place.astype(np.int32))], names=["h", "u", "s"])


def _segments(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The segments that begin at the named places, with their words."""
    for batch in batches:
        u, k = batch.column(0).to_numpy(), batch.column(3).to_numpy()
        lists = batch.column(2)
        named = lists.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        for a, b, texts in _groups(batch, 1):
            found = Parts(texts, window, gram)
            # Texts of one id share their places: some may lie beyond this text.
            places = named[ends[a] : ends[b]] + np.repeat(found.bounds[:-1], np.diff(ends[a : b + 1]))
            wanted = np.zeros(found.bounds[-1] + 1, bool)
            wanted[places[places < np.repeat(found.bounds[1:], np.diff(ends[a : b + 1]))]] = True
            pick = np.flatnonzero(wanted[found.first])
            row = found.owner[pick]
            yield pa.RecordBatch.from_arrays([
                pa.array(found.anchor[pick]), pa.array(u[a:b][row]), pa.array(k[a:b][row]), pa.array(found.place[pick].astype(np.int32)),
                pa.array((found.last - found.first)[pick].astype(np.int32)), pa.array([found.words(i) for i in pick.tolist()], pa.binary()),
            ], names=["h", "u", "k", "s", "n", "seg"])


def _single_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Every window of a segment as a segment of its own, routed by all its words."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for h, u, d, e, seg in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            words = seg.split(b" ")
            for o in range(len(words) - window + 1):
                part = b" ".join(words[o : o + window])
                for held, x in zip(out, (h, u, d, e, o, part), strict=True):
                    held.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (*[pa.int64()] * 4, pa.int32(), pa.binary()), strict=True)], names=["h", "u", "d", "e", "o", "seg"])


class ReferenceBlock:
    """Index of reference segments, each held by its earliest document.

    Places of equal stretches of words share a number, for stretches of ``window`` words and each longer length. A number
    keeps the earliest document that has the stretch, so the longest factor at a place is found by looking up its numbers.
    """

    def __init__(self, segments: list[bytes], owners: np.ndarray, window: int):
        known: dict[bytes, int] = {}
        words = [[known.setdefault(w, len(known)) for w in s.split(b" ")] for s in segments]
        sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.sizes, self.owners = sizes, owners
        flat = np.array([i for w in words for i in w], np.int64)
        self.left = np.repeat(self.starts + sizes, sizes) - np.arange(len(flat))  # words from a place to the end of its segment
        self.owner = np.repeat(owners, sizes)
        self.longest = np.zeros(len(flat), np.int64)
        # Numbers of stretches of 1, 2, 4, ... words, then of the window from two that overlap.
        number, width = flat, 1
        while 2 * width <= window:
            number, width = self._joined(number, width), 2 * width
        if width < window:
            number = self._joined(number, window - width)
        length, open_ = window, np.flatnonzero(self.left >= window)
        while len(open_):
            earliest = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(earliest, number[open_], self.owner[open_])
            copied = open_[earliest[number[open_]] < self.owner[open_]]
            self.longest[copied] = length
            # One word more: a longer stretch is a copy only if some document has it twice or two documents have it.
            number = self._joined(number, 1)
            length += 1
            open_ = open_[self.left[open_] >= length]
            if not len(copied):
                break

    @staticmethod
    def _joined(number: np.ndarray, shift: int) -> np.ndarray:
        """Numbers of pairs (here, ``shift`` places on)."""
        then = np.concatenate([number[shift:], np.full(min(shift, len(number)), -1)])
        return np.unique((number + 1) * (int(number.max(initial=0)) + 2) + then + 1, return_inverse=True)[1].astype(np.int64)

    def parse(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Copied stretches (segment, first word, one past the last) of every segment against earlier documents.

        All segments advance together: at its cursor a segment takes the longest factor that an earlier document has, if it
        is long enough, else one word. Copies that lie across the end of a factor are then looked up place by place.
        """
        cursor, end = self.starts.copy(), self.starts + self.sizes
        rows = np.arange(len(cursor))
        factors = []
        while len(rows):
            length = self.longest[cursor[rows]]
            long = length >= window
            factors.append(np.stack([rows[long], cursor[rows[long]], cursor[rows[long]] + length[long]]))
            cursor[rows] += np.maximum(length, 1)
            rows = rows[cursor[rows] + window <= end[rows]]
        found = np.concatenate(factors, axis=1) if factors else np.empty((3, 0), np.int64)
        across = found[2][:, None] - np.arange(1, window)[None, :]
        row = np.repeat(found[0], window - 1).reshape(across.shape)
        held = (across >= self.starts[row]) & (self.longest[np.maximum(across, 0)] >= window)
        more = np.stack([row[held], across[held], across[held] + self.longest[across[held]]])
        found = np.concatenate([found, more], axis=1)
        found[1:] -= self.starts[found[0]]
        return found


def _parsed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their anchors: a block holds whole anchors, and each segment is factored against it."""
    held: list[tuple] = []
    words = 0

    def flush() -> pa.RecordBatch:
        block = ReferenceBlock([r[4] for r in held], np.array([r[1] for r in held], np.int64), window)
        row, a, b = block.parse(window)
        spans: list[list[dict]] = [[] for _ in held]
        for i, x, y in zip(row.tolist(), a.tolist(), b.tolist(), strict=True):
            spans[i].append({"a": x, "b": y})
        keep = [i for i, s in enumerate(spans) if s]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        columns = [pa.array([held[i][c] for i in keep], pa.int64()) for c in (0, 2, 3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([spans[i] for i in keep], kind)], names=["h", "d", "e", "spans"])

    for batch in batches:
        for r in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if words >= BLOCK_WORDS and held[-1][0] != r[0]:
                yield flush()
                held, words = [], 0
            held.append(r)
            words += r[4].count(b" ") + 1
    if held:
        yield flush()


def copied_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``u, k, found``: stretches of words (a, b), b exclusive, they may overlap, covered by windows that a row of smaller ``u`` has, from rows
    ``u, text`` of ``window`` words or more; ``k`` is a digest of the text.
    """
    anchors = texts.mapInArrow(lambda it: _anchors(it, window, gram), "h long, u long, s int")
    shared = written(anchors.groupBy("h").agg(F.min("u").alias("x"), F.max("u").alias("y")).where("x < y").select("h"))
    places = anchors.join(shared, "h").groupBy("u").agg(F.collect_set("s").alias("named"))
    segments = written(
        texts.join(places, "u").select("u", F.encode("text", "UTF-8").alias("raw"), "named", F.xxhash64("text").alias("k"))
        .mapInArrow(lambda it: _segments(it, window, gram), "h long, u long, k long, s int, n int, seg binary")
        .withColumns({"d": F.xxhash64("seg"), "e": F.xxhash64(F.lit(1), "seg")}))
    discard(shared)
    # Equal segments are one reference, of their earliest text; in all later texts they are copies as a whole.
    references = written(segments.groupBy("h", "d", "e", "seg").agg(F.min("u").alias("u"), F.max("u").alias("z")))
    sizes = references.groupBy("h").agg(F.count("*").alias("c"), F.min("u").alias("x"), F.max("u").alias("y")).where("c > 1 and x < y")
    sizes = written(sizes.select("h", (F.col("c") > crowd).alias("crowded")))
    routed = references.select("h", "u", "d", "e", "seg").join(sizes, "h")
    few = (
        routed.where("not crowded").select("h", "u", "d", "e", "seg").repartition("h").sortWithinPartitions("h")
        .mapInArrow(lambda it: _parsed(it, window), "h long, d long, e long, spans array<struct<a:int,b:int>>"))
    # An anchor with a crowd of different segments: its windows are routed by all their words, and again held by their earliest text.
    single = written(
        routed.where("crowded").select("h", "u", "d", "e", "seg")
        .mapInArrow(lambda it: _single_windows(it, window), "h long, u long, d long, e long, o int, seg binary"))
    earliest = written(single.groupBy("seg").agg(F.min("u").alias("x"), F.max("u").alias("y")).where("x < y").select("seg", "x"))
    copies = single.join(earliest, "seg").where("u > x")
    many = copies.groupBy("h", "d", "e").agg(F.collect_list(F.struct(F.col("o").alias("a"), (F.col("o") + window).alias("b"))).alias("spans"))
    parsed = written(few.unionByName(many))
    discard(single, earliest, sizes)

    # What a segment loses: all its words where its text isn't the earliest, else what its block has found.
    known = references.select("h", "d", "e", F.col("u").alias("x"), "z").join(parsed, ["h", "d", "e"], "left").where("z > x or spans is not null")
    met = segments.select("h", "d", "e", "u", "k", "s", "n").join(known, ["h", "d", "e"])
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    lost = met.select("u", "k", "s", F.explode(F.when(F.col("u") > F.col("x"), whole).otherwise(F.col("spans"))).alias("r"))
    spans = lost.groupBy("u", "k").agg(F.collect_set(F.struct((F.col("s") + F.col("r.a")).alias("a"), (F.col("s") + F.col("r.b")).alias("b"))).alias("found"))
    spans = written(spans)
    discard(segments, references, parsed)
    return spans


def _judged(batches: Iterator[pa.RecordBatch], outputs: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """What is left of each text: rows (row, text, spans)."""
    run = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for batch in batches:
        found = batch.column(2)
        flat = found.flatten()
        a, b = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        ends = np.concatenate([[0], np.cumsum(found.value_lengths().fill_null(0).to_numpy())]).tolist()
        counts, spans, left, digests = [], [], [], []
        data, offsets = kernels.text_bytes(batch.column(1))
        for i in range(len(found)):
            words = data[offsets[i] : offsets[i + 1]].tobytes().split()
            runs = []
            if ends[i] < ends[i + 1]:
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, a[ends[i] : ends[i + 1]], 1)
                np.add.at(cover, b[ends[i] : ends[i + 1]], -1)
                gone = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
                edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
                runs = list(zip(edges[::2], edges[1::2], strict=True))
                counts.append(len(words))
                words = [w for x, y in zip([0, *edges[1::2]], [*edges[::2], len(words)], strict=True) for w in words[x:y]]
            else:
                counts.append(len(words))
            kept = b" ".join(words)
            spans.append([{"a": x, "b": y} for x, y in runs])
            left.append(kept.decode() if "kept" in outputs else None)
            digests.append(hashlib.sha256(kept).hexdigest() if "kept_sha256" in outputs else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, run), pa.array(left, pa.string()), pa.array(digests, pa.string())], names=["row", "n", "r", "k", "s"])


OUTPUTS = ("spans", "kept")


def remove_copied(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD,
    outputs: Sequence[str] = OUTPUTS,
) -> DataFrame:
    """Every row of the input with a struct ``copied``: ``n_words, n_removed`` (long) and, as ``outputs`` ask, ``spans`` (maximal removed
    runs of words, from inclusive, to exclusive), ``kept`` (the words left, joined by one space) and ``kept_sha256`` (its digest).

    Words are stretches of other characters than ASCII white space, unchanged. A word goes if a window of ``window`` words
    covers it that also starts in a document with a smaller id; windows are judged on the input. The words around an anchor
    that windows choose by their content form a segment; a reference block indexes the segments of many anchors, each held
    by its earliest document, and every segment is factored greedily against the block that has its anchor: long factors, and
    windows across factor ends, are copies. Segments of an anchor with more than ``crowd`` different ones are first cut into single windows.

    A null text has no words. A row with a null id neither copies nor is copied from; rows of equal ids do not copy from each
    other; repeated rows get the same result. Ids are whole numbers. Other columns stay as they are; one called ``copied`` is replaced.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} has to be a whole number")
    text, key = text_or_empty(text_col), F.col(f"`{id_col}`").cast("long")
    long = docs.where(F.col(f"`{id_col}`").isNotNull() & (F.octet_length(text) >= 2 * window - 1)).select(key.alias("u"), text.alias("text"))
    spans = copied_spans(long, window, gram, crowd)
    others = [c for c in docs.columns if c != "copied"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), key.alias("u"), F.xxhash64(text).alias("k"))
    kind = rows.schema["row"].dataType.simpleString()
    own = F.encode(F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")), "UTF-8")
    judged = rows.join(spans, ["u", "k"], "left").select("row", own.alias("raw"), "found").mapInArrow(
        lambda it: _judged(it, outputs), f"row {kind}, n long, r array<struct<a:bigint,b:bigint>>, k string, s string")
    gone = F.aggregate("r", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    shown = {"spans": F.col("r"), "kept": F.col("k"), "kept_sha256": F.col("s")}
    return judged.select(
        *[F.col("row").getField(c).alias(c) for c in others],
        F.struct(F.col("n").alias("n_words"), gone.alias("n_removed"), *[shown[o].alias(o) for o in outputs]).alias("copied"))
