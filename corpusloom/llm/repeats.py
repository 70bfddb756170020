"""Removal of long repeated substrings by a run-length index over aligned text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels
from corpusloom.llm.common import WORD, discard, own_names, text_or_empty, written

LENGTH = 400
GRAM = 24  # bytes of an anchor
STRETCH = 160  # consecutive grams of which one becomes an anchor, at most: two stretches have to fit a string
CROWD = 1000  # occurrences of an anchor above which its windows are counted by digest instead of indexed together
ROWS = 4096  # rows an index holds
_GROUP = 1 << 19
_SPANS = 1 << 18  # spans spelled out at once
_PLACE = np.uint64((1 << 26) - 1)


class Anchors:
    """Anchors of texts laid end to end.

    Of every ``stretch`` consecutive grams the one with the least digest is an anchor (the leftmost of equals), so a string
    has the same inner anchors wherever it occurs: those that a stretch within the string chooses.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, stretch: int = STRETCH):
        self.data, self.bounds = data, bounds
        n = max(len(data) - GRAM + 1, 0)
        sums = kernels.prefix_hash(kernels.BYTE_CODES[data])
        self.grams = kernels.mix((sums[GRAM:] - sums[:n]) * kernels.powers(len(data))[1][:n]) if n else np.empty(0, np.uint64)
        chosen = (kernels.sliding_min((self.grams & ~_PLACE) | np.arange(n, dtype=np.uint64), stretch) & _PLACE).astype(np.int64)
        self.sums = sums
        # Stretches that end in the text where they begin.
        starts = np.arange(len(chosen))
        owner = np.searchsorted(bounds, starts, "right") - 1
        valid = starts + stretch + GRAM - 1 <= bounds[owner + 1]
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
        self.valid = valid
        self.of_stretch = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        self.position, self.owner = chosen[at], owner[at]
        self.digest = self.grams[self.position].view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch], stretch: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy()
        data, offsets = kernels.text_bytes(batch.column(1))
        for a, b in kernels.text_batches(data, offsets, _GROUP):
            bounds = offsets[a : b + 1] - offsets[a]
            found = Anchors(data[offsets[a] : offsets[b]], bounds, stretch)
            yield pa.RecordBatch.from_arrays([
                pa.array(found.digest), pa.array(keys[a:b][found.owner]), pa.array((found.position - bounds[found.owner]).astype(np.int32)),
            ], names=["h", "u", "p"])


def _segments(batches: Iterator[pa.RecordBatch], length: int, stretch: int) -> Iterator[pa.RecordBatch]:
    """Stretches of windows that may repeat, by the rarest anchor inside them.

    A window with an inner anchor that occurs once is unique. All others go to their inner anchor of least (count,
    digest): equal windows choose the same one at the same distance. ``off`` is that distance at the first window.
    """
    inner = length - GRAM - stretch + 2
    for batch in batches:
        keys = batch.column(0).to_numpy()
        data, offsets = kernels.text_bytes(batch.column(1))
        lists, flat = batch.column(2), batch.column(2).flatten()
        places, counts = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        for a, b in kernels.text_batches(data, offsets, _GROUP):
            bounds = offsets[a : b + 1] - offsets[a]
            text = data[offsets[a] : offsets[b]]
            found = Anchors(text, bounds, stretch)
            if not len(found.position):
                continue
            repeated = places[ends[a] : ends[b]] + np.repeat(bounds[:-1], np.diff(ends[a : b + 1]))
            by_place = np.argsort(repeated, kind="stable")
            repeated, times = repeated[by_place], counts[ends[a] : ends[b]][by_place]
            at = np.minimum(np.searchsorted(repeated, found.position), max(len(repeated) - 1, 0))
            count = np.where(repeated[at] == found.position, times[at], 1) if len(repeated) else np.ones(len(found.position), np.int64)
            order = np.lexsort((np.arange(len(count)), found.digest, count))
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            best = order[kernels.sliding_min(np.where(found.valid, rank[found.of_stretch], np.int32(2**31 - 1)), inner).clip(0, len(order) - 1)]
            starts = np.arange(len(best))
            home = np.searchsorted(bounds, starts, "right") - 1
            maybe = (starts + length <= bounds[home + 1]) & (count[best] > 1)
            first = maybe.copy()
            first[1:] &= ~maybe[:-1] | (best[1:] != best[:-1]) | (home[1:] != home[:-1])
            last = maybe.copy()
            last[:-1] &= ~maybe[1:] | (best[1:] != best[:-1]) | (home[1:] != home[:-1])
            s1, s2 = np.flatnonzero(first), np.flatnonzero(last)
            pick = best[s1]
            held = [text[x : y + length].tobytes() for x, y in zip(s1.tolist(), s2.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(found.digest[pick]), pa.array(count[pick]), pa.array((found.position[pick] - s1).astype(np.int32)), pa.array(held, pa.binary()),
                pa.array(keys[a:b][home[s1]]), pa.array(s1 - bounds[home[s1]]),
            ], names=["h", "c", "off", "seg", "u", "s"])


class RunLengthIndex:
    """Positional Burrows-Wheeler transform of aligned rows, kept as runs, streamed column by column.

    The rows stand in the order of their reversed prefixes, with the column where the match of each row with the one
    before it begins. Reading a column, rows of one run stay neighbours and keep their match; only the head of a run gets
    a new one, from the maxima kept at the ends of the runs between it and the last run of its symbol. The longest match
    of a row with any other row that ends at the column is the one with a neighbour: these are its matching statistics.
    """

    ABSENT = 256

    def __init__(self, rows: int):
        self.order = np.arange(rows)
        self.match = np.zeros(rows, np.int32)
        self.column = 0

    def push(self, symbols: np.ndarray) -> None:
        """Read the next column: one symbol a row, ABSENT where a row has none."""
        here = symbols[self.order]
        heads = np.concatenate([[0], np.flatnonzero(here[1:] != here[:-1]) + 1])
        kinds = here[heads]
        by_kind = np.argsort(kinds, kind="stable")
        longest = np.maximum.reduceat(self.match, heads)
        # Heads: the latest begin among the rows since the last run of the same symbol.
        begin = self.match.copy()
        same = kinds[by_kind[1:]] == kinds[by_kind[:-1]]
        before, own = by_kind[:-1][same], by_kind[1:][same]
        begin[heads] = self.column + 1
        begin[heads[own]] = np.maximum(self.match[heads[own]], _range_max(longest, before + 1, own))
        to = np.argsort(here, kind="stable")
        self.order, self.match = self.order[to], begin[to]
        absent = len(here) - int((here == self.ABSENT).sum())
        self.column += 1
        self.match[absent:] = self.column

    def statistics(self) -> np.ndarray:
        """Longest match with another row that ends at the last column, in the present order."""
        back = self.column - self.match
        if len(back):
            back[0] = 0
        return np.maximum(back, np.append(back[1:], 0))


def _range_max(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximum of x[begin:end] for each pair; -1 where empty."""
    out = np.full(len(begin), -1, x.dtype)
    size = end - begin
    level, width = x, 1
    while True:
        # Ranges of width..2*width-1 are two overlapping spans of that width.
        now = (size >= width) & (size < 2 * width)
        if now.any():
            out[now] = np.maximum(level[begin[now]], level[end[now] - width])
        if not (size >= 2 * width).any():
            return out
        level = np.maximum(level[: len(level) - width], level[width:])
        width *= 2


def repeated_windows(segments: list[bytes], offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``length`` bytes that another row has at the same distance from its anchor: runs (row, first, last)."""
    lead = int(offs.max())
    shift = lead - offs
    sizes = np.array([len(x) for x in segments])
    width = int((shift + sizes).max())
    table = np.full((width, len(segments)), RunLengthIndex.ABSENT, np.uint16)
    flat = np.frombuffer(b"".join(segments), np.uint8)
    row = np.repeat(np.arange(len(segments)), sizes)
    table[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes - shift, sizes), row] = flat
    index, marks = RunLengthIndex(len(segments)), np.zeros((max(width - length + 1, 0), len(segments)), bool)
    for column in range(width):
        index.push(table[column])
        if column + 1 >= length:
            marks[column + 1 - length, index.order] = index.statistics() >= length
    marks = marks.T
    edge = np.zeros((len(segments), 1), bool)
    first = np.argwhere(marks & ~np.concatenate([edge, marks[:, :-1]], axis=1))
    last = np.argwhere(marks & ~np.concatenate([marks[:, 1:], edge], axis=1))
    return first[:, 0], first[:, 1] - shift[first[:, 0]], last[:, 1] - shift[last[:, 0]]


def _indexed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their anchors: an index holds whole groups, and the repeated spans of each document come out."""
    held: list[tuple] = []

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        which, a, b = repeated_windows([r[2] for r in rows], np.array([r[1] for r in rows]), length)
        u, s = np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u[which]), pa.array(s[which] + a), pa.array(s[which] + b + length)], names=["u", "a", "b"])

    for batch in batches:
        for r in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if len(held) >= ROWS and held[-1][0] != r[0]:
                yield flush(held)
                held = []
            held.append(r)
    if held:
        yield flush(held)


def _window_digests(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, weights = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = kernels.text_bytes(batch.column(2))
        for a, b in kernels.text_batches(data, offsets, _GROUP):
            bounds = offsets[a : b + 1] - offsets[a]
            text = data[offsets[a] : offsets[b]]
            sums, windows = kernels.prefix_hash(kernels.BYTE_CODES[text]), np.diff(bounds) - length + 1
            row = np.repeat(np.arange(b - a), windows)
            within = np.arange(len(row)) - (np.cumsum(windows) - windows)[row]
            at = bounds[:-1][row] + within
            digest = kernels.mix((sums[at + length] - sums[at]) * kernels.powers(len(text))[1][at])
            yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), pa.array(weights[a:b][row]), pa.array(ids[a:b][row]), pa.array(within.astype(np.int32))], names=["w", "n", "sid", "o"])


def _joined_spans(rows: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of the texts of a share that the runs of their segments cover, joined where they overlap or touch."""
    held, fresh = [np.empty(0, np.int64)] * 3, []

    def join() -> list[np.ndarray]:
        u, a, b = (np.concatenate(x) for x in zip(held, *fresh, strict=True))
        order = np.lexsort((b, a, u))
        u, a, b = u[order], a[order], b[order]
        if not len(u):
            return [u, a, b]
        # Ends so far, text after text: texts stand apart by more than the longest of them.
        apart = np.cumsum(np.concatenate([[0], u[1:] != u[:-1]])) * (int(b.max()) + 2)
        reach = np.maximum.accumulate(apart + b)
        first = np.flatnonzero(np.concatenate([[True], (apart + a)[1:] > reach[:-1]]))
        last = np.append(first[1:], len(u)) - 1
        return [u[first], a[first], reach[last] - apart[last]]

    for batch in rows:
        at, runs = batch.column("at"), batch.column("runs")
        places, spans = at.flatten(), runs.flatten()
        u, s = (places.field(i).to_numpy() for i in (0, 1))
        a, b = (spans.field(i).to_numpy().astype(np.int64) for i in (0, 1))
        n, m = at.value_lengths().to_numpy().astype(np.int64), runs.value_lengths().to_numpy().astype(np.int64)
        begin, place_row = np.cumsum(m) - m, np.repeat(np.arange(len(n)), n)
        fan = m[place_row]
        total = np.cumsum(fan)
        x = 0
        while x < len(u):
            y = max(int(np.searchsorted(total, (total[x - 1] if x else 0) + _SPANS, "right")), x + 1)
            own = np.repeat(np.arange(x, y), fan[x:y])
            which = np.arange(len(own)) - np.repeat(np.cumsum(fan[x:y]) - fan[x:y], fan[x:y]) + begin[place_row[own]]
            fresh.append([u[own], s[own] + a[which], s[own] + b[which] + length])
            x = y
            if sum(len(f[0]) for f in fresh) > max(_SPANS, len(held[0])):
                held, fresh = join(), []
    held = join()
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["u", "a", "b"])


def repeated_spans(texts: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """``u, a, b``: byte spans that repeated windows cover (spans of one text may overlap), from distinct texts ``u, text``."""
    stretch = min(STRETCH, (length - GRAM) // 2)
    if stretch < 1:
        raise ValueError(f"length has to be {GRAM + 2} at least")
    long = texts.where(F.octet_length("text") >= length)
    anchors = long.mapInArrow(lambda it: _anchor_rows(it, stretch), "h long, u long, p int")
    counts = written(anchors.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    lists = anchors.join(counts, "h").groupBy("u").agg(F.collect_list(F.struct("p", "c")).alias("found"))
    segments = written(long.join(lists, "u").select("u", "text", "found").mapInArrow(
        lambda it: _segments(it, length, stretch), "h long, c long, off int, seg binary, u long, s long"))
    few = segments.where(F.col("c") <= crowd).select("h", "off", "seg", "u", "s")
    indexed = few.repartition("h").sortWithinPartitions("h").mapInArrow(lambda it: _indexed(it, length), "u long, a long, b long")

    # Anchors of a crowd: equal segments first become one row, then single windows are counted by digest.
    many = segments.where(F.col("c") > crowd).withColumn("sid", F.xxhash64("h", "off", "seg"))
    distinct = written(many.groupBy("sid").agg(F.count("*").alias("n"), F.first("seg").alias("seg")))
    digests = written(distinct.select("sid", "n", "seg").mapInArrow(lambda it: _window_digests(it, length), "w long, n long, sid long, o int"))
    common = digests.groupBy("w").agg(F.sum("n").alias("t")).where("t > 1").select("w")
    windows = written(digests.join(common, "w").groupBy("sid").agg(F.collect_set("o").alias("o")))
    discard(counts, distinct, digests)
    # A share of the texts gets a row for each segment, with all its places there: a crowd meets its runs once a share, and a text
    # comes out with spans already joined, whatever the number of its segments.
    shares = max(segments.rdd.getNumPartitions(), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def joined(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _joined_spans(rows, length)

    places = many.groupBy("sid", F.pmod("u", F.lit(shares)).cast("int").alias("share")).agg(F.collect_list(F.struct("u", "s")).alias("at"))
    counted = places.join(windows, "sid").select("share", "at", _runs(F.array_sort("o")).alias("runs"))
    counted = counted.groupBy("share").applyInArrow(joined, "u long, a long, b long")
    return indexed.unionByName(counted)


def _runs(numbers: Column) -> Column:
    """Runs (a, b) of consecutive whole numbers in a sorted array."""
    fresh = F.array().cast("array<struct<a:int,b:int>>")

    def step(runs: Column, o: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["a"].alias("a"), o.alias("b"))))
        return F.when((F.size(runs) > 0) & (last["b"] == o - 1), longer).otherwise(F.concat(runs, F.array(F.struct(o.alias("a"), o.alias("b")))))

    return F.aggregate(numbers, fresh, step)


def _merged(spans: Column) -> Column:
    """Maximal runs of a sorted array of spans (a, b) that may overlap or touch."""
    fresh = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def step(runs: Column, x: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when((F.size(runs) > 0) & (last["b"] >= x["a"]), longer).otherwise(F.concat(runs, F.array(x)))

    return F.aggregate(spans, fresh, step)


def _continues(raw: Column, at: Column) -> Column:
    """1 if the byte goes on with a character that begins before it."""
    byte = F.conv(F.hex(F.substring(raw, at + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.between(128, 191), F.lit(False)).cast("int")


def _whole_characters(raw: Column, spans: Column) -> Column:
    """Spans without the bytes of characters that are covered in part only."""

    def inner(x: Column) -> Column:
        a, b = x["a"].cast("int"), x["b"].cast("int")
        up = _continues(raw, a) * (1 + _continues(raw, a + 1) * (1 + _continues(raw, a + 2)))
        down = _continues(raw, b) * (1 + _continues(raw, b - 1) * (1 + _continues(raw, b - 2)))
        return F.struct((a + up).cast("long").alias("a"), (b - down).cast("long").alias("b"))

    return F.filter(F.transform(spans, inner), lambda x: x["a"] < x["b"])


def _without(raw: Column, spans: Column) -> Column:
    """The bytes outside sorted spans that do not touch."""
    size = F.size(spans)
    part = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int"))
    gaps = F.transform(F.sequence(F.lit(0), size), lambda i: part(
        F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(spans, i - 1)["b"]),
        F.when(i == size, F.octet_length(raw).cast("long")).otherwise(F.get(spans, i)["a"])))
    return F.aggregate(gaps, F.lit(b""), lambda held, x: F.concat(held, x))


OUTPUTS = ("spans", "kept", "text")


def remove_repeats(
    docs: DataFrame, text_col: str = "text", length: int = LENGTH, crowd: int = CROWD, outputs: Sequence[str] = OUTPUTS,
) -> DataFrame:
    """Every row of the input with a struct ``repeats``: ``n_bytes, n_removed`` (long) and, as ``outputs`` ask, ``spans`` (maximal
    removed runs, from inclusive, to exclusive, in bytes of the input text), ``kept`` (the remaining bytes), ``kept_sha256`` (their
    digest) and ``text`` (the remaining text; a character that would lose some of its bytes stays).

    A byte goes if a string of ``length`` bytes covers it that also starts anywhere else in the table, the same text
    included; strings are judged on the input. Anchors bring equal strings together; a run-length index over the aligned
    text around an anchor finds them by its matching statistics; strings around an anchor with more than ``crowd``
    occurrences are counted by digest instead, with the same result. Equal texts are indexed once and, if long enough,
    wholly removed.

    A null text is empty; shorter texts lose nothing; repeated rows and ids are texts of their own, so their long texts go;
    ids are not used. Other columns stay as they are; a column called ``repeats`` is replaced.
    """
    text = text_or_empty(text_col)
    columns = [c for c in docs.columns if c not in ("repeats", text_col if "text" in outputs else "repeats")]
    digest = F.xxhash64(text)
    distinct = docs.select(digest.alias("u"), text.alias("text")).groupBy("u").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    spans = repeated_spans(distinct.select("u", "text"), length, crowd)
    gone = spans.groupBy("u").agg(_merged(F.array_sort(F.collect_set(F.struct("a", "b")))).alias("found"))

    raw, size = F.encode("text", "UTF-8"), F.octet_length("text").cast("long")
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), size.alias("b")))
    judged = distinct.join(gone, "u", "left").select(
        "u", size.alias("n_bytes"), raw.alias("raw"), F.when((F.col("copies") > 1) & (size >= length), whole).otherwise(F.coalesce("found", none)).alias("spans"))
    forms = {
        "spans": F.col("spans"), "kept": _without(F.col("raw"), F.col("spans")), "kept_sha256": F.sha2(_without(F.col("raw"), F.col("spans")), 256),
        "text": F.decode(_without(F.col("raw"), _whole_characters(F.col("raw"), F.col("spans"))), "UTF-8"),
    }
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    mine, theirs = own_names(docs, "_u", "_of")
    results = written(judged.select(F.col("u").alias(theirs), F.struct("n_bytes", removed.alias("n_removed"), *[forms[o].alias(o) for o in outputs]).alias("repeats")))
    rows = docs.select(digest.alias(mine), *[F.col(f"`{c}`") for c in columns])
    return rows.join(results, F.col(f"`{mine}`") == F.col(f"`{theirs}`")).drop(mine, theirs)


def cut_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Documents without their repeated strings, in the columns of the input; those without a word left go."""
    cut = remove_repeats(docs, text_col, outputs=("text",), **options)
    shown = cut.select(*[F.col("repeats.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
    return shown.where(F.col(text_col).rlike(WORD))
