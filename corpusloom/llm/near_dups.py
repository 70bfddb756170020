"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpusloom.llm import kernels
from corpusloom.llm.common import text_or_empty, written
from corpusloom.operators.ordered import number_sorted
from corpusloom.session import checkpointed

SHINGLE = 5
PERCENT = 75
MINIMA = 128
MISSED = 1e-5  # bands are so short that a pair at the threshold is missed with at most this probability; at 75 percent 32 bands of 4, five in a million
SKETCH_BITS = 4  # low bits kept of each of the minima
SKETCH_DEVIATIONS = 5  # a pair at the threshold passes the sketch unless it agrees in so many deviations less than on average
WANTED_BITS = 26  # bitmap of documents to verify: 8 MB at any size
CROWDED = 2000  # pairs across components above which a bucket is compared in blocks
BLOCK = 512  # documents of a block
SKETCH = [f"b{i}" for i in range(8)]
_BATCH = 1 << 22
_CHUNK = 1 << 15


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows a band: the longest bands that miss a pair at the threshold with probability MISSED or less."""
    rows = max([r for r in range(1, MINIMA + 1) if (1 - (percent / 100) ** r) ** (MINIMA // r) <= MISSED], default=1)
    return MINIMA // rows, rows


def sketch_agreement(percent: int, minima: int) -> int:
    """Places of a sketch in which a pair at the threshold agrees at least; minima that a short signature lacks always do."""
    held = min(minima, MINIMA)
    equal = percent / 100 + (1 - percent / 100) / (1 << SKETCH_BITS)
    return MINIMA - held + math.floor(held * equal - SKETCH_DEVIATIONS * math.sqrt(held * equal * (1 - equal)))


def circulant_signatures(shingles: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """``size`` minima for every set that is not empty (``bounds`` of such sets): one row a set.

    The first permutation scatters the shingles over the circle of 2**32 places; coordinate k is the smallest image
    under the second permutation after the circle is turned by k places. Both are bijections of 32-bit numbers.
    """
    out = np.empty((len(bounds) - 1, size), np.uint32)
    at = 0
    while at < len(bounds) - 1:  # sets by chunks that stay in the cache
        to = max(int(np.searchsorted(bounds, bounds[at] + _CHUNK, "right")) - 1, at + 1)
        placed = _permute((shingles[bounds[at] : bounds[to]] >> np.uint64(32)).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
        starts = bounds[at:to] - bounds[at]
        turned = np.empty_like(placed)
        for k in range(size):
            np.add(placed, np.uint32(k), out=turned)
            out[at:to, k] = np.minimum.reduceat(_permute(turned, 0x7FEB352D, 0x846CA68B), starts)
        at = to
    return out


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = kernels.text_bytes(column)
    for a, b in kernels.text_batches(data, offsets, _BATCH):
        words, bounds = kernels.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, *kernels.shingle_sets(words, bounds, size)


def _signed(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, sets, ends in _sets(batch.column(1), size):
            n = np.diff(ends)
            full = np.flatnonzero(n)
            bounds = np.concatenate([ends[:-1][full], ends[-1:]])
            minima = circulant_signatures(sets, bounds, bands * rows)
            wide = minima.astype(np.uint64).reshape(len(full), bands, rows)
            keys = np.zeros((len(full), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                keys = kernels.mix(keys ^ wide[:, :, r])
            # Sums of two spreads of the members stand for the whole set.
            sums = [np.add.reduceat(kernels.mix(sets ^ np.uint64(c)), bounds[:-1]) if len(full) else np.empty(0, np.uint64) for c in (1, 2)]
            sketch = _nibbles(minima)
            spread = lambda v, n=b - a, at=full: _placed(v, n, at)
            every = np.zeros(b - a + 1, np.int64)
            every[1:] = np.cumsum(np.where(n > 0, bands, 0))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), *[pa.array(spread(s.view(np.int64))) for s in sums],
                *[pa.array(spread(sketch[:, i])) for i in range(len(SKETCH))], kernels.binaries(keys.view(np.int64).ravel(), every),
            ], names=["id", "n", "s1", "s2", *SKETCH, "keys"])


def _nibbles(minima: np.ndarray) -> np.ndarray:
    """Low bits of up to 128 minima of a set in eight longs."""
    low = np.zeros((len(minima), 128), np.uint8)
    low[:, : minima.shape[1]] = (minima & ((1 << SKETCH_BITS) - 1)).astype(np.uint8)[:, :128]
    return np.ascontiguousarray(low[:, ::2] | (low[:, 1::2] << 4)).view(np.int64)


def _placed(values: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[at] = values
    return out


def _band_rows(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2048):
            part = batch.slice(at, 2048)
            data, _ = kernels.text_bytes(part.column(1))
            repeat = np.repeat(np.arange(len(part)), bands)
            yield pa.RecordBatch.from_arrays(
                [pa.array(data.view(np.int64)), part.column(0).take(pa.array(repeat))], names=["key", "rep"])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT,
    bands: int | None = None, rows: int | None = None,
) -> DataFrame:
    """Component of every document under links of ``100 * |A ∩ B| >= percent * |A ∪ B|``.

    Sets are the distinct ``size``-word shingles of the whole text, A-Z in lower case; a shorter text is one shingle, a
    text without words has the empty set and links with nothing. Returns ``id, n_shingles, component_id`` (smallest id
    reachable) and ``kept`` (the document is that one), a row for each row of the input.

    Documents with equal sets form one class with the smallest id as representative. In every band bucket the members
    are first compared with the smallest one; whoever still lies in another component of the same bucket is then compared
    across components. So no bucket gives all its pairs, yet no candidate link between different components is lost.
    Links are confirmed on the full sets, and components grow by label propagation in Spark.

    ``bands`` of ``rows`` minima follow from ``percent`` if not given.

    Repeated ids are one document with several rows: they share a component. Rows with a null id link with nothing, have
    no component, and are kept. Ids that are no whole numbers are numbered in their order first.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        return _numbered(docs, id_col, text_col, size=size, percent=percent, bands=bands, rows=rows)
    if bands is None or rows is None:
        bands, rows = banding(percent)
    agree = sketch_agreement(percent, bands * rows)
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    signed = written(source.mapInArrow(
        lambda it: _signed(it, size, bands, rows), f"id long, n long, s1 long, s2 long, {', '.join(f'{b} long' for b in SKETCH)}, keys binary"))
    linked = signed.where("id is not null and n > 0")
    of_set = ["n", "s1", "s2"]
    classes = written(
        linked.groupBy(*of_set).agg(F.min(F.struct("id", *SKETCH, "keys")).alias("m")).select(*of_set, F.col("m.id").alias("rep"), *[f"m.{b}" for b in SKETCH], "m.keys"))
    # Rows of one id may have several texts; the id then joins their classes.
    banded = classes.select("rep", "keys").mapInArrow(lambda it: _band_rows(it, bands), "key long, rep long")
    crowded = banded.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("hub")).where("m > 1").select("key", "hub")
    members = written(banded.join(crowded, "key"))
    members = written(members.join(classes.select("rep", "n", *SKETCH), "rep"))

    hubs = members.where("rep = hub").select("key", *[F.col(c).alias(f"h_{c}") for c in ("rep", "n", *SKETCH)]).distinct()
    star = written(members.where("rep <> hub").join(hubs, "key").where(_close(percent, agree)).select(F.col("h_rep").alias("a"), F.col("rep").alias("b")).distinct())
    first = written(_verified(star, source, size, percent))

    twins = linked.join(classes.select(*of_set, "rep"), of_set).select(F.col("rep").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    roots = components(first)
    second = written(_across(members, roots, star, source, size, percent, agree))
    own = written(twins)
    roots = components(first.unionByName(second).unionByName(own))
    return (
        signed.join(roots.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component_id", F.coalesce("root", "id"))
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def _numbered(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """Near duplicates of documents whose ids are not whole numbers."""
    named = docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text"))
    numbers = written(number_sorted(named.where("name is not null").select("name").distinct(), "name", name="id"))
    found = near_duplicates(named.join(numbers, "name", "left"), "id", "text", **options)
    first = numbers.select(F.col("name").alias("component_id"), F.col("id").alias("_first"))
    return (
        found.withColumnRenamed("component_id", "_first").join(numbers, "id", "left").join(first, "_first", "left")
        .select(F.col("name").alias(id_col), "n_shingles", "component_id", "kept")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, that with the smallest id, in the columns of the input; of several rows of that id one stays,
    the first by a digest of the row. Rows with a null id stay as they are.
    """
    found = near_duplicates(docs, id_col, text_col, **options).where(F.col(id_col).isNotNull())
    kinds = found.groupBy(F.col(id_col).alias("_id")).agg((~F.bool_and("kept")).alias("gone"), F.count("*").alias("rows"))
    other = written(kinds.where("gone or rows > 1").select("_id", "gone"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), whole.alias("_row"))
    # Only rows of repeated ids are shuffled whole; nulls meet nothing.
    single = rows.join(other, "_id", "left_anti")
    order = F.md5(F.to_json("_row", {"ignoreNullFields": "false"}))
    several = rows.join(other.where("not gone"), "_id", "left_semi").groupBy("_id").agg(F.min_by("_row", order).alias("_row"))
    return single.unionByName(several).select("_row.*")


def _close(percent: int, agree: int):
    """Sizes and low bits of the minima leave the threshold possible."""
    differ = F.lit(0)
    for b in SKETCH:
        x = F.col(b).bitwiseXOR(F.col(f"h_{b}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(x)
    small, large = F.least("n", "h_n"), F.greatest("n", "h_n")
    return (small * 100 >= large * percent) & (differ <= MINIMA - agree)


def _across(members: DataFrame, roots: DataFrame, tested: DataFrame, source: DataFrame, size: int, percent: int, agree: int) -> DataFrame:
    """Links between different components of one bucket: all members against those outside its largest component.

    Buckets with few such pairs give them as rows; crowded ones are compared in blocks.
    """
    placed = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root", "hub")
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.sum("m").alias("all"), F.max(F.struct("m", "comp")).alias("top")).where("comps > 1")
    minors = F.col("all") - F.col("top.m")
    mixed = mixed.select("key", F.col("top.comp").alias("major"), (F.col("all") * minors > CROWDED).alias("crowded"),
                         F.ceil(F.col("all") / BLOCK).alias("many"), F.ceil(minors / BLOCK).alias("few"))
    open_rows = written(placed.join(mixed, "key"))
    calm = open_rows.where("not crowded")
    minor = calm.where("comp <> major").select("key", F.col("comp").alias("h_comp"), *[F.col(c).alias(f"h_{c}") for c in ("rep", "n", *SKETCH)])
    pairs = calm.join(minor, "key").where((F.col("comp") != F.col("h_comp")) & ((F.col("comp") == F.col("major")) | (F.col("rep") < F.col("h_rep")))).where(_close(percent, agree))
    pairs = pairs.select(F.least("rep", "h_rep").alias("a"), F.greatest("rep", "h_rep").alias("b")).distinct()
    pairs = written(pairs.join(tested, ["a", "b"], "left_anti"))
    crowded = open_rows.where("crowded").select("key", "rep", "comp", "major", "many", "few")
    return _verified(pairs, source, size, percent).unionByName(_crowded_links(crowded, source, size, percent))


def _packed_sets(ids: DataFrame, source: DataFrame, size: int) -> DataFrame:
    """``id, members``: the full set of each document named in ``ids``, sorted digests."""
    wanted = ids.distinct()
    place = F.pmod(F.xxhash64("id"), F.lit(1 << WANTED_BITS))
    bitmap = np.zeros(1 << (WANTED_BITS - 5), np.int64)
    cells = wanted.select(F.shiftright(place, 5).alias("w"), F.pmod(place, F.lit(32)).cast("int").alias("o")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, o)")).alias("m")).toPandas()
    bitmap[cells["w"].to_numpy()] = cells["m"].to_numpy()
    held = source.sparkSession.sparkContext.broadcast(bitmap.astype(np.uint32))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 > 0))
            for a, b, sets, ends in _sets(batch.column(1), size):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), kernels.binaries(sets.view(np.int64), ends)], names=["id", "members"])

    # The bitmap lets through all documents that are wanted and few others; the join is exact.
    sets = source.where("id is not null").select("id", "text", place.alias("at")).mapInArrow(pack, "id long, members binary")
    return written(sets.join(wanted, "id", "left_semi").dropDuplicates(["id", "members"]))


def _verified(pairs: DataFrame, source: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = _packed_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")), source, size)
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(confirm, "a long, b long").distinct()


def _crowded_links(rows: DataFrame, source: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components of crowded buckets, block against block.

    The members of a bucket are dealt to blocks, those outside its largest component to blocks of their own; every two
    blocks meet in one task, which intersects the full sets and returns a single link for a document and a component.
    A pair that shares several such buckets is tested in the one of least key.
    """
    sets = _packed_sets(rows.select(F.col("rep").alias("id")), source, size)
    shared = rows.groupBy("rep").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    docs = shared.join(sets.withColumnRenamed("id", "rep"), "rep")
    place = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    count = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    kept = ["key", "rep", "comp", "major", "i", "j"]
    every = rows.withColumn("i", place(0, "many")).withColumn("j", F.explode(count("few"))).select(kept)
    minor = rows.where("comp <> major").withColumn("j", place(1, "few")).withColumn("i", F.explode(count("many"))).select(kept)
    # Both sides come from the same rows, so their columns are named anew.
    whole = lambda side: side.join(docs, "rep").select(*[F.col(c).alias(c) for c in (*kept, "keys", "members")]).groupBy("key", "i", "j")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _links_between(left.to_pylist(), right.to_pylist(), percent)
        return pa.table({n: pa.array([x[i] for x in found], pa.int64()) for i, n in enumerate(("a", "b"))})

    return whole(every).cogroup(whole(minor)).applyInArrow(meet, "a long, b long").distinct()


def _links_between(every: list[dict], minor: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links of minor documents with others of other components, one for each document and component."""
    if not every or not minor:
        return []
    sets = [np.frombuffer(r["members"], np.uint64) for r in every]
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    rep, comp = (np.array([r[c] for r in every]) for c in ("rep", "comp"))
    in_major = comp == every[0]["major"]
    holders: dict[int, list[int]] = {}
    for i, r in enumerate(every):
        for k in r["keys"]:
            holders.setdefault(k, []).append(i)
    out = []
    for r in minor:
        own = np.frombuffer(r["members"], np.uint64)
        wanted = (comp != r["comp"]) & (in_major | (rep < r["rep"]))
        for k in r["keys"]:
            if k < r["key"]:
                wanted[holders.get(k, [])] = False
        if not wanted.any():
            continue
        first, last = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        n = last - first
        hits = owner[np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)]
        both = np.bincount(hits, minlength=len(sets))
        linked = np.flatnonzero(wanted & (100 * both >= percent * (sizes + len(own) - both)))
        for i in np.unique(comp[linked], return_index=True)[1]:
            out.append((min(r["rep"], int(rep[linked[i]])), max(r["rep"], int(rep[linked[i]]))))
    return out


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links but the roots; ``root`` is the smallest node of the component.

    Large-star and small-star steps with minima and joins: a node with very many links is a skewed join key, never a
    group in one task. Every round is kept in the checkpoint folder.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        down = edges.join(least, "u")
        edges = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = checkpointed(edges.where("u <> v").distinct())
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (seen.n, seen.h):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = (seen.n, seen.h)
