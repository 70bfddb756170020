"""Exact top-k search: columnar branch-and-bound over blocks of vectors in vertical layout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_ROWS = 1 << 16
QUERY_ROWS = 1 << 12
DIMS = 8


def scaled(vector: Column | str, scale: int = 1024) -> Column:
    """Components as ``floor(scale * x)``; null if the vector is null or a component is null or not finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS, dims: int = DIMS, scale: int = 1024,
) -> DataFrame:
    """The ``k`` highest integer inner products of every query: ``query_id, rank, <id>, score``.

    Candidates and queries are dealt by digest into stripes of bounded size; every pair of stripes meets in
    one task, which keeps only ``k`` rows a query. Ties go to the smaller id. A query never gets rows of its
    own id; with fewer candidates it gets all. Rows with a null id, a null or empty vector, or null or
    non-finite components take no part, nor do candidates of another length than the query. Repeated
    candidate rows count each; a query id with several different vectors ranks over all of them.
    """
    # Digest over the vector too, so that a repeated id is spread like any other rows.
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("_id"), scaled(vector_col, scale).alias("_v"), is_query.alias("_q"),
                       F.xxhash64(id_col, vector_col).alias("_h"))
        .where("_id is not null and size(_v) > 0")
    )
    seen = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("_q"), 1)).alias("q")).first()
    stripes, blocks = -(-seen.n // candidate_rows) or 1, -(-seen.q // query_rows) or 1
    base = rows.select("_id", "_v", F.pmod("_h", F.lit(stripes)).cast("int").alias("_s"), F.pmod(F.shiftright("_h", 20), F.lit(blocks)).cast("int").alias("_b"), "_q")
    candidates = base.select("_id", "_v", "_s", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    queries = base.where("_q").dropDuplicates(["_id", "_v"]).select("_id", "_v", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("_s"), "_b")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return search(left.column("_id").to_numpy(), left.column("_v"), right.column("_id").to_numpy(), right.column("_v"), k, dims)

    found = (
        candidates.groupBy("_s", "_b").cogroup(queries.groupBy("_s", "_b"))
        .applyInArrow(meet, "query_id long, id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _matrices(ids: np.ndarray, vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by length: ids in ascending order and components as one row a dimension."""
    vectors = vectors.combine_chunks()
    vectors = vectors if isinstance(vectors, pa.ListArray) else pa.concat_arrays(vectors.chunks)
    lengths = np.diff(vectors.offsets.to_numpy())
    flat, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
    out = {}
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        at = at[np.argsort(ids[at], kind="stable")]
        out[int(size)] = ids[at], np.ascontiguousarray(flat[starts[at][:, None] + np.arange(size)].T)
    return out


def search(ids, vectors, query_ids, query_vectors, k: int, dims: int) -> pa.Table:
    """Best ``k`` of one stripe for each query of another."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(ids) and len(query_ids):
        stripes = _matrices(ids, vectors)
        for size, (asking, wanted) in _matrices(query_ids, query_vectors).items():
            if size in stripes:
                own, columns = stripes[size]
                index = Vertical(own, columns)
                for j, query in enumerate(asking):
                    best, score = index.best(wanted[:, j], query, k, dims)
                    out.append((np.full(len(best), query), best, score))
    parts = [np.concatenate(x) if out else np.empty(0, np.int64) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
    return pa.table({n: pa.array(v.astype(np.int64), pa.int64()) for n, v in zip(("query_id", "id", "score"), parts, strict=True)})


class Vertical:
    """A stripe stored dimension by dimension."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray):
        self.ids, self.columns = ids, columns
        # Sums of products stay exact as doubles below 2**53; beyond that whole numbers of 64 bits are used.
        self.peak = float(np.abs(columns.astype(np.float64)).max(initial=0))
        self.exact = columns.astype(np.float64)
        self.squares = np.square(self.exact)
        self.mass = self.squares.sum(axis=0)

    def best(self, query: np.ndarray, own: int, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """Accumulate block by block, largest query components first; drop rows whose remaining mass cannot help."""
        q = query.astype(np.float64)
        if len(q) * self.peak * float(np.abs(q).max(initial=0)) >= 2**53:
            score = (self.columns * query[:, None]).sum(axis=0)
            return self._pick(np.flatnonzero(self.ids != own), score, k)
        order = np.argsort(-np.abs(q), kind="stable")
        left = np.flatnonzero(self.ids != own)
        if len(left) == 0:
            return self.ids[:0], np.empty(0, np.int64)
        # The first rows, scored in full, give a first bound that later rows have to reach.
        head = left[: 4 * k]
        sums = q @ self.exact[:, head]
        floor = np.sort(sums)[-k] if len(head) >= k else -np.inf
        partial, mass, rest = np.zeros(len(left)), self.mass[left].copy(), float(q @ q)
        for at in range(0, len(q), dims):
            block = order[at : at + dims]
            rows = self.exact[np.ix_(block, left)]
            partial += q[block] @ rows
            mass -= np.square(rows).sum(axis=0)
            rest -= float(q[block] @ q[block])
            reach = np.sqrt(np.maximum(mass, 0) * max(rest, 0.0)) * (1 + 1e-9) + 1e-3
            if len(left) > k:
                floor = max(floor, np.partition(partial - reach, len(left) - k)[len(left) - k])
            keep = partial + reach >= floor
            if not keep.all():
                left, partial, mass = left[keep], partial[keep], mass[keep]
        score = np.zeros(len(self.ids), np.int64)
        score[left] = partial.astype(np.int64)
        return self._pick(left, score, k)

    def _pick(self, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = at[np.lexsort((self.ids[at], -score[at]))][:k]
        return self.ids[at], score[at]
