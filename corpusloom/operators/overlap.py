"""Overlap between training documents and evaluation items, by shared word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.tokens import words

SHINGLE = 8
LEAK_SHARE = 0.5


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Distinct digests of every ``size`` consecutive words in lower case; of all words where there are fewer.

    Two digests of each, so that equal pairs mean equal words at any size of a table.
    """
    split = words(F.lower(F.coalesce(text, F.lit(""))))

    def listed(w: Column) -> Column:
        last = F.greatest(F.size(w) - size, F.lit(0))
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))
        pair = F.transform(F.array_distinct(cut), lambda s: F.struct(F.xxhash64(s).alias("h1"), F.xxhash64(s, F.lit(1)).alias("h2")))
        return F.when(F.size(w) > 0, pair).otherwise(F.array().cast("array<struct<h1:bigint,h2:bigint>>"))

    return F.get(F.transform(F.array(split), listed), F.lit(0))


def overlap_audit(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", size: int = SHINGLE,
) -> DataFrame:
    """``doc, item, matched, shingles, share`` for every pair that shares a shingle: an equi-join on digests.

    ``share`` is the part of the item's distinct shingles that the document holds.
    """
    spread = lambda df, key: df.select(F.col(key), F.explode(shingles(F.col(text), size)).alias("s")).select(key, "s.*")
    wanted = spread(items, item_id)
    sizes = wanted.groupBy(item_id).agg(F.count(F.lit(1)).alias("shingles"))
    met = spread(docs, doc_id).join(wanted, ["h1", "h2"]).groupBy(doc_id, item_id).agg(F.count(F.lit(1)).alias("matched"))
    return met.join(sizes, item_id).select(doc_id, item_id, "matched", "shingles", (F.col("matched") / F.col("shingles")).alias("share"))


def without_leaks(docs: DataFrame, items: DataFrame, share: float = LEAK_SHARE, doc_id: str = "doc_id", **options) -> DataFrame:
    """Documents that hold less than ``share`` of every evaluation item."""
    leaking = overlap_audit(docs, items, doc_id, **options).where(F.col("share") >= share).select(doc_id).distinct()
    return docs.join(leaking, doc_id, "left_anti").select(docs.columns)
