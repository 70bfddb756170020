"""Leakage queries: documents that hold evaluation items."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import overlap
from corpusloom.plans.binding import WORDS, documents, rounded, table


def _audit(spark, folder):
    found = overlap.overlap_audit(documents(spark, folder), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "shingles", rounded(F.col("share")).alias("share"))


def _clean(spark, folder):
    return overlap.without_leaks(documents(spark, folder), table(spark, folder, "benchmark")).select("doc_id", "lang")


QUERIES = {"jon9_overlap_audit": _audit, "jon9_without_leaks": _clean}

_MET = f"""WITH s AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
    w AS (SELECT side, id, {WORDS.replace('text,', "lower(coalesce(text, '')),", 1)} AS w FROM s),
    g AS (SELECT DISTINCT side, id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT id, count(*) AS n FROM g WHERE side = 'b' GROUP BY 1),
    met AS (SELECT a.id AS doc_id, b.id AS item_id, count(*) AS matched, any_value(n.n) AS shingles FROM g a JOIN g b ON a.side = 'd' AND b.side = 'b' AND a.g = b.g
      JOIN n ON n.id = b.id GROUP BY 1, 2)"""

ORACLES = {
    "jon9_overlap_audit": f"{_MET} SELECT doc_id, item_id, matched, shingles, round(matched / shingles, 6) AS share FROM met",
    "jon9_without_leaks": f"{_MET} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM met WHERE matched / shingles >= 0.5)",
}
