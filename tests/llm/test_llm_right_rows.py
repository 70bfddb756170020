"""Names that operators use inside, ids of any kind, thresholds below 75 percent, equal rows of several sources."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import langid, mixing, near_dups, quality

CLASHES = ("_m", "_removed", "_turns", "_pieces", "_round", "_key", "_turn", "_k", "_s", "_row", "_d", "_text", "_source", "_times", "_id", "rounds", "parts", "size", "gone", "rows")


def text(n, start=0):
    return " ".join(f"w{start + i}{'.' if i % 9 == 8 else ''}" for i in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, text(60, 1000 * (i // 2)) + (" more" if i % 2 else ""), "en", f"s{i % 2}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASHES], F.create_map(F.lit("k"), "doc_id").alias("held"))


@pytest.mark.parametrize("stage", [quality.clean, near_dups.deduplicate, mixing.mixed_documents])
def test_stages_keep_columns_of_any_name(clashing, stage):
    found = stage(clashing)
    assert found.columns == clashing.columns
    rows = found.collect()
    assert rows
    for r in rows:
        assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHES) and r.held == {"k": r.doc_id}
    if stage is near_dups.deduplicate:
        assert sorted(r.doc_id for r in rows) == [0, 2, 4]


def test_assess_keeps_clashing_columns(clashing):
    assert {c for c in quality.assess(clashing).columns} == {*clashing.columns, "quality"}


def test_equal_documents_of_two_sources_fill_both_targets(spark):
    docs = spark.createDataFrame([(1, text(1000), "s0", 1), (1, text(1000), "s1", 2), (2, text(500, 7), "s1", 3), (2, text(500, 7), "s1", 3), (3, text(400, 9), None, 4)],
                                 "doc_id long, text string, source string, extra int")
    taken = {r.source: r.n for r in mixing.mix(docs, block_words=16).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    given = mixing.mixed_documents(docs, block_words=16).withColumn("n", F.size(F.split(F.trim("text"), " ")))
    assert {r.source: r.n for r in given.groupBy("source").agg(F.sum("n").alias("n")).collect()} == {k: n for k, n in taken.items() if n}


def test_one_row_of_an_id_stays(spark):
    rows = [(1, text(80), "a"), (1, text(80), "b"), (2, text(80, 500), "a"), (None, text(80), "c"), (None, text(80), "c"), (3, text(80), "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = near_dups.deduplicate(docs).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 1, 2]


def _components(rows, percent):
    sets = {}
    for name, value in rows:
        words = value.split()
        sets[name] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}
    root = {n: n for n in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {n: low if r == high else r for n, r in root.items()}
    return root


@pytest.mark.parametrize("percent", [50, 60, 90])
def test_every_threshold_with_text_ids(spark, percent):
    draw = random.Random(percent)
    rows = []
    for k in range(25):
        words = [f"g{k}x{i}" for i in range(400)]
        rows.append((f"d{k:02}a", " ".join(words)))
        cut = int(400 * (percent + 1.5) / 100) if k % 2 else int(400 * (percent - 3) / 100)
        rows.append((f"d{k:02}b", " ".join(words[:cut])))
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "name string, text string")
    found = {r.name: r.component_id for r in near_dups.near_duplicates(docs, "name", percent=percent).collect()}
    assert found == _components(rows, percent)
    assert len(set(found.values())) == 38  # twelve pairs are just above the threshold


def test_banding_at_the_usual_threshold():
    assert near_dups.banding(75) == (32, 4) and near_dups.sketch_agreement(75, 128) == 74


def test_every_language_is_sampled_without_ids(spark):
    rows = [(None, f"{lang} text number {n}" if lang < "g" else "the same text", lang) for lang in "abcdefgh" for n in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    windows, labels = langid.training_sample(docs, "doc_id", "text", "lang")
    assert set(labels) == set("abcdefgh") and len(windows) == len(labels)
    least = min(langid.SAMPLE_DOCS, 1500) // 2
    assert all(labels.count(x) >= least for x in "abcdef")
