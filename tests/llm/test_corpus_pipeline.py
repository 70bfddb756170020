"""The stages on a small table against brute force, each on what the one before kept."""

import os
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from corpusloom.llm import queries
from tests.llm.test_llm_edges import links_by_hand
from tests.llm.test_llm_queries import DATA, cut_by_hand, packed_by_hand, tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")


def whole_characters(raw, gone):
    """Bytes that stay if a character goes only as a whole."""
    out, at = b"", 0
    for char in raw.decode():
        n = len(char.encode())
        out += b"" if all(gone[at : at + n]) else raw[at : at + n]
        at += n
    return out.decode()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, con = docs.columns, duckdb.connect()
    before = docs.collect()

    def step(k, frame):
        out = str(tmp_path / str(k))
        frame.write.parquet(out)
        return spark.read.parquet(out)

    # Quality: the SQL verdicts, and lines that pass.
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    verdict = con.execute(queries.ORACLES["op8_quality_rules"]).fetchdf().set_index("doc_id")
    docs = step(0, corpus_pipeline.STAGES[0][1](spark, docs, DATA))
    rows = docs.collect()
    assert docs.columns == columns and {r.doc_id for r in rows} == set(verdict.index[verdict["kept"]])
    old = {r.doc_id: r.text for r in before}
    for r in rows:
        assert len(tokens(old[r.doc_id])) - len(tokens(r.text)) == verdict.loc[r.doc_id, "removed_words"]
        assert set(r.text.split("\n")) <= set(old[r.doc_id].split("\n")) and r.n_chars == len(r.text)

    # Near duplicates: one of each group.
    expected = {i for i, _, _, kept in links_by_hand([(r.doc_id, r.text) for r in rows]) if kept}
    docs = step(1, corpus_pipeline.STAGES[1][1](spark, docs, DATA))
    assert docs.columns == columns
    rows, held = docs.collect(), {r.doc_id: r for r in rows}
    assert {r.doc_id for r in rows} == expected and all(held[r.doc_id] == r for r in rows)

    # Repeated strings.
    raw = {r.doc_id: r.text.encode() for r in rows}
    gone = cut_by_hand(raw, corpus_pipeline.PASSAGE_BYTES)
    expected = {k: whole_characters(raw[k], gone[k]) for k in raw}
    docs = step(2, corpus_pipeline.STAGES[2][1](spark, docs, DATA))
    rows = docs.collect()
    assert docs.columns == columns
    assert {r.doc_id: r.text for r in rows} == {k: t for k, t in expected.items() if len(tokens(t)) > 1}

    # The mix: words as the SQL of the mix takes them from this table.
    con.execute("DROP VIEW documents")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path / '2'}/*.parquet'")
    taken = con.execute(queries.ORACLES["op7_source_mix"]).fetchdf().set_index("doc_id")["taken"].to_dict()
    docs = step(3, corpus_pipeline.STAGES[3][1](spark, docs, DATA))
    rows = docs.collect()
    assert docs.columns == columns
    words = Counter()
    for r in rows:
        words[r.doc_id] += len(tokens(r.text)) - 1
    assert dict(words) == {k: n for k, n in taken.items() if n}

    # Packing: exact best fit of all rows.
    out = corpus_pipeline.STAGES[4][1](spark, docs, DATA).collect()
    assert sum(r.length for r in out) == sum(words.values()) and {r.doc_id for r in out} == set(words)
    sizes = Counter(len(tokens(r.text)) - 1 for r in rows)
    assert Counter(r.length for r in out) == Counter([n % 2048 for n in sizes.elements() if n % 2048] + [2048 for n in sizes.elements() for _ in range(n // 2048)])


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and {"doc_id", "bin", "offset", "length"} <= set(rows[0].asDict())
    assert re.fullmatch(r"[a-z_]+", corpus_pipeline.STAGES[0][0]) and len(corpus_pipeline.STAGES) == 5
    assert packed_by_hand([(1, 5, None, 1)]) == {1: (0, 0)}
