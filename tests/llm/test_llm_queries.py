"""Every registered query against its SQL or a brute-force version on the smallest tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as driver
from corpusloom.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    df = driver.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    result = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in result.description]
    shown = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    canon = lambda cols, data: sorted(tuple(shown(r[i]) for i in sorted(range(len(cols)), key=lambda i: cols[i])) for r in data)
    assert sorted(names) == sorted(df.columns)
    assert canon(df.columns, rows) == canon(names, result.fetchall())


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def test_op1_base_counts_and_gain(spark, texts):
    rows = driver.queries()["op1_context_mixing"](spark, DATA).collect()
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    seen = Counter(w for k, t in texts.items() if not held[k] for w in tokens(t))
    total, types = sum(seen.values()), len(seen)
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(seen[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (types + 1))) for w in own), rel_tol=1e-9)
        assert r.score < 0 and r.bits_per_byte > 0
    trained = [r for r in rows if not r.held_out]
    assert sum(r.score for r in trained) > sum(r.base_score for r in trained)


def test_op3_is_the_library_on_whole_texts(spark, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_path())
    rows = driver.queries()["op3_token_counts"](spark, DATA).collect()
    for r in rows:
        n = len(model.encode(texts[r.doc_id] or "", add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 2048)
    assert len(rows) == len(texts)


def packed_by_hand(rows, capacity=2048):
    """Bins by scanning all open ones for the tightest that fits and does not conflict."""
    open_bins, made, out = [], 0, {}
    for key, length, source, cluster in rows:
        fits = [b for b in open_bins if b[0] >= length and not (b[2] & {("s", source), ("c", cluster)} - {("s", None)})]
        if fits:
            best = min(fits, key=lambda b: (b[0], b[1]))
            open_bins.remove(best)
        else:
            best, made = (capacity, made, frozenset()), made + 1
        out[key] = (best[1], capacity - best[0])
        open_bins.append((best[0] - length, best[1], best[2] | {("s", source), ("c", cluster)}))
    return out


def test_op4_is_exact_best_fit_without_conflicts(spark, texts):
    rows = driver.queries()["op4_best_fit_packing"](spark, DATA).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sizes = {k: len(tokens(t)) - 1 for k, t in texts.items()}
    covered, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        covered[r.doc_id] += r.length
        bins[r.shard, r.bin].append(r)
    assert dict(covered) == {k: n for k, n in sizes.items() if n}
    for inside in bins.values():
        assert sum(r.length for r in inside) <= 2048
        spans = sorted((r.offset, r.offset + r.length) for r in inside)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert len({source[r.doc_id] for r in inside}) == len({" ".join(map(str, tokens(texts[r.doc_id]))) for r in inside}) == len(inside)
    rests = sorted(((k, n % 2048) for k, n in sizes.items() if n % 2048), key=lambda x: (-x[1], x[0]))
    expected = packed_by_hand([(k, n, source[k], " ".join(map(str, tokens(texts[k])))) for k, n in rests])
    assert {r.doc_id: (r.bin, r.offset) for r in rows if r.length < 2048} == expected


def cut_by_hand(texts, length=400):
    seen = Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for k, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out[k] = gone
    return out


def test_op6_is_exact(spark, texts):
    raw = {k: (t or "").encode() for k, t in texts.items()}
    gone = cut_by_hand(raw)
    rows = driver.queries()["op6_run_length_index"](spark, DATA).collect()
    assert len(rows) == len(raw)
    for r in rows:
        kept = bytes(b for b, x in zip(raw[r.doc_id], gone[r.doc_id], strict=True) if not x)
        runs = len(re.findall(b"\1+", bytes(gone[r.doc_id])))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw[r.doc_id]), sum(gone[r.doc_id]), runs, hashlib.sha256(kept).hexdigest())
        assert r.text.encode() == kept or len(r.text.encode()) > len(kept)


def test_op9_on_held_out_documents(spark):
    folder = DATA.replace("0.001", "0.01")
    named = driver.queries()["op9_byte_recurrent_langid"](spark, folder)
    rows = named.join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
