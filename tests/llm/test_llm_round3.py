"""Copied words, token alignment and periodic runs: brute force on small tables, and odd rows."""

import bisect
import hashlib
import itertools
import os
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from corpusloom.llm import alignment, copied, kernels, lm_score, periodic, queries
from tests.llm.conftest import PASSAGE, words

DATA = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def copied_by_hand(rows, window=13):
    """Words left of every (id, text)."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        for p in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def copies(df, **options):
    return ordered((r.doc_id, r.copied.n_words, r.copied.n_removed, r.copied.kept) for r in copied.remove_copied(df, **options).collect())


@pytest.mark.parametrize("crowd", [4096, 2, 0])
def test_copies_are_exact(spark, crowd):
    """Passages cut at every place, of several sources, behind and before other words; crowds of segments too."""
    rng = np.random.default_rng(crowd)
    pool = [f"p{k % 61}" for k in range(400)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.integers(0, 6)):
            a = int(rng.integers(0, 380))
            parts += pool[a : a + int(rng.integers(5, 40))] if rng.random() < 0.7 else [f"u{rng.integers(0, 4)}" for _ in range(rng.integers(1, 20))]
        rows.append((int(rng.integers(0, 100)), " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert copies(df, crowd=crowd) == ordered(copied_by_hand(rows))


def test_copied_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = copied.remove_copied(odd)
    assert copies(odd) == ordered(copied_by_hand(rows)) and got.columns == [*odd.columns, "copied"]
    assert copied.remove_copied(none).count() == 0
    runs = {r.doc_id: r.copied.spans for r in got.collect()}
    assert runs[1] == [] and [(s.a, s.b) for s in runs[2]] == [(0, 120)]
    with pytest.raises(TypeError):
        copied.remove_copied(odd.withColumn("doc_id", F.col("key")))


def test_block_factors_are_longest_and_boundaries_are_checked():
    """Two references meet inside a segment: the window across their factors comes from a third."""
    w = [f"w{k}" for k in range(40)]
    text = lambda a, b, *more: " ".join([*w[a:b], *more]).encode()
    block = copied.ReferenceBlock([text(0, 16, "x"), text(16, 32, "y"), text(9, 23, "z"), text(0, 32)], np.array([1, 2, 3, 9]), 13)
    row, a, b = block.parse(13)
    assert {(int(x), int(y)) for x, y in zip(a, b, strict=True)} == {(0, 16), (16, 32), (9, 23), (10, 23)}
    assert set(row.tolist()) == {3}


def runs_by_hand(x, times=4, shortest=6):
    out, n = {}, len(x)
    for q in range(1, n // times + 1):
        for same, group in itertools.groupby(range(n - q), lambda i, q=q: x[i] == x[i + q]):
            group = list(group)
            if same and len(group) + q >= max(shortest, times * q):
                out.setdefault((group[0], len(group) + q), q)
    return sorted((s, n_, q) for (s, n_), q in out.items())


@pytest.mark.parametrize("span", [1 << 20, 4])
def test_runs_are_exact(monkeypatch, span):
    monkeypatch.setattr(periodic, "SPAN", span)
    rng = np.random.default_rng(span)
    for _ in range(400):
        n = int(rng.integers(0, 100))
        x = rng.integers(0, rng.integers(1, 4), n)
        if n > 8:
            p, a = int(rng.integers(1, n // 3)), int(rng.integers(0, n))
            x[a:] = np.resize(x[a : a + p], n - a)
        assert periodic.runs_of(x.astype(np.int64), n) == runs_by_hand(x.tolist())


def test_squared_differences_are_exact():
    rng = np.random.default_rng(3)
    x = rng.integers(0, periodic.PRIME, 64).astype(np.uint64)
    got = periodic.squared_differences(x, np.array([0, 8, 16]), 8)
    for r, a in enumerate((0, 8, 16)):
        for d in range(8, 16):
            assert got[r, d - 8] == sum((int(x[a + i]) - int(x[a + d + i])) ** 2 for i in range(8)) % periodic.PRIME


def test_false_equal_hashes_are_caught():
    far = periodic.Extension(np.array([1, 2, 3, 1, 2, 3, 1, 9], np.int64))
    assert far.checked(0, 5, 3, 0) == (0, 4) and far.checked(0, 4, 3, 0) == (0, 4)


def test_runs_of_odd_rows(odd, none):
    got = periodic.find_runs(odd).collect()
    rows = odd.collect()
    assert ordered((r.doc_id, r.text) for r in got) == ordered((r.doc_id, r.text) for r in rows)
    for r in got:
        w = (r.text or "").encode().split()
        runs = runs_by_hand(w) if len(w) < 1000 else [(x.start, x.length, x.period) for x in r.periodic.runs]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.periodic.n_words == len(w) and [(x.start, x.length, x.period) for x in r.periodic.runs] == runs
        assert r.periodic.kept == b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    assert periodic.find_runs(none).count() == 0


def test_minimal_hash_numbers_every_key_once():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 70_000):
        keys = np.unique(rng.integers(0, 2**62, n))
        own = alignment.MinimalHash.opened(*alignment.MinimalHash.of(keys).packed())
        assert sorted(own.index(keys).tolist()) == list(range(len(keys)))
        strangers = rng.integers(0, 2**62, 1000)
        at = own.index(strangers)
        assert ((at >= -1) & (at < max(len(keys), 1))).all()


def aligned_by_hand(texts):
    a, b = (alignment.Vocabulary(queries.tokenizer_path(n)) for n in queries.ALIGNED)
    entry = lambda v, i: v.flat[v.starts[i] : v.starts[i] + v.sizes[i]].tobytes()
    groups = []
    for text in texts:
        ids = [v.encode([text or ""])[0] if text else [] for v in (a, b)]
        if any(b"".join(entry(v, i) for i in x) != (" " + (text or "")).encode() for v, x in zip((a, b), ids, strict=True)):
            ids = [[], []]
        ends = [list(itertools.accumulate(len(entry(v, i)) for i in x)) for v, x in zip((a, b), ids, strict=True)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        own = [([], []) for _ in cuts]
        for side in (0, 1):
            for i, e in zip(ids[side], ends[side], strict=True):
                own[bisect.bisect_left(cuts, e)][side].append(i)
        groups.append(own)
    held = Counter(p for own in groups for p in {(x, y) for g in own for x in g[0] for y in g[1]})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for own in groups:
        links = [(x, y) for g in own for x in g[0] for y in g[1]]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own)
        out.append((sum(len(g[0]) for g in own), sum(len(g[1]) for g in own), len(own), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha(shown) if own else ""))
    return out


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")
def test_op12_is_exact(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    expected = ordered((r.doc_id, *x) for r, x in zip(rows, aligned_by_hand([r.text for r in rows]), strict=True))
    assert ordered(tuple(r) for r in driver.queries()["op12_pair_alignment"](spark, DATA).collect()) == expected


@pytest.mark.parametrize("options", [{}, {"shard_keys": 50, "fan_in": 2, "table_bytes": 2000}])
def test_alignment_of_odd_rows(spark, none, options):
    """One lot or many, one leaf or a tree of them; special strings, long runs of signs, unusual characters, repeated rows."""
    texts = [None, "", " ", "\n\n  \t", "One two", "One two", "</s><s> <|endoftext|> <unk>", "=" * 3000, "áé中文 \U0001f600\U0001f600", "▁x ▁", "\x00\x01�", words(300), PASSAGE]
    df = spark.createDataFrame([(t, k, k) for k, t in enumerate(texts)], "text string, row int, a int").repartition(6)
    paths = [queries.tokenizer_path(n) for n in queries.ALIGNED]
    got = sorted((r.row, *[r.aligned[n] for n in ALIGNED]) for r in alignment.align(df, *paths, **options).collect())
    assert got == [(k, *x) for k, x in enumerate(aligned_by_hand(texts))]
    assert alignment.align(none, *paths, **options).count() == 0


def test_links_come_in_slices(monkeypatch):
    a, b = (alignment.vocabulary(queries.tokenizer_path(n)) for n in queries.ALIGNED)
    found = alignment.Encoder(a, b)([words(200), "-" * 500, "x"])
    assert a.apart and b.apart
    monkeypatch.setattr(a, "apart", False)
    whole = alignment.Encoder(a, b)([words(200), "-" * 500, "x"])
    assert all(np.array_equal(x, y) for s, t in zip(found, whole, strict=True) for x, y in zip(s, t, strict=True))
    whole = alignment.Groups(*found, a, b)
    monkeypatch.setattr(alignment, "WIDE", 3)
    few = Counter()
    for d, p, n in whole.pairs():
        for x, y, z in zip(d.tolist(), p.tolist(), n.tolist(), strict=True):
            few[x, y] += z
    monkeypatch.setattr(alignment, "WIDE", 1 << 12)
    total = Counter(dict_items for d, p, n in whole.pairs() for dict_items in zip(d.tolist(), p.tolist(), n.tolist(), strict=True))
    one = [x.tolist() for x in alignment._by_document(whole)]
    counted = Counter()
    for (d, p, n), times in total.items():
        counted[d, p] += n * times
    assert counted == few
    monkeypatch.setattr(alignment, "LINKS", 3)
    assert Counter(x for d, p, n in whole.pairs() for x in zip(d.tolist(), p.tolist(), n.tolist(), strict=True)) == total
    assert sorted(itertools.chain(*one)) == sorted(itertools.chain(*(x.tolist() for x in alignment._by_document(whole))))


def test_stretches_do_not_change_ids():
    """Cutting at single spaces gives the ids of whole texts, whatever stands around the spaces."""
    a, b = (alignment.vocabulary(queries.tokenizer_path(n)) for n in queries.ALIGNED)
    rng = np.random.default_rng(11)
    signs = [" ", " ", "a", "B", "'s", "'", "1", ".", "\n", "\t", "\u00a0", "\u2003", "\u00e9", "\u4e2d", "\U0001f600", "\u2581", "\u0301", "<|endoftext|>", "</s>", "-", "word"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 14))) for _ in range(4000)]
    encode = alignment.Encoder(a, b)
    for side, v in enumerate((a, b)):
        whole = v.encode(texts)
        cut = [[i for s in alignment._stretches(t) for i in np.frombuffer(encode._measured([s])[0][side], np.uint16).tolist()] for t in texts]
        assert [list(x) for x in whole] == cut


@pytest.mark.parametrize("room", [1 << 20, 2000, 0])
def test_stretches_are_aligned_once_and_together(monkeypatch, room):
    """New stretches reach a vocabulary in lots, stretches known before not at all; groups are those of whole texts, however little is kept."""
    a, b = (alignment.vocabulary(queries.tokenizer_path(n)) for n in queries.ALIGNED)
    rng = np.random.default_rng(5)
    odd = [" lead and trail ", "a  b   c d", "\u2581x \u2581 y", "", " ", "tab\t x", "\x00 \x01\ufffd z", "</s> <unk> </s>", "o" * 90 + " " + "o" * 90]
    batches = [[" ".join(rng.choice(words(400).split(), 200)) for _ in range(20)] + odd for _ in range(4)]
    asked = []
    for v in (a, b):
        monkeypatch.setattr(v, "encode", lambda texts, f=v.encode: asked.append(len(texts)) or f(texts))
    monkeypatch.setattr(alignment, "MEMO_BYTES", room)
    encode = alignment.Encoder(a, b)
    found = [encode.aligned(texts) for texts in batches]
    if room == 1 << 20:
        assert sum(asked) < 400  # 4,000 words and more, about 330 different ones
    monkeypatch.setattr(a, "apart", False)
    plain = alignment.Encoder(a, b)
    for texts, (ids, groups, links, digests) in zip(batches, found, strict=True):
        whole, n, m, shown = plain.aligned(texts)
        assert [[x.tolist() for x in side] for side in ids] == [[x.tolist() for x in side] for side in whole]
        assert (groups.tolist(), links.tolist(), digests) == (n.tolist(), m.tolist(), shown)


@pytest.mark.parametrize("room", [1 << 19, 100])
def test_first_pass_holds_a_bounded_number_of_words(monkeypatch, room):
    """A row a word of all the batches of a task, or several where they do not fit; counts are the same."""
    monkeypatch.setattr(lm_score, "HELD_WORDS", room)
    texts = [words(300, 7 * (k % 3)) for k in range(12)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 2])], names=["t"]) for i in range(0, 12, 2)]
    found, rows = Counter(), 0
    for batch in lm_score._first_pass(iter(batches)):
        for kind, h, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found[h] += c if kind == 0 else 0
            rows += kind == 0
    assert sorted(c for c in found.values() if c) == sorted(Counter(w for t in texts for w in [*t.split(), None]).values())
    if room > 100:
        assert rows == len({w for t in texts for w in t.split()}) + 1


def test_a_strange_pair_is_refused():
    keys = np.array([3, 5, 9])
    own = alignment.MinimalHash.of(keys)
    placed = np.empty(3, np.int64)
    placed[own.index(keys)] = keys
    with pytest.raises(ValueError):
        alignment._looked_up(own, placed, np.array([4]))


def test_case_of_words_counts():
    data = np.frombuffer(b"Abc abc", np.uint8)
    assert len(set(kernels.word_hashes(data, np.array([0, 7]), fold=False)[0].tolist())) == 2
    assert len(set(kernels.word_hashes(data, np.array([0, 7]))[0].tolist())) == 1


def _asked_group(texts, train):
    """What a group of texts asks for, and its canonical texts."""
    flat = "".join(texts).encode()
    sizes = np.array([len(t.encode()) for t in texts])
    batch = pa.RecordBatch.from_pydict({
        "g": [0], "texts": pa.array([lm_score.zstandard.ZstdCompressor().compress(flat)], pa.binary()),
        "sizes": pa.array([lm_score._pressed(sizes.astype(np.int64))], pa.binary()), "train": [train]})
    return batch, lm_score.canonical(np.frombuffer(flat, np.uint8), np.concatenate([[0], np.cumsum(sizes)]))


def test_context_mixing_asks_in_bounded_memory():
    """A group of 3 MB of texts takes well under a hundred bytes a byte to ask for its contexts."""
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 12))) for _ in range(20_000)]
    texts = [" ".join(pool[k] for k in rng.integers(0, len(pool), 300)) for _ in range(1500)]
    batch, (out, _) = _asked_group(texts, [True] * len(texts))
    tracemalloc.start()
    try:
        assert sum(len(b) for b in lm_score._ask(iter([batch]), 40, 2)) == 4
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 * len(out), peak / len(out)


def test_context_mixing_sends_turns_once():
    """Answers of pairs are counts where paths part; the margins made of them are those of counting every node."""
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["stem" + "".join(rng.choice(list("abc"), 3)) for _ in range(40)] + ["it", "is"], 60)) for _ in range(30)]
    train = [k % 4 != 1 for k in range(len(texts))]
    batch, (out, bounds) = _asked_group(texts, train)
    code = lm_score.Code.from_counts(np.bincount(out, minlength=256))
    asked = next(lm_score._ask(iter([batch]), 40, 1))
    own = pa.Table.from_batches([asked.filter(pc.equal(asked.column("part"), 1))])
    both = pa.concat_tables([own, own.set_column(1, "g", pa.array([1], pa.int64()))])  # two groups alike: all counts are doubled
    answered, made = lm_score._answer_turns(both, code), lm_score.units(out, bounds, 40)
    nbits = made.followed_bits(out, code)
    for row in answered.to_pylist():
        held = lm_score._held(pa.Table.from_pylist([row], answered.schema), np.empty(0, np.int8), nbits)
        spelt = [out[b : b + n].tobytes() for b, n in zip(made.begin[made.shown], made.sizes[made.shown], strict=True)]
        paths = [[int(s > 0) for b in w for s in code.signs[: code.length[b], b]] for w in spelt]
        counts = lm_score._opened(own.column("counts")[0].as_py(), np.uint32).astype(int) * 2
        nodes = defaultdict(int)
        for pair, word, count in zip(made.pairs.tolist(), made.words.tolist(), counts.tolist(), strict=True):
            for d in range(len(paths[word]) + 1):
                nodes[pair, tuple(paths[word][:d])] += count
        expected = [
            int(lm_score._margin(np.float64(nodes[pair, tuple(path[: d + 1])]), nodes[pair, tuple(path[:d])] - nodes[pair, tuple(path[: d + 1])]))
            for pair, path in zip(made.pairs.tolist(), (paths[w] for w in made.words.tolist()), strict=True) for d in range(len(path))]
        assert held.tolist() == expected
    turns, alike = lm_score._opened(answered.column("turns")[0].as_py(), np.uint32).reshape(2, -1)
    assert alike.sum() > 0 and len(lm_score._opened(answered.column("gaps")[0].as_py(), np.uint32)) == turns.sum() - alike.sum()
