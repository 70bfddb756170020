"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, kernels, langid, lm_score, mixing, near_dups, packing, quality, repeats, token_counts, topk
from corpusloom.llm.queries import tokenizer_path
from tests.llm.conftest import BASE, LONG, odd_rows, words
from tests.llm.test_llm_queries import cut_by_hand, packed_by_hand, tokens

TEXTS = [r[1] for r in odd_rows()]


def by_text(rows, column="text"):
    return sorted(rows, key=lambda r: (r[column] is None, r[column] or ""))


def test_scores(odd, none):
    rows = lm_score.score(odd, F.col("doc_id") > 0).collect()
    assert len(rows) == len(TEXTS)
    empty = [r for r in rows if r.n_tokens == 1]
    assert len(empty) == 4 and len({(r.score, r.base_score) for r in empty}) == 1
    assert lm_score.score(none, F.lit(True)).collect() == []
    untrained = lm_score.score(odd, F.lit(False)).collect()
    assert len(untrained) == len(TEXTS) and {r.n_known for r in untrained} == {0}


def test_scores_are_probabilities():
    """All texts of one byte and all of two bytes cannot have more than probability one together."""
    train = [b"a b a b ab", b"ba ab"]
    flat = np.frombuffer(b"".join(train), np.uint8)
    bounds = np.cumsum([0, *map(len, train)])
    out, ends = lm_score.canonical(flat, bounds)
    code = lm_score.Code.from_counts(np.bincount(out, minlength=256))
    buckets = [np.zeros(1 << lm_score.BUCKET_BITS, np.uint32) for _ in range(3)]
    lm_score.count_contexts(out, ends, buckets)
    chosen = [lm_score.choose(b) for b in buckets]
    counts = [np.zeros(2 * lm_score._SLOTS, np.uint32) for _ in range(3)]
    lm_score.count_bits(out, ends, code, chosen, counts)
    mixer = lm_score.Mixer(code, chosen, [lm_score.logits(c) for c in counts])
    letters = [bytes([b]) for b in range(33, 128) if not 65 <= b <= 90]
    texts = [b"", *letters, *[a + b for a in letters for b in letters], *[a + b" " + b for a in letters for b in letters]]
    out, ends = lm_score.canonical(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    bits = mixer.bits(out, ends)
    assert bits.min() > 0 and np.exp2(-bits).sum() <= 1.0001


def links_by_hand(rows, size=5, percent=75):
    sets = []
    for _, t in rows:
        w = tokens(t)[:-1]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for (i, _), x in zip(rows, sets, strict=True):
            for (j, _), y in zip(rows, sets, strict=True):
                if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                    low = min(root[i], root[j])
                    changed |= root[i] != low or root[j] != low
                    root[i] = root[j] = low
    return sorted(((i, len(s), root.get(i), root.get(i, i) == i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def test_near_duplicates(spark, odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    # A chain whose ends do not link directly, a repeated id with another text, and a crowd of near copies.
    chain = BASE.split()
    for step in range(1, 5):
        chain = [*chain[: step * 20], f"step{step}", *chain[step * 20 + 1 :]]
        rows.append((100 + step, " ".join(chain)))
    rows.append((8, BASE))
    for n in range(40):
        other = LONG.split()[:90]
        other[n * 2] = f"copy{n}"
        rows.append((200 + n, " ".join(other)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dups.near_duplicates(frame).collect()
    assert sorted((tuple(r) for r in found), key=str) == links_by_hand(rows)
    assert near_dups.near_duplicates(none).collect() == []
    kept = near_dups.deduplicate(odd)
    assert kept.columns == odd.columns
    want = {i for i, _, _, stays in links_by_hand([(r[0], r[1]) for r in odd_rows()]) if stays and i is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)


def test_token_counts(odd, none):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    rows = token_counts.count_tokens(odd, tokenizer_path(), batch_bytes=1000).collect()
    expected = [(len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False))) for t in TEXTS]
    assert Counter((r.n_bytes, r.n_tokens) for r in rows) == Counter(expected)
    assert token_counts.count_tokens(none, tokenizer_path()).collect() == []


@pytest.mark.parametrize("text", ["<|endoftext|> a<|startoftext|>b", "it's   CAFÉ́  x y", "a\x1cb\x85c", "́abc", "don't123 456!!", "ΑΣ ΣΑΣ"])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_odd_strings(text, name):
    counter = token_counts.Counter(tokenizer_path(name))
    if name.endswith(".model"):
        import sentencepiece

        want = len(sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name)).encode(text))
    else:
        from tokenizers import Tokenizer

        want = len(Tokenizer.from_file(tokenizer_path(name)).encode(text, add_special_tokens=False))
    assert counter.counts([text.encode()]) == [want]


def test_packing(spark, odd, none):
    rows = packing.pack(odd, capacity=500).collect()
    assert sum(r.length for r in rows) == sum(len(tokens(t)) - 1 for t in TEXTS)
    assert packing.pack(none).collect() == []
    spread = packing.pack(odd, capacity=500, shard_docs=4).collect()
    assert sum(r.length for r in spread) == sum(r.length for r in rows) and len({r.shard for r in spread}) > 1


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = 60
        items = sorted([(k, int(rng.integers(1, 100)), f"s{rng.integers(6)}" if rng.random() < 0.8 else None, int(rng.integers(30))) for k in range(n)], key=lambda x: -x[1])
        got = packing.best_fit([x[1] for x in items], [x[2] for x in items], [x[3] for x in items], 100)
        assert {x[0]: g for x, g in zip(items, got, strict=True)} == packed_by_hand(items, 100)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=12)], 0) for i in range(400)]
    rows += [(400, None, 0), (401, [], 0), (402, [None] * 12, 0), (403, [float("nan")] * 12, 0), (404, [float("inf")] * 12, 0), (None, rows[0][1], 0)]
    rows += [(500, rows[3][1], 0), (501, rows[3][1], 0), (100, rows[100][1], 0), (600, [1.0, 2.0], 0), (601, [2.0, 1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    vectors = [(i, np.floor(np.array(v) * 1024).astype(int)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all()]
    want = []
    for q, v in {i: v for i, v in vectors if i % 100 == 0}.items():
        best = sorted(((-int(v @ w), i) for i, w in vectors if i != q and len(w) == len(v)))[:7]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for stripe in (50, 1 << 16):
        got = topk.top_k(frame, F.col("vec_id") % 100 == 0, k=7, candidate_rows=stripe, query_rows=3)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(frame.where("vec_id < 0"), F.col("vec_id") % 100 == 0).collect() == []


def test_a_crowd_comes_out_by_text(spark):
    """A passage in many texts: a row for each text, not for each of its segments; gaps, joined ends and several passages are kept apart."""
    passages = [words(260, 1000 * i) for i in range(3)]
    texts = {k: " ".join([f"own{k}" * (k + 1), passages[0], "x" * (1 + k % 3), passages[1 + k % 2], f"tail{k}"]) for k in range(24)}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "u long, text string").repartition(5)
    spans = {}
    for r in repeats.repeated_spans(df, crowd=2).collect():
        spans.setdefault(r.u, []).append((r.a, r.b))
    assert all(len(x) <= 3 for x in spans.values())  # a segment each before: 20 and more of them
    raw = {k: t.encode() for k, t in texts.items()}
    starts = {}
    for k, t in raw.items():
        for i in range(len(t) - repeats.LENGTH + 1):
            starts.setdefault(t[i : i + repeats.LENGTH], []).append((k, i))
    covered = {k: set() for k in raw}
    for places in starts.values():
        for k, i in places if len(places) > 1 else ():
            covered[k].update(range(i, i + repeats.LENGTH))
    assert {k: set().union(*(range(a, b) for a, b in spans.get(k, ()))) for k in raw} == covered


@pytest.mark.parametrize("crowd", [1, 1000])
def test_repeats(odd, none, crowd):
    raw = dict(enumerate((t or "").encode() for t in TEXTS))
    gone = cut_by_hand(raw)
    want = Counter((raw[k], bytes(b for b, x in zip(raw[k], gone[k], strict=True) if not x)) for k in raw)
    got = repeats.remove_repeats(odd, crowd=crowd, outputs=("spans", "kept")).collect()
    assert Counter(((r.text or "").encode(), bytes(r.repeats.kept)) for r in got) == want
    assert "u" in repeats.remove_repeats(odd, crowd=crowd).columns
    assert repeats.remove_repeats(none).collect() == []
    assert repeats.cut_documents(odd).columns == odd.columns


def test_cut_text_keeps_characters_whole(spark):
    tail = "x" * 450
    rows = [(1, "aé" + tail), (2, "bè" + tail)]  # the second byte of é and è differ, so cuts begin behind them
    rows += [(3, "ü" * 300 + "a"), (4, "ü" * 300 + "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.repeats.text for r in repeats.remove_repeats(frame).collect()}
    assert got == {1: "aé", 2: "bè", 3: "a", 4: "b"}


def test_run_length_index_against_all_pairs():
    rng = np.random.default_rng(8)
    for _ in range(30):
        rows = int(rng.integers(1, 12))
        offs = rng.integers(0, 6, rows)
        segs = [bytes(rng.integers(97, 99, int(rng.integers(6, 20))).astype(np.uint8)) for _ in range(rows)]
        at = {}
        for r in range(rows):
            for i in range(len(segs[r]) - 3):
                at.setdefault((i - offs[r], segs[r][i : i + 4]), []).append((r, i))
        want = {x for v in at.values() if len(v) > 1 for x in v}
        which, a, b = repeats.repeated_windows(segs, offs, 4)
        assert {(r, i) for r, x, y in zip(which, a, b, strict=True) for i in range(x, y + 1)} == want


def test_mixing(odd, none):
    rows = mixing.mix(odd, block_words=8, shard_docs=3).collect()
    again = mixing.mix(odd, block_words=8, shard_docs=3).collect()
    plain = lambda rs: sorted(str(tuple(r)) for r in rs)
    assert plain(rows) == plain(again) and len(rows) == len(TEXTS)
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.rounds * r.size + sum(p.b - p.a for p in r.parts) for r in rows)
    assert mixing.mix(none).collect() == []
    out = mixing.mixed_documents(odd, block_words=8, shard_docs=3)
    assert out.columns == odd.columns
    assert sum(len(tokens(r.text)) - 1 for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.mixed_documents(none).collect() == []


def seats_by_hand(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        if votes[best]:
            won[best] += 1
    return won


def test_sainte_lague_gives_the_highest_quotients(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for g in range(40):
        votes = [int(v) for v in rng.integers(0, 1000, int(rng.integers(1, 9)))]
        seats = int(rng.integers(0, 60))
        rows += [(g, i, v, seats) for i, v in enumerate(votes)]
        want += [(g, i, n) for i, n in enumerate(seats_by_hand(votes, seats))]
    got = mixing.sainte_lague(spark.createDataFrame(rows, "g int, i int, votes long, seats long"), ["g"], "votes", "seats", "i")
    assert sorted(tuple(r) for r in got.select("g", "i", "won").collect()) == want


def test_quality(odd, none):
    rows = quality.assess(odd).collect()
    assert len(rows) == len(TEXTS) and all(len(r) == len(odd.columns) for r in rows)
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        q = r.quality
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert (q.n_words, q.word_chars, q.n_repeat_words) == (len(w), sum(map(len, w)), len(inside))
        assert q.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
    assert quality.assess(none).collect() == []
    assert quality.clean(odd).columns == odd.columns
    kept = {r.doc_id for r in quality.clean(odd).collect()}
    assert {1, 2, 3, 12} <= kept and not kept & {4, 5, 6, 7, 8, 13, 14}  # 7 repeats itself


def test_languages(odd, none):
    rows = langid.identify(odd, F.lit(True), rounds=3).collect()
    assert len(rows) == len(TEXTS)
    assert Counter(r.lang_pred for r in rows) == Counter("en" if t and re.search(r"[^\W\d_]", t) else "und" for t in TEXTS)
    assert langid.identify(none, F.lit(True)).collect() == []
    assert {r.lang_pred for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}


def test_backpropagation_against_differences():
    rng = np.random.default_rng(2)
    net = langid.Network.fresh(["a", "b", "c"], 3)
    for name in ("tables", "loops", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    codes, held = rng.integers(97, 100, (7, 5)).astype(np.uint8), np.ones((7, 5), np.float32)
    held[5:, 0] = 0
    labels = np.array([0, 1, 2, 0, 1])
    _, grads = net.gradients(codes, held, labels)
    for param, grad in zip([net.tables, net.loops, net.out, net.bias], grads, strict=True):
        spots = [tuple(rng.integers(0, s) for s in param.shape) for _ in range(6)]
        spots += [(0, 1, 98), (1, 2, 99)] if param is net.tables else []
        for spot in spots:
            kept = param[spot]
            param[spot] = kept + 1e-2
            up = net.gradients(codes, held, labels)[0]
            param[spot] = kept - 1e-2
            down = net.gradients(codes, held, labels)[0]
            param[spot] = kept
            assert math.isclose((up - down) / 2e-2, grad[spot], rel_tol=0.05, abs_tol=2e-3)


def test_chat(spark):
    rows = [
        (1, 0, "system", "Rules.", 9), (1, 1, "ann", "Hi", 9), (1, 2, "bob b", None, 9), (1, 3, None, "who?", 9), (1, 3, None, "who?", 9), (1, None, "ann", "first", 9),
        (None, 1, "ann", "alone", 9), (2, 0, "system", "nobody", 9), (3, 0, "ann", "x" * 900, 9), (3, 1, "bob b", "y" * 900, 9),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    got = chat.rotate(frame, part_chars=500).collect()
    whole = {}
    for r in sorted(got, key=lambda r: (str(r.conv_id), r.perspective, r.part)):
        text, _ = whole.get((r.conv_id, r.perspective), ("", []))
        own = [r.text[a:b] for a, b in zip(r.mask_from, r.mask_to, strict=True)]
        whole[r.conv_id, r.perspective] = (text + r.text, whole.get((r.conv_id, r.perspective), ("", []))[1] + own)
    want = {}
    for conv in (1, None, 3):
        turns = sorted([(t is not None, t or 0, s or "unknown", x or "") for c, t, s, x, _ in rows if c == conv])
        for me in {s for _, _, s, _ in turns} - {"system"}:
            shown, own = "", []
            for _, _, s, x in turns:
                role = "assistant" if s == me else "system" if s == "system" else "user name=" + s.replace(" ", "_")
                shown += f"<|im_start|>{role}\n{x}<|im_end|>\n"
                own += [f"{x}<|im_end|>"] if s == me else []
            want[conv, me] = (shown, own)
    assert whole == want
    assert chat.rotate(frame.where("conv_id = 99")).collect() == []


def test_kernels_hash_words_whatever_the_pieces(monkeypatch):
    import pyarrow as pa

    texts = ["Ab cd", "", "  ", "ab", "é" * 50, "a" * 9000 + " b", "x\ty\nz"]
    data, offsets = kernels.text_bytes(pa.array(texts))
    whole, bounds = kernels.word_hashes(data, offsets)
    monkeypatch.setattr(kernels, "PIECE", 7)
    pieces, same = kernels.word_hashes(data, offsets)
    assert (whole == pieces).all() and (bounds == same).all()
    assert np.diff(bounds).tolist() == [2, 0, 0, 1, 1, 2, 3]
    assert len(set(whole.tolist())) == 8  # "ab" occurs twice


def test_repeats_with_names_of_its_own(odd):
    clash = odd.withColumns({c: F.lit(k) for k, c in enumerate(("_u", "_of", "__u"))})
    assert repeats.cut_documents(clash).columns == clash.columns
    assert repeats.remove_repeats(clash).select("_u", "_of", "__u").distinct().collect() == [(0, 1, 2)]


def test_shorter_strings_are_cut(spark):
    """A passage of 55 words is cut in every text, by the length in bytes of 50 words."""
    passage = words(55, 300)
    df = spark.createDataFrame([(k, f"{words(30, 1000 + 40 * k)} {passage} {words(30, 3000 + 40 * k)}") for k in range(20)], "doc_id long, text string")
    for r in repeats.cut_documents(df, length=250).collect():
        assert len(r.text) <= 2 + len(words(30, 1000 + 40 * r.doc_id) + words(30, 3000 + 40 * r.doc_id)) + 20
