"""Nothing is left out where the input is large or has many groups."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.llm import langid, lm_score
from tests.llm.conftest import words


def test_every_context_is_learned(spark):
    """Scores are those of exact counters for every context of the training texts, also of contexts seen once."""
    texts = [words(60, k * 37) + f" only{k} here" for k in range(24)] + ["", None, "Zebra quagga \u00e9t\u00e9"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm_score.score(docs, F.col("doc_id") % 4 != 1).collect()}
    read = [[10] * 4 + [b for w in (t or "").lower().encode().split() for b in (*w, 32)] + [10] for t in texts]

    def seen(t, i):
        start = [j for j in range(4, i + 1) if j == 4 or t[j - 1] in (10, 32)]
        return bytes(t[i - 4 : i]), bytes(t[start[-1] : i]), bytes(t[([2, 3] + start)[-3] : i])

    made = [[(t[i], [(k, c) for k, c in enumerate(seen(t, i))]) for i in range(4, len(t))] for t in read]
    code = lm_score.Code.from_counts(np.bincount([b for k, t in enumerate(made) if k % 4 != 1 for b, _ in t], minlength=256))
    counts = {}
    for b, found in (x for k, t in enumerate(made) if k % 4 != 1 for x in t):
        for c in found:
            for d in range(code.length[b]):
                counts.setdefault((c, code.nodes[d, b]), [0, 0])[int(code.signs[d, b] > 0)] += 1
    assert min(sum(v) for v in counts.values()) == 1
    for k, t in enumerate(made):
        held = lm_score.logits(np.array([counts.get((c, code.nodes[d, b]), [0, 0]) for j in range(3) for b, found in t for c in found[j : j + 1] for d in range(code.length[b])]))
        lengths = np.array([code.length[b] for _ in range(3) for b, _ in t])
        firsts = np.zeros((3, len(t) + 4), np.int32)
        firsts[:, 4:] = (np.cumsum(lengths) - lengths).reshape(3, -1)
        bits = lm_score.PathMixer(code).path_bits(np.array(read[k], np.uint8), np.array([0, len(t) + 4]), list(firsts), held)[0]
        assert np.isclose(got[k], -bits * np.log10(2), rtol=1e-5), k


def test_counters_beyond_sixteen_bits(monkeypatch):
    """Large counters are summed unclipped; buckets that tie at the top are kept, not dropped."""
    code = lm_score.Code.from_counts(np.bincount(np.frombuffer(b"aaaabbc", np.uint8), minlength=256))
    keys = np.array([5 << 8 | 97, 5 << 8 | 98], np.uint64)
    asked = pa.table({
        "part": [0, 0], "g": [1, 2], "contexts": [lm_score._pressed(np.diff(keys >> np.uint64(8), prepend=np.uint64(0)))] * 2,
        "symbols": [lm_score._pressed(keys.astype(np.uint8))] * 2, "counts": [lm_score._pressed(np.array(c, np.uint32)) for c in ([9_000_000, 65_535], [1, 65_537])],
    })
    nodes, held = lm_score.node_counts(keys, np.array([9_000_001, 131_072]), code)
    expected = lm_score.path_logits(keys, nodes, lm_score.logits(held), code)[0].tolist()
    assert held.max() == 9_131_073 and sorted(held[held[:, 0].astype(bool) & held[:, 1].astype(bool)][0].tolist()) == [131_072, 9_000_001]
    for packed in lm_score._answer(asked, code).column("held").to_pylist():
        assert lm_score._opened(packed, np.int8).tolist() == expected
    monkeypatch.setattr(lm_score, "CONTEXTS", 4)
    assert lm_score.choose(np.array([7, 7, 7, 1, 7, 7])).tolist() == [True, True, True, False, True, True]


def test_every_language_is_learned(spark):
    """Seventy languages with scripts of their own, the last ones rarer than the first 64."""
    letters = [chr(0x4E00 + 97 * k) + chr(0x4E01 + 97 * k) for k in range(70)]
    texts = [(k, (x[0] + x[1] + x[0]) * 12, f"l{k:02}") for k, x in enumerate(letters)]
    docs = spark.createDataFrame([(100 * k + i, t, lang) for k, t, lang in texts for i in range(2 if k >= 64 else 4)], "doc_id long, text string, lang string")
    _, labels = langid.training_sample(docs, "doc_id", "text", "lang")
    assert set(labels) == {lang for _, _, lang in texts}
    found = {(r.doc_id // 100, r.lang_pred) for r in langid.identify(docs, F.lit(True)).collect()}
    assert sum((k, f"l{k:02}") in found for k in range(64, 70)) >= 5


def test_languages_take_turns():
    """More languages than a batch has windows: each still gets its share of rounds."""
    rng = np.random.default_rng(1)
    names = [f"l{k}" for k in range(6)]
    windows = [bytes(rng.choice([65 + 3 * k, 66 + 3 * k], langid.STEPS).astype(np.uint8)) for k in range(6) for _ in range(8)]
    net = langid.fit(windows, [n for n in names for _ in range(8)], batch=4, rounds=200)
    flat = np.frombuffer(b"".join(windows), np.uint8)
    p = langid.document_probabilities(net, flat, np.arange(len(windows) + 1) * langid.STEPS)
    assert [net.langs[i] for i in p.argmax(axis=1)] == [n for n in names for _ in range(8)]


def test_followers_of_pairs_by_hand():
    """Margins behind pairs of words, and words behind their stems, are those of counting every bit of every word."""
    texts = ["a ab abc abcd abcde abcdef abcdeg", "a ab abcdeg abcdef a ab abcdeg", "", "zz été abcdx a ab abcdex", "a ab abcd " * 9, "abcdefgh" * 40]
    flat = "".join(texts).encode()
    sizes = np.array([len(t.encode()) for t in texts])
    train = [True, True, True, False, True, False]
    batch = pa.record_batch({
        "g": [0], "texts": pa.array([lm_score.zstandard.ZstdCompressor().compress(flat)], pa.binary()),
        "sizes": pa.array([lm_score._pressed(sizes.astype(np.int64))], pa.binary()), "train": [train]})
    out, bounds = lm_score.canonical(np.frombuffer(flat, np.uint8), np.concatenate([[0], np.cumsum(sizes)]))
    code = lm_score.Code.from_counts(np.bincount(out, minlength=256))
    parts, held = 3, []
    for row in next(lm_score._ask(iter([batch]), 40, parts)).to_pylist():
        own = pa.Table.from_pylist([row], pa.schema([("part", pa.int32()), ("g", pa.int64()), *((c, pa.binary()) for c in ("contexts", "symbols", "counts", "words"))]))
        answered = (lm_score._answer if row["part"] < parts else lm_score._answer_pairs)(own, code)
        held.append(lm_score._opened(answered.column("held")[0].as_py(), np.int8))
    firsts, signs, total = lm_score._firsts(out, lm_score.units(out, bounds, 40), code)
    held = np.concatenate(held)
    held[:total] *= signs
    read = [out[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def seen(t, i):
        start = [j for j in range(4, i + 1) if j == 4 or t[j - 1] in (10, 32)]
        return bytes(t[i - 4 : i]), bytes(t[start[-1] : i]), bytes(t[([2, 3] + start)[-3] : i])

    counts = {}
    for t in (t for t, use in zip(read, train, strict=True) if use):
        for i in range(4, len(t)):
            for k, c in enumerate(seen(t, i)):
                for d in range(code.length[t[i]]):
                    counts.setdefault((k, c, code.nodes[d, t[i]]), [0, 0])[int(code.signs[d, t[i]] > 0)] += 1
    for t, a in zip(read, bounds[:-1].tolist(), strict=True):
        for i in range(4, len(t)):
            for k, c in enumerate(seen(t, i)):
                b, at = t[i], firsts[k][a + i]
                pairs = np.array([counts.get((k, c, code.nodes[d, b]), [0, 0]) for d in range(code.length[b])])
                expected = lm_score.logits(pairs) * code.signs[: code.length[b], b]
                assert held[at : at + len(expected)].tolist() == expected.tolist(), (bytes(t), i, k)
