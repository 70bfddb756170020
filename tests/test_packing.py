import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import packing, prepare, tokens

SCHEMA = "doc long, ids array<int>"


def sequential(docs, length, dev, train, cap):
    """Pack one document after another, checking the cap after each document or chunk."""
    buffer, out = [], []
    for _, ids in docs:
        buffer += ids
        while len(buffer) >= length:
            out.append(buffer[:length])
            buffer = buffer[length:]
        if cap == "document" and train >= 0 and len(out) - dev >= train:
            break
    if cap == "chunk" and train >= 0:
        out = out[: dev + train]
    return [("valid" if i < dev else "train", c) for i, c in enumerate(out)]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    return [(i * 3, [rng.randint(0, 999) for _ in range(rng.choice([0, 1, 7, 8, 9, 40, 400]))]) for i in range(300)]


@pytest.mark.parametrize("length", [1, 8, 64])
def test_matches_sequential(spark, docs, length):
    df = spark.createDataFrame(docs, SCHEMA).repartition(7)
    found = [(r.split, r.ids) for r in packing.pack(df, "doc", "ids", length, dev_num=5).orderBy("chunk").collect()]
    assert found == sequential(docs, length, 5, -1, "chunk")


@pytest.mark.parametrize("cap", ["chunk", "document"])
@pytest.mark.parametrize("train", [0, 3, 50, 10**6])
def test_caps(spark, docs, cap, train):
    df = spark.createDataFrame(docs, SCHEMA)
    found = [(r.split, r.ids) for r in packing.pack(df, "doc", "ids", 8, 4, train, cap).orderBy("chunk").collect()]
    assert found == sequential(docs, 8, 4, train, cap)


def test_index_and_document_index(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, []), (2, [4])], "seq_id long, ids array<int>")
    rows = packing.token_index(df, "ids", 2).orderBy("seq_id").collect()
    assert [(r.size, r.pointer) for r in rows] == [(3, 0), (0, 6), (1, 6)]
    assert sorted(r.doc_start for r in packing.document_index(df, "ids").collect()) == [0, 2]


def test_merge_rebases_and_checks_types(spark):
    a = spark.createDataFrame([(0, [1]), (1, [2])], "seq_id long, ids array<int>")
    b = spark.createDataFrame([(0, [3])], "seq_id long, ids array<int>")
    assert {(r.seq_id, r.ids[0]) for r in packing.merge_token_datasets(a, b).collect()} == {(0, 1), (1, 2), (2, 3)}
    with pytest.raises(ValueError):
        packing.merge_token_datasets(a, b.withColumn("ids", F.col("ids").cast("array<long>")))


def test_slice_ids(spark):
    df = spark.createDataFrame([([5, 6, 7, 8],)], "ids array<int>")
    row = df.select(packing.slice_ids(F.col("ids"), 1, 2).alias("a"), packing.slice_ids(F.col("ids"), 3).alias("b"),
                    packing.slice_ids(F.col("ids"), 9).alias("c")).first()
    assert (row.a, row.b, row.c) == ([6, 7], [8], [])


def test_encode_words_with_shared_and_null_keys(spark):
    texts = [(i % 7 or None, " ".join(["the"] * (i % 5) + [f"w{i % 7}", "the"])) for i in range(60)] + [(99, None), (100, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    vocab = tokens.build_vocab(df, "text", min_count=9)
    ids = {r.token: r.id for r in vocab.collect()}
    rows = tokens.encode_words(df, "id", "text", vocab, -1).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == (None if r.text is None else [ids.get(w, -1) for w in r.text.split()])


def test_pack_refuses_a_wrong_size(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], 2)], "id long, ids array<int>, n int")
    with pytest.raises(Exception, match="size is not the number of ids"):
        packing.pack(df, "id", "ids", 1, size=F.col("n")).collect()


def test_user_encoder_and_nulls(spark):
    class Lengths:
        eos_id = 0

        def encode_batch(self, texts):
            return texts.map(lambda t: [len(w) for w in t.split()])

    df = spark.createDataFrame([("a bb",), (None,), ("",)], "text string")
    assert [r.ids for r in df.select(tokens.encode(F.col("text"), Lengths()).alias("ids")).collect()] == [[1, 2], None, []]


def test_normalize_keeps_empty_last_output(spark):
    df = spark.createDataFrame(
        [("", "p", None, None, None, "", None, ""), (None, None, "q", "", "i", None, None, None), (None, "", None, "c", "i", "o", None, None)],
        "instruction string, prompt string, question string, context string, input string, response string, output string, answer string",
    )
    rows = prepare.normalize_instructions(df).collect()
    assert [(r.instruction, r.input, r.output) for r in rows] == [("p", "", "")]


def test_pair_round_trip_without_sentinel(spark):
    df = spark.createDataFrame([([1, 2, -1, 3],), ([7, 8],), ([-1, 4],)], "ids array<int>")
    got = [r.d for r in df.select(prepare.decode_pair(F.col("ids")).alias("d")).collect()]
    assert [(d.prompt_ids, d.response_ids) for d in got] == [([1, 2], [3]), (None, [7, 8]), ([], [4])]


def test_an_encoder_gets_bounded_slices(spark):
    import pyarrow as pa

    texts = pa.array([None, "a" * 700_000, "", "b" * 600_000, "é" * 900_000, None, "c", "d"])
    parts = list(tokens._slices(texts))
    assert len(parts) > 2 and sum(len(p) for p in parts) == len(texts)
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= tokens.SLICE_BYTES for p in parts)
    assert pa.concat_arrays(parts).equals(texts) and list(tokens._slices(texts.slice(0, 0))) == []
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts.to_pylist())], "i long, t string").coalesce(1)
    found = {r.i: r.n for r in df.select("i", F.size(tokens.encode(F.col("t"), tokens.ByteEncoder())).alias("n")).collect()}
    assert found == {i: (None if t is None else len(t.encode())) for i, t in enumerate(texts.to_pylist())}


@pytest.mark.parametrize("room", [1 << 18, 2, 0])
def test_common_words_do_not_meet_the_vocabulary(spark, monkeypatch, room):
    """Only words beyond the common ones are joined; ids are the same however many are common, for odd texts and vocabularies too."""
    monkeypatch.setattr(tokens, "COMMON_WORDS", room)
    asked = []
    monkeypatch.setattr(tokens, "_others", lambda words, held, f=tokens._others: asked.append(held) or f(words, held))
    long = "x" * 100
    listed = [("the", 0), ("a", 1), ("of", 2), (long, 3), ("of", 7), ("né", 4), ("no", None)]
    ids = {"the": 0, "a": 1, "of": 2, long: 3, "né": 4}
    texts = [None, "", "  ", "the a of", "the the the", f"of {long} new né no the", "the a of", "new new"]
    vocab = spark.createDataFrame(listed, "token string, id int")
    df = spark.createDataFrame([(k if k != 3 else None, t) for k, t in enumerate(texts)], "k int, t string").repartition(3)
    found = tokens.encode_words(df, "k", "t", vocab, unk_id=-1)
    expected = sorted((repr(t), None if t is None else [ids.get(w, -1) for w in t.split()]) for t in texts)
    assert sorted((repr(r.t), r.ids) for r in found.collect()) == expected
    assert len(asked[0].value[0]) == min(room, 4)
    left = df.where("t IS NOT NULL").select(F.explode(tokens._others(tokens.words(F.col("t")), asked[0])).alias("w"))
    common = set(asked[0].value[0].to_pylist())
    assert {r.w for r in left.collect()} == {w for t in texts if t for w in t.split()} - common
