import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrays
from corpusloom.functions.text import in_active_window, normalize_answer, short_count, significant, strip
from corpusloom.operators import batching, examples, select


def pair(spark, prompt, response):
    return spark.createDataFrame([(prompt, response)], "prompt_ids array<int>, response_ids array<int>")


def test_lm_example_worked(spark):
    row = examples.lm_example(pair(spark, [10, 11, 12], [20, 21, 2]), 8, 2, max_prompt_length=4).first()
    assert row.input_ids == [10, 11, 12, 20, 21, 2, 2, 2]
    assert row.attention_mask == [1, 1, 1, 1, 1, 0, 0, 0]
    assert row.position_ids == [0, 1, 2, 3, 4, 0, 0, 0]
    assert row.label == [-100, -100, 20, 21, 2, -100, -100, -100]
    assert row.loss_mask == [0, 0, 1, 1, 1, 0, 0, 0]
    assert (row.gen_ids, row.gen_mask) == ([2, 10, 11, 12], [0, 1, 1, 1])


@pytest.mark.parametrize("prompt,response,label", [
    (None, [5, 6, 7], [6, 7, -100, -100]),
    ([1, 2, 3, 4, 5], [6], [-100, -100, -100, -100]),
    ([1], [9], [9, -100, -100, -100]),
    ([1, 2], [3, 4, 5, 6], [-100, 3, 4, -100]),
])
def test_lm_example_edges(spark, prompt, response, label):
    assert examples.lm_example(pair(spark, prompt, response), 4, 0).first().label == label


def test_unshifted_labels(spark):
    row = examples.lm_example(pair(spark, [1, 2], [3]), 4, 0, label_shift=0).first()
    assert (row.input_ids, row.label) == ([1, 2, 3, 0], [-100, -100, 3, -100])


def test_truncation_sides(spark):
    row = spark.createDataFrame([([1, 2, 3],)], "a array<int>").select(
        arrays.truncate_ids(F.col("a"), 2, "head").alias("h"), arrays.truncate_ids(F.col("a"), 2, "tail").alias("t"),
        arrays.truncate_ids(F.col("a"), 9, "tail").alias("w")).first()
    assert (row.h, row.t, row.w) == ([1, 2], [2, 3], [1, 2, 3])
    with pytest.raises(ValueError):
        arrays.truncate_ids(F.col("a"), 2, "middle")


def test_pad_to_group_max(spark):
    df = spark.createDataFrame([("a", [1], [1, 2, 3]), ("a", [1, 2], [4]), ("b", [], [9])], "g string, q array<int>, r array<int>")
    rows = {(r.g, tuple(r.q), tuple(r.r)) for r in examples.pad_to_group_max(df, "g", {"q": 0}, {"r": 7}).collect()}
    assert rows == {("a", (0, 1), (1, 2, 3)), ("a", (1, 2), (4, 7, 7)), ("b", (), (9,))}


def test_normalize_answer_matches_reference_rule(spark):
    import string

    texts = ["The  Cat, sat!", "a b c", "x\x1cy\x85z", "", " \t\n", "İstanbul ß", "don't-stop", "a​b", "«q» …"]
    rule = lambda s: " ".join("".join(c for c in s.lower() if c not in set(string.punctuation)).split())
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize_answer(F.col("t")).alias("n"), strip(F.col("t")).alias("s"))
    for row in df.collect():
        assert row.n == rule(row.t)
        assert row.s == row.t.strip()


@pytest.mark.parametrize("window,hour,minute,expected", [
    ("22:00-08:00", 23, 0, True), ("22:00-08:00", 8, 0, False), ("22:00-08:00", 7, 59, True), ("09:00-17:00", 9, 0, True),
    ("09:00-17:00", 17, 0, False), ("09:00-09:00", 3, 0, True), ("9-17", 3, 0, True), (None, 3, 0, True), (" 0:00-1:00 ", 0, 30, True),
])
def test_active_window(spark, window, hour, minute, expected):
    df = spark.createDataFrame([(f"2024-01-01 {hour:02}:{minute:02}:00", window)], "ts string, w string")
    assert df.select(in_active_window(F.col("ts").cast("timestamp"), F.col("w")).alias("x")).first().x is expected


def test_counts_beyond_a_trillion_stay_in_billions(spark):
    df = spark.createDataFrame([(10**12,), (1001280780500,), (9_007_199_255_335_000_001,), (-3 * 10**12,), (None,)], "n long")
    shown = [r.s for r in df.select(short_count(F.col("n")).alias("s")).collect()]
    assert shown == ["1000B", "1001.28B", "9007199255.34B", "-3000B", None]


def test_number_formats(spark):
    df = spark.createDataFrame([(0,), (999,), (200_000,), (10_000_000,), (1_500,), (2_000_000_000,)], "n long")
    assert [r.s for r in df.select(short_count(F.col("n")).alias("s")).collect()] == ["0", "999", "200K", "10M", "1.5K", "2B"]
    df = spark.createDataFrame([(0.0,), (123456.0,), (0.0012345,), (-7.777,)], "x double")
    assert [round(r.s, 9) for r in df.select(significant(F.col("x")).alias("s")).collect()] == [0.0, 123000.0, 0.00123, -7.78]


@pytest.mark.parametrize("rows,batch,epochs,total", [(59553, 16, 10, 37220), (59553, 32, 3, 5583), (59553, 128, 20, 9300)])
def test_published_step_counts(spark, rows, batch, epochs, total):
    df = spark.createDataFrame([(rows, batch, 1, 1, epochs)], "n long, b long, w long, g long, e long")
    assert batching.training_plan(df, "n", "b", "w", "g", epochs="e").first().planned_steps == total


def test_batches_cover_every_row_once(spark):
    df = spark.range(103).withColumnRenamed("id", "row")
    padded = batching.plan_batches(df, "row", world=4, batch=5, seed=1, drop_last=False).collect()
    assert len(padded) == 104 and {r.row for r in padded} == set(range(103))
    assert len({(r["rank"], r.batch, r.slot) for r in padded}) == 104
    other = batching.plan_batches(df, "row", world=4, batch=5, seed=1, epoch=1).collect()
    assert [(r.row) for r in sorted(other, key=lambda r: (r["rank"], r.batch, r.slot))] != sorted(r.row for r in other)
    few = batching.plan_batches(spark.range(2).withColumnRenamed("id", "row"), "row", world=5, batch=1, seed=1, drop_last=False).collect()
    assert len(few) == 5 and {r["rank"] for r in few} == set(range(5))


def test_replay_sample_too_large_fails(spark):
    df = spark.range(5).select(F.col("id").alias("row_id"), F.col("id").alias("arrival_seq"))
    assert {r.row_id for r in select.replay_sample(df, 3, 3, 1).collect()} == {2, 3, 4}
    with pytest.raises(Exception, match="larger than the buffer"):
        select.replay_sample(df, 3, 4, 1).collect()


def test_checkpoint_picks(spark):
    df = spark.createDataFrame(
        [("r", "5", 200_000_000, 1, True), ("r", "40", 200_000_000, 2, False), ("r", "300", 100_000_000, 3, True), ("r", "eval", 900_000_000, 9, True), ("q", "x", 1, 1, False)],
        "run string, step string, size_bytes long, mtime long, has_config boolean")
    assert [r.step for r in select.latest_checkpoint(df).collect()] == ["40"]
    assert [(r.run, r.step) for r in select.eligible_runs(df).collect()] == [("r", "300")]
