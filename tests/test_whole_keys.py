"""Rows of different users and conversations stay apart where their packed ids are equal."""

from corpusloom.plans import binding


def test_rollouts_of_two_users_with_one_packed_id(spark, tmp_path):
    rows = [(1, (1_000_005 << 10) + 1, "view", 1.0), (2, (5 << 10) + 1, "view", 2.0), (2, (5 << 10) + 2, "click", 3.0)]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = binding.rollouts(spark, str(tmp_path)).collect()
    assert len({r.rollout_id for r in found}) == 1
    assert sorted(len(r.response) for r in found) == [1, 2]


def test_a_long_conversation_is_met_block_by_block(spark, tmp_path, monkeypatch):
    """Every pair once, references in the order of turns, and no array of a whole conversation."""
    monkeypatch.setattr(binding, "BLOCK", 4)
    rows = [(1, t, "assistant", f"reply {t}") for t in range(0, 60, 2)] + [(2, 1, "assistant", "alone"), (3, 5, "assistant", "a"), (3, 7, "assistant", "b")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    pairs = binding.reply_pairs(spark, str(tmp_path))
    assert "collect_list" not in pairs._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in pairs.collect():
        assert found.setdefault((r.conv_id, r.turn), {}).setdefault(r.ref, r.reference) == r.reference
    texts = {c: [x[3] for x in sorted(rows) if x[0] == c] for c in (1, 2, 3)}
    expected = {(c, t): dict(enumerate(x for x in texts[c] if x != text)) for c, t, _, text in rows if c != 2}
    assert found == expected and pairs.count() == 30 * 29 + 2
    assert {(r.conv_id, r.turn): r.n for r in binding.counted_replies(spark, str(tmp_path)).collect()} == {(c, t): len(texts[c]) - 1 for c, t, _, _ in rows}
