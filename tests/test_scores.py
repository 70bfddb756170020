import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import logits as lg
from corpusloom.functions.rouge import lcs_length, porter_stem, rouge_f
from corpusloom.operators import distance, metrics, rollouts

# Word/stem pairs given with the published algorithm.
STEMS = dict(
    caresses="caress", ponies="poni", cats="cat", feed="feed", agreed="agre", plastered="plaster", bled="bled", motoring="motor",
    sing="sing", conflated="conflat", troubled="troubl", sized="size", hopping="hop", tanned="tan", falling="fall", hissing="hiss",
    fizzed="fizz", failing="fail", filing="file", happy="happi", sky="sky", relational="relat", conditional="condit", rational="ration",
    digitizer="digit", operator="oper", feudalism="feudal", decisiveness="decis", hopefulness="hope", formaliti="formal",
    triplicate="triplic", formative="form", electrical="electr", goodness="good", revival="reviv", allowance="allow",
    adjustable="adjust", replacement="replac", adoption="adopt", activate="activ", effective="effect", probate="probat", rate="rate",
    cease="ceas", controll="control", roll="roll", dies="die", dying="die", analogy="analog", enjoy="enjoy",
)


def test_stems():
    assert {w: porter_stem(w) for w in STEMS} == STEMS


def test_lcs_against_table():
    rng = random.Random(11)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        assert lcs_length(a, b) == row[-1]


def test_rouge_hand_cases():
    assert rouge_f("the cat sat", "the cat sat") == 1.0
    assert rouge_f("", "x") == rouge_f("日本", "日本") == 0.0
    assert rouge_f("a b c d", "a c x") == pytest.approx(2 * (2 / 4) * (2 / 3) / (2 / 4 + 2 / 3))
    assert rouge_f("running its", "run it", True) == pytest.approx(0.5)  # short words keep their ending
    assert rouge_f("running quickly", "runs quick", True) < rouge_f("running", "running", False)


def test_scoring_report(spark):
    rows = [(1, "A cat!", ["a cat", "dog"], "x"), (2, "no", ["yes"], "x"), (3, "alone", [], "y"), (4, "b", ["B"], "y")]
    df = spark.createDataFrame(rows, "idx long, text string, references array<string>, grp string")
    best = metrics.max_over_references(df, keep=("grp",))
    total = metrics.score(best).first()
    assert (total.rows, total.exact_match, total.rougeL) == (3, pytest.approx(200 / 3), pytest.approx(200 / 3))
    tidy = {(r.grp, r.metric): r.value for r in metrics.score_by(best, "grp").collect()}
    assert tidy[("x", "exact_match")] == 50.0 and tidy[("y", "rougeL")] == 100.0
    names = {r.name for r in metrics.named_by_group(metrics.score_by(best, "grp"), "grp").collect()}
    assert names == {"exact_match_for_x", "exact_match_for_y", "rougeL_for_x", "rougeL_for_y"}
    assert metrics.score(best.where("idx < 0")).first().exact_match is None


def reference_divergences(s, t, mix=0.9, skew=0.1):
    """Vector form of the published definitions."""
    with np.errstate(all="ignore"):
        lq, lp = s - np.logaddexp.reduce(s), t - np.logaddexp.reduce(t)
        q, p = np.exp(lq), np.exp(lp)
        ok = np.isfinite(s) & np.isfinite(t)
        cut = lambda x, m=ok: np.where(m, x, 0).sum()
        fkl, rkl = -cut(p * lq, np.isfinite(s)), cut(q * (lq - lp))
        lm = np.log((1 - mix) * p + mix * q)
        return {
            "fkl": fkl, "rkl": rkl, "skl": (1 - mix) * fkl + mix * rkl,
            "jsd": mix * cut(q * (lq - lm)) + (1 - mix) * cut(p * (lp - lm)), "tvd": 0.5 * cut(abs(p - q)),
            "sfkl": -cut(p * np.log(skew * p + (1 - skew) * q)), "srkl": cut(q * (lq - np.log((1 - skew) * p + skew * q))),
        }


@pytest.fixture(scope="module")
def logit_rows():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 4, 12), rng.normal(0, 4, 12)) for i in range(20)]
    rows[3][1][2] = rows[4][2][5] = rows[5][1][0] = rows[5][2][0] = -np.inf
    rows[6] = (6, rows[6][1], rows[6][1].copy())
    rows[7] = (7, rows[7][1] + 800, rows[7][2] - 800)
    return rows


@pytest.mark.parametrize("compute", [lg.divergence_terms, lg.divergences_arrow])
def test_divergences(spark, logit_rows, compute):
    df = spark.createDataFrame([(i, s.tolist(), t.tolist()) for i, s, t in logit_rows], "i int, s array<double>, t array<double>")
    for row in df.select("i", compute(F.col("s"), F.col("t")).alias("d")).collect():
        want = reference_divergences(logit_rows[row.i][1], logit_rows[row.i][2])
        for name in lg.ALL:
            assert row.d[name] == pytest.approx(want[name], rel=1e-9, abs=1e-12), (row.i, name)


def test_equal_rows_have_no_distance(spark, logit_rows):
    s = logit_rows[6][1].tolist()
    d = spark.createDataFrame([(s, s)], "s array<double>, t array<double>").select(
        lg.divergence_terms(F.col("s"), F.col("t")).alias("d"), lg.entropy(F.col("s")).alias("h")).first()
    assert d.d.fkl == pytest.approx(d.h) and all(abs(d.d[n]) < 1e-12 for n in ("rkl", "jsd", "tvd", "srkl"))


def test_names():
    assert [lg.divergence_name(n) for n in ("adaptive-sfkl", "srkl-fkl", "kd", "fkl", "rkl", "jsd")] == ["sfkl", "srkl", "fkl", "fkl", "rkl", "jsd"]
    with pytest.raises(NotImplementedError):
        lg.divergence_name("lm")


def test_lm_loss_ignores_labels(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 0), (1, [0.0, 0.0], -100), (2, [5.0, 0.0], 0), (2, [5.0, 0.0], 1)], "example_id int, logits array<double>, label int")
    row = distance.lm_loss(df).first()
    a, b, c = np.log(2), np.log1p(np.exp(-5)), 5 + np.log1p(np.exp(-5))
    assert row.token_mean == pytest.approx((a + b + c) / 3) and row.row_mean == pytest.approx((a + (b + c) / 2) / 2)


def test_advantages(spark):
    rows = [(0, [1.0, -2.0, 0.5], [1, 1, 1]), (1, [3.0, 0.0, 0.0], [1, 0, 0]), (2, [0.0, 0.0, 0.0], [0, 0, 0])]
    df = spark.createDataFrame(rows, "i int, rewards array<double>, mask array<int>")
    raw = {}
    for i, r, m in rows:
        g, out = 0.0, []
        for t in reversed(range(3)):
            g = r[t] + 0.95 * g
            out.append(g / max(sum(m[t:]), 1))
        raw[i] = out[::-1]
    plain = {x.i: x.advantages for x in rollouts.advantages(df, whitened=False).collect()}
    assert all(plain[i] == pytest.approx(raw[i]) for i in raw)
    flat = np.array(list(raw.values()))
    white = (flat - flat.mean()) / np.sqrt(flat.var() + 1e-8)
    found = {x.i: x.advantages for x in rollouts.advantages(df).collect()}
    assert all(found[i] == pytest.approx(white[i].tolist()) for i in range(3))


def test_threshold_replay(spark):
    rng = random.Random(2)
    rows = [(run, i, rng.choice([0.0, 0.05, 0.3]) + i * rng.choice([0, 0.004])) for run in ("a", "b") for i in range(150)]
    df = spark.createDataFrame(rows, "run string, step long, loss double")
    found = {(r.run, r.step): (r.threshold, r.reference_loss) for r in rollouts.adaptive_threshold(df, "run", "step", "loss", 0.1, start=0.2).collect()}
    for run in ("a", "b"):
        threshold, prev = 0.2, None
        for _, step, loss in (r for r in rows if r[0] == run):
            if prev is None:
                prev = loss
            elif loss >= prev + 0.1:
                threshold, prev = min(threshold + 0.1, 1.0), loss
            assert found[(run, step)] == (pytest.approx(threshold), pytest.approx(prev))
    with pytest.raises(ValueError):
        rollouts.adaptive_threshold(df, "run", "step", "loss", -1.0)


@pytest.mark.parametrize("ga,interval", [(1, 3), (2, 3), (4, 1), (3, 2)])
def test_log_blocks_follow_the_loop(spark, ga, interval):
    n = 41
    df = spark.range(1, n + 1).select(F.col("id").alias("s"), F.col("id").cast("double").alias("v"))
    found = {r.global_step: (r.micro_steps, r.v) for r in rollouts.log_intervals(df, "s", ["v"], interval, ga).collect()}
    step = gstep = 1
    held, expected = [], {}
    while step <= n:
        held.append(float(step))
        if gstep % interval == 0 and step % ga == 0:
            expected[gstep] = (len(held), pytest.approx(sum(held) / (interval * ga)))
            held = []
        step += 1
        if step % ga == 0:
            gstep += 1
    assert found == expected


def test_divergences_of_mixed_vocabularies_and_nulls(spark):
    rows = [(0, [0.5, 1.0], [1.0, 0.2]), (1, [0.1, 0.2, 0.3], [0.3, 0.2, 0.1]), (2, None, [1.0]), (3, [1.0], [1.0, 2.0]), (4, [], []), (5, [0.4] * 1500, [0.1] * 1500)]
    df = spark.createDataFrame(rows, "i int, s array<double>, t array<double>").coalesce(1)
    found = {r.i: r.d for r in df.select("i", lg.divergences_arrow(F.col("s"), F.col("t")).alias("d")).collect()}
    for i in (0, 1, 5):
        want = reference_divergences(np.array(rows[i][1]), np.array(rows[i][2]))
        assert all(found[i][n] == pytest.approx(want[n], rel=1e-9, abs=1e-12) for n in lg.ALL)
    assert all(found[i] is None or all(found[i][n] is None for n in lg.ALL) for i in (2, 3, 4))


def test_nan_scores_never_win_and_never_move_the_threshold(spark):
    from corpusloom.operators import rollouts, select

    nan = float("nan")
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, nan), (1, 2, 1.5), (1, 3, 2.0), (2, 0, nan), (2, 1, 5.0)], "run long, step long, loss double")
    best = {r.run: r.step for r in select.best_checkpoint(df, "loss").collect()}
    assert best == {1: 3, 2: 1}
    found = {(r.run, r.step): r.threshold for r in rollouts.adaptive_threshold(df, "run", "step", "loss", 0.1).collect()}
    assert [found[1, s] for s in range(4)] == pytest.approx([0.0, 0.0, 0.1, 0.2]) and found[2, 1] == 0.0


@pytest.mark.parametrize("n", [2_000, 32_000])
def test_folds_over_long_sequences(spark, n):
    from corpusloom.functions import arrays, rewards

    mask = [int(x) for x in np.arange(n) % 3 != 0]
    values = np.sin(np.arange(n)).tolist()
    df = spark.createDataFrame([(mask, values), (None, None), ([], []), ([1], [2.0])], "m array<int>, r array<double>")
    rows = df.select(arrays.position_ids(F.col("m")).alias("p"), arrays.remaining_length(F.col("m")).alias("left"), rewards.suffix_returns(F.col("r"), 0.5).alias("g")).collect()
    counted = np.cumsum(mask)
    assert rows[0].p == [(int(c) - 1) * m for c, m in zip(counted, mask, strict=True)]
    assert rows[0].left == [int(x) for x in np.cumsum(mask[::-1])[::-1]]
    g, want = 0.0, []
    for r in reversed(values):
        g = g * 0.5 + r
        want.append(g)
    assert rows[0].g == pytest.approx(want[::-1])
    assert tuple(rows[1]) == (None, None, None) and tuple(rows[2]) == ([], [], []) and (rows[3].p, rows[3].g) == ([0], [2.0])


def _peers_by_hand(rows, stem):
    best = {}
    for g, m, t in rows:
        for h, other, r in rows:
            if g is None or m is None or other is None or g != h or m == other:
                continue
            old = best.setdefault((g, m), (None, None))
            if t is None or r is None:
                continue
            normal = lambda x: " ".join("".join(c for c in x.lower() if c not in string.punctuation).split())
            new = (float(normal(t) == normal(r)), rouge_f(t, r, stem))
            best[g, m] = new if old[0] is None else (max(old[0], new[0]), max(old[1], new[1]))
    return best


@pytest.mark.parametrize(("texts", "stem"), [(512, False), (3, True), (1, False)])
def test_best_over_peers_equals_all_pairs(spark, monkeypatch, texts, stem):
    monkeypatch.setattr(metrics, "PEER_TEXTS", texts)
    rng = random.Random(5)
    words = ["run", "runs", "Running", "cat!", "cats", "the", "of", "late"]
    rows = [(rng.randint(1, 3), m, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for m in range(60)]
    rows += [(1, 100 + m, "the same reply") for m in range(20)]  # a stock reply
    rows += [(2, 200, None), (2, 201, ""), (2, 202, "?!"), (2, 203, None), (4, 1, "alone"), (None, 1, "x"), (None, 2, "x"), (5, None, "x")]
    rows += [(6, 1, "two texts of one"), (6, 1, "two texts of one member"), (6, 2, "of one member"), (7, 1, "a"), (7, 1, "a"), (8, 1, None), (8, 2, "b")]
    found = metrics.max_over_peers(spark.createDataFrame(rows, "g int, m int, t string"), "g", "m", "t", stem).collect()
    wanted = _peers_by_hand(rows, stem)
    assert len(found) == len(wanted)
    assert {(r.g, r.m): (r.exact_match, r.rougeL and round(r.rougeL, 9)) for r in found} == {
        k: (em, f and round(f, 9)) for k, (em, f) in wanted.items()}


def test_stock_replies_are_scored_once(spark):
    rows = [(1, m, f"thank you for call number {m % 4} and good bye") for m in range(400)] + [(1, 1000, "thank you all")]
    found = metrics.max_over_peers(spark.createDataFrame(rows, "g int, m int, t string"), "g", "m", "t").collect()
    assert len(found) == 401 and sum(r.pairs for r in found) <= 4  # all pairs would be 160,400
    assert not metrics.max_over_peers(spark.createDataFrame([], "g int, m int, t string"), "g", "m", "t").collect()
