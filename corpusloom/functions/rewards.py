"""Per-token reward arrays of rollouts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

GAMMA = 0.95
CLIP_RATIO = 0.2
CLIP_REWARD = 1.0


def rev_kl(teacher: Column, student: Column, mask: Column) -> Column:
    """``exp(d) - 1 - d`` per token, ``d`` the masked log-probability difference."""
    d = F.zip_with(F.zip_with(teacher, student, lambda p, q: p - q), mask, lambda x, m: x * m)
    return F.transform(d, lambda x: F.exp(x) - 1 - x)


def shape_rewards(
    teacher: Column, logprobs: Column, scale: float | None = None, clip: float | None = CLIP_REWARD
) -> Column:
    """Teacher reward plus entropy reward (minus the log-probability), scaled and clipped."""

    def one(t: Column, lp: Column) -> Column:
        r = t - lp
        if scale is not None:
            r = r / scale
        return F.least(F.greatest(r, F.lit(-clip)), F.lit(clip)) if clip else r

    return F.zip_with(teacher, logprobs, one)


def importance_weight(logprobs: Column, rollout: Column, teacher: Column, alpha: float | None) -> Column:
    """Weight of the current policy against the ``alpha``-mixture that generated the rollout."""
    if alpha is None:
        return F.transform(logprobs, lambda _: F.lit(1.0))
    mixed = F.zip_with(rollout, teacher, lambda r, t: F.ln((1 - alpha) * F.exp(r) + alpha * F.exp(t)))
    return F.zip_with(logprobs, mixed, lambda lp, m: F.exp(lp - m))


def discounted_return(rewards: Column, gamma: float = GAMMA, length: Column | None = None) -> Column:
    """Return from the first token, divided by ``length`` when given."""
    value = F.aggregate(F.reverse(rewards), F.lit(0.0), lambda g, r: g * gamma + r)
    return value if length is None else F.try_divide(value, length.cast("double"))


def suffix_returns(rewards: Column, gamma: float = GAMMA) -> Column:
    """Discounted return from every token to the end, linear in the tokens.

    The rows of a batch go backwards together, so a step is one array operation over the rows still that long.
    """

    @F.arrow_udf("array<double>")
    def run(rows: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        out = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        by_size = np.argsort(-sizes, kind="stable")
        last, lengths = ends[by_size] - 1, sizes[by_size]
        for back in range(1, int(sizes.max(initial=0))):
            at = last[: np.searchsorted(-lengths, -back, "left")] - back
            out[at] += gamma * out[at + 1]
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(out), mask=rows.is_null())

    return run(rewards)


def clipped_objective(adv: Column, ratio: Column, clip: float = CLIP_RATIO) -> Column:
    """Pessimistic of the plain and the clipped policy loss for one token."""
    bounded = F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip))
    return F.greatest(-adv * ratio, -adv * bounded)
