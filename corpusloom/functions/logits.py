"""Softmax algebra over logit arrays: divergences, entropies, likelihoods.

Column forms use higher-order functions. Divergences are computed with NumPy over Arrow batches
(``divergences_arrow``) at any vocabulary; ``divergence_terms`` is the same as one expression.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.arrays import IGNORE, let, total

MIX = 0.9  # default weight of the symmetric and Jensen-Shannon forms
SKEW = 0.1  # default weight of the skewed forms
# Divergence names in the order they are looked for inside a run type.
NAMES = ("sfkl", "srkl", "jsd", "tvd", "fkl", "rkl")
ALL = ("fkl", "rkl", "skl", "jsd", "tvd", "sfkl", "srkl")


def _infinite(x: Column) -> Column:
    return F.abs(x) == F.lit(float("inf"))


def log_sum_exp(logits: Column) -> Column:
    """Stable log-sum-exp; the maximum is bound once."""
    return let(
        F.array_max(logits),
        lambda m: m + F.ln(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - m))),
    )


def log_softmax(logits: Column) -> Column:
    return let(log_sum_exp(logits), lambda z: F.transform(logits, lambda x: x - z))


def token_logprob(logits: Column, token: Column) -> Column:
    """Log-probability of one token id; null outside the vocabulary."""
    return F.get(logits, token) - log_sum_exp(logits)


def gather_token(values: Column, token: Column) -> Column:
    """Value of the realised token; null outside the vocabulary."""
    return F.get(values, token)


def centred_reward(logits: Column, token: Column) -> Column:
    """Mean-centred chosen logit minus log-sum-exp of the centred logits.

    Centring cancels, so this is the token's log-probability; kept in its own form because
    the two agree only up to rounding.
    """
    mean = total(logits) / F.size(logits)
    centred = lambda m: F.transform(logits, lambda x: x - m)
    return let(mean, lambda m: let(centred(m), lambda c: F.get(c, token) - log_sum_exp(c)))


def divergence_terms(student: Column, teacher: Column, mix: float = MIX, skew: float = SKEW) -> Column:
    """Per-position divergences as a struct, one field per name in ``ALL``.

    The two normalisers are bound once; a single pass over the zipped logits adds up all
    the sums. Entries with an infinite logit contribute nothing.
    """

    def body(z: Column) -> Column:
        def term(a: Column, b: Column) -> Column:
            lq, lp = a - z["s"], b - z["t"]
            q, p = F.exp(lq), F.exp(lp)
            live = ~(_infinite(a) | _infinite(b))
            keep = lambda x: F.when(live, x).otherwise(F.lit(0.0))
            lm = F.ln((1 - mix) * p + mix * q)
            return F.struct(
                F.when(~_infinite(a), -(p * lq)).otherwise(F.lit(0.0)).alias("fkl"),
                keep(q * (lq - lp)).alias("rkl"),
                keep(mix * q * (lq - lm) + (1 - mix) * p * (lp - lm)).alias("jsd"),
                keep(0.5 * F.abs(p - q)).alias("tvd"),
                keep(-(p * F.ln(skew * p + (1 - skew) * q))).alias("sfkl"),
                keep(q * (lq - F.ln((1 - skew) * p + skew * q))).alias("srkl"),
            )

        fields = ("fkl", "rkl", "jsd", "tvd", "sfkl", "srkl")
        zero = F.struct(*[F.lit(0.0).alias(f) for f in fields])
        sums = F.aggregate(
            F.zip_with(student, teacher, term),
            zero,
            lambda acc, t: F.struct(*[(acc[f] + t[f]).alias(f) for f in fields]),
        )
        symmetric = lambda d: F.struct(
            d["fkl"].alias("fkl"),
            d["rkl"].alias("rkl"),
            ((1 - mix) * d["fkl"] + mix * d["rkl"]).alias("skl"),
            *[d[f].alias(f) for f in fields[2:]],
        )
        return let(sums, symmetric)

    return let(F.struct(log_sum_exp(student).alias("s"), log_sum_exp(teacher).alias("t")), body)


def divergences_arrow(student: Column, teacher: Column, mix: float = MIX, skew: float = SKEW) -> Column:
    """Same struct as ``divergence_terms`` by NumPy, vocabulary by vocabulary.

    Rows with a null on either side, no logits or unequal lengths have null fields; a null inside makes them null, too.
    """

    @F.pandas_udf(", ".join(f"{n} double" for n in ALL))
    def run(s: pd.Series, t: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({n: np.full(len(s), np.nan) for n in ALL})
        size = lambda x: -1 if x is None else len(x)
        left, right = (np.array([size(x) for x in side], dtype=np.int64) for side in (s, t))
        for n in np.unique(left[(left == right) & (left > 0)]):
            rows = np.flatnonzero((left == n) & (right == n))
            out.iloc[rows] = of_size(s.iloc[rows], t.iloc[rows]).to_numpy()
        return out

    def of_size(s: pd.Series, t: pd.Series) -> pd.DataFrame:
        a, b = np.stack(s.to_numpy()).astype(np.float64), np.stack(t.to_numpy()).astype(np.float64)
        with np.errstate(all="ignore"):
            norm = lambda x: x - (x.max(1, keepdims=True) + np.log(np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True)))
            lq, lp = norm(a), norm(b)
            q, p = np.exp(lq), np.exp(lp)
            dead = np.isinf(a) | np.isinf(b)
            summed = lambda x, off: np.where(off, 0.0, x).sum(1)
            lm = np.log((1 - mix) * p + mix * q)
            fkl = summed(-p * lq, np.isinf(a))
            rkl = summed(q * (lq - lp), dead)
            return pd.DataFrame(
                {
                    "fkl": fkl,
                    "rkl": rkl,
                    "skl": (1 - mix) * fkl + mix * rkl,
                    "jsd": summed(mix * q * (lq - lm) + (1 - mix) * p * (lp - lm), dead),
                    "tvd": summed(0.5 * np.abs(p - q), dead),
                    "sfkl": summed(-p * np.log(skew * p + (1 - skew) * q), dead),
                    "srkl": summed(q * (lq - np.log((1 - skew) * p + skew * q)), dead),
                }
            )

    return run(student, teacher)


def divergence_name(run_type: str) -> str:
    """Divergence a run type selects: the first known name it contains; plain ``kd`` is forward KL."""
    for name in NAMES:
        if name in run_type or (name == "fkl" and run_type == "kd"):
            return name
    raise NotImplementedError(f"no divergence in run type {run_type!r}")


def divergence(name: str, student: Column, teacher: Column, **weights: float) -> Column:
    """One per-position divergence by its name (``ALL``) or by the run type that contains it."""
    field = name if name in ALL else divergence_name(name)
    return divergences_arrow(student, teacher, **weights)[field]


def masked_mean(value: Column, label: Column) -> Column:
    """Mean over positions whose label is not ignored."""
    return F.avg(F.when(label != IGNORE, value))


def cross_entropy(logits: Column, other: Column, mask: Column | None = None) -> Column:
    """``-sum softmax(logits) * log_softmax(other)``; infinite entries contribute nothing."""

    def body(z: Column) -> Column:
        term = lambda a, b: F.when(
            ~(_infinite(a) | _infinite(b)), -(F.exp(a - z["a"]) * (b - z["b"]))
        ).otherwise(F.lit(0.0))
        return total(F.zip_with(logits, other, term))

    value = let(F.struct(log_sum_exp(logits).alias("a"), log_sum_exp(other).alias("b")), body)
    return value if mask is None else value * mask


def entropy(logits: Column, mask: Column | None = None) -> Column:
    return cross_entropy(logits, logits, mask)


def token_loss(logits: Column, label: Column) -> Column:
    """Negative log-likelihood of the label; null where the label is ignored."""
    return F.when(label != IGNORE, -token_logprob(logits, label))


def combined_loss(lm: Column, kd: Column, ratio: float, aux: Column | None = None, coef: float = 0.0) -> Column:
    loss = (1 - ratio) * lm + ratio * kd
    return loss if aux is None else loss + coef * aux
