"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels
from corpusloom.llm.common import text_or_empty

HIDDEN = 8
STEPS = 64  # bytes a window; the state starts anew in each
SAMPLE_DOCS = 512  # labelled documents per language that the network is fitted on, at most
SAMPLE_WINDOWS = 4  # windows taken from each of them
SAMPLE_ALL = 64 * SAMPLE_DOCS  # documents of all languages; with more languages each gives fewer, but LEAST_DOCS
LEAST_DOCS = 32
UNKNOWN = "und"
_COLUMNS = 4096


def _squash(a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """a / (1 + |a|) in place; ``size`` keeps 1 + |a|."""
    np.abs(a, out=size)
    size += 1
    a /= size
    return a


@dataclass
class Network:
    """Per direction a byte table and a recurrent matrix for gate and candidate; one output layer over both states.

    State: ``h += gate * (candidate - h)`` with ``gate = (1 + s) / 2`` and s, candidate squashed sums of the byte's row
    and the recurrent product.
    """

    langs: list[str]
    tables: np.ndarray  # direction, gate and candidate units, byte
    loops: np.ndarray  # direction, gate and candidate units, hidden
    out: np.ndarray  # language, both states
    bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls(langs, draw(2, 2 * hidden, 256, scale=0.5), draw(2, 2 * hidden, hidden, scale=0.5 / hidden**0.5),
                   draw(len(langs), 2 * hidden, scale=0.3), np.zeros((len(langs), 1), np.float32))

    def states(self, codes: np.ndarray, keep: bool = False) -> tuple[list[np.ndarray], list]:
        """Hidden states of both directions at every step: (step, hidden, window); what training needs if ``keep``."""
        steps, n = codes.shape
        hidden = self.loops.shape[2]
        out, kept = [], []
        for d in (0, 1):
            table, loop = self.tables[d], self.loops[d]
            h, a, size = np.zeros((hidden, n), np.float32), np.empty((2 * hidden, n), np.float32), np.empty((2 * hidden, n), np.float32)
            states, trail = np.empty((steps, hidden, n), np.float32), []
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.matmul(loop, h, out=a)
                a += table[:, codes[t]]
                _squash(a, size)
                gate, delta = a[:hidden], a[hidden:]
                gate *= 0.5
                gate += 0.5
                if keep:
                    trail.append((t, h.copy(), gate.copy(), delta.copy(), size.copy()))
                delta -= h
                delta *= gate
                h += delta
                states[t] = h
            out.append(states)
            kept.append(trail)
        return out, kept

    def logits(self, states: list[np.ndarray]) -> np.ndarray:
        hidden = states[0].shape[1]
        return np.matmul(self.out[:, :hidden], states[0]) + np.matmul(self.out[:, hidden:], states[1]) + self.bias

    def window_probabilities(self, codes: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Sum over the labelled positions of a window of their language probabilities: (language, window)."""
        p = self.logits(self.states(codes)[0])
        np.exp(np.minimum(p, 30, out=p), out=p)
        p /= p.sum(axis=1, keepdims=True)
        p *= held[:, None, :]
        return p.sum(axis=0)

    def gradients(self, codes: np.ndarray, held: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over labelled positions and its gradients, by backpropagation through time."""
        states, kept = self.states(codes, keep=True)
        hidden = states[0].shape[1]
        p = self.logits(states)
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        total = max(float(held.sum()), 1.0)
        columns = np.arange(codes.shape[1])
        loss = float(-(np.log(p[:, labels, columns] + 1e-9) * held).sum() / total)
        p[:, labels, columns] -= 1
        p *= held[:, None, :] / total
        g_out = np.concatenate([np.einsum("tln,thn->lh", p, s, optimize=True) for s in states], axis=1)
        g_bias = p.sum(axis=(0, 2))[:, None]
        g_tables, g_loops = np.zeros_like(self.tables), np.zeros_like(self.loops)
        for d in (0, 1):
            down = np.matmul(self.out[:, d * hidden : (d + 1) * hidden].T, p)
            back = np.zeros((hidden, codes.shape[1]), np.float32)
            rows = np.zeros((256, 2 * hidden), np.float32)
            for t, h, gate, candidate, size in reversed(kept[d]):
                back += down[t]
                sums = np.concatenate([0.5 * back * (candidate - h), back * gate])
                sums /= size * size
                g_loops[d] += sums @ h.T
                np.add.at(rows, codes[t], sums.T)
                back = back * (1 - gate) + self.loops[d].T @ sums
            g_tables[d] = rows.T
        return loss, [g_tables, g_loops, g_out, g_bias]


def fit(windows: list[bytes], labels: list[str], hidden: int = HIDDEN, rounds: int = 400, batch: int = 256, rate: float = 0.02, seed: int = 5) -> Network:
    """Adam on windows drawn evenly from the languages; those that do not fit a batch take turns, over more rounds."""
    langs = sorted(set(labels))
    net = Network.fresh(langs, hidden, seed)
    if len(langs) < 2:
        return net
    rng = np.random.default_rng(seed)
    codes, held = _windows_matrix(windows)
    number = np.searchsorted(np.array(langs, object), np.array(labels, object))
    of_lang = np.split(np.argsort(number, kind="stable"), np.cumsum(np.bincount(number, minlength=len(langs)))[:-1])
    params = [net.tables, net.loops, net.out, net.bias]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    share, turns = max(1, batch // len(langs)), -(-len(langs) // batch)
    rounds *= turns
    for step in range(1, rounds + 1):
        if (step - 1) % turns == 0:
            order = np.arange(len(langs)) if turns == 1 else rng.permutation(len(langs))
        now_on = order[(step - 1) % turns :: turns]
        pick = np.concatenate([rng.choice(of_lang[i], share) for i in now_on])
        _, grads = net.gradients(codes[:, pick], held[:, pick], np.repeat(now_on, share))
        now = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def _windows_matrix(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.full((STEPS, len(windows)), 32, np.uint8)
    held = np.zeros((STEPS, len(windows)), np.float32)
    for i, w in enumerate(windows):
        w = w[:STEPS]
        codes[: len(w), i] = np.frombuffer(w, np.uint8)
        held[: len(w), i] = 1
    return codes, held


def document_probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean over all positions of a text of their probabilities: (text, language); zero for empty texts."""
    sizes = np.diff(offsets)
    windows = -(-sizes // STEPS)
    owner = np.repeat(np.arange(len(sizes)), windows)
    first = np.cumsum(windows) - windows
    starts = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * STEPS
    ends = offsets[1:][owner]
    sums = np.zeros((len(sizes), len(net.langs)))
    columns = max(1, min(_COLUMNS, _COLUMNS * 64 // max(len(net.langs), 1)))
    for a in range(0, len(starts), columns):
        at = starts[None, a : a + columns] + np.arange(STEPS)[:, None]
        held = at < ends[None, a : a + columns]
        codes = data[np.where(held, at, 0)]
        codes[~held] = 32
        p = net.window_probabilities(codes, held.astype(np.float32)).T
        np.add.at(sums, owner[a : a + columns], p)
    return sums / np.maximum(sizes, 1)[:, None]


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[bytes], list[str]]:
    """Windows and labels of a sample of every language: the documents of lowest digest of id and text, at most SAMPLE_DOCS of each."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col).cast("string")).alias("h"))
    rows = rows.where("lang is not null and length(text) > 0")
    order = F.pmod("h", F.lit(1 << 30))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(order).alias("first")).collect()  # one row a language
    if not sizes:
        return [], []
    most = max(LEAST_DOCS, min(SAMPLE_DOCS, SAMPLE_ALL // len(sizes)))
    # About twice the wanted number per language, and the lowest always, passes a threshold on the digest; the driver keeps the lowest.
    limits = docs.sparkSession.createDataFrame([(r["lang"], max(int(min(1.0, 2 * most / r["n"]) * (1 << 30)), r["first"] + 1)) for r in sizes], "lang string, below long")
    rows = rows.join(F.broadcast(limits), "lang")
    place = lambda i: F.pmod(F.xxhash64("h", F.lit(i)), F.greatest(F.length("text") - STEPS // 2, F.lit(1))) + 1
    # Repeated rows have one digest and count once; only windows are shuffled for that.
    cut = rows.where(order < F.col("below")).select("lang", order.alias("o"), "h", F.array(*[F.substring("text", place(i).cast("int"), F.lit(STEPS)) for i in range(SAMPLE_WINDOWS)]).alias("w")).dropDuplicates(["lang", "h"])
    windows, labels, taken = [], [], {}
    for r in sorted(cut.collect(), key=lambda r: (r.lang, r.o, r.h, r.w)):
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= most:
            windows += [w.encode()[:STEPS] for w in r.w]
            labels += [r.lang] * len(r.w)
    return windows, labels


def identify(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rounds: int = 400, hidden: int = HIDDEN,
) -> DataFrame:
    """``id, lang_pred, score`` of every whole text.

    The network learns every language, from a sample (at most ``SAMPLE_DOCS`` documents of each) of the rows for which
    ``train`` is true and the language is not null; prediction sees the text alone. Every byte gets language probabilities from the
    states of both directions; a document takes their mean, the language with the highest (ties: first by name) and that
    value as score. Null texts and texts without a letter are ``und`` with score 0, as is everything if no language
    was learned. Rows are judged one by one: repeated rows and null ids get the verdict of their text.
    """
    windows, labels = training_sample(docs.where(train), id_col, text_col, lang_col)
    net = fit(windows, labels, hidden, rounds) if labels else None
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"), text_or_empty(text_col).rlike(r"\p{L}").alias("_l"))
    kind = rows.schema["_id"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernels.text_bytes(batch.column(1))
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in kernels.text_batches(data, offsets, 1 << 21):
                if net is None:
                    names, score = [UNKNOWN] * (b - a), np.zeros(b - a)
                else:
                    p = document_probabilities(net, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    best = p.argmax(axis=1)
                    names = [net.langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letters[a:b].tolist(), strict=True)]
                    score = np.where(letters[a:b], np.clip(p.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["_id", "lang_pred", "score"])

    return rows.mapInArrow(label, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)
