"""Best ROUGE-L and exact match among the texts of two blocks of a group, pairs that cannot win left out."""

from __future__ import annotations

from collections import Counter
from typing import Any, NamedTuple

import numpy as np

from corpusloom.functions.rouge import f_measure, lcs_length, word_pieces


class Peer(NamedTuple):
    block: int
    member: Any  # the first member that has the text
    shared: bool  # other members have it too
    text: str | None
    normal: str | None


def best_of_peers(peers: list[Peer], i: int, j: int, stem: bool) -> list[tuple[Any, float | None, float | None, int]]:
    """``member, exact match, ROUGE-L, pairs scored`` of every text that one member alone has, against the other block.

    The texts of a block are different; a text meets those of block ``j`` if it lies in block ``i`` and the other way round.
    """
    words = [word_pieces(p.text, stem) if p.text is not None else [] for p in peers]
    sizes = np.array([len(w) for w in words], np.int64)
    items, owner, bounds = _items(words)
    order = np.argsort(items, kind="stable")
    items_sorted, holders = items[order], owner[order]
    by_normal: dict[str, list[int]] = {}
    alone: dict[Any, list[int]] = {}  # texts of one member are no references of each other
    for at, p in enumerate(peers):
        if not p.shared:
            alone.setdefault(p.member, []).append(at)
        if p.normal is not None:
            by_normal.setdefault(p.normal, []).append(at)
    blocks = np.array([p.block for p in peers])
    present = np.array([p.text is not None for p in peers], bool)
    scored: dict[tuple[int, int], int] = {}
    out = []
    for at, p in enumerate(peers):
        if p.shared:
            continue
        if p.text is None:
            out.append((p.member, None, None, 0))
            continue
        wanted = present & (blocks == (j if p.block == i else i))
        wanted[alone[p.member]] = False
        if not wanted.any():
            out.append((p.member, None, None, 0))
            continue
        exact = float(any(wanted[k] for k in by_normal[p.normal]))
        mine = items[bounds[at] : bounds[at + 1]]
        first, last = np.searchsorted(items_sorted, mine, "left"), np.searchsorted(items_sorted, mine, "right")
        n = last - first
        hits = holders[np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)]
        most = np.where(wanted, np.bincount(hits, minlength=len(peers)), 0)
        total = sizes + sizes[at]
        best, best_total, winner, pairs = 0, 1, -1, 0
        likely = np.flatnonzero(most)
        for k in likely[np.argsort(-(most[likely] / total[likely]), kind="stable")].tolist():
            # The measure is 2 * common / total: compared as whole numbers.
            if int(most[k]) * best_total <= best * int(total[k]):
                break
            pair = (min(at, k), max(at, k))
            if pair not in scored:
                scored[pair] = len(words[at]) if words[at] == words[k] else lcs_length(words[at], words[k])
                pairs += 1
            if scored[pair] * best_total > best * int(total[k]):
                best, best_total, winner = scored[pair], int(total[k]), k
        out.append((p.member, exact, f_measure(best, len(words[at]), len(words[winner])) if winner >= 0 else 0.0, pairs))
    return out


def _items(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each (word, how often it came before in the text), so that shared numbers count shared words with repeats."""
    numbers: dict[tuple[str, int], int] = {}
    flat, owner, bounds = [], [], [0]
    for at, text in enumerate(words):
        for word, count in Counter(text).items():
            flat += [numbers.setdefault((word, k), len(numbers)) for k in range(count)]
        owner += [at] * (len(flat) - bounds[-1])
        bounds.append(len(flat))
    return np.array(flat, np.int64), np.array(owner, np.int64), np.array(bounds, np.int64)
