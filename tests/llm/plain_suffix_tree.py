"""The probabilistic suffix tree as an automaton in one process: what the table of grams is tested with."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from panelstats.llm.suffix_tree_lm import DEPTH, DIVERGENCE, END, SIGNIFICANT, stream_of

STRETCH = 256


@dataclass
class Tree:
    symbol: np.ndarray  # of each byte
    next: np.ndarray  # (states, symbols)
    log_p: np.ndarray  # (states, symbols), log10 for one byte
    start: int
    depth: int


def build(contexts: dict[tuple[int, int], dict[int, int]], depth: int = DEPTH, divergence: float = DIVERGENCE,
          significant: float = SIGNIFICANT) -> Tree:
    """The tree as an automaton in one process, for small corpora; tests compare ``smoothed`` with it.
    Takes (length, context) -> {next byte: count}; (0, 0) is the root."""
    root = contexts.get((0, 0), {})
    seen = sorted(root)
    symbol = np.full(256, len(seen), np.int64)
    symbol[seen] = np.arange(len(seen))
    width = len(seen) + 1  # the last stands for any byte not seen
    size = np.ones(width)
    size[-1] = max(1, 256 - len(seen))

    def counts(key) -> np.ndarray:
        out = np.zeros(width)
        for b, n in contexts.get(key, {}).items():
            out[symbol[b]] += n
        return out

    suffix = lambda key: (key[0] - 1, key[1] & ((1 << (8 * (key[0] - 1))) - 1))  # noqa: E731  without its oldest byte
    prefix = lambda key: (key[0] - 1, key[1] >> 8)  # noqa: E731  without its newest byte
    smooth: dict[tuple[int, int], np.ndarray] = {}
    own = counts((0, 0))
    smooth[0, 0] = (own + 1) / (own.sum() + 256)  # one byte's probability, for bytes not seen too
    kept = set()
    for key in sorted(k for k in contexts if k[0] > 0):
        own = counts(key)
        shorter = key
        while True:
            shorter = suffix(shorter)
            if shorter in smooth:
                break
        base = smooth[shorter]
        total, kinds = own.sum(), (own > 0).sum()
        p = own / total
        on = own > 0
        if (p[on] * np.log(p[on] / base[on])).sum() >= max(divergence, significant / total):
            smooth[key] = (own + kinds * base) / (total + kinds)
            kept.add(key)
    states, todo = {(0, 0)}, list(kept)
    while todo:
        key = todo.pop()
        if key not in states:
            states.add(key)
            todo += [suffix(key), prefix(key)]
    order = sorted(states)
    number = {key: i for i, key in enumerate(order)}
    nxt, log_p = np.zeros((len(order), width), np.int32), np.empty((len(order), width))
    longer: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for key in order[1:]:
        longer.setdefault(prefix(key), []).append(key)
    for i, key in enumerate(order):
        if i:
            back = number[suffix(key)]
            nxt[i] = nxt[back]
            log_p[i] = np.log10(smooth[key]) if key in smooth else log_p[back]
        else:
            log_p[i] = np.log10(smooth[key])
        for child in longer.get(key, ()):
            nxt[i, symbol[child[1] & 255]] = number[child]
    state = 0
    for _ in range(depth):
        state = nxt[state, symbol[END]]
    return Tree(symbol, nxt, log_p, int(state), depth)


def log_probabilities(tree: Tree, docs: list[list[bytes]]) -> np.ndarray:
    """log10 probability of each document."""
    data, start, stop = stream_of(docs, tree.depth)
    if not len(docs):
        return np.zeros(0)
    sym = tree.symbol[data]
    rows = -(-len(sym) // STRETCH)
    pad = np.full(tree.depth, tree.symbol[END])
    sym = np.concatenate([pad, sym, np.full(rows * STRETCH - len(sym), tree.symbol[END])])
    lanes = np.lib.stride_tricks.sliding_window_view(sym, STRETCH + tree.depth)[::STRETCH].T.copy()
    width = tree.next.shape[1]
    flat_next, flat_p = tree.next.ravel(), tree.log_p.ravel()
    state = np.zeros(rows, np.int64)
    out = np.empty((STRETCH, rows))
    for t in range(STRETCH + tree.depth):
        at = state * width + lanes[t]
        if t >= tree.depth:
            flat_p.take(at, out=out[t - tree.depth])
        state = flat_next.take(at).astype(np.int64)
    per = out.T.ravel()[:len(data)]
    edges = np.stack([start, stop], 1).ravel()
    sums = np.add.reduceat(np.concatenate([per, [0.0]]), edges)[::2]
    return sums
