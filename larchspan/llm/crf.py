"""A linear-chain conditional random field in numpy: maximum-likelihood training and batched Viterbi decoding.

Sequences hold active feature numbers per position (a ragged list); emissions are sums of feature weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _table(sequences: list[list[list[int]]], labels: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and numbers of the active features, labels and mask, of the sequences as one table."""
    n, width = len(sequences), max(map(len, sequences))
    mask, gold = np.zeros((n, width), bool), np.zeros((n, width), np.int64)
    where, feats = [], []
    for i, (s, y) in enumerate(zip(sequences, labels, strict=True)):
        mask[i, : len(s)] = True
        gold[i, : len(s)] = y
        for t, f in enumerate(s):
            where += [i * width + t] * len(f)
            feats += f
    return np.array(where, np.int64), np.array(feats, np.int64), gold, mask


def _gradient(w: np.ndarray, move: np.ndarray, first: np.ndarray, where: np.ndarray, feats: np.ndarray, gold: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By forward and backward sums over the table of sequences."""
    (n, width), n_labels = mask.shape, len(first)
    last, one = mask.sum(1) - 1, np.eye(n_labels)
    emit = np.zeros((n * width, n_labels))
    for k in range(n_labels):
        emit[:, k] = np.bincount(where, weights=w[feats, k], minlength=n * width)
    emit = emit.reshape(n, width, n_labels)
    alpha = np.zeros_like(emit)
    alpha[:, 0] = emit[:, 0] + first
    for t in range(1, width):
        alpha[:, t] = _logsumexp(alpha[:, t - 1, :, None] + move, 1) + emit[:, t]
    beta = np.zeros_like(emit)
    for t in range(width - 2, -1, -1):
        back = _logsumexp(move + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where((t < last)[:, None], back, 0.0)
    z = _logsumexp(alpha[np.arange(n), last], 1)
    p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * mask[:, :, None]
    d_emit = (p - one[gold] * mask[:, :, None]).reshape(-1, n_labels)
    gw = np.stack([np.bincount(feats, weights=d_emit[where, k], minlength=len(w)) for k in range(n_labels)], 1)
    gm = np.zeros_like(move)
    for t in range(1, width):
        live = mask[:, t]
        if not live.any():
            break
        q = alpha[live, t - 1, :, None] + move + (emit[live, t] + beta[live, t])[:, None, :] - z[live, None, None]
        gm += np.exp(np.minimum(q, 0)).sum(0)
        np.add.at(gm, (gold[live, t - 1], gold[live, t]), -1)
    gb = d_emit.reshape(n, width, n_labels)[:, 0].sum(0)
    return gw / n, gm / n, gb / n


@dataclass
class ChainCRF:
    """weights (features, labels); moves (labels, labels), from row to column; first (labels,)."""

    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    @classmethod
    def train(cls, sequences: list[list[list[int]]], labels: list[list[int]], n_features: int, n_labels: int, epochs: int = 60, rate: float = 0.15, l2: float = 1e-3, forbidden: list[tuple[int, int]] = (), not_first: list[int] = ()) -> ChainCRF:
        """Full-batch Adam on the mean negative log-likelihood; deterministic.  `forbidden` moves never happen."""
        keep = [i for i, s in enumerate(sequences) if s]
        sequences, labels = [sequences[i] for i in keep], [labels[i] for i in keep]
        where, feats, gold, mask = _table(sequences, labels)
        ban, ban_first = np.zeros((n_labels, n_labels)), np.zeros(n_labels)
        for i, j in forbidden:
            ban[i, j] = -1e4
        ban_first[list(not_first)] = -1e4
        params = [np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, epochs + 1):
            w, m, b = params
            for p_, g, a, s in zip(params, _gradient(w, m + ban, b + ban_first, where, feats, gold, mask), mean, square, strict=True):
                g = g + l2 * p_
                a *= 0.9
                a += 0.1 * g
                s *= 0.99
                s += 0.01 * g * g
                p_ -= rate * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        w, m, b = params
        return cls(w, m + ban, b + ban_first)

    def gradient(self, sequences: list[list[list[int]]], labels: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the mean negative log-likelihood of (non-empty) labelled sequences, by weights, moves and first."""
        return _gradient(self.weights, self.moves, self.first, *_table(sequences, labels))

    def emissions(self, sequences: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of all positions one after another, and the sequences' lengths."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        counts = np.array([len(f) for s in sequences for f in s], np.int64)
        flat = np.fromiter((x for s in sequences for f in s for x in f), np.int64, int(counts.sum()))
        total = np.concatenate([np.zeros((1, self.weights.shape[1])), np.cumsum(self.weights[flat], axis=0)])
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts], lengths

    def viterbi(self, sequences: list[list[list[int]]], block: int = 1 << 20) -> list[np.ndarray]:
        """The best labels of each sequence.  Sequences of like length are decoded together, `block` cells at a time."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        k, at = self.weights.shape[1], 0
        while at < len(order):
            width = len(sequences[order[at]])
            if not width:
                at += 1
                continue
            take, stop = [], at
            while stop < len(order) and (len(take) + 1) * len(sequences[order[stop]]) * k <= max(block, len(sequences[order[stop]]) * k) and len(sequences[order[stop]]) <= 2 * width:
                take.append(order[stop])
                stop += 1
            at = stop
            emit, lengths = self.emissions([sequences[i] for i in take])
            n, width = len(take), int(lengths.max())
            starts = np.cumsum(lengths) - lengths
            score = emit[starts] + self.first
            back = np.zeros((width, n, k), np.int8 if k < 128 else np.int64)
            for t in range(1, width):
                live = lengths > t
                step = score[live, :, None] + self.moves
                back[t, live] = step.argmax(1)
                score[live] = step.max(1) + emit[starts[live] + t]
            best = score.argmax(1)
            path = np.zeros((width, n), np.int64)
            for t in range(width - 1, -1, -1):
                live = lengths - 1 > t
                if live.any():
                    path[t, live] = back[t + 1, live, path[t + 1, live]]
                at_end = lengths - 1 == t
                path[t, at_end] = best[at_end]
            for j, i in enumerate(take):
                out[i] = path[: lengths[j], j]
        return out
