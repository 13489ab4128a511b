"""A linear-chain conditional random field over blocks: two labels, binary features, Viterbi decoding."""

from __future__ import annotations

import numpy as np


class Crf:
    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.names, self.weights, self.steps = names, weights, steps

    def ids(self, features: list[str]) -> list[int]:
        return [self.names[f] for f in features if f in self.names]

    def scores(self, blocks: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[i].sum(axis=0) for i in blocks])

    def decode(self, features: list[list[str]]) -> list[int]:
        """The most probable labels of a page's blocks."""
        if not features:
            return []
        scores = self.scores([self.ids(f) for f in features]).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b = scores[0]
        back = []
        for u, v in scores[1:]:
            from_a = (a + s00 >= b + s10, a + s01 >= b + s11)
            back.append(from_a)
            a, b = u + (a + s00 if from_a[0] else b + s10), v + (a + s01 if from_a[1] else b + s11)
        out = [int(b > a)]
        for from_a in reversed(back):
            out.append(0 if from_a[out[-1]] else 1)
        return out[::-1]


def gradient(crf: Crf, blocks: list[list[int]], labels: list[int]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood of a page's labels, features in use, its gradient by their weights, by the steps)."""
    node, n = crf.scores(blocks), len(blocks)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = node[0]
    for t in range(1, n):
        ahead[t] = node[t] + np.logaddexp(ahead[t - 1, 0] + crf.steps[0], ahead[t - 1, 1] + crf.steps[1])
    for t in range(n - 2, -1, -1):
        behind[t] = np.logaddexp(crf.steps[:, 0] + node[t + 1, 0] + behind[t + 1, 0], crf.steps[:, 1] + node[t + 1, 1] + behind[t + 1, 1])
    whole = np.logaddexp(*ahead[-1])
    prob = np.exp(ahead + behind - whole)
    y = np.asarray(labels)
    of_steps = np.zeros((2, 2))
    np.add.at(of_steps, (y[:-1], y[1:]), 1.0)
    value = float(node[np.arange(n), y].sum() + (crf.steps * of_steps).sum() - whole)
    if n > 1:
        of_steps -= np.exp(ahead[:-1, :, None] + crf.steps + (node + behind)[1:, None, :] - whole).sum(axis=0)
    used, where = np.unique(np.concatenate([np.asarray(b) for b in blocks]), return_inverse=True)
    of_weights = np.zeros((len(used), 2))
    np.add.at(of_weights, where, (np.eye(2)[y] - prob)[np.repeat(np.arange(n), [len(b) for b in blocks])])
    return value, used, of_weights, of_steps


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 10, rate: float = 0.3, l2: float = 1e-4, seed: int = 3) -> Crf:
    """Maximise the regularised conditional likelihood by Adagrad over pages of (features per block, labels)."""
    names: dict[str, int] = {}
    coded = [([[names.setdefault(f, len(names)) for f in b] for b in blocks], labels) for blocks, labels in pages if blocks]
    crf = Crf(names, np.zeros((len(names), 2)), np.zeros((2, 2)))
    seen_w, seen_s = np.full((len(names), 2), 1e-6), np.full((2, 2), 1e-6)
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for p in rng.permutation(len(coded)):
            _, used, grad, grad_s = gradient(crf, *coded[p])
            grad -= l2 * crf.weights[used]
            seen_w[used] += grad**2
            crf.weights[used] += rate * grad / np.sqrt(seen_w[used])
            seen_s += grad_s**2
            crf.steps += rate * grad_s / np.sqrt(seen_s)
    return crf
