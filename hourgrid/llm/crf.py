"""A linear-chain conditional random field over sparse features, trained and decoded in numpy batches."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np

#: Positions (sequences times their common padded length) decoded at once.
BATCH_POSITIONS = 1 << 14


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@dataclass
class Chain:
    """``index`` numbers the features seen in training; ``weight`` is (features + 1, tags), its last row is
    zero and stands for padding and unseen features; ``step`` is (tags, tags), ``begin`` (tags)."""

    tags: list[str]
    index: dict[str, int]
    weight: np.ndarray
    step: np.ndarray
    begin: np.ndarray

    def _emissions(self, sequences: list[list[list[str]]]) -> np.ndarray:
        width = max(len(f) for s in sequences for f in s)
        ids = np.full((len(sequences), max(map(len, sequences)), width), len(self.index))
        for i, s in enumerate(sequences):
            for t, features in enumerate(s):
                ids[i, t, : len(features)] = [self.index.get(f, len(self.index)) for f in features]
        return ids

    def decode(self, sequences: list[list[list[str]]]) -> list[np.ndarray]:
        """The best tag numbers of every sequence (Viterbi); sequences of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if s), key=lambda i: len(sequences[i]))
        while order:
            count = max(1, BATCH_POSITIONS // len(sequences[order[-1]]))
            batch, order = order[-count:], order[:-count]
            ids = self._emissions([sequences[i] for i in batch])
            for i, path in zip(batch, self._best([len(sequences[i]) for i in batch], self.weight[ids].sum(2))):
                out[i] = path
        return out

    def _best(self, lengths: list[int], emission: np.ndarray) -> list[np.ndarray]:
        rows, steps, tags = emission.shape
        last = np.array(lengths) - 1
        score = self.begin + emission[:, 0]
        back = np.zeros((steps, rows, tags), np.int16)
        for t in range(1, steps):
            ways = score[:, :, None] + self.step
            back[t] = ways.argmax(1)
            new = ways.max(1) + emission[:, t]
            score = np.where((t <= last)[:, None], new, score)
        path = np.zeros((rows, steps), np.int64)
        tag = score.argmax(1)
        for t in range(steps - 1, -1, -1):
            path[:, t] = tag
            if t:
                tag = np.where(t <= last, back[t][np.arange(rows), tag], tag)
        return [p[:n] for p, n in zip(path, lengths)]


def train(sequences: list[list[list[str]]], labels: list[list[str]], tags: list[str], rounds: int = 80, rate: float = 0.2, penalty: float = 1e-3) -> Chain:
    """Weights of the highest conditional likelihood (full-batch AdaGrad with an L2 penalty).  An empty table
    gives a model that answers the first tag everywhere."""
    index: dict[str, int] = defaultdict(lambda: len(index))
    for s in sequences:
        for features in s:
            for f in features:
                index[f]
    n = len(tags)
    chain = Chain(tags, dict(index), np.zeros((len(index) + 1, n)), np.zeros((n, n)), np.zeros(n))
    if not sequences:
        chain.begin[0] = 1.0
        chain.step[:, 0] = 1.0
        return chain
    ids = chain._emissions(sequences)
    rows, steps = ids.shape[:2]
    length = np.array([len(s) for s in sequences])
    number = {t: i for i, t in enumerate(tags)}
    gold = np.zeros((rows, steps), np.int64)
    for i, y in enumerate(labels):
        gold[i, : len(y)] = [number[t] for t in y]
    live = np.arange(steps) < length[:, None]
    onehot = np.eye(n)[gold] * live[:, :, None]
    gold_step = np.einsum("rta,rtb->ab", onehot[:, :-1], onehot[:, 1:])
    history = [np.full_like(w, 1e-8) for w in (chain.weight, chain.step, chain.begin)]
    for _ in range(rounds):
        emission = chain.weight[ids].sum(2)
        forward = np.zeros((rows, steps, n))
        forward[:, 0] = chain.begin + emission[:, 0]
        for t in range(1, steps):
            new = _logsumexp(forward[:, t - 1, :, None] + chain.step, 1) + emission[:, t]
            forward[:, t] = np.where(live[:, t, None], new, forward[:, t - 1])
        total = _logsumexp(forward[np.arange(rows), length - 1], 1)
        backward = np.zeros((rows, steps, n))
        for t in range(steps - 2, -1, -1):
            new = _logsumexp(chain.step + (emission[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(live[:, t + 1, None], new, 0)
        tag = np.exp(forward + backward - total[:, None, None]) * live[:, :, None]
        expected_step = np.zeros((n, n))
        for t in range(1, steps):
            way = forward[:, t - 1, :, None] + chain.step + (emission[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
            expected_step += (np.exp(way) * live[:, t, None, None]).sum(0)
        difference = (onehot - tag).reshape(-1, n)
        weight = np.zeros_like(chain.weight)
        for k in range(ids.shape[2]):
            np.add.at(weight, ids[:, :, k].ravel(), difference)
        weight[-1] = 0
        steps_up = (weight, gold_step - expected_step, onehot[:, 0].sum(0) - tag[:, 0].sum(0))
        for w, up, h in zip((chain.weight, chain.step, chain.begin), steps_up, history):
            up = up - penalty * rows * w
            h += up * up
            w += rate * up / np.sqrt(h)
    chain.weight[-1] = 0
    return chain
