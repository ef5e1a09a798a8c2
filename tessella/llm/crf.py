"""A small linear-chain conditional random field over binary features, trained and decoded with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class ChainField:
    """weights: features x tags; moves: tags x tags."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each sequence of feature rows; sequences of one length are decoded together."""
        out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(sequences)
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(sequences):
            by_length.setdefault(len(s), []).append(i)
        for n, group in by_length.items():
            if not n:
                continue
            scores = np.stack([sequences[i] for i in group]).astype(np.float64) @ self.weights
            best, back = scores[:, 0], []
            for k in range(1, n):
                step = best[:, :, None] + self.moves[None]
                back.append(step.argmax(axis=1))
                best = step.max(axis=1) + scores[:, k]
            tags = np.empty((len(group), n), dtype=np.int64)
            tags[:, -1] = best.argmax(axis=1)
            for k in range(n - 2, -1, -1):
                tags[:, k] = back[k][np.arange(len(group)), tags[:, k + 1]]
            for i, t in zip(group, tags, strict=True):
                out[i] = t
        return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(sequences: list[np.ndarray], tags: list[np.ndarray], n_tags: int, rounds: int = 250, rate: float = 0.5, penalty: float = 1e-4) -> ChainField:
    """Maximum likelihood with an L2 penalty by AdaGrad. Equal sequences are one, weighted by the root of their number."""
    width = sequences[0].shape[1]
    w, m = np.zeros((width, n_tags)), np.zeros((n_tags, n_tags))
    gw, gm = np.full_like(w, 1e-8), np.full_like(m, 1e-8)
    counts: dict[tuple[int, bytes, bytes], int] = {}
    for s, y in zip(sequences, tags, strict=True):
        if len(s):
            key = (len(s), s.astype(np.float32).tobytes(), y.astype(np.int64).tobytes())
            counts[key] = counts.get(key, 0) + 1
    groups: dict[int, list[tuple[int, bytes, bytes]]] = {}
    for key in sorted(counts):
        groups.setdefault(key[0], []).append(key)
    packed = [
        (
            np.stack([np.frombuffer(k[1], dtype=np.float32).reshape(n, width) for k in g]).astype(np.float64),
            np.stack([np.frombuffer(k[2], dtype=np.int64) for k in g]),
            np.sqrt(np.array([counts[k] for k in g], dtype=np.float64)),
        )
        for n, g in groups.items()
    ]
    total = max(1.0, sum(c.sum() for _, _, c in packed))
    for _ in range(rounds):
        dw, dm = penalty * w, penalty * m
        for x, y, c in packed:
            scores = x @ w
            b, n, _ = scores.shape
            ahead, behind = np.empty_like(scores), np.zeros_like(scores)
            ahead[:, 0] = scores[:, 0]
            for k in range(1, n):
                ahead[:, k] = _logsumexp(ahead[:, k - 1][:, :, None] + m[None], 1) + scores[:, k]
            for k in range(n - 2, -1, -1):
                behind[:, k] = _logsumexp(m[None] + (scores[:, k + 1] + behind[:, k + 1])[:, None, :], 2)
            z = _logsumexp(ahead[:, -1], 1)
            mass = np.exp(ahead + behind - z[:, None, None])
            mass[np.arange(b)[:, None], np.arange(n)[None], y] -= 1
            mass *= c[:, None, None]
            dw += np.einsum("bnf,bnt->ft", x, mass) / total
            for k in range(1, n):
                pair = np.exp(ahead[:, k - 1][:, :, None] + m[None] + (scores[:, k] + behind[:, k])[:, None, :] - z[:, None, None])
                dm += (pair * c[:, None, None]).sum(axis=0) / total
                np.subtract.at(dm, (y[:, k - 1], y[:, k]), c / total)
        gw += dw**2
        gm += dm**2
        w -= rate * dw / np.sqrt(gw)
        m -= rate * dm / np.sqrt(gm)
    return ChainField(w, m)
