"""Boosting of small one-layer networks, for tasks that each fit one model."""

from __future__ import annotations

import numpy as np


class Net:
    """One hidden layer, fitted by full-batch Adam on squared error with decay."""

    def __init__(self, hidden: int, activation: str, decay: float, rounds: int, seed: int):
        self.hidden, self.activation, self.decay, self.rounds, self.seed = hidden, activation, decay, rounds, seed

    def act(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.activation == "tanh":
            a = np.tanh(z)
            return a, 1 - a * a
        if self.activation == "relu":
            return np.maximum(z, 0), (z > 0).astype(float)
        return z, np.ones_like(z)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Net:
        rng = np.random.default_rng(self.seed)
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, 1 / np.sqrt(self.hidden), self.hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for t in range(1, self.rounds + 1):
            a, slope = self.act(x @ w[0] + w[1])
            e = (a @ w[2] + w[3] - y) / len(y)
            back = np.outer(e, w[2]) * slope
            g = [x.T @ back + self.decay * w[0] / len(y), back.sum(0), a.T @ e + self.decay * w[2] / len(y), np.array([e.sum()])]
            for i in range(4):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g[i], 0.999 * v[i] + 0.001 * g[i] ** 2
                w[i] = w[i] - 0.05 * m[i] / (1 - 0.9**t) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.w = w
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.act(x @ self.w[0] + self.w[1])[0] @ self.w[2] + self.w[3]


class NeuralBoosted:
    """Networks added one by one to what is left of y, until a held-back part stops improving. As a classifier (two classes 0 and 1) on the logit."""

    def __init__(self, n: int = 50, rate: float = 0.1, hidden: int = 3, activation: str = "tanh", decay: float = 1e-4, rounds: int = 100, patience: int = 10, held: float = 0.15, classify: bool = False, seed: int = 42):
        self.n, self.rate, self.patience, self.held, self.classify, self.seed = n, rate, patience, held, classify, seed
        self.net = (hidden, activation, decay, rounds)

    def fit(self, x: np.ndarray, y: np.ndarray) -> NeuralBoosted:
        self.mean, self.sd = x.mean(0), np.where(x.std(0) == 0, 1, x.std(0))
        z = (x - self.mean) / self.sd
        held = np.random.default_rng(self.seed).permutation(len(y)) < max(1, int(self.held * len(y)))
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if self.classify else 0.0
        self.start = float(np.log(share / (1 - share))) if self.classify else float(y[~held].mean())
        f, self.nets, best, since = np.full(len(y), self.start), [], np.inf, 0
        for k in range(self.n):
            left = y - 1 / (1 + np.exp(-f)) if self.classify else y - f
            self.nets.append(Net(*self.net, self.seed + k).fit(z[~held], left[~held]))
            f = f + self.rate * self.nets[-1].predict(z) * (4 if self.classify else 1)
            p = np.clip(1 / (1 + np.exp(-f[held])), 1e-9, 1 - 1e-9)
            loss = -(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean() if self.classify else ((y - f)[held] ** 2).mean()
            if loss < best - 1e-9:
                best, since, keep = loss, 0, k + 1
            elif (since := since + 1) >= self.patience:
                break
        self.nets = self.nets[:keep]
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.sd
        return self.start + self.rate * (4 if self.classify else 1) * sum((n.predict(z) for n in self.nets), np.zeros(len(x)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = self.decision(x)
        return (f > 0).astype(int) if self.classify else f

    def importances(self) -> np.ndarray:
        w = np.mean([np.abs(n.w[0]).mean(1) for n in self.nets], axis=0)
        return w / w.sum()
